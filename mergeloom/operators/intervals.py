"""Token counts of byte ranges, as if each range were encoded alone (no pattern).

The last tokens of all prefixes form a tree (the parent of an end is where its last
token begins).  Walking back from the range's end by these tokens reaches a place
where a token boundary of the range's own encoding is met; only the part before it
needs encoding.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from mergeloom.functions.columns import Tokenizer, _binary
from mergeloom.functions.kernels import Vocabulary


class IntervalIndex:
    """Prefix tree of one text: `depth[p]` tokens encode the first p bytes."""

    def __init__(self, vocab: Vocabulary, data: bytes):
        self.vocab, self.data = vocab, data
        self.last = vocab.prefix_tokens(data)
        if self.last is None:
            raise ValueError("a byte of the text isn't in the vocabulary")
        self.depth = [0]
        for end, t in enumerate(self.last, 1):
            self.depth.append(self.depth[end - len(vocab.tokens[t])] + 1)

    def count(self, start: int, end: int) -> int:
        """Tokens of data[start:end]."""
        if not 0 <= start <= end <= len(self.data):
            raise ValueError("range outside the text")
        if start == 0:
            return self.depth[end]
        # encode from `start` until a prefix ends in the same token as the whole text's does there
        vocab, own, counts = self.vocab, [], [0]
        ends = {}
        p = end
        while p > start:
            ends[p] = self.last[p - 1]
            p -= len(vocab.tokens[self.last[p - 1]])
        for stop in range(start + 1, end + 1):
            for t in vocab.ending_at(self.data[start:stop], stop - start):
                at = stop - start - len(vocab.tokens[t])
                if at == 0 or vocab.valid_pair(own[at - 1], t):
                    own.append(t)
                    counts.append(counts[at] + 1)
                    break
            if ends.get(stop) == own[-1]:
                # from here on both encodings append the same tokens
                return counts[-1] + self.depth[end] - self.depth[stop]
        return counts[-1]


def count_range(tok: Tokenizer, data: Column | str, start: Column, end: Column) -> Column:
    """Tokens of data[start:end] in bytes; null for null input or a range outside the data."""
    shared = tok._shared

    @F.arrow_udf("int")
    def count(values: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        vocab, kept, index, out = shared.value, None, None, []
        for v, a, b in zip(values.to_pylist(), starts.to_pylist(), ends.to_pylist()):
            if v is None or a is None or b is None or not 0 <= a <= b <= len(v):
                out.append(None)
                continue
            if v != kept:
                try:
                    kept, index = v, IntervalIndex(vocab, v)
                except ValueError:
                    kept, index = v, None
            out.append(None if index is None else index.count(a, b))
        return pa.array(out, pa.int32())

    return count(_binary(data), start.cast("int"), end.cast("int"))
