"""Token counts of texts that grow at their end or their front (no pattern).

Appending needs the last token and count of the last `max_len` prefixes and as many
bytes, whatever the length so far.  Counts aren't additive over the parts, so windows
of sums can't give them.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.functions.columns import Tokenizer
from mergeloom.functions.kernels import Vocabulary
from mergeloom.functions.pieces import SLICE, WORKER_ENTRIES, Memo


class Appender:
    """Counts while bytes are appended; keeps a bounded tail unless `whole` asks for truncation."""

    def __init__(self, vocab: Vocabulary, whole: bool = False):
        self.vocab, self.whole = vocab, whole
        self.data, self.last, self.counts, self.dropped = b"", [], [0], 0

    def extend(self, data: bytes) -> "Appender":
        vocab = self.vocab
        for byte in data:
            self.data += bytes((byte,))
            end = len(self.data)
            for t in vocab.ending_at(self.data, end):
                at = end - len(vocab.tokens[t])
                if at + self.dropped == 0 or (at > 0 and vocab.valid_pair(self.last[at - 1], t)):
                    self.last.append(t)
                    self.counts.append(self.counts[at] + 1)
                    break
            else:
                raise ValueError("a byte isn't in the vocabulary")
            if not self.whole and end > 4 * vocab.max_len:
                cut = end - vocab.max_len - 1
                self.data, self.last, self.counts, self.dropped = self.data[cut:], self.last[cut:], self.counts[cut:], self.dropped + cut
        return self

    def truncate(self, length: int) -> "Appender":
        """Keep the first `length` bytes; needs `whole` beyond the kept tail."""
        keep = length - self.dropped
        if keep < 0 or (keep == 0 and self.dropped):
            raise ValueError("the prefix isn't kept; use whole=True")
        if keep < len(self.data):
            self.data, self.last, self.counts = self.data[:keep], self.last[:keep], self.counts[: keep + 1]
        return self

    @property
    def token_count(self) -> int:
        return self.counts[-1]

    def __len__(self) -> int:
        return self.dropped + len(self.data)

    def state(self) -> tuple[bytes, list[int], list[int], int]:
        return self.data, self.last, self.counts, self.dropped

    @classmethod
    def restore(cls, vocab: Vocabulary, state) -> "Appender":
        out = cls(vocab)
        out.data, out.last, out.counts, out.dropped = bytes(state[0]), list(state[1]), list(state[2]), int(state[3])
        return out


class Prepender:
    """Counts while bytes are put before the front: extend(b"abc") spells b"cba"."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.data, self.counts, self.first = vocab, bytearray(), [0], []

    def extend(self, data: bytes) -> "Prepender":
        """`data` byte by byte to the front; tokens of a suffix follow its first token."""
        vocab = self.vocab
        for byte in data:
            self.data.append(byte)  # kept back to front
            n = len(self.data)
            text = bytes(self.data[: -vocab.max_len - 1 : -1])
            for k in range(min(vocab.max_len, n), 0, -1):
                t = vocab.ranks.get(text[:k])
                if t is not None and (k == n or vocab.valid_pair(t, self.first[n - k - 1])):
                    self.first.append(t)
                    self.counts.append(self.counts[n - k] + 1)
                    break
            else:
                raise ValueError("a byte isn't in the vocabulary")
        return self

    def truncate(self, length: int) -> "Prepender":
        """Drop the front-most bytes until `length` are left."""
        del self.data[length:], self.first[length:], self.counts[length + 1 :]
        return self

    @property
    def token_count(self) -> int:
        return self.counts[-1]

    def __len__(self) -> int:
        return len(self.data)


class _Chunks(Memo):
    """chunk -> its ids, unsplit."""

    entries = WORKER_ENTRIES

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def make(self, chunk: str) -> tuple[int, ...]:
        ids = self.vocab.encode(chunk.encode("utf-8", "surrogatepass"))
        if ids is None:
            raise ValueError("a byte isn't in the vocabulary")
        return tuple(ids)


class Grown:
    """Ids of a text that grows at either end by whole texts.

    A text is cut before each blank and a chunk is encoded once a worker.  Where two
    chunks meet, tokens stay if the right one may follow the left one; else as many
    beside the seam are encoded again as it takes.
    """

    def __init__(self, vocab: Vocabulary, chunks: Memo):
        self.vocab, self.chunks = vocab, chunks
        self.ids: deque[int] = deque()
        self.text = ""  # kept only where seams can't be told
        self.n_bytes = 0

    def append(self, text: str) -> "Grown":
        return self._grow(text, False)

    def prepend(self, text: str) -> "Grown":
        return self._grow(text, True)

    @property
    def token_count(self) -> int:
        return len(self.ids)

    def _grow(self, text: str, front: bool) -> "Grown":
        self.n_bytes += len(text.encode("utf-8", "surrogatepass"))
        if not self.vocab.linked:
            self.text = text + self.text if front else self.text + text
            self.ids = deque(self.chunks.make(self.text))
            return self
        head, *parts = text.split(" ")
        known, ids, follows, size = self.chunks, self.ids, self.vocab.follows, len(self.vocab)
        if front:
            for p in reversed(parts):
                self._meet(known[" " + p], True)
            self._meet(known[head], True)
            return self
        self._meet(known[head], False)
        for p in parts:
            more = known[" " + p]
            if ids and follows[ids[-1] * size + more[0]]:
                ids.extend(more)
            else:
                self._meet(more, False)
        return self

    def _meet(self, more: tuple[int, ...], front: bool) -> None:
        ids, vocab = self.ids, self.vocab
        if not ids or not more:
            ids.extend(more)
            return
        left, right = (more, ids) if front else (ids, more)
        a = b = 0  # tokens encoded again, on the left and on the right
        mid: list[int] = []
        while True:
            # what stands left and right of the seam that may still be wrong
            ok_left = vocab.valid_pair(left[-a - 1], mid[0] if mid else right[0]) if a < len(left) else True
            ok_right = vocab.valid_pair(mid[-1], right[b]) if mid and b < len(right) else True
            if ok_left and ok_right:
                break
            a = a if ok_left and mid else min(len(left), max(1, 2 * a))
            b = b if ok_right and mid else min(len(right), max(1, 2 * b))
            tokens = [left[-i] for i in range(a, 0, -1)] + [right[i] for i in range(b)]
            mid = vocab.encode(b"".join(vocab.tokens[t] for t in tokens))
        if front:
            for _ in range(b):
                ids.popleft()
            ids.extendleft(reversed(mid))
            ids.extendleft(more[i] for i in range(len(more) - a - 1, -1, -1))
        else:
            for _ in range(a):
                ids.pop()
            ids.extend(mid)
            ids.extend(more[b:])


_CHUNKS: dict[int, _Chunks] = {}


def _worker_chunks(vocab: Vocabulary) -> _Chunks:
    """The worker's memo of chunks."""
    if id(vocab) not in _CHUNKS:
        _CHUNKS[id(vocab)] = _Chunks(vocab)
    return _CHUNKS[id(vocab)]


def _grown_counts(tok: Tokenizer, df: DataFrame, key: str, order: str, text: str, front: bool) -> DataFrame:
    shared = tok._shared

    def run(rows: pa.Table) -> pa.Table:
        by = pc.sort_indices(rows, [("_order", "ascending"), ("_text", "ascending")], null_placement="at_start")
        rows = rows.take(by)
        grown, sizes, counts = Grown(shared.value, _worker_chunks(shared.value)), [], []
        grow = grown.prepend if front else grown.append
        for batch in rows.column("_text").chunks:
            for i in range(0, len(batch), SLICE):
                for t in batch.slice(i, SLICE).to_pylist():
                    if t:
                        grow(t)
                    sizes.append(grown.n_bytes)
                    counts.append(grown.token_count)
        return pa.table([rows.column("_key"), rows.column("_order"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[key, order, "n_bytes", "n_tokens"])

    types = dict(df.dtypes)
    rows = df.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col(text).cast("string").alias("_text"))
    return rows.groupBy("_key").applyInArrow(run, f"`{key}` {types[key]}, `{order}` {types[order]}, n_bytes bigint, n_tokens bigint")


def append_counts(tok: Tokenizer, df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, order, n_bytes, n_tokens): after each row of a key, of all its texts so far, concatenated.

    Rows of a key are taken by `order`, ties by text; null texts add nothing; rows with
    a null key are one group.
    """
    return _grown_counts(tok, df, key, order, text, False)


def prepend_counts(tok: Tokenizer, df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Like `append_counts`, each text put before those taken already."""
    return _grown_counts(tok, df, key, order, text, True)
