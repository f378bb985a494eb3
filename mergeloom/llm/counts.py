"""Operator 6: token counts with a whole-token shortcut.

Offline, every vocabulary string that encodes alone as one token is proved to do
so (by encoding it); a pre-token among those counts as 1 without merging, and only
the rest is merged.  The distinct pre-tokens of a slice of texts are merged side by
side in arrays, one merge of each a round; nothing is kept from slice to slice, so a
worker's memory doesn't follow the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.columns import gather_lists
from mergeloom.functions.kernels import Vocabulary
from mergeloom.functions.pieces import CL, ENDS
from mergeloom.llm.text import slices, text_buffers, tidy
from mergeloom.sources.ranks import DEFAULT_RANKS, load_vocabulary

#: Stands for a chunk that can't be counted alone.
ALONE = -1
COUNTED_BYTES = 1 << 22
#: Bytes that are merged side by side, and those of the longest piece among them.
MERGED_BYTES = 1 << 17
SHORT = 48
NEVER = 1 << 60
_HERE: dict[int, "TokenCounter"] = {}
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ENDS]] = True


def prove_whole(vocab: Vocabulary) -> frozenset[str]:
    """Strings of the vocabulary that encode alone as exactly their own token."""
    whole = []
    for i, token in enumerate(vocab.tokens):
        try:
            piece = token.decode()
        except UnicodeDecodeError:
            continue
        if vocab.encode(token) == [i]:
            whole.append(piece)
    return frozenset(whole)


class PairTable:
    """(left id, right id) -> id of their concatenation, for arrays of pairs; ids up to the number of tokens, which stands for none."""

    def __init__(self, vocab: Vocabulary):
        ranks, self.base = vocab.ranks, len(vocab) + 1
        found = [(ranks[t[:k]] * self.base + ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs, merged = np.array(found, dtype=np.int64).reshape(-1, 2).T
        self.shift = np.uint64(64 - max(8, (2 * len(pairs)).bit_length()))
        slot = self.slot(pairs)
        self.pairs = np.full(1 << (64 - int(self.shift)), -1, dtype=np.int64)
        self.merged = np.full(len(self.pairs), -1, dtype=np.int64)
        at, first = np.unique(slot, return_index=True)
        self.pairs[at], self.merged[at] = pairs[first], merged[first]
        # pairs whose slot is taken are looked up in order
        rest = np.setdiff1d(np.arange(len(pairs)), first)
        rest = rest[np.argsort(pairs[rest])]
        self.other, self.other_merged = pairs[rest], merged[rest]
        self.shared = np.zeros(len(self.pairs), dtype=bool)
        self.shared[slot[rest]] = True

    def slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids, -1 where the concatenation is no token."""
        pairs = left * self.base + right
        slot = self.slot(pairs)
        same = self.pairs[slot] == pairs
        out = np.where(same, self.merged[slot], -1)
        again = np.flatnonzero(~same & self.shared[slot])
        if len(again):
            at = np.minimum(np.searchsorted(self.other, pairs[again]), len(self.other) - 1)
            out[again] = np.where(self.other[at] == pairs[again], self.other_merged[at], -1)
        return out


class TokenCounter:
    """Counts of whole texts; built on the driver, one instance a process."""

    def __init__(self, vocab: Vocabulary, whole: frozenset[str], pattern=CL):
        self.vocab, self.whole, self.pattern = vocab, whole, pattern
        self.proved = pa.array([w.encode() for w in whole], pa.binary())
        self.bytes = np.array([vocab.ranks[bytes((i,))] for i in range(256)], dtype=np.int64)
        self.table = PairTable(vocab)

    def __reduce__(self):
        return _restore, (self.vocab, self.whole)

    def counted(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens of every piece data[bounds[i] : bounds[i + 1]]; pieces must not be empty."""
        out = np.ones(len(bounds) - 1, dtype=np.int64)
        pieces = pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
        rest = np.flatnonzero(~pc.is_in(pieces, value_set=self.proved).to_numpy(zero_copy_only=False))
        size = np.diff(bounds)[rest]
        for i in rest[size > SHORT].tolist():
            out[i] = len(self.vocab.encode(pieces[i].as_py()))
        rest, size = rest[size <= SHORT], size[size <= SHORT]
        by = np.argsort(size, kind="stable")  # pieces of like length need as many rounds
        rest, size = rest[by], size[by]
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // MERGED_BYTES)) + 1
        for part, n in zip(np.split(rest, cuts), np.split(size, cuts)):
            if len(part):
                out[part] = self.merged(gather_lists(bounds[part], n, data), n)
        return out

    def merged(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens left of short pieces, given one behind the other, after all merges, lowest rank first, leftmost on ties.

        A place for each byte and one without a token behind each piece; a place costs
        (id of it and its successor, where it lies in its piece) as one number.
        """
        none, find = len(self.vocab), self.table.find
        head = np.cumsum(size + 1) - size
        ids = np.full(int((size + 1).sum()) + 1, none, dtype=np.int64)
        ids[np.arange(len(data)) + np.repeat(np.arange(len(size)), size) + 1] = self.bytes[data]
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        place = np.zeros(n, dtype=np.int64)
        place[1:] = np.arange(n - 1) - np.repeat(head - 1, size + 1)
        cost = np.full(n, NEVER, dtype=np.int64)
        first = find(ids[:-1], ids[1:])
        cost[:-1] = np.where(first < 0, NEVER, first << 6 | place[:-1])
        left = size.copy()
        at = np.arange(len(head))
        while len(head):
            # what lies between heads has no cost left
            least = np.minimum.reduceat(cost, head)
            live = least < NEVER
            if not live.all():
                head, least, at = head[live], least[live], at[live]
                if not len(head):
                    break
            left[at] -= 1
            i, token = head + (least & 63), least >> 6
            j = after[i]
            k, h = after[j], before[i]
            ids[i], after[i], before[k], cost[j] = token, k, i, NEVER
            got = find(np.concatenate((token, ids[h])), np.concatenate((ids[k], token)))
            got = np.where(got < 0, NEVER, got << 6 | place[np.concatenate((i, h))])
            cost[i], cost[h] = got[: len(i)], got[len(i) :]
        return left

    def listed(self, pieces: list[str]) -> np.ndarray:
        """Tokens of every piece of a list."""
        out = np.ones(len(pieces), dtype=np.int64)
        rest = [i for i, p in enumerate(pieces) if p not in self.whole]
        if rest:
            data = [pieces[i].encode("utf-8", "surrogatepass") for i in rest]
            bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, data), dtype=np.int64, count=len(data)))))
            out[rest] = self.counted(np.frombuffer(b"".join(data), dtype=np.uint8), bounds)
        return out

    def pieces(self, text: str) -> int:
        return int(self.listed(self.pattern.findall(text)).sum())

    def count(self, text: str) -> int:
        return self.column(pa.array([text], pa.string()))[0].as_py()

    def chunks(self, chunks: pa.Array, lead: str) -> np.ndarray:
        """Counts of `lead` + chunk of every chunk between blanks, `ALONE` where it may not be taken alone."""
        data, bounds = text_buffers(chunks)
        size = np.diff(bounds)
        other = np.concatenate(([0], np.cumsum(~_LETTER[data])))
        other = other[bounds[1:]] - other[bounds[:-1]]
        last = data[np.maximum(bounds[1:] - 1, 0)] if len(data) else np.zeros(len(size), dtype=np.uint8)
        ended = (other == 1) & (size > 1) & _END[last]
        plain = np.flatnonzero((other == 0) & (size > 0) | ended)
        out = np.zeros(len(chunks), dtype=np.int64)
        if len(plain):  # letters, with a mark behind that is a token: no pattern is needed
            n = size[plain] - ended[plain]
            ends = np.concatenate(([0], np.cumsum(n + len(lead))))
            body = np.full(int(ends[-1]), 32, dtype=np.uint8)
            body[np.arange(int(n.sum())) + len(lead) * np.repeat(np.arange(1, len(n) + 1), n)] = gather_lists(bounds[plain], n, data)
            out[plain] = self.counted(body, ends) + ended[plain]
        rest = np.setdiff1d(np.arange(len(chunks)), plain)
        pieces: list[str] = []
        owner: list[int] = []
        for i, chunk in zip(rest.tolist(), chunks.take(pa.array(rest)).to_numpy(zero_copy_only=False).tolist()):
            if chunk.isalpha():
                found = [lead + chunk]
            elif chunk[-1:] in ENDS and chunk[:-1].isalpha():
                found = [lead + chunk[:-1], chunk[-1]]
            elif not chunk and not lead:
                continue
            elif not chunk or chunk[0].isspace() or chunk[-1].isspace():
                out[i] = ALONE
                continue
            else:
                found = self.pattern.findall(lead + chunk)
            pieces += found
            owner += [i] * len(found)
        np.add.at(out, np.array(owner, dtype=np.int64), self.listed(pieces))
        return out

    def column(self, texts: pa.Array) -> pa.Array:
        """Counts of a column: every distinct chunk of it is counted once."""
        filled = texts.fill_null("")
        if not len(filled):
            return pa.array([], pa.int64())
        lists = pc.split_pattern(filled, pattern=" ")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        heads = np.cumsum(sizes) - sizes
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        n = self.chunks(coded.dictionary, " ")[coded.indices.to_numpy()]
        first = flat.take(pa.array(heads)).dictionary_encode()
        n[heads] = self.chunks(first.dictionary, "")[first.indices.to_numpy()]
        alone = n < 0
        n[alone] = 0
        out = np.add.reduceat(n, heads)
        for i in np.flatnonzero(np.logical_or.reduceat(alone, heads)).tolist():
            out[i] = self.pieces(filled[i].as_py())
        return pa.array(out, pa.int64(), mask=texts.is_null().to_numpy(zero_copy_only=False))


def _restore(vocab, whole) -> TokenCounter:
    key = hash(vocab.tokens)
    if key not in _HERE:
        _HERE[key] = TokenCounter(vocab, whole)
    return _HERE[key]


def share_counter(spark: SparkSession, ranks: str = DEFAULT_RANKS):
    vocab = load_vocabulary(spark, ranks)
    return spark.sparkContext.broadcast(TokenCounter(vocab, prove_whole(vocab)))


def count_documents(spark: SparkSession, docs: DataFrame, ranks: str = DEFAULT_RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row: exact byte-pair token counts.

    A null text gives a null count, "" gives 0; repeated rows and null ids are
    counted like any other row, other columns are not read.
    """
    shared = share_counter(spark, ranks)

    @tidy
    def run(batches):
        count = shared.value.column
        for batch in batches:
            for part in slices(batch, limit=COUNTED_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), count(part.column(1))], ["doc_id", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint")
