"""Column functions of a tokenizer: split, encode, count, decode and the raw forms.

Splitting is a JVM regular expression.  Merging runs in Arrow UDFs that look at
each distinct piece of a batch once and gather the rest with numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.kernels import Vocabulary
from mergeloom.functions.patterns import CL, NAMED
from mergeloom.functions.pieces import BY_JAVA, SLICE, WORKER_ENTRIES, PieceEncoder, pack_lists, sliced
from mergeloom.sources.ranks import DEFAULT_RANKS, load_vocabulary

IDS = "array<int>"


def gather_lists(starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Concatenate values[starts[i] : starts[i] + sizes[i]] for all i."""
    total = int(sizes.sum())
    if not total:
        return values[:0]
    jump = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return values[jump + np.arange(total)]


def piece_table(flat: pa.Array, vocab: Vocabulary):
    """(index of each piece among the distinct ones, starts, sizes, ids of the distinct ones, unknown)."""
    coded = flat.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ids: list[int] = []
    starts, sizes, unknown = [], [], []
    for piece in coded.dictionary.cast(pa.binary()).to_pylist():
        got = vocab.encode_memo(piece)
        starts.append(len(ids))
        unknown.append(got is None)
        if got is not None:
            ids.extend(got)
        sizes.append(0 if got is None else len(got))
    as_int = lambda x: np.array(x, dtype=np.int64)
    return index, as_int(starts), as_int(sizes), np.array(ids, dtype=np.int32), np.array(unknown, dtype=bool)


def list_bounds(lists: pa.Array) -> np.ndarray:
    """Offsets of a list array into its `flatten()`; null lists are empty there."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate(([0], np.cumsum(sizes)))


def _plain(lists):
    return lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists


def encode_lists(lists: pa.Array, vocab: Vocabulary) -> pa.Array:
    lists = _plain(lists)
    bounds = list_bounds(lists)
    index, starts, sizes, ids, unknown = piece_table(lists.flatten(), vocab)
    per = sizes[index]
    at = np.concatenate(([0], np.cumsum(per)))
    null = lists.is_null().to_numpy(zero_copy_only=False)
    if unknown.any():
        bad = np.concatenate(([0], np.cumsum(unknown[index])))
        null = null | (bad[bounds[1:]] > bad[bounds[:-1]])
    out = gather_lists(starts[index], per, ids)
    offsets = pa.array(at[bounds].astype(np.int32), mask=np.append(null, False))
    return pa.ListArray.from_arrays(offsets, pa.array(out, pa.int32()))


def count_lists(lists: pa.Array, vocab: Vocabulary) -> pa.Array:
    lists = _plain(lists)
    bounds = list_bounds(lists)
    index, _, sizes, _, unknown = piece_table(lists.flatten(), vocab)
    at = np.concatenate(([0], np.cumsum(sizes[index])))
    null = lists.is_null().to_numpy(zero_copy_only=False)
    if unknown.any():
        bad = np.concatenate(([0], np.cumsum(unknown[index])))
        null = null | (bad[bounds[1:]] > bad[bounds[:-1]])
    return pa.array((at[bounds[1:]] - at[bounds[:-1]]).astype(np.int32), mask=null)


def _mapped(values: pa.Array, one, kind: pa.DataType) -> pa.Array:
    return pa.array([None if v is None else one(v) for v in values.to_pylist()], kind)


_ENCODERS: dict[tuple, PieceEncoder] = {}
_TOKENS: dict[int, tuple] = {}
DECODED = 1 << 16  # ids that are decoded at once


def worker_tokens(vocab: Vocabulary) -> pa.Array:
    """All tokens' bytes, made once a worker."""
    if id(vocab) not in _TOKENS:
        _TOKENS[id(vocab)] = (pa.array(vocab.tokens, pa.binary()), vocab)
    return _TOKENS[id(vocab)][0]


def decode_lists(lists: pa.Array, tokens: pa.Array) -> pa.Array:
    """Concatenated tokens of each list of ids; null if one is unknown. Taken in runs of rows of about `DECODED` ids."""
    at = list_bounds(lists)
    parts, i = [], 0
    while i < len(lists):
        j = max(i + 1, int(np.searchsorted(at, at[i] + DECODED, "right")) - 1)
        some, bounds = lists.slice(i, j - i), at[i : j + 1] - at[i]
        flat = some.flatten()
        bad = pc.or_kleene(pc.less(flat, 0), pc.greater_equal(flat, len(tokens))).fill_null(True)
        seen = np.concatenate(([0], np.cumsum(bad.to_numpy(zero_copy_only=False))))
        null = some.is_null().to_numpy(zero_copy_only=False) | (seen[bounds[1:]] > seen[bounds[:-1]])
        got = tokens.take(pc.if_else(bad, None, flat))
        _, ends, data = got.buffers()
        ends = np.frombuffer(ends, dtype=np.int32)[got.offset :][bounds] if len(got) else np.zeros(len(bounds), dtype=np.int32)
        mask = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
        parts.append(pa.Array.from_buffers(pa.binary(), j - i, [mask, pa.py_buffer(ends.tobytes()), data or pa.py_buffer(b"")]))
        i = j
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def worker_encoder(vocab: Vocabulary, pattern: str) -> PieceEncoder:
    """The worker's memoising encoder of a complete vocabulary under a named pattern."""
    key = (id(vocab), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(vocab.encode_short, BY_JAVA[pattern], WORKER_ENTRIES)
    return _ENCODERS[key]


class Tokenizer:
    """A vocabulary and a split pattern (None: the whole text is one piece).

    Nulls give nulls; "" gives [] or 0; a byte that an incomplete vocabulary lacks
    gives null.
    """

    def __init__(self, spark: SparkSession, vocab: Vocabulary, pattern: str | None = CL):
        if not isinstance(vocab, Vocabulary):
            raise TypeError("a Tokenizer needs a Vocabulary")
        self.spark, self.vocab = spark, vocab
        self.pattern = NAMED.get(pattern, pattern) if pattern else None
        self._shared = spark.sparkContext.broadcast(vocab)

    @classmethod
    def load(cls, spark: SparkSession, path: str = DEFAULT_RANKS, pattern: str | None = CL, strict: bool = True) -> "Tokenizer":
        return cls(spark, load_vocabulary(spark, path, strict), pattern)

    def without_pattern(self) -> "Tokenizer":
        """The raw view: same vocabulary, no splitting."""
        return Tokenizer(self.spark, self.vocab, None)

    # -- splitting ---------------------------------------------------------

    def split(self, text: Column | str) -> Column:
        """Pieces in order; they concatenate to the text."""
        col = F.col(text) if isinstance(text, str) else text
        if self.pattern is None:
            return F.when(col.isNull(), F.lit(None)).when(col == "", F.array().cast("array<string>")).otherwise(F.array(col))
        return F.regexp_extract_all(col, F.lit(self.pattern), F.lit(0))

    # -- text --------------------------------------------------------------

    @property
    def _direct(self) -> bool:
        """Whether texts go to the worker whole: named patterns, complete vocabularies."""
        return self.pattern in BY_JAVA and self.vocab.strict

    def encode(self, text: Column | str) -> Column:
        if not self._direct:
            return self.encode_pieces(self.split(text))
        shared, pattern = self._shared, self.pattern

        @F.arrow_udf(IDS)
        def encode_text(texts: pa.Array) -> pa.Array:
            one = worker_encoder(shared.value, pattern).text
            parts = [pack_lists([None if t is None else one(t) for t in texts.slice(i, SLICE).to_pylist()]) for i in range(0, len(texts), SLICE)]
            return pa.concat_arrays(parts) if parts else pack_lists([])

        return encode_text(F.col(text) if isinstance(text, str) else text)

    def encode_pieces(self, pieces: Column) -> Column:
        shared = self._shared

        @F.arrow_udf(IDS)
        def encode_split(lists: pa.Array) -> pa.Array:
            return encode_lists(lists, shared.value)

        return encode_split(pieces)

    def count(self, text: Column | str) -> Column:
        shared, pattern = self._shared, self.pattern
        if self._direct:

            @F.arrow_udf("int")
            def count_text(texts: pa.Array) -> pa.Array:
                one = worker_encoder(shared.value, pattern).text
                return sliced(texts, lambda t: len(one(t)) >> 2, pa.int32())

            return count_text(F.col(text) if isinstance(text, str) else text)

        @F.arrow_udf("int")
        def count_split(lists: pa.Array) -> pa.Array:
            return count_lists(lists, shared.value)

        return count_split(self.split(text))

    def count_till_limit(self, text: Column | str, limit: int) -> Column:
        """The count if it is at most the limit, else null.

        Rows that the piece or byte count already decides reach the UDF as null.
        """
        if limit < 0:
            raise ValueError("limit must not be negative")
        col = F.col(text) if isinstance(text, str) else text
        shared, top, pattern = self._shared, self.vocab.max_len, self.pattern
        if self._direct:

            @F.arrow_udf("int")
            def count_within(texts: pa.Array) -> pa.Array:
                one = worker_encoder(shared.value, pattern).count_within
                return sliced(texts, lambda t: one(t, limit), pa.int32())

            return count_within(F.when(F.octet_length(col) <= limit * top, col))
        pieces = self.split(col)

        @F.arrow_udf("int")
        def count_some(lists: pa.Array) -> pa.Array:
            return count_lists(lists, shared.value)

        undecided = (F.octet_length(col) <= limit * top) & (F.size(pieces) <= limit)
        n = count_some(F.when(undecided, pieces))
        return F.when(n <= limit, n)

    def decode(self, ids: Column | str) -> Column:
        """Text of the ids; null if one is unknown or the bytes aren't UTF-8."""
        return F.try_validate_utf8(self.decode_bytes(ids).cast("string"))

    def decode_bytes(self, ids: Column | str) -> Column:
        shared = self._shared

        @F.arrow_udf("binary")
        def join_bytes(lists: pa.Array) -> pa.Array:
            return decode_lists(_plain(lists), worker_tokens(shared.value))

        return join_bytes(F.col(ids) if isinstance(ids, str) else ids)

    # -- raw bytes ---------------------------------------------------------

    def raw(self, data: Column | str, method: str = "merge") -> Column:
        """Encode bytes without splitting: merge, heap, table, greedy, minimal or prefixes."""
        names = {"merge": "encode", "heap": "encode_heap", "table": "encode_table", "greedy": "encode_greedy", "minimal": "encode_minimal", "prefixes": "prefix_tokens", "prefix_counts": "prefix_counts"}
        if method not in names:
            raise ValueError(f"method must be one of {sorted(names)}")
        shared, name = self._shared, names[method]

        @F.arrow_udf(IDS)
        def encode_raw(values: pa.Array) -> pa.Array:
            return _mapped(values, getattr(shared.value, name), pa.list_(pa.int32()))

        return encode_raw(_binary(data))

    def count_raw(self, data: Column | str, limit: int | None = None) -> Column:
        """Token count of unsplit bytes; with a limit, null beyond it."""
        if limit is not None and limit < 0:
            raise ValueError("limit must not be negative")
        shared = self._shared

        def one(data: bytes):
            if limit is not None:
                return shared.value.count_within(data, limit)
            ids = shared.value.encode(data)
            return None if ids is None else len(ids)

        @F.arrow_udf("int")
        def count_unsplit(values: pa.Array) -> pa.Array:
            return _mapped(values, one, pa.int32())

        return count_unsplit(_binary(data))

    def valid_pair(self, left: Column, right: Column) -> Column:
        """Whether the right id may follow the left one in an encoding."""
        shared = self._shared

        @F.arrow_udf("boolean")
        def follows(a: pa.Array, b: pa.Array) -> pa.Array:
            n = len(shared.value)
            known = lambda x: x is not None and 0 <= x < n
            return pa.array([shared.value.valid_pair(x, y) if known(x) and known(y) else None for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())

        return follows(left, right)

    def register(self, prefix: str = "bpe") -> None:
        """SQL functions: {prefix}_encode_pieces and {prefix}_count_pieces of split texts, {prefix}_decode.

        Without a pattern, or with a named one and a complete vocabulary, also
        {prefix}_encode and {prefix}_count of texts.
        """
        shared, pattern = self._shared, self.pattern
        direct = self._direct

        def ids(vocab, texts: pa.Array) -> list[bytes | None]:
            if direct:
                one = worker_encoder(vocab, pattern).text
            else:
                def one(t):
                    got = vocab.encode(t.encode())
                    return None if got is None else np.array(got, dtype=np.int32).tobytes()
            return [None if t is None else one(t) for t in texts.to_pylist()]

        @F.arrow_udf(IDS)
        def encode_text(texts: pa.Array) -> pa.Array:
            return pack_lists(ids(shared.value, texts))

        @F.arrow_udf("int")
        def count_text(texts: pa.Array) -> pa.Array:
            return pa.array([None if p is None else len(p) >> 2 for p in ids(shared.value, texts)], pa.int32())

        if direct or pattern is None:
            self.spark.udf.register(f"{prefix}_encode", encode_text)
            self.spark.udf.register(f"{prefix}_count", count_text)

        @F.arrow_udf(IDS)
        def encode_split(lists: pa.Array) -> pa.Array:
            return encode_lists(lists, shared.value)

        @F.arrow_udf("int")
        def count_split(lists: pa.Array) -> pa.Array:
            return count_lists(lists, shared.value)

        @F.arrow_udf("string")
        def decode_ids(lists: pa.Array) -> pa.Array:
            def one(ids):
                got = shared.value.decode(ids)
                try:
                    return None if got is None else got.decode()
                except UnicodeDecodeError:
                    return None

            return _mapped(lists, one, pa.string())

        self.spark.udf.register(f"{prefix}_encode_pieces", encode_split)
        self.spark.udf.register(f"{prefix}_count_pieces", count_split)
        self.spark.udf.register(f"{prefix}_decode", decode_ids)


def _binary(data: Column | str) -> Column:
    return (F.col(data) if isinstance(data, str) else data).cast("binary")
