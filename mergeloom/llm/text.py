"""Text as numpy arrays straight from Arrow buffers, and word hashing over them.

Every operator here reads whole texts.  A record batch is cut into slices of
about `SLICE_BYTES` of text so that temporary arrays stay small; a text longer
than that is a slice of its own.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
MULT = 1099511628211
SPREAD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

LARGE_TABLE = 1 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc

_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)


def give_back() -> None:
    """Hand what this worker has freed back to the system; allocators would keep it, also while the worker idles."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(run: Callable) -> Callable:
    """A function of batches that gives freed memory back after each batch and at its end."""

    def each(batches):
        for batch in batches:
            yield batch
            del batch
            give_back()

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(each(batches))
        finally:
            give_back()

    return tidied


def tidy_table(run: Callable) -> Callable:
    """A function of a table that gives freed memory back if the table isn't small."""

    @functools.wraps(run)
    def tidied(table):
        large = table.nbytes >= LARGE_TABLE
        out = run(table)
        del table
        if large:
            give_back()
        return out

    return tidied


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT**i and MULT**-i modulo 2**64 for i in 0..n."""
    global _POW, _INV
    if len(_POW) <= n:
        size = 1 << max(16, int(n).bit_length())
        base = np.full(size, MULT, dtype=np.uint64)
        base[0] = 1
        _POW = np.cumprod(base, dtype=np.uint64)
        back = np.full(size, pow(MULT, -1, 1 << 64), dtype=np.uint64)
        back[0] = 1
        _INV = np.cumprod(back, dtype=np.uint64)
    return _POW, _INV


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, at, body = col.buffers()
    offsets = np.frombuffer(at, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if at is not None and len(col) else np.zeros(len(col) + 1, dtype=np.int64)
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `limit` bytes of text."""
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True


def words(data: np.ndarray, offsets: np.ndarray, alnum: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of words, and first[i] the index of row i's first word.

    With `alnum`, words are runs of ASCII letters and digits and of bytes from 128
    on; without, runs of anything but ASCII white space.
    """
    inside = _ALNUM[data] if alnum else ~_SPACE[data]
    begin = np.zeros(len(data) + 1, dtype=bool)
    begin[:-1] = inside
    begin[1:-1] &= ~inside[:-1]
    finish = np.zeros(len(data) + 1, dtype=bool)
    finish[1:] = inside
    finish[1:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    both = cuts[inside[cuts - 1] & inside[cuts]]
    begin[both] = True
    finish[both] = True
    start, end = np.flatnonzero(begin), np.flatnonzero(finish)
    return start, end, np.searchsorted(start, offsets)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of byte spans: h = h * MULT + byte + 1, modulo 2**64."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse[: len(data)], out=sums[1:])
    return (sums[end] - sums[start]) * power[end - 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i] : bounds[i+1]], empty spans included."""
    at = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=at[1:])
    return at[bounds[1:]] - at[bounds[:-1]]
