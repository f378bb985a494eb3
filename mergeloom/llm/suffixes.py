"""Suffix arrays by external induced sorting.

The text is a sequence of runs of equal symbols.  Runs that are local minima seed the
order; runs above their successor ("larger" type) are induced from it in ascending
order of symbols, runs below it ("smaller" type) in descending order.  Tuples (run,
order of its successor) wait in a priority queue whose keys are ranges of symbols:
one bucket a range, spooled to files beyond a memory limit, popped whole and sorted
at once.  Ranks of minima come from the same induction by names, recursively as long
as names repeat.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs

BUCKET_RUNS = 1 << 16
MEMORY = 256 << 10


class BucketQueue:
    """Priority queue of (run, order) tuples by symbol range; buckets beyond `memory` bytes lie in files.

    `folder` is a path or URI that the executor can write; None keeps all in memory.
    """

    def __init__(self, buckets: int, folder: str | None, memory: int):
        self.waiting: list[list[np.ndarray]] = [[] for _ in range(buckets)]
        self.files: list[list[str]] = [[] for _ in range(buckets)]
        self.held, self.memory, self.store, self.base = 0, memory, None, None
        if folder is not None:
            self.store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
            self.base = f"{base.rstrip('/')}/mergeloom-queue-{uuid.uuid4().hex}"

    def push(self, bucket: np.ndarray, run: np.ndarray, order: np.ndarray) -> None:
        if not len(bucket):
            return
        by = np.argsort(bucket, kind="stable")
        bucket, pairs = bucket[by], np.stack((run[by], order[by]))
        heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(heads, np.r_[heads[1:], len(bucket)]):
            self.waiting[bucket[a]].append(pairs[:, a:b])
        self.held += pairs.nbytes
        if self.store is not None and self.held > self.memory:
            self.spool()

    def spool(self) -> None:
        """Write what waits, the largest buckets first, until half the memory is free."""
        sizes = [sum(x.nbytes for x in w) for w in self.waiting]
        self.store.create_dir(self.base, recursive=True)
        for k in np.argsort(sizes)[::-1]:
            if self.held <= self.memory // 2 or not sizes[k]:
                break
            path = f"{self.base}/{k}-{len(self.files[k])}"
            with self.store.open_output_stream(path) as out:
                out.write(np.ascontiguousarray(np.concatenate(self.waiting[k], axis=1)).tobytes())
            self.files[k].append(path)
            self.waiting[k] = []
            self.held -= sizes[k]

    def pop(self, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of a bucket."""
        parts = self.waiting[bucket]
        self.held -= sum(x.nbytes for x in parts)
        self.waiting[bucket] = []
        for path in self.files[bucket]:
            with self.store.open_input_stream(path) as f:
                parts.append(np.frombuffer(f.read(), dtype=np.int64).reshape(2, -1))
            self.store.delete_file(path)
        self.files[bucket] = []
        run, order = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), dtype=np.int64)
        return run, order

    def close(self) -> None:
        if self.store is not None and self.store.get_file_info(self.base).type == fs.FileType.Directory:
            self.store.delete_dir(self.base)


def _dense(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorting order, rank of each item with ties) by keys, the first the major one."""
    spans = [(int(k.min()), int(k.max())) if len(k) else (0, 0) for k in keys]
    bits = [int(hi - lo).bit_length() for lo, hi in spans]
    if sum(bits) <= 63:
        packed = np.zeros(len(keys[0]), dtype=np.int64)
        for k, (lo, _), b in zip(keys, spans, bits):
            packed = packed << b | (k - lo)
        by = np.argsort(packed)
        new = packed[by][1:] != packed[by][:-1]
    else:
        by = np.lexsort(keys[::-1])
        new = np.zeros(max(0, len(by) - 1), dtype=bool)
        for k in keys:
            new |= k[by][1:] != k[by][:-1]
    rank = np.empty(len(by), dtype=np.int64)
    rank[by] = np.concatenate((np.zeros(min(1, len(by)), dtype=np.int64), np.cumsum(new)))
    return by, rank


class _Runs:
    def __init__(self, text: np.ndarray):
        self.start = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        self.symbol = text[self.start]
        self.length = np.diff(np.r_[self.start, len(text)])
        n = len(self.start)
        self.smaller = np.ones(n, dtype=bool)
        self.smaller[:-1] = self.symbol[:-1] < self.symbol[1:]
        self.minimum = self.smaller.copy()
        self.minimum[0] = False
        self.minimum[1:] &= self.symbol[:-1] > self.symbol[1:]
        cuts = max(1, min(512, n // BUCKET_RUNS))
        edges = np.unique(np.sort(self.symbol)[np.linspace(0, n - 1, cuts + 1).astype(np.int64)[1:-1]]) if cuts > 1 else np.zeros(0, dtype=text.dtype)
        self.bucket = np.searchsorted(edges, self.symbol, side="right")
        self.buckets = len(edges) + 1


def _pass(runs: _Runs, fixed: np.ndarray, minor: np.ndarray, wanted: np.ndarray, down: bool, folder, memory) -> np.ndarray:
    """Order (with ties) of the fixed and the wanted runs, induced in the order of symbols.

    `fixed` runs are ordered among their symbol by `minor`; `wanted` ones by length and
    successor.  Ascending, larger runs are wanted; descending (`down`), smaller ones.
    """
    order = np.full(len(runs.start), -1, dtype=np.int64)
    queue = BucketQueue(runs.buckets, folder, memory)
    by_bucket = np.argsort(runs.bucket[fixed], kind="stable")
    fixed = fixed[by_bucket]
    bounds = np.searchsorted(runs.bucket[fixed], np.arange(runs.buckets + 1))
    sign = -1 if down else 1
    placed = len(runs.start) + 1 if down else 0
    for b in range(runs.buckets - 1, -1, -1) if down else range(runs.buckets):
        still = fixed[bounds[b] : bounds[b + 1]]
        run, after = queue.pop(b)
        # runs of this range whose successor is of it too: induced in rounds
        inner = [np.zeros(0, dtype=np.int64)]
        reach = np.concatenate((still, run))
        while len(reach):
            before = reach[reach > 0] - 1
            before = before[wanted[before] & (runs.bucket[before] == b)]
            inner.append(before)
            reach = before
        inside = np.concatenate(inner)
        items = np.concatenate((still, run, inside))
        if not len(items):
            continue
        kind = runs.smaller[items].astype(np.int64)
        first = np.concatenate((minor[still], sign * runs.length[run], sign * runs.length[inside]))
        second = np.concatenate((np.zeros(len(still), dtype=np.int64), after, np.zeros(len(inside), dtype=np.int64)))
        symbol = runs.symbol[items]
        # fixed and wanted runs of a symbol differ in kind, except for minima while ascending
        base = second.max(initial=0) + 1
        low = len(still) + len(run)
        by, rank = _dense(symbol * 2 + kind, first, second)
        if len(inside):
            spot = np.argsort(items)
            at = spot[np.searchsorted(items[spot], inside + 1)]
            while True:
                # successors outside this range lie before it ascending, behind it descending
                second[low:] = (-len(items) * 2 + rank[at]) if down else base + rank[at]
                by, fresh = _dense(symbol * 2 + kind, first, second)
                if np.array_equal(fresh, rank):
                    break
                rank = fresh
        size = int(rank.max()) + 1
        if down:
            placed -= size
            order[items] = placed + rank
        else:
            order[items] = placed + rank
            placed += size
        before = items[items > 0] - 1
        go = wanted[before] & (runs.bucket[before] != b)
        before = before[go]
        queue.push(runs.bucket[before], before, order[before + 1])
    queue.close()
    return order


def _induce(runs: _Runs, seed: np.ndarray, folder, memory) -> np.ndarray:
    """Order of all runs from the ranks of the minima (`seed`, by run)."""
    minima = np.flatnonzero(runs.minimum)
    larger = ~runs.smaller
    up = _pass(runs, minima, seed, larger, False, folder, memory)
    return _pass(runs, np.flatnonzero(larger), up, runs.smaller, True, folder, memory)


def _order_runs(text: np.ndarray, folder, memory) -> tuple[_Runs, np.ndarray]:
    runs = _Runs(text)
    n = len(runs.start)
    if n == 1:
        return runs, np.zeros(1, dtype=np.int64)
    minima = np.flatnonzero(runs.minimum)
    order = _induce(runs, np.zeros(n, dtype=np.int64), folder, memory)
    _, names = np.unique(order[minima], return_inverse=True)
    if int(names.max()) + 1 < len(minima):
        ranks = np.empty(len(minima), dtype=np.int64)
        ranks[_suffixes(names, folder, memory)] = np.arange(len(minima))
        names = ranks
    seed = np.zeros(n, dtype=np.int64)
    seed[minima] = names
    order = _induce(runs, seed, folder, memory)
    return runs, order


def _suffixes(text: np.ndarray, folder, memory) -> np.ndarray:
    """Suffix array of a text whose last symbol is its only smallest one."""
    runs, order = _order_runs(text, folder, memory)
    if len(runs.start) == len(text):
        return np.argsort(order)
    run = np.repeat(np.arange(len(runs.start)), runs.length)
    left = runs.start[run] + runs.length[run] - np.arange(len(text))
    smaller = runs.smaller[run]
    after = np.append(order, 0)[run + 1]
    by, _ = _dense(text * 2 + smaller, np.where(smaller, -left, left), after)
    return by


def suffix_array(text: np.ndarray, folder: str | None = None, memory: int = MEMORY) -> np.ndarray:
    """Positions of all suffixes of a sequence of integers in lexicographic order; a prefix comes first."""
    text = np.asarray(text)
    if not len(text):
        return np.zeros(0, dtype=np.int64)
    _, dense = np.unique(text, return_inverse=True)
    return _suffixes(np.append(dense.astype(np.int64) + 1, 0), folder, memory)[1:]


def common_prefixes(text: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix in `array` (sorted ones, perhaps not all) with the one before it, counted up to `most`."""
    n = len(text)
    out = np.zeros(len(array), dtype=np.int32)
    live = np.arange(1, len(array))
    a, b = array[:-1].astype(np.int64), array[1:].astype(np.int64)
    for k in range(most):
        inside = np.maximum(a, b) + k < n
        live, a, b = live[inside], a[inside], b[inside]
        same = text[a + k] == text[b + k]
        live, a, b = live[same], a[same], b[same]
        if not len(live):
            break
        out[live] = k + 1
    return out
