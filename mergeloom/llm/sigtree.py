"""Signature trees: exact set-similarity joins of blocks of documents.

A node holds the OR of its documents' token bitmaps, the range of their sizes, the
largest excess (tokens beyond distinct bits) and the tokens that all of them share.
Two documents share at most popcount(and of bitmaps) + the smaller excess tokens, and
no more than the smaller has: node pairs whose bound stays below what the threshold
asks are pruned.  Node pairs whose common tokens alone reach the threshold for every
size in range are accepted whole, so that a block of near copies isn't compared pair
by pair.  The rest is descended together; document pairs that remain are counted
exactly.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8
PAIRS_AT_ONCE = 1 << 16


def _intersect(sets: list[np.ndarray]) -> np.ndarray:
    out = sets[0]
    for s in sets[1:]:
        if not len(out):
            break
        out = np.intersect1d(out, s, assume_unique=True)
    return out


class SignatureTree:
    """Levels of nodes over sets given as sorted distinct integers: values[bounds[i] : bounds[i + 1]]."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray, bits: int):
        size = np.diff(bounds)
        self.order = np.lexsort((values[np.minimum(bounds[:-1], max(0, len(values) - 1))], size)) if len(values) else np.arange(len(size))
        bitmap = np.zeros((len(size), bits // 64), dtype=np.uint64)
        at = (values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & (bits - 1)
        row = np.repeat(np.arange(len(size)), size)
        np.bitwise_or.at(bitmap, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        excess = size - np.bitwise_count(bitmap).sum(axis=1).astype(np.int64)
        level = (bitmap[self.order], size[self.order], size[self.order], excess[self.order])
        common = [values[bounds[i] : bounds[i + 1]] for i in self.order]
        self.levels, self.common = [level], [common]
        while len(level[0]) > 1:
            self._grow()
            level = self.levels[-1]

    def _grow(self) -> None:
        level, common = self.levels[-1], self.common[-1]
        heads = np.arange(0, len(level[0]), FANOUT)
        self.levels.append((np.bitwise_or.reduceat(level[0], heads), np.minimum.reduceat(level[1], heads), np.maximum.reduceat(level[2], heads), np.maximum.reduceat(level[3], heads)))
        self.common.append([_intersect(common[k : k + FANOUT]) for k in heads.tolist()])

    def leaves(self, depth: int, node: int) -> np.ndarray:
        """Documents below a node."""
        width = FANOUT**depth
        return self.order[node * width : (node + 1) * width]


def _possible(x: SignatureTree, y: SignatureTree, depth: int, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which node pairs of a level may hold a pair of documents that reaches the threshold."""
    bits_a, low_a, high_a, excess_a = x.levels[depth]
    bits_b, low_b, high_b, excess_b = y.levels[depth]
    smaller = np.minimum(high_a[a], high_b[b])
    need = threshold / (1 + threshold) * (low_a[a] + low_b[b])
    ok = np.flatnonzero((smaller >= need - 1e-9) & (smaller >= threshold * np.maximum(low_a[a], low_b[b]) - 1e-9))
    out = np.zeros(len(a), dtype=bool)
    for k in range(0, len(ok), PAIRS_AT_ONCE):
        part = ok[k : k + PAIRS_AT_ONCE]
        i, j = a[part], b[part]
        shared = np.bitwise_count(bits_a[i] & bits_b[j]).sum(axis=1, dtype=np.int64) + np.minimum(excess_a[i], excess_b[j])
        out[part] = shared >= need[part] - 1e-9
    return out


def _certain(x: SignatureTree, y: SignatureTree, depth: int, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which node pairs hold only pairs of documents that reach the threshold, by the tokens all share."""
    need = threshold / (1 + threshold) * (x.levels[depth][2][a] + y.levels[depth][2][b]) + 1e-9
    size_a, size_b = (np.array([len(c) for c in t.common[depth]], dtype=np.int64) for t in (x, y))
    out = np.zeros(len(a), dtype=bool)
    for k in np.flatnonzero(np.minimum(size_a[a], size_b[b]) >= need).tolist():
        out[k] = len(np.intersect1d(x.common[depth][a[k]], y.common[depth][b[k]], assume_unique=True)) >= need[k]
    return out


def traverse(x: SignatureTree, y: SignatureTree, threshold: float, whole: bool = True):
    """Yields (sure, a, b): arrays of documents of x and of y.

    Sure ones are all pairs between two sets of documents (or within one, if x is y and
    the sets are the same); of the others, a[k] and b[k] are a pair that no bound excludes.
    """
    while len(x.levels) < len(y.levels):
        x._grow()
    while len(y.levels) < len(x.levels):
        y._grow()
    same = x is y
    todo = [(len(x.levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))] if len(x.order) and len(y.order) else []
    while todo:
        depth, a, b = todo.pop()
        keep = _possible(x, y, depth, a, b, threshold)
        if same and not depth:
            keep &= a != b
        a, b = a[keep], b[keep]
        if whole and depth and len(a):
            sure = _certain(x, y, depth, a, b, threshold)
            for i, j in zip(a[sure].tolist(), b[sure].tolist()):
                yield True, x.leaves(depth, i), y.leaves(depth, j)
            a, b = a[~sure], b[~sure]
        if not len(a):
            continue
        if not depth:
            yield False, x.order[a], y.order[b]
            continue
        n, m = len(x.levels[depth - 1][0]), len(y.levels[depth - 1][0])
        step = PAIRS_AT_ONCE // FANOUT**2
        for k in range(0, len(a), step):
            i = (a[k : k + step, None, None] * FANOUT + np.arange(FANOUT)[None, :, None]) + np.zeros((1, 1, FANOUT), dtype=np.int64)
            j = (b[k : k + step, None, None] * FANOUT + np.arange(FANOUT)[None, None, :]) + np.zeros((1, FANOUT, 1), dtype=np.int64)
            i, j = i.ravel(), j.ravel()
            ok = (i < n) & (j < m)
            if same:
                ok &= i <= j
            todo.append((depth - 1, i[ok], j[ok]))


class Block:
    """Sets of 64-bit hashes, cut into one side or two that are joined with each other."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray, side: np.ndarray | None = None):
        _, dense = np.unique(values, return_inverse=True)
        self.values, self.bounds, self.size = dense.astype(np.int64), bounds, np.diff(bounds)
        typical = int(np.median(self.size)) if len(self.size) else 1
        self.bits = 1 << int(np.clip(np.ceil(np.log2(max(1, 4 * typical))), 9, 15))
        rows = [np.arange(len(self.size))] if side is None else [np.flatnonzero(side == s) for s in (0, 1)]
        self.sides = [(r, self._tree(r)) for r in rows]
        self.flag = np.zeros(int(dense.max()) + 1 if len(dense) else 1, dtype=bool)

    def _tree(self, rows: np.ndarray) -> SignatureTree:
        parts = [np.sort(self.values[self.bounds[r] : self.bounds[r + 1]]) for r in rows.tolist()]
        bounds = np.concatenate(([0], np.cumsum(self.size[rows]))).astype(np.int64)
        return SignatureTree(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64), bounds, self.bits)

    def found(self, threshold: float, whole: bool = True):
        """As `traverse`, in places of the block, with the pairs that aren't sure counted: (sure, a, b, jaccard)."""
        (mine, x), (other, y) = self.sides[0], self.sides[-1]
        for sure, a, b in traverse(x, y, threshold, whole):
            a, b = mine[a], other[b]
            if sure:
                yield True, a, b, None
            else:
                yield False, *self._count(a, b, threshold)

    def _count(self, a: np.ndarray, b: np.ndarray, threshold: float):
        by = np.lexsort((b, a))
        a, b = a[by], b[by]
        heads = np.append(np.flatnonzero(np.r_[True, a[1:] != a[:-1]]), len(a))
        jaccard = np.zeros(len(a))
        for lo, hi in zip(heads[:-1].tolist(), heads[1:].tolist()):
            one = self.values[self.bounds[a[lo]] : self.bounds[a[lo] + 1]]
            self.flag[one] = True
            for k in range(lo, hi, 4096):
                y = b[k : min(hi, k + 4096)]
                n = self.size[y]
                ends = np.cumsum(n)
                at = np.repeat(self.bounds[y] - (ends - n), n) + np.arange(ends[-1])
                shared = np.add.reduceat(self.flag[self.values[at]].astype(np.int64), ends - n)
                jaccard[k : k + len(y)] = shared / (len(one) + n - shared)
            self.flag[one] = False
        ok = jaccard >= threshold - 1e-12
        return a[ok], b[ok], jaccard[ok]


def join_block(values: np.ndarray, bounds: np.ndarray, threshold: float, side: np.ndarray | None = None):
    """(a, b, jaccard) of all pairs of non-empty sets that reach the threshold, a < b by place; with `side`, only pairs across."""
    found = [f[1:] for f in Block(values, bounds, side).found(threshold, whole=False)]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    a, b, jaccard = (np.concatenate(x) for x in zip(*found))
    a, b = np.minimum(a, b), np.maximum(a, b)
    by = np.lexsort((b, a))
    return a[by], b[by], jaccard[by]


def link_block(values: np.ndarray, bounds: np.ndarray, weight: np.ndarray, threshold: float, side: np.ndarray | None = None):
    """(links, root) of each set: the weight of the sets that it reaches the threshold with, and the least place of its component."""
    links, root = np.zeros(len(weight), dtype=np.int64), np.arange(len(weight))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    def unite(i: int, j: int) -> None:
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)

    for sure, a, b, _ in Block(values, bounds, side).found(threshold):
        if sure:
            same = side is None and a[0] == b[0]
            links[a] += weight[b].sum() - (weight[a] if same else 0)
            if not same:
                links[b] += weight[a].sum()
            for i in (*a.tolist(), *b.tolist()):
                unite(int(a[0]), i)
        elif len(a):
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            label = np.array([find(int(i)) for i in np.unique(np.concatenate((a, b)))])
            index = np.unique(np.concatenate((a, b)))
            ra, rb = label[np.searchsorted(index, a)], label[np.searchsorted(index, b)]
            for i, j in np.unique(np.stack((ra, rb), axis=1)[ra != rb], axis=0).tolist():
                unite(i, j)
    return links, np.array([find(i) for i in range(len(root))], dtype=np.int64)
