"""Operator 8: approximate nearest neighbours by learned partitions.

On a bounded sample, the exact neighbour graph is cut into balanced parts, and a
small network learns each vector's and its neighbours' parts.  Every vector is stored
once, in its likeliest part; a query is searched for in the several likeliest ones,
where cosine similarities are exact.  How many is the least number that keeps the
target recall on vectors held out of training.

A part has about `PART_ROWS` vectors at any size of table: parts that are larger than
twice that are split again, by networks of their own, fitted on samples of their own
in one task each.  A part that can't be split (equal vectors, say) is searched in
blocks.  Queries whose parts hold too few vectors are compared with all vectors.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mergeloom.session import written

K = 10
PART_ROWS = 1_000
LEAST_PARTS = 4
FANOUT = 64
SAMPLE_ROWS = 4_096
BLOCK_ROWS = 20_000
RECALL = 0.98
HIDDEN = 128


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def top_neighbours(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int):
    """(query row, data row, similarity): the k most similar other ids; ties by smaller id."""
    order = np.argsort(ids, kind="stable")
    data, ids = data[order], ids[order]
    out = []
    for lo in range(0, len(queries), 1024):
        s = np.round((queries[lo : lo + 1024] @ data.T).astype(np.float64), 6)
        s[query_ids[lo : lo + 1024, None] == ids[None, :]] = -np.inf
        n = min(k, s.shape[1])
        cut = -np.partition(-s, n - 1, axis=1)[:, n - 1]
        row, col = np.nonzero((s >= cut[:, None]) & np.isfinite(s))
        sim = s[row, col]
        by = np.lexsort((col, -sim, row))
        row, col, sim = row[by], col[by], sim[by]
        first = np.searchsorted(row, np.arange(len(s)))
        keep = np.arange(len(row)) - first[row] < n
        out.append((row[keep] + lo, order[col[keep]], sim[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """Parts of near-equal size with few graph edges between them.

    Starts from centres with room for n / parts each, then moves vertices to the part
    that most of their neighbours are in while room is left there.
    """
    rng = np.random.default_rng(seed)
    n = len(x)
    room = int(np.ceil(n / parts * 1.05))
    centre = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, dtype=np.int64)
    for _ in range(8):
        near = x @ centre.T
        part[:] = -1
        left = np.full(parts, room)
        best = np.argsort(-near, axis=1)
        for i in np.argsort(-(near.max(axis=1))):
            for p in best[i]:
                if left[p]:
                    part[i], left[p] = p, left[p] - 1
                    break
        centre = unit(np.stack([x[part == p].mean(axis=0) if (part == p).any() else x[rng.integers(n)] for p in range(parts)]))
    size = np.bincount(part, minlength=parts)
    both: list[list[int]] = [list(r) for r in graph]
    for i, r in enumerate(graph):
        for j in r:
            both[j].append(i)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[both[i]], minlength=parts) if both[i] else np.zeros(parts)
            votes = np.where(size < room, votes, -1)
            to = int(votes.argmax())
            here = part[i]
            if to != here and votes[to] > np.count_nonzero(part[both[i]] == here):
                size[here] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if moved < n // 200:
            break
    return part


@dataclass
class Router:
    """One hidden layer and a softmax over parts; `probes` parts are searched."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, target: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 3e-3, seed: int = 11) -> Router:
    """Adam on the cross entropy against each vector's distribution over parts."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], target.shape[1]
    p = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v, k = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            rows = order[lo : lo + batch]
            a, t = x[rows], target[rows]
            h = np.maximum(a @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = (e / e.sum(axis=1, keepdims=True) - t) / len(rows)
            back = (g @ p[2].T) * (h > 0)
            k += 1
            for i, grad in enumerate((a.T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    return Router(*(a.astype(np.float32) for a in p))


def fit_router(sample: np.ndarray, parts: int, k: int = K, recall: float = RECALL) -> Router:
    """Router of a sample of unit vectors; a fifth of it is held out to choose the number of probes."""
    held = np.arange(len(sample)) % 5 == 4
    x, q = sample[~held], sample[held]
    parts = min(parts, len(x))
    ids = np.arange(len(x))
    row, col, _ = top_neighbours(x, ids, x, ids, k)
    graph = [col[a:b] for a, b in zip(np.searchsorted(row, ids), np.searchsorted(row, ids, side="right"))]
    part = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (ids, part), 1.0)
    np.add.at(target, (row, part[col]), 1.0)
    router = train_router(x, target / target.sum(axis=1, keepdims=True))
    router.probes = parts
    if len(q):
        home = router.scores(x).argmax(axis=1)
        near, other, _ = top_neighbours(q, np.full(len(q), -1), x, ids, k)
        rank = np.argsort(np.argsort(-router.scores(q), axis=1), axis=1)
        found = rank[near, home[other]]
        reach = np.cumsum(np.bincount(found, minlength=parts)) / len(found)
        router.probes = int(min(parts, np.searchsorted(reach, recall) + 1))
    return router


def _children(rows: int) -> int:
    """Parts that a part of so many rows is split into."""
    return int(np.clip(-(-rows // PART_ROWS), LEAST_PARTS, FANOUT))


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, d)


def _routed(router: Router, x: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child): stored rows once, queries in as many parts as are probed."""
    order = np.argsort(-router.scores(x), axis=1, kind="stable")[:, : router.probes]
    n = np.where(query, order.shape[1], 1)
    row = np.repeat(np.arange(len(x)), n)
    return row, order[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]


ROWS = "id bigint, v array<float>, query boolean, part bigint"


def _first_split(spark: SparkSession, both: DataFrame, sample: np.ndarray, total: int, d: int, k: int) -> DataFrame:
    router = spark.sparkContext.broadcast(fit_router(sample, _children(total), k))

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                row, child = _routed(router.value, _vectors(batch.column(1), d), batch.column(2).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns[:3], pa.array(child.astype(np.int64))], ["id", "v", "query", "part"])

    return both.mapInArrow(route, ROWS)


def _next_split(spark: SparkSession, both: DataFrame, d: int, k: int) -> DataFrame:
    """Splits every part of more than twice `PART_ROWS` stored vectors; what isn't split keeps its rows."""
    sizes = both.groupBy("part").agg(F.count_if(~F.col("query")).alias("n"))
    sizes = written(spark, sizes.withColumn("blocks", F.when(F.col("n") > 2 * PART_ROWS, F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))), "sizes")
    both = both.join(sizes, "part")
    drawn = both.where("blocks IS NOT NULL AND NOT query").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30) * F.col("n") < SAMPLE_ROWS)

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        got = fit_router(_vectors(table.column("v"), d), _children(table.column("n")[0].as_py()), k)
        return pa.table({"part": table.column("part")[:1], "router": pa.array([pickle.dumps(got)], pa.binary())})

    routers = written(spark, drawn.select("part", "id", "v", "n").groupBy("part").applyInArrow(fit, "part bigint, router binary"), "routers")
    large = both.where("blocks IS NOT NULL").select("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "v", "query", F.lit(None).cast("binary").alias("router"))
    heads = routers.join(sizes, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("array<float>").alias("v"), F.lit(False).alias("query"), "router")

    def route(table: pa.Table) -> pa.Table:
        is_head = table.column("router").is_valid()
        table, router = table.filter(pc.invert(is_head)), pickle.loads(table.filter(is_head).column("router")[0].as_py())
        if not table.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float32())), "query": pa.array([], pa.bool_()), "part": pa.array([], pa.int64())})
        row, child = _routed(router, _vectors(table.column("v"), d), table.column("query").to_numpy())
        part = table.column("part")[0].as_py() * FANOUT + child
        return table.select(["id", "v", "query"]).take(pa.array(row)).append_column("part", pa.array(part.astype(np.int64)))

    split = large.unionByName(heads).groupBy("part", "block").applyInArrow(route, ROWS)
    return split.union(both.where("blocks IS NULL").select("id", "v", "query", (F.col("part") * FANOUT).alias("part")))


FOUND = "vec_id bigint, neighbour_id bigint, similarity double"


def _search(both: DataFrame, sizes: DataFrame, d: int, k: int) -> DataFrame:
    """Each query's most similar stored vectors of its parts, block by block; `sizes` has the blocks of each part."""
    both = both.join(sizes, "part")
    block = F.when(F.col("query"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))

    def search(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy()
        x, who = _vectors(table.column("v"), d), table.column("id").to_numpy()
        asked, held = np.flatnonzero(query), np.flatnonzero(~query)
        if not len(held) or not len(asked):
            return pa.table({"vec_id": pa.array([], pa.int64()), "neighbour_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        a, b, s = top_neighbours(x[asked], who[asked], x[held], who[held], k)
        return pa.table({"vec_id": who[asked][a], "neighbour_id": who[held][b], "similarity": s})

    return both.select("part", F.explode(block).alias("block"), "id", "v", "query").groupBy("part", "block").applyInArrow(search, FOUND)


def nearest(spark: SparkSession, vectors: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 1) -> DataFrame:
    """(vec_id, neighbour_id, similarity, rank): the k most cosine-similar other vectors of each query.

    Queries are the vectors whose id `every` divides, searched for among all.  Rows with
    a null id or vector, with a null or non-finite component, of zero length, or of
    another length than most, have no neighbours and are nobody's.  Of rows that share
    an id the one with the least vector counts; ties go to the smaller id; other columns
    are not read.  Fewer than 8 * `LEAST_PARTS` vectors are one part.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(F.size("v") > 0).where(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))).where(F.exists("v", lambda e: e != 0))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = FOUND + ", rank int"
    if not lengths:
        return spark.createDataFrame([], schema)
    d = lengths[0].d

    def normal(batches):
        for batch in batches:
            flat = unit(_vectors(batch.column(1), d).astype(np.float32)).ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * d), pa.array(flat))], ["id", "v"])

    rows = written(spark, rows.where(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v")).mapInArrow(normal, "id bigint, v array<float>"), "vectors")
    total = rows.count()
    asks = rows.where(F.col("id") % every == 0)
    both = rows.withColumn("query", F.lit(False)).union(asks.withColumn("query", F.lit(True)))
    if total >= 8 * LEAST_PARTS:
        ids = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
        sample = _vectors(rows.join(F.broadcast(ids), "id").orderBy("id").toArrow().column("v"), d)
        both = written(spark, _first_split(spark, both, sample, total, d, k), "routed")
        reached = FANOUT * PART_ROWS
        while reached < total:
            both = written(spark, _next_split(spark, both, d, k), "routed")
            reached *= FANOUT
    else:
        both = both.withColumn("part", F.lit(0).cast("bigint"))
    blocks = F.ceil(F.greatest(F.count_if(~F.col("query")), F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")
    top = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour_id"))
    found = _search(both, both.groupBy("part").agg(blocks), d, k)
    found = written(spark, found.withColumn("rank", top).where(F.col("rank") <= k), "found")
    enough = found.groupBy("vec_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, total - 1))
    short = written(spark, asks.join(enough, asks["id"] == enough["vec_id"], "left_anti"), "short")
    if total > 1 and not short.isEmpty():  # all vectors, in blocks, for the few queries whose parts hold too few
        all_of = rows.withColumn("query", F.lit(False)).union(short.withColumn("query", F.lit(True))).withColumn("part", F.lit(0).cast("bigint"))
        rest = _search(all_of, spark.range(1).select(F.col("id").alias("part"), F.lit(-(-total // BLOCK_ROWS)).cast("int").alias("blocks")), d, k)
        found = found.join(short.select(F.col("id").alias("vec_id")), "vec_id", "left_anti").union(rest.withColumn("rank", top).where(F.col("rank") <= k))
    return found.select("vec_id", "neighbour_id", "similarity", "rank")
