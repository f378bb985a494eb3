"""Operator 4: n-gram Jaccard join with signature trees.

Documents whose sets of word 3-grams have a Jaccard index of at least the threshold are
linked.  Words are runs of letters, digits and non-ASCII characters of the lower-cased
text; a text of fewer than three words is one gram.

1. A task turns a text into its set's size and hash, a minwise sketch, and bands.
2. Documents with equal sets are one class from here on, named by the set's hash.
3. Classes that share a band are compared by their sketches; those that may reach the
   threshold are joined, and connected classes are one block.
4. A block's full sets meet once, in a signature tree whose dual traversal and exact
   counts give its links.  A large block is cut into parts and every pair of parts is
   a block of its own, joined tree against tree.

Bands and sketches miss a pair at the threshold with probability 0.000002 and less
above it; whatever they bring together is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.llm.graphs import components
from mergeloom.llm.samples import parted
from mergeloom.llm.sigtree import join_block, link_block
from mergeloom.llm.text import MULT, SPREAD, hash_spans, mix, slices, text_buffers, tidy, tidy_table, words
from mergeloom.session import written

GRAM = 3
THRESHOLD = 0.5
BANDS, ROWS = 48, 2
SKETCH = 120
SLACK = 0.22
LINK_CLASSES = 4_000
LINK_ROWS = 20_000
BLOCK_CLASSES = 4_000
_FACTORS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(SPREAD)) | np.uint64(1)


def gram_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds): sorted distinct 64-bit hashes of each text's n-grams."""
    data, offsets = text_buffers(pc.utf8_lower(col))
    start, end, first = words(data, offsets, True)
    n = len(offsets) - 1
    h = mix(hash_spans(data, start, end))
    count = np.diff(first)
    row = np.repeat(np.arange(n), np.maximum(count - GRAM + 1, (count > 0).astype(np.int64)))
    place = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n))))[:-1], np.bincount(row, minlength=n)) if len(row) else np.zeros(0, dtype=np.int64)
    at = first[row] + place
    g = np.zeros(len(row), dtype=np.uint64)
    for k in range(GRAM):
        inside = at + k < first[row + 1]
        g = g * np.uint64(MULT) + np.where(inside, h[np.minimum(at + k, max(0, len(h) - 1))], np.uint64(0)) if len(h) else g
    g = mix(g)
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (row[1:] != row[:-1])] if len(g) else np.zeros(0, dtype=bool)
    g, row = g[new], row[new]
    return g, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n))))


def set_hashes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each set."""
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(values + np.uint64(1)), dtype=np.uint64)))
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """`SKETCH` independent minwise values of each set; sets must not be empty."""
    out = np.empty((SKETCH, len(bounds) - 1), dtype=np.uint64)
    if out.shape[1]:
        held = np.empty_like(values)
        for k, factor in enumerate(_FACTORS):
            np.multiply(values, factor, out=held)
            np.minimum.reduceat(held, bounds[:-1], out=out[k])
    return out.T


def _blobs(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a matrix of bytes."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


@tidy
def _signatures(batches):
    """(doc_id, text_key, whole, size, bands, sketch) of every row; what has no word has no set."""
    for batch in batches:
        for part in slices(batch):
            values, bounds = gram_sets(part.column(2))
            size = np.diff(bounds)
            some = np.flatnonzero(size > 0)
            whole = set_hashes(values, bounds)
            at = np.concatenate((bounds[:-1][some], bounds[-1:]))
            sketch = sketches(values, at)
            bands = np.zeros((len(some), BANDS), dtype=np.uint64)
            for r in range(ROWS):
                bands = bands * np.uint64(MULT) + mix(sketch[:, r * BANDS : (r + 1) * BANDS] + np.uint64(r))
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
            short = (mix(sketch) & np.uint64(255)).astype(np.uint8)
            n = len(some)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel().view(np.int64)))
            held = np.where(size > 0, np.cumsum(size > 0) - 1, -1)
            take = pa.array(held, mask=held < 0)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(whole.view(np.int64), mask=size == 0), pa.array(size.astype(np.int32)), lists.take(take), _blobs(short).take(take)],
                ["doc_id", "text_key", "whole", "size", "bands", "sketch"],
            )


MARKS = "doc_id bigint, text_key bigint, whole bigint, size int, bands array<bigint>, sketch binary"
EDGES = "a bigint, b bigint"


def _similar(one: np.ndarray, others: np.ndarray, threshold: float) -> np.ndarray:
    return (others == one).sum(axis=-1) >= (threshold - SLACK) * SKETCH


def _link_small(size, sketch, bucket, threshold: float):
    """Pairs (places) of classes of one bucket that may be similar; rows come in order of bucket and size."""
    for k in range(1, len(bucket)):
        i = np.flatnonzero(bucket[k:] == bucket[:-k])
        if not len(i):
            return
        i = i[size[i + k] * threshold <= size[i]]
        near = _similar(sketch[i], sketch[i + k], threshold)
        yield i[near], i[near] + k


def _link_large(size, sketch, part, threshold: float):
    """The same for one large bucket, without what is linked already; `part` is None or 0 and 1, to be linked across."""
    label = np.arange(len(size))
    stop = np.searchsorted(size, size / threshold, side="right")
    for i in range(len(size) - 1):
        other = i + 1 + np.flatnonzero(label[i + 1 : stop[i]] != label[i])
        if part is not None:
            other = other[part[other] != part[i]]
        near = other[_similar(sketch[i], sketch[other], threshold)]
        if len(near):
            linked = np.unique(np.append(label[near], label[i]))
            label[np.isin(label, linked)] = linked[0]
    rest = np.flatnonzero(label != np.arange(len(label)))
    return label[rest], rest


def _link(table: pa.Table, threshold: float) -> pa.Table:
    """Edges between the classes of each bucket that may be similar, by size and sketch."""
    table = table.sort_by([(c, "ascending") for c in ("bucket", "low", "high", "size", "whole")])
    column = lambda c: table.column(c).to_numpy()
    ids, size, part, low, high = (column(c) for c in ("whole", "size", "part", "low", "high"))
    same = np.stack((column("bucket"), low, high), axis=1)
    same = np.cumsum(np.r_[False, (same[1:] != same[:-1]).any(axis=1)])
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
    n = np.bincount(same)[same]
    few = np.flatnonzero((n <= 8) & (low == high))
    found = [(few[a], few[b]) for a, b in _link_small(size[few], sketch[few], same[few], threshold)]
    for k in np.unique(same[(n > 8) | (low != high)]).tolist():
        rows = np.flatnonzero(same == k)
        a, b = _link_large(size[rows], sketch[rows], part[rows] if low[rows[0]] != high[rows[0]] else None, threshold)
        found.append((rows[a], rows[b]))
    a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2
    return pa.table({"a": ids[a], "b": ids[b]})


def _row(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _paired(df: DataFrame, key: str) -> DataFrame:
    """Each row for every pair (low, high) of parts that its own part belongs to."""
    df = df.withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_other")
    return df.select("*", other).withColumns({"low": F.least("part", "_other"), "high": F.greatest("part", "_other")}).drop("_other")


def near_blocks(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"):
    """(marks, classes, held).

    marks are rows (doc_id, text_key, whole, ...) of all documents, whole null where there is no word;
    classes (whole, rep, n) have their first row and number of rows; held are the grams of classes that
    may have links, (whole, n, grams, block, part, low, high).
    """
    rows = _row(docs, id_col, text_col)
    marks = written(spark, rows.mapInArrow(_signatures, MARKS), "sketches")
    first = F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "text_key")
    # rows of a class differ in id and text only; tasks reduce theirs before they are sent
    sets = marks.where("whole IS NOT NULL").groupBy("whole").agg(F.min(first).alias("rep"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = written(spark, sets, "classes")
    band = classes.select("whole", F.explode("bands").alias("bucket"))
    met = band.groupBy("bucket").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("whole")).alias("of"), F.min("whole").alias("least")).where("m > 1")
    # classes that meet in several bands are compared in one
    met = met.groupBy("m", "of", "least").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("m") / LINK_CLASSES).cast("int").alias("parts"))
    members = written(spark, _paired(band.join(met, "bucket"), "whole"), "members")
    shards = max(1, -(-members.count() // LINK_ROWS))
    full = members.join(classes.select("whole", "size", "sketch"), "whole").withColumn("shard", F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(shards)))
    groups = components(full.groupBy("shard").applyInArrow(tidy_table(lambda t: _link(t, threshold)), EDGES))
    sizes = groups.groupBy("group").agg(F.count("*").alias("m"))
    blocks = groups.join(sizes, "group").select(F.col("node").alias("whole"), F.col("group").alias("block"), F.ceil(F.col("m") / BLOCK_CLASSES).cast("int").alias("parts"))
    inside = classes.select("whole", "rep", "n").join(blocks, "whole")

    @tidy
    def sets_of(batches):
        for batch in batches:
            for part in slices(batch):
                values, bounds = gram_sets(part.column(0))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([lists, *part.columns[1:]], ["grams", "whole", "n", "block", "parts"])

    rep = written(spark, inside.select(F.col("rep.doc_id").alias("_id"), F.col("rep.text_key").alias("_key"), "whole", "n", "block", "parts"), "members")
    near, _ = parted(rows, F.col("text_key"), rep.select("_key"))
    found = near.join(rep, (near["text_key"] == rep["_key"]) & near["doc_id"].eqNullSafe(rep["_id"])).select("text", "whole", "n", "block", "parts")
    held = found.mapInArrow(sets_of, "grams array<bigint>, whole bigint, n bigint, block bigint, parts int")
    return marks, classes.select("whole", "rep", "n"), _paired(held, "whole")


def _block(table: pa.Table):
    """(hashes of classes, rows in them, values, bounds, side) of a block, ordered; repeated rows count once."""
    table = table.sort_by("whole").combine_chunks()
    ids = table.column("whole").to_numpy()
    if (ids[1:] == ids[:-1]).any():
        table = table.filter(pa.array(np.r_[True, ids[1:] != ids[:-1]])).combine_chunks()
        ids = table.column("whole").to_numpy()
    grams = table.column("grams").chunk(0)
    values = grams.flatten().to_numpy().view(np.uint64)
    bounds = np.concatenate(([0], np.cumsum(grams.value_lengths().to_numpy()))).astype(np.int64)
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    side = None if low == high else (table.column("part").to_numpy() == high).astype(np.int64)
    return ids, table.column("n").to_numpy(), values, bounds, side


def near_pairs(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, other_id, jaccard): pairs of different sets that reach the index, by the least ids that have them.

    A pair at the threshold is missed with probability 0.000002.  Documents with equal
    sets aren't paired here: `near_groups` has their classes.  Null and empty texts,
    and texts without a word, pair with nothing; a null id stands for a class all of
    whose rows have none; rows that share an id are documents of their own.
    """
    _, classes, held = near_blocks(spark, docs, threshold, id_col, text_col)

    @tidy_table
    def join(table: pa.Table) -> pa.Table:
        ids, _, values, bounds, side = _block(table)
        a, b, jaccard = join_block(values, bounds, threshold, side)
        return pa.table({"a": ids[a], "b": ids[b], "jaccard": jaccard})

    pairs = held.groupBy("block", "low", "high").applyInArrow(join, "a bigint, b bigint, jaccard double")
    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("whole").alias(end), F.col("rep.doc_id").alias(f"_{end}")), end)
    other = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.greatest("_a", "_b"))
    return pairs.select(F.least("_a", "_b").alias("doc_id"), other.alias("other_id"), "jaccard")


def _groups(spark: SparkSession, docs: DataFrame, threshold: float, id_col: str, text_col: str):
    """(marks, groups): groups (whole, group, links, n, rep) of the classes that have links."""
    marks, classes, held = near_blocks(spark, docs, threshold, id_col, text_col)

    @tidy_table
    def join(table: pa.Table) -> pa.Table:
        ids, n, values, bounds, side = _block(table)
        links, root = link_block(values, bounds, n, threshold, side)
        some = np.flatnonzero(links)
        return pa.table({"a": ids[some], "b": ids[root[some]], "links": links[some], "cut": pa.array([table.column("parts")[0].as_py() > 1] * len(some), pa.bool_())})

    links = written(spark, held.groupBy("block", "low", "high").applyInArrow(join, EDGES + ", links bigint, cut boolean"), "links")
    total = links.groupBy(F.col("a").alias("whole")).agg(F.sum("links").alias("links"))
    # a block that isn't cut has its components whole
    groups = links.where("NOT cut").select(F.col("a").alias("whole"), F.col("b").alias("group"))
    groups = groups.union(components(links.where("cut")))
    return marks, total.join(groups, "whole"), classes


def near_groups(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) of every row: its class of near copies and how many other rows it reaches the index with.

    A class is connected by links, and is named by the least id in it (null if none of
    its rows has one).  A null or empty text, or one without a word, has no links and is
    a class of its own; rows that share an id, repeated rows and rows without an id are
    documents like any other; other columns are not read.  A link at the threshold is
    missed with probability 0.000002.
    """
    marks, linked, classes = _groups(spark, docs, threshold, id_col, text_col)
    named = classes.join(linked, "whole", "left").withColumn("group", F.coalesce("group", "whole"))
    named = written(spark, named.select("whole", "group", F.col("rep.doc_id").alias("_least"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")).where("n_links > 0"), "named")
    least = named.groupBy("group").agg(F.min("_least").alias("class_id"))
    info = named.join(least, "group").select("whole", "n_links", "class_id", F.lit(True).alias("_in"))
    out = marks.select("doc_id", "whole").join(info, "whole", "left")
    return out.select("doc_id", F.when(F.col("_in"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class of near copies: that of the least id.

    Rows without an id come last, and of rows that share an id that with the least hash
    of the text.  Of repeated rows one stays (if other columns differ, the one of the
    least hash).  Rows keep all their columns; those with a null or empty text, or
    without a word, stay.
    """
    marks, linked, _ = _groups(spark, docs, threshold, "doc_id", "text")
    names = docs.columns
    at = F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "text_key")
    rows = marks.where("whole IS NOT NULL").select("whole", at.alias("at")).join(linked.select("whole", "group"), "whole", "left")
    rows = written(spark, rows.select(F.coalesce("group", "whole").alias("group"), "at"), "rows")
    best = rows.groupBy("group").agg(F.min("at").alias("best"), F.count("*").alias("m")).where("m > 1").drop("m")
    met = rows.join(best, "group").groupBy("at").agg(F.max(F.col("at") == F.col("best")).alias("best"), F.count("*").alias("m"))
    met = written(spark, met.where("NOT best OR m > 1").select(F.col("at.doc_id").alias("_id"), F.col("at.text_key").alias("_key"), "best"), "gone")
    some, others = parted(docs, F.xxhash64(docs["text"].cast("string")), met.select("_key"))
    on = lambda other: (F.xxhash64(some["text"].cast("string")) == other["_key"]) & some["doc_id"].cast("bigint").eqNullSafe(other["_id"])
    kept = others.unionByName(some.join(met, on(met), "left_anti"))
    again = met.where("best")
    packed = some.join(again, on(again), "left_semi").select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.xxhash64("doc_id", "text").alias("is"), F.xxhash64(*(F.col(f"`{c}`") for c in names)).alias("by"))
    return kept.unionByName(packed.groupBy("is").agg(F.min_by("row", "by").alias("row")).select("row.*"))
