"""Operator 10: sum-of-squares online packing of documents into token windows.

A document is placed in the fill level that keeps the sum of squared counts of
partially filled windows smallest; the counts are an array over levels.  Shards of
about `SHARD_DOCS` documents are packed on their own, so nothing grows with the
corpus but the number of shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.llm.counts import count_documents
from mergeloom.llm.text import tidy_table
from mergeloom.session import written

WINDOW = 2048
SHARD_DOCS = 50_000
PLACES = "shard int, window bigint, start int, doc_id bigint, doc_start bigint, n_tokens int"


class Packer:
    """Online packing; `put(size)` gives (window, fill level found) of an item below the window size."""

    def __init__(self, window: int):
        if window < 1:
            raise ValueError("a window needs at least one token")
        self.window, self.opened = window, 0
        self.level = np.zeros(window + 1, dtype=np.int64)  # partially filled windows by fill; the full level stays 0
        self.open: list[list[int]] = [[] for _ in range(window)]

    def put(self, size: int) -> tuple[int, int]:
        level, window = self.level, self.window
        top = window - size
        here, there = level[1 : top + 1], level[1 + size : window + 1]
        best, at = 2 * int(level[size]) + 1, 0
        if top > 0:
            change = 2 * (there - here) + 2
            change[-1] -= 1  # a window that becomes full leaves the sum
            change[here == 0] = 1 << 60
            k = top - 1 - int(change[::-1].argmin())  # ties: the fullest window
            if change[k] <= best:
                best, at = int(change[k]), k + 1
        if at:
            level[at] -= 1
            found = self.open[at].pop()
        else:
            found, self.opened = self.opened, self.opened + 1
        if at + size < window:
            level[at + size] += 1
            self.open[at + size].append(found)
        return found, at


def pack(sizes, window: int = WINDOW):
    """(item, window, start, item_start, length) of every piece, items in the given order.

    An item of at least a window fills whole windows first; its rest is placed like
    any other.  Items without tokens take no place.
    """
    packer = Packer(window)
    out = []
    for i, size in enumerate(sizes):
        whole, rest = divmod(int(size), window)
        for k in range(whole):
            out.append((i, packer.opened, 0, k * window, window))
            packer.opened += 1
        if rest:
            found, at = packer.put(rest)
            out.append((i, found, at, whole * window, rest))
    return out


def pack_counts(spark: SparkSession, counts: DataFrame, window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Places (shard, window, start, doc_id, doc_start, n_tokens) for rows (doc_id, n_tokens).

    Within a shard documents come in order of (doc_id, n_tokens).  Null or zero counts
    take no place; rows with a null doc_id, and rows that repeat, are placed like others.
    """
    counts = written(spark, counts.where("n_tokens > 0").select("doc_id", "n_tokens"), "counts")
    shards = max(1, -(-counts.count() // shard_docs))

    @tidy_table
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        got = pack(table.column("n_tokens").to_numpy(), window)
        item, at, start, doc_start, n = np.array(got, dtype=np.int64).reshape(-1, 5).T
        return pa.table({"shard": table.column("shard").combine_chunks().take(pa.array(item)), "window": at, "start": start.astype(np.int32), "doc_id": table.column("doc_id").combine_chunks().take(pa.array(item)), "doc_start": doc_start, "n_tokens": n.astype(np.int32)})

    keyed = counts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    return keyed.groupBy("shard").applyInArrow(run, PLACES)


def pack_documents(spark: SparkSession, docs: DataFrame, window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """`pack_counts` of the exact token counts of documents (doc_id, text); other columns are not read."""
    return pack_counts(spark, count_documents(spark, docs), window, shard_docs)
