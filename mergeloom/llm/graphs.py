"""Connected components of large sparse graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, group): the least node of each node's component; edges are (a, b).

    In each round least labels spread along edges and are followed to their own label;
    each round's labels are a table in the shared folder.  Edges here are mostly stars,
    which take two or three rounds; a chain whose ids are in no order may take more.
    Edges with a null end join nothing.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select("a", "b")
    both = written(spark, edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("group"))
    labels = written(spark, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("group")).select(F.col("a").alias("node"), "group"), "labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("group").alias("_seen"))
        least = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("_seen").alias("_least"))
        nxt = labels.join(least, "node").select("node", F.col("group").alias("_old"), F.least("group", "_least").alias("group"))
        root = labels.select(F.col("node").alias("group"), F.col("group").alias("_root"))
        nxt = written(spark, nxt.join(root, "group").select("node", "_old", F.least("group", "_root").alias("group")), "labels")
        labels = nxt.select("node", "group")
        if not nxt.where("_old <> group").limit(1).count():
            return labels
