"""Corpus pipeline: documents through filters, near-copy removal, passage removal and packing.

`STAGES` are (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written and read again as the next one's docs.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mergeloom.llm import neardups, packing, passages, quality, toxicity
from mergeloom.session import written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar doesn't reject."""
    return toxicity.keep_clean(docs, toxicity.fit_lexicon(spark, docs, _labels(spark, sf_dir)))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose n-grams look enough like trusted ones."""
    return quality.keep_good(docs, quality.fit_quality(spark, docs, _labels(spark, sf_dir)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies."""
    return neardups.one_of_each(spark, docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document, or place, holds."""
    return passages.without_copies(spark, docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' tokens in windows."""
    return packing.pack_documents(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_passages),
    ("packing", pack_windows),
]

# SQL expresses neither fitted grammars and thresholds nor online packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(spark, docs, f"stage{k}")
    return docs
