"""Vocabulary sources: rank files and parquet tables.

A rank file has one ``base64 rank`` pair a line; ranks must be 0..n-1.  A
vocabulary is small (tens of thousands of rows whatever the corpus), so its
derived columns are computed once on the driver and travel as one broadcast.
"""

from __future__ import annotations

import base64
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergeloom.functions.kernels import Vocabulary

DEFAULT_DIR = os.environ.get("MERGELOOM_TOKENIZERS", "/opt/tokenizers")
DEFAULT_RANKS = f"{DEFAULT_DIR}/byte_bpe_50k.tiktoken"
MULTI_RANKS = f"{DEFAULT_DIR}/byte_bpe_multi_50k.tiktoken"

VOCAB_SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("bytes", T.BinaryType(), False),
        T.StructField("n_bytes", T.IntegerType(), False),
        T.StructField("left", T.IntegerType(), False),
        T.StructField("right", T.IntegerType(), False),
        T.StructField("next_prefix", T.IntegerType(), True),
    ]
)


def scan_rank_file(spark: SparkSession, path: str = DEFAULT_RANKS) -> DataFrame:
    """Rank file as rows ``(id INT, bytes BINARY, n_bytes INT)``, JVM-side only.

    Blank lines are skipped.
    """
    cols = F.split("value", " ")
    raw = F.unbase64(cols[0])
    return (
        spark.read.text(path)
        .where(F.trim("value") != "")
        .select(cols[1].cast("int").alias("id"), raw.alias("bytes"), F.octet_length(raw).alias("n_bytes"))
    )


def parse_ranks(lines) -> list[bytes]:
    """Token bytes in rank order; ranks that aren't exactly 0..n-1 are an error."""
    found: dict[int, bytes] = {}
    for line in lines:
        parts = line.split()
        if len(parts) >= 2:
            found[int(parts[1])] = base64.b64decode(parts[0])
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must be 0..n-1 without gaps or repeats")
    return [found[i] for i in range(len(found))]


_LOADED: dict[tuple, Vocabulary] = {}


def load_vocabulary(spark: SparkSession, path: str = DEFAULT_RANKS, strict: bool = True) -> Vocabulary:
    """Read and validate a rank file; kept per (path, strict) for the session's life."""
    key = (path, strict)
    if key not in _LOADED:
        rows = spark.read.text(path).collect()
        _LOADED[key] = Vocabulary(parse_ranks(r.value for r in rows), strict=strict)
    return _LOADED[key]


def is_loaded(path: str, strict: bool = True) -> bool:
    """Whether the vocabulary of this path has been built already."""
    return (path, strict) in _LOADED


def vocabulary_frame(spark: SparkSession, vocab: Vocabulary) -> DataFrame:
    """The full vocabulary table (`VOCAB_SCHEMA`)."""
    left, right = vocab.splits
    nxt = vocab.next_prefixes
    rows = [(i, bytearray(b), len(b), left[i], right[i], nxt[i]) for i, b in enumerate(vocab.tokens)]
    return spark.createDataFrame(rows, VOCAB_SCHEMA)


def write_vocabulary(spark: SparkSession, vocab: Vocabulary, path: str) -> None:
    """Store the derived table; `read_vocabulary` restores it without deriving again."""
    vocabulary_frame(spark, vocab).coalesce(1).write.mode("overwrite").parquet(path)


def read_vocabulary(spark: SparkSession, path: str, strict: bool = True) -> Vocabulary:
    """Vocabulary from `write_vocabulary`'s table, splits and prefixes included."""
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.id)
    if [r.id for r in rows] != list(range(len(rows))):
        raise ValueError("ids must be 0..n-1 without gaps or repeats")
    vocab = Vocabulary([bytes(r.bytes) for r in rows], strict=strict)
    vocab._splits = ([r.left for r in rows], [r.right for r in rows])
    vocab._next = [r.next_prefix for r in rows]
    return vocab


