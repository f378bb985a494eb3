"""Lookups in the vocabulary table as joins; a vocabulary's size doesn't grow with the data."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_token_ids(df: DataFrame, vocab: DataFrame, data: str, out: str = "id") -> DataFrame:
    """Rows with the id of the token whose bytes `data` (string or binary) holds, else null."""
    right = vocab.select(F.col("bytes").alias("_bytes"), F.col("id").alias(out))
    return df.join(F.broadcast(right), F.col(data).cast("binary") == F.col("_bytes"), "left").drop("_bytes")


def with_token_bytes(df: DataFrame, vocab: DataFrame, token: str, out: str = "bytes") -> DataFrame:
    """Rows with the bytes and the length (`n_bytes`) of a token id, null if it is unknown."""
    right = vocab.select(F.col("id").alias("_id"), F.col("bytes").alias(out), "n_bytes")
    return df.join(F.broadcast(right), F.col(token) == F.col("_id"), "left").drop("_id")


def decode_by_join(df: DataFrame, vocab: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, data): concatenated bytes of id lists by a join, null where an id is unknown or the list is null.

    The key must be unique.  `Tokenizer.decode_bytes` gives the same without a shuffle.
    """
    right = vocab.select(F.col("id").alias("_token"), F.col("bytes").alias("_bytes"))
    flat = df.select(key, F.posexplode(tokens).alias("_pos", "_token")).join(F.broadcast(right), "_token", "left")
    joined = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_bytes"))).alias("_parts"), F.count_if(F.col("_bytes").isNull()).alias("_bad"))
    data = F.aggregate("_parts", F.lit(b""), lambda a, x: F.concat(a, x["_bytes"]))
    whole = df.select(key, F.when(F.col(tokens).isNotNull(), F.size(tokens)).alias("_n")).join(joined, key, "left")
    return whole.select(key, F.when(F.col("_n") == 0, F.lit(b"")).when(F.col("_bad") == 0, data).alias("data"))


def occurrences(df: DataFrame, vocab: DataFrame, text: str, longest: int) -> DataFrame:
    """Every vocabulary token at every byte place of short texts: adds (start, id).

    Probes all substrings up to the longest token; for texts of any length use an encoder.
    """
    data = F.col(text).cast("binary")
    places = df.withColumn("_at", F.explode(F.sequence(F.lit(1), F.greatest(F.octet_length(data), F.lit(1)))))
    spans = places.withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.greatest(F.octet_length(data) - F.col("_at") + 1, F.lit(1))))))
    spans = spans.withColumn("_bytes", F.substring(data, F.col("_at"), F.col("_n")))
    right = vocab.select(F.col("bytes").alias("_bytes"), "id")
    return spans.join(F.broadcast(right), "_bytes").withColumn("start", F.col("_at") - 1).drop("_at", "_n", "_bytes")


def next_match(df: DataFrame, vocab: DataFrame, text: str, longest: int, out: str = "id") -> DataFrame:
    """Rows with the longest token that the text starts with; null for null or empty texts."""
    data = F.col(text).cast("binary")
    texts = df.select(data.alias("_data")).where(F.octet_length(data) > 0).distinct()
    heads = texts.withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.octet_length("_data")))))
    right = vocab.select(F.col("bytes").alias("_bytes"), "id")
    best = heads.withColumn("_bytes", F.substring("_data", F.lit(1), F.col("_n"))).join(F.broadcast(right), "_bytes").groupBy("_data").agg(F.max_by("id", "_n").alias(out))
    return df.join(best, data == F.col("_data"), "left").drop("_data")


def token_frequency(df: DataFrame, tokens: Column | str) -> DataFrame:
    """(token, n): how often each id occurs in the lists.

    Lists are counted where they are; what leaves a batch is a row for each distinct id.
    """
    lists = df.select((F.col(tokens) if isinstance(tokens, str) else tokens).alias("tokens"))

    def count(batches):
        for batch in batches:
            got = pc.value_counts(batch.column(0).flatten())
            yield pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], ["token", "n"])

    kind = lists.schema["tokens"].dataType.elementType.simpleString()
    return lists.mapInArrow(count, f"token {kind}, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def batch_totals(df: DataFrame, tokens: str) -> DataFrame:
    """(n_texts, total_tokens) of encoded texts; null lists count as texts without tokens."""
    return df.agg(F.count("*").alias("n_texts"), F.coalesce(F.sum(F.when(F.col(tokens).isNotNull(), F.size(tokens))), F.lit(0)).alias("total_tokens"))
