"""Labelled documents, whole or as bounded samples, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.session import written

WORDS = 1 << 18


def fresh_name(name: str, taken) -> str:
    """`name`, lengthened until no other column has it, whatever its case."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def _labels(labels: DataFrame, what: str, id_col: str) -> DataFrame:
    return labels.where(F.col(id_col).isNotNull() & F.col(what).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("_id")).agg(F.max(what).alias("label"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("text")).where(F.col("_id").isNotNull() & F.col("text").isNotNull())


def _bits(key) -> tuple:
    """(word, bit) of a key in a bit array of 64 * WORDS bits."""
    place = F.pmod(F.xxhash64(key), F.lit(64 * WORDS))
    return F.shiftright(place, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))


def parted(df: DataFrame, key, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among `keys`, rows whose key isn't), so that few rows travel to a join.

    `key` is a bigint column of df, `keys` has one column of bigints and should be a
    written table.  They are told apart by a bit array, of at most `WORDS` rows however
    many keys there are, that is broadcast; a full one lets all rows through as possible.
    """
    word, bit = _bits(F.col(keys.columns[0]))
    at, held = fresh_name("_word", df.columns), fresh_name("_bits", df.columns)
    array = F.broadcast(keys.groupBy(word.alias(at)).agg(F.bit_or(bit).alias(held)))
    word, bit = _bits(key)
    both = df.withColumn(at, word).join(array, at, "left")
    mask = fresh_name("_mask", both.columns)
    both = both.withColumn(mask, F.coalesce(F.col(held).bitwiseAND(bit) != 0, F.lit(False)))
    return both.where(F.col(mask)).drop(at, held, mask), both.where(~F.col(mask)).drop(at, held, mask)


def labelled_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, what: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All labelled documents (text, label), written to the shared folder; rows are skipped as in `labelled_sample`.

    A bit array of the labels' hashed ids, of bounded size, is broadcast first, so that
    few other texts travel to the join.
    """
    chosen = _labels(labels, what, id_col)
    texts, _ = parted(_texts(docs, id_col, text_col), F.col("_id"), chosen.select("_id"))
    return written(spark, texts.select("_id", "text").join(chosen.hint("merge"), "_id").select("text", "label"), "labelled")


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, what: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to `rows` labelled documents (text, label, half), written to the shared folder.

    They are chosen, and halved at random, by a hash of the id.  Labels with a null id
    or value, and documents with a null id or text, are skipped; of several labels for
    an id the largest counts.
    """
    chosen = _labels(labels, what, id_col).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    half = F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)).cast("int")
    return written(spark, _texts(docs, id_col, text_col).join(F.broadcast(chosen), "_id").select("text", "label", half.alias("half")), "labelled")
