"""Operator 5: quality by a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams, case and marks kept, are hashed into buckets.  One
multinomial counts them over all documents, one over all trusted documents (labelled
good); a text's score is the mean log ratio of its n-grams.  Every document whose
score is below one threshold is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mergeloom.llm.samples import labelled_documents
from mergeloom.llm.text import hash_spans, mix, slices, text_buffers, tidy, words
from mergeloom.session import written

BITS = 16
GOOD_WEIGHT = 20
SMOOTHING = 1.0


def buckets(col: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, row) of every unigram and bigram of the texts, and the number of rows."""
    data, offsets = text_buffers(col)
    start, end, first = words(data, offsets, False)
    n = len(offsets) - 1
    if not len(start):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), n
    h = hash_spans(data, start, end)
    row = np.repeat(np.arange(n), np.diff(first))
    same = row[1:] == row[:-1]
    pairs = mix(h[:-1] * np.uint64(31) + h[1:] + np.uint64(7))[same]
    out = np.concatenate((mix(h), pairs)) >> np.uint64(64 - BITS)
    return out.astype(np.int64), np.concatenate((row, row[:-1][same])), n


def count_buckets(texts: DataFrame) -> np.ndarray:
    """Counts of all n-grams of all texts (one column); each task sends one vector."""

    @tidy
    def run(batches):
        total = np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, batch.schema.names[0]):
                total += np.bincount(buckets(part.column(0))[0], minlength=1 << BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    got = texts.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS)
    out[got["bucket"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=float)
    return out


@dataclass
class Quality:
    """Log ratio of each bucket, and the least score that is kept."""

    ratio: np.ndarray
    threshold: float

    def scores(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(score, n-grams) of each text; without n-grams the score is 0."""
        at, row, n = buckets(col)
        size = np.bincount(row, minlength=n)
        return np.bincount(row, weights=self.ratio[at], minlength=n) / np.maximum(size, 1), size

    def keeps(self, score: np.ndarray) -> np.ndarray:
        return score >= self.threshold


def log_ratio(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of two smoothed multinomials."""
    part = lambda x: np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * len(x)))
    return part(trusted) - part(raw)


def held_out_scores(col: pa.Array, trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Score of each trusted text by all trusted documents but itself."""
    at, row, n = buckets(col)
    size = np.bincount(row, minlength=n)
    _, back, own = np.unique(row << BITS | at, return_inverse=True, return_counts=True)
    others = np.log(trusted[at] - own[back] + SMOOTHING) - np.log(trusted.sum() - size + SMOOTHING * len(trusted))[row]
    return np.bincount(row, weights=others - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * len(raw)))[at], minlength=n) / np.maximum(size, 1)


def best_cut(scored: DataFrame) -> float:
    """The score that divides good (label 1) from bad (0) best; -inf without good or without bad ones.

    Counts below a score are running sums within bins of scores, so that no task
    holds all of them.
    """
    per = scored.where("label IN (0, 1)").groupBy("score").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"))
    per = per.withColumn("bin", F.floor(F.col("score") * 256))
    bins = per.groupBy("bin").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad")).toPandas().sort_values("bin")
    n_good, n_bad = int(bins["all_good"].sum()), int(bins["all_bad"].sum())
    if not n_good or not n_bad:
        return float("-inf")
    cost = GOOD_WEIGHT * (bins["all_good"].cumsum() - bins["all_good"]) - (bins["all_bad"].cumsum() - bins["all_bad"]) + n_bad
    before = scored.sparkSession.createDataFrame([(int(b), int(c)) for b, c in zip(bins["bin"], cost)], "bin bigint, before bigint")
    below = W.partitionBy("bin").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    within = F.coalesce(F.sum(GOOD_WEIGHT * F.col("good") - F.col("bad")).over(below), F.lit(0))
    return float(per.withColumn("within", within).join(F.broadcast(before), "bin").orderBy(F.col("before") + F.col("within"), "score").first()["score"])


def fit_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, text_col: str = "text") -> Quality:
    """Raw counts over all documents, trusted counts over all labelled good, the threshold from all labelled ones.

    The threshold is the cut that divides the labelled documents best, a lost good one
    weighing as much as `GOOD_WEIGHT` kept bad ones; a good one is scored without its
    own part in the trusted counts.  Without good or without bad labels nothing is
    rejected.
    """
    labelled = labelled_documents(spark, docs, labels, "quality", text_col=text_col)
    raw = count_buckets(docs.select(F.col(text_col).cast("string").alias("text")))
    trusted = count_buckets(labelled.where("label = 1").select("text"))
    model = Quality(log_ratio(trusted, raw), float("-inf"))
    if not trusted.sum():
        model.ratio = np.zeros(1 << BITS)
        return model
    shared = spark.sparkContext.broadcast((model, trusted, raw))

    @tidy
    def run(batches):
        model, trusted, raw = shared.value
        for batch in batches:
            for part in slices(batch):
                label = part.column(1).cast(pa.int32())
                score = model.scores(part.column(0))[0]
                good = label.to_numpy() == 1
                if good.any():
                    score[good] = held_out_scores(part.column(0).filter(pa.array(good)), trusted, raw)
                yield pa.RecordBatch.from_arrays([pa.array(score), label], ["score", "label"])

    model.threshold = best_cut(written(spark, labelled.mapInArrow(run, "score double, label int"), "scores"))
    return model


def score_documents(docs: DataFrame, model: Quality, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_grams, keep) of every row.

    A null or empty text has no n-grams, scores 0 and is judged by the threshold like
    any other; repeated rows and null ids too; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                score, size = shared.value.scores(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(size), pa.array(shared.value.keeps(score))], ["doc_id", "score", "n_grams", "keep"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, n_grams bigint, keep boolean")


def keep_good(docs: DataFrame, model: Quality) -> DataFrame:
    """The rows whose text is kept, with the columns they came with."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(shared.value.keeps(shared.value.scores(part.column(place))[0])))

    return docs.mapInArrow(run, docs.schema)
