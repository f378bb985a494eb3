"""Operator 2: language identification by averaged hashed subword embeddings.

Byte 3- and 4-grams of lower-cased text (anything but letters becomes one blank's
byte) are hashed to embeddings; a text's average goes through a linear softmax.
Both layers are trained by stochastic gradient descent in numpy on snippets of a
bounded sample.  Held-out documents give a temperature and the least confidence
that is accepted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.llm.samples import labelled_sample
from mergeloom.llm.text import mix, slices, text_buffers

BITS = 15
SIZE = 16
LABELLED_ROWS = 4_000
SNIPPETS = 4
SNIPPET_BYTES = (16, 400)
ACCEPTED = 0.998

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[: 1 << 7] = 32
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)


def subwords(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(bucket of each position, bounds of rows)] for the 3- and the 4-grams."""
    x = _PLAIN[data].astype(np.uint32)
    out = []
    gram = x[:-1] << np.uint32(8) | x[1:] if len(x) > 1 else x[:0]
    for n in (3, 4):
        gram = gram[: max(0, len(x) - n + 1)] << np.uint32(8) | x[n - 1 :] if len(x) >= n else x[:0]
        h = (gram ^ gram >> np.uint32(15)) * np.uint32(0x9E3779B1) + np.uint32(n)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0x85EBCA77)
        at = (h >> np.uint32(32 - BITS)).astype(np.int32)
        out.append((at, offsets, n))
    return out


def gram_sums(values: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Sums over the n-grams that lie inside each row."""
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    lo = np.minimum(offsets[:-1], len(values))
    hi = np.maximum(lo, np.minimum(offsets[1:] - n + 1, len(values)))
    return sums[hi] - sums[lo]


@dataclass
class LanguageModel:
    """Class scores by bucket (embeddings times weights), bias, temperature, least confidence."""

    names: list
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(class scores, number of subwords) of each text."""
        data, offsets = text_buffers(pc.utf8_lower(col))
        total, size = np.zeros((len(offsets) - 1, len(self.names))), np.zeros(len(offsets) - 1)
        for at, bounds, n in subwords(data, offsets):
            size += np.maximum(0, np.diff(bounds) - n + 1)
            for k in range(len(self.names)):
                total[:, k] += gram_sums(self.table[:, k][at], bounds, n)
        return total / np.maximum(size, 1)[:, None] + self.bias, size

    def predict(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(class, calibrated confidence) of each text; -1 and 0 where there are no subwords."""
        logits, size = self.logits(col)
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        top = p[np.arange(len(best)), best]
        return np.where(size > 0, best, -1), np.where(size > 0, top, 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(snippets: list[bytes], label: np.ndarray, names: list, epochs: int = 6, batch: int = 32, rate: float = 1.0, seed: int = 7) -> LanguageModel:
    """Embeddings and softmax weights by stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (1 << BITS, SIZE)).astype(np.float32)
    weight = rng.normal(0, 0.1, (SIZE, len(names))).astype(np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    grams = []
    for s in snippets:
        data = np.frombuffer(s, dtype=np.uint8)
        grams.append(np.concatenate([at for at, _, _ in subwords(data, np.array([0, len(data)]))]))
    keep = np.array([i for i, g in enumerate(grams) if len(g)], dtype=np.int64)
    steps = max(1, epochs * len(keep) // batch)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(keep)
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            sizes = np.array([len(grams[i]) for i in rows])
            at = np.concatenate([grams[i] for i in rows])
            begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            mean = np.add.reduceat(embed[at], begin) / sizes[:, None]
            p = softmax(mean @ weight + bias)
            p[np.arange(len(rows)), label[rows]] -= 1
            slow = rate * (1 - step / steps)
            back = p @ weight.T / sizes[:, None]
            weight -= slow * mean.T @ p / len(rows) * 4
            bias -= slow * p.mean(axis=0)
            delta = np.repeat(back.astype(np.float32) * np.float32(slow * 8), sizes, axis=0)
            order_at = np.argsort(at, kind="stable")
            sorted_at = at[order_at]
            heads = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]])
            embed[sorted_at[heads]] -= np.add.reduceat(delta[order_at], heads)
            step += 1
    return LanguageModel(list(names), (embed @ weight).astype(np.float32), bias.astype(np.float64))


def calibrate(model: LanguageModel, logits: np.ndarray, truth: np.ndarray, accepted: float = ACCEPTED) -> None:
    """Temperature by likelihood; the least confidence that accepts that share of what is right."""
    if not len(truth):
        return
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 60))
    rows = np.arange(len(truth))
    loss = [-np.log(softmax(logits / t)[rows, truth] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logits / model.temperature)
    right = p.argmax(axis=1) == truth
    if right.any():
        model.least = float(np.quantile(p.max(axis=1)[right], 1 - accepted, method="lower"))


def fit_languages(spark: SparkSession, docs: DataFrame, rows: int = LABELLED_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Train on half of at most `rows` documents with a language, calibrate on the other half.

    Returns None if no document has a language.
    """
    labels = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col), F.col(lang_col).cast("string").alias("language"))
    sample = labelled_sample(spark, docs, labels, "language", rows, id_col, text_col)
    low, high = SNIPPET_BYTES

    def draw(batches):
        for batch in batches:
            texts, label = [], []
            for text, name in zip(pc.utf8_lower(batch.column(0)).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode()
                rng = np.random.default_rng(len(data) * 1_000_003 + sum(data[:64]))
                for _ in range(SNIPPETS):
                    size = int(rng.integers(low, high))
                    at = int(rng.integers(0, max(1, len(data) - size)))
                    texts.append(data[at : at + size])
                    label.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(label, pa.string())], ["text", "label"])

    got = sample.where("half = 0").select("text", "label").mapInArrow(draw, "text binary, label string").toPandas().sort_values(["label", "text"])
    if not len(got):
        return None
    names = sorted(set(got["label"]))
    number = {x: i for i, x in enumerate(names)}
    model = train([bytes(t) for t in got["text"]], got["label"].map(number).to_numpy(), names)
    shared = spark.sparkContext.broadcast(model)

    def weigh(batches):
        for batch in batches:
            for part in slices(batch):
                logits, size = shared.value.logits(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(list(logits), pa.list_(pa.float64())), part.column(1), pa.array(size)], ["logits", "label", "size"])

    held = sample.where("half = 1").select("text", "label").mapInArrow(weigh, "logits array<double>, label string, size double").toPandas()
    held = held[held["label"].isin(names) & (held["size"] > 0)]
    if len(held):
        calibrate(model, np.stack(held["logits"].to_numpy()), held["label"].map(number).to_numpy())
    return model


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language, confidence, accepted) of every row.

    `language` is the likeliest one; `accepted` is false below the calibrated
    confidence.  A null or empty text, or one of fewer than three bytes, and every
    text if there is no model, has a null language, confidence 0 and isn't accepted.
    Repeated rows and null ids are judged like any other row; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                if shared.value is None:
                    best, top, names, least = np.full(part.num_rows, -1), np.zeros(part.num_rows), [], 0.0
                else:
                    best, top = shared.value.predict(part.column(1))
                    names, least = shared.value.names, shared.value.least
                known = best >= 0
                language = pa.array([*names, None], pa.string()).take(pa.array(np.where(known, best, len(names))))
                yield pa.RecordBatch.from_arrays([part.column(0), language, pa.array(top), pa.array(known & (top >= least))], ["doc_id", "language", "confidence", "accepted"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, language string, confidence double, accepted boolean")
