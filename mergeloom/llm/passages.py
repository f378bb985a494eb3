"""Operator 7: repeated passages by suffix arrays over shards.

A passage is a window of 50 words (lower-cased runs of letters, digits and non-ASCII
characters); longer repeats are unions of windows.  Every window of every document
that occurs twice anywhere is found:

1. Each window is keyed by the least and the greatest hash of the 8-grams in it.
   Equal windows have equal keys; windows whose key occurs in one run only are
   done, unless the run may repeat itself.
2. Runs of the other windows of one key are snippets.  Equal snippets are reduced to
   one before they are sent, with the place that comes first; equal windows that are
   left meet in the shard of their key.
3. A shard is sorted by external induced sorting (`suffixes`); neighbours in its
   suffix array that share 50 words are the same window.
4. What a snippet's windows turn out to be is joined back to all its places.

A shard's queues spool to the shared folder beyond a memory limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.columns import gather_lists
from mergeloom.llm.samples import fresh_name, parted
from mergeloom.llm.suffixes import MEMORY, common_prefixes, suffix_array
from mergeloom.llm.text import MULT, hash_spans, mix, slices, text_buffers, tidy, tidy_table, words
from mergeloom.session import shared_dir, written

PASSAGE = 50
GRAM = 8
SPAN = PASSAGE - GRAM + 1
SHARD_WORDS = 500_000


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of each text's first word)."""
    data, offsets = text_buffers(pc.utf8_lower(col))
    start, end, first = words(data, offsets, True)
    return mix(hash_spans(data, start, end)), first


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick(x[i : i + width]) for every i."""
    done, out = 1, x
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def window_keys(h: np.ndarray, first: np.ndarray):
    """(start, row, least, greatest, repeating) of every window inside a text; start counts all texts' words.

    `repeating` says that the least 8-gram may come again at once: only then can two
    windows of one run be equal.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(h) < PASSAGE:
        return none, none, h[:0], h[:0], none.astype(bool)
    grams = np.zeros(len(h) - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        grams = grams * np.uint64(MULT) + h[k : len(h) - GRAM + 1 + k]
    grams = mix(grams)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), np.maximum(count - PASSAGE + 1, 0))
    inside = np.maximum(count - PASSAGE + 1, 0)
    start = np.arange(len(row)) - np.repeat(np.cumsum(inside) - inside, inside) + first[:-1][row]
    low = _slide(grams, SPAN, np.minimum)[start]
    of = np.zeros(len(grams) + SPAN - 1, dtype=np.uint64)
    of[start + SPAN - 1] = low
    anchors = np.flatnonzero(_slide(of, SPAN, np.maximum) == grams)
    again = anchors[1:][grams[anchors[1:]] == grams[anchors[:-1]]]
    seen = np.zeros(len(grams) + 1, dtype=np.int64)
    seen[again + 1] = 1
    seen = np.cumsum(seen)
    return start, row, low, _slide(grams, SPAN, np.maximum)[start], seen[start + SPAN] > seen[start]


def _heads(*columns) -> np.ndarray:
    """Places where consecutive equal values begin."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


@tidy
def _keys(batches):
    for batch in batches:
        for part in slices(batch):
            h, first = word_hashes(part.column(1))
            start, row, low, high, again = window_keys(h, first)
            at = _heads(row, low, high)
            key = mix(low[at] * np.uint64(31) + high[at]).view(np.int64)
            n = np.diff(np.append(at, len(start)))
            again = np.logical_or.reduceat(again, at) if len(at) else again
            yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(pa.array(row[at])), pa.array((start - first[:-1][row])[at].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(again)], ["key", "uid", "start", "n", "again"])


@tidy
def _snippets(batches):
    """Runs of candidate windows of one key, with their words."""
    for batch in batches:
        for part in slices(batch):
            h, first = word_hashes(part.column(1))
            start, row, low, high, _ = window_keys(h, first)
            lists = part.column(2)
            flat = lists.flatten()
            owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            begin = flat.field("start").to_numpy().astype(np.int64)
            n = flat.field("n").to_numpy().astype(np.int64)
            inside = np.maximum(np.diff(first) - PASSAGE + 1, 0)
            before = np.concatenate(([0], np.cumsum(inside)))
            mark = np.zeros(len(start) + 1, dtype=np.int64)
            np.add.at(mark, before[owner] + begin, 1)
            np.add.at(mark, before[owner] + begin + n, -1)
            kept = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            if not len(kept):
                continue
            at = _heads(row[kept], low[kept], high[kept], kept - np.arange(len(kept)))
            size = np.diff(np.append(at, len(kept)))
            head = kept[at]
            length = size + PASSAGE - 1
            body = gather_lists(start[head], length, (h >> np.uint64(32)).astype(np.uint32))
            ends = np.concatenate(([0], np.cumsum(length * 4))).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body.tobytes())])
            key = mix(low[head] * np.uint64(31) + high[head]).view(np.int64)
            place = pa.array(row[head])
            yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(place), part.column(3).take(place), pa.array((start - first[:-1][row])[head].astype(np.int32)), blob], ["key", "uid", "doc_id", "start", "words"])


RUNS = "snippet bigint, place int, n int, first boolean, uid bigint, start int"


def repeated_windows(snippets: list[np.ndarray], folder: str | None = None, memory: int = MEMORY) -> list[np.ndarray]:
    """Class of every window of every snippet; equal windows share a class."""
    size = np.array([len(s) for s in snippets], dtype=np.int64)
    begin = np.cumsum(size + 1) - size - 1
    text = np.empty(int((size + 1).sum()), dtype=np.int64)
    text[np.concatenate([np.arange(b, b + n) for b, n in zip(begin, size)]) if len(size) else np.zeros(0, dtype=np.int64)] = np.concatenate(snippets).astype(np.int64) + len(size) if len(size) else 0
    text[begin + size] = np.arange(len(size))
    array = suffix_array(text, folder, memory)
    windows = np.zeros(len(text), dtype=bool)
    windows[np.concatenate([np.arange(b, b + n - PASSAGE + 1) for b, n in zip(begin, size)])] = True
    array = array[windows[array]]
    other = np.ones(len(array), dtype=bool)
    other[1:] = common_prefixes(text, array, PASSAGE)[1:] < PASSAGE
    cls = np.zeros(len(text), dtype=np.int64)
    cls[array] = np.cumsum(other) - 1
    return [cls[b : b + n - PASSAGE + 1] for b, n in zip(begin, size)]


def _shard(table: pa.Table, folder: str | None, memory: int) -> pa.Table:
    """Runs of windows of each snippet that occur elsewhere too; `first` if the first of them all is in the snippet's first place.

    Every snippet comes once, with its first place and whether it has others (`many`).
    """
    table = table.combine_chunks()
    column = lambda c: table.column(c).to_numpy()
    words_of = table.column("words").combine_chunks()
    classes = repeated_windows([np.frombuffer(b.as_buffer(), dtype=np.uint32) for b in words_of], folder, memory)
    n = np.array([len(c) for c in classes], dtype=np.int64)
    cls = np.concatenate(classes)
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(cls)) - np.repeat(np.cumsum(n) - n, n)
    doc = table.column("doc_id").fill_null(0).to_numpy()
    by = np.lexsort((column("start")[of] + place, column("uid")[of], doc[of], column("nameless")[of], cls))
    first = np.zeros(len(cls), dtype=bool)
    heads = _heads(cls[by])
    first[by[heads]] = True
    size = np.bincount(cls)
    keep = np.flatnonzero((size[cls] > 1) | column("many")[of])
    of, place, first = of[keep], place[keep], first[keep]
    heads = _heads(of, first, place - np.arange(len(place)))
    at = of[heads]
    return pa.table({"snippet": column("snippet")[at], "place": place[heads].astype(np.int32), "n": np.diff(np.append(heads, len(of))).astype(np.int32), "first": first[heads], "uid": column("uid")[at], "start": column("start")[at]})


def _uid(docs: DataFrame, id_col: str, text_col: str):
    """What tells rows apart: those that share an id and a text are one document."""
    return F.xxhash64(docs[id_col].cast("bigint"), docs[text_col].cast("string"))


def window_runs(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, memory: int = MEMORY) -> DataFrame:
    """Rows (uid, doc_id, start, n, later): windows start .. start + n - 1 of a document occur elsewhere too."""
    rows = docs.select(_uid(docs, id_col, text_col).alias("uid"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("bigint").alias("doc_id")).where("text IS NOT NULL")
    keys = rows.select("uid", "text").mapInArrow(_keys, "key bigint, uid bigint, start int, n int, again boolean")
    # counted in every task before they are sent; then looked up, as a join that can split hot keys
    hot = keys.groupBy("key").agg(F.count("*").alias("m"), F.max("again").alias("again")).where("m > 1 OR again").select("key")
    met = keys.join(hot, "key", "left_semi")
    spans = written(spark, met.groupBy("uid").agg(F.collect_set(F.struct("start", "n")).alias("spans")), "candidates")
    candidate = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    total = spans.agg(F.sum(candidate)).first()[0] or 0
    shards = max(1, -(-3 * total // shard_words))  # a window brings about six words, and half of them or more are copies
    some, _ = parted(rows, F.col("uid"), spans.select("uid"))
    found = some.join(spans, "uid").select("uid", "text", "spans", "doc_id").mapInArrow(_snippets, "key bigint, uid bigint, doc_id bigint, start int, words binary")
    found = written(spark, found.withColumn("snippet", F.xxhash64("words")), "snippets")
    place = F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "uid", "start")
    one = found.groupBy("snippet").agg(F.min(place).alias("at"), (F.min(place) != F.max(place)).alias("many"), F.first("key").alias("key"), F.first("words").alias("words"))
    one = one.select("snippet", "at.*", "many", "words", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    folder = shared_dir(spark)
    runs = written(spark, one.groupBy("shard").applyInArrow(tidy_table(lambda t: _shard(t, folder, memory)), RUNS), "runs")
    runs = runs.select("snippet", "place", "n", "first", F.col("uid").alias("_uid"), F.col("start").alias("_start"))
    later = ~(F.col("first") & (F.col("uid") == F.col("_uid")) & (F.col("start") == F.col("_start")))
    return found.select("snippet", "uid", "doc_id", "start").join(runs, "snippet").select("uid", "doc_id", (F.col("start") + F.col("place")).alias("start"), "n", later.alias("later"))


def _spans(runs: list[dict]) -> list[tuple[int, int, bool]]:
    """(first word, end word, later) of a document's runs: words in a later window, and other repeated words."""
    stop = max(r["start"] + r["n"] for r in runs) + PASSAGE
    change = np.zeros((2, stop + 1), dtype=np.int64)
    for r in runs:
        change[int(r["later"]), r["start"]] += 1
        change[int(r["later"]), r["start"] + r["n"] + PASSAGE - 1] -= 1
    seen, later = np.cumsum(change, axis=1) > 0
    state = np.where(later, 2, seen.astype(np.int64))
    at = _heads(state)
    return [(int(a), int(b), bool(state[a] == 2)) for a, b in zip(at, np.append(at[1:], stop)) if state[a]]


def repeated_passages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, start_word, end_word, later): words that lie in a passage of 50 words that occurs elsewhere too.

    `later` words lie in a copy of a passage that occurs before (in order of id, then of
    a hash of the text, then of place; rows without an id come last); the others only in
    first occurrences.  Copies within a document count.  Null and empty texts, and those
    of fewer than 50 words, have no passages.  Rows that share an id and a text are one
    document, reported once; those that share an id only are documents of their own.
    Other columns are not read.
    """

    @tidy
    def run(batches):
        for batch in batches:
            out = [(i, *s) for i, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in _spans(runs)]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.bool_()))], ["doc_id", "start_word", "end_word", "later"])

    runs = window_runs(spark, docs, id_col, text_col, **options)
    return runs.groupBy("uid", "doc_id").agg(F.collect_set(F.struct("start", "n", "later")).alias("runs")).select("doc_id", "runs").mapInArrow(run, "doc_id bigint, start_word int, end_word int, later boolean")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between a removed word and the next word."""
    data, offsets = text_buffers(pa.array([text], pa.string()))
    start, end, _ = words(data, offsets, True)
    out, at = [], 0
    raw = data.tobytes()
    for a, b in sorted(spans):
        out.append(raw[at : start[a]])
        at = start[b] if b < len(start) else len(raw)
    out.append(raw[at:])
    return b"".join(out).decode()


def without_copies(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Documents without the passages that occur before them, in the order of `repeated_passages`.

    Columns stay; `n_chars`, where present, is the new length.  A document of which
    nothing but blanks is left goes; one without such passages, or with a null or empty
    text, stays as it is.  Rows that share an id and a text are one document: all of
    them stay, cut alike.
    """
    names = docs.columns
    key, found = fresh_name("_id", names), fresh_name("_runs", names)
    runs = window_runs(spark, docs, **options).where("later").groupBy(F.col("uid").alias(key)).agg(F.collect_set(F.struct("start", "n", "later")).alias(found))
    runs = written(spark, runs, "copies")
    place, number, cols = names.index("text"), names.index("n_chars") if "n_chars" in names else None, len(names)

    @tidy
    def run(batches):
        for batch in batches:
            arrays = list(batch.columns)
            runs = arrays[cols]
            hit = np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False))
            keep = np.ones(batch.num_rows, dtype=bool)
            if len(hit):
                texts = arrays[place].to_pylist()
                sizes = arrays[number].to_pylist() if number is not None else None
                for i in hit.tolist():
                    if texts[i] is None:
                        continue
                    texts[i] = cut_words(texts[i], [(a, b) for a, b, later in _spans(runs[i].as_py()) if later])
                    keep[i] = bool(texts[i].strip())
                    if sizes is not None:
                        sizes[i] = len(texts[i])
                arrays[place] = pa.array(texts, arrays[place].type)
                if sizes is not None:
                    arrays[number] = pa.array(sizes, arrays[number].type)
            yield pa.RecordBatch.from_arrays(arrays[:cols], names).filter(pa.array(keep))

    some, others = parted(docs, _uid(docs, "doc_id", "text"), runs.select(key))
    joined = some.join(runs, _uid(some, "doc_id", "text") == runs[key], "left").drop(key)
    return others.union(joined.mapInArrow(run, docs.schema))
