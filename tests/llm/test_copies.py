import random
import re

import numpy as np
import pyarrow as pa
import pytest

from mergeloom.llm import neardups, passages, suffixes
from mergeloom.llm.graphs import components
from mergeloom.llm.sigtree import Block, join_block, link_block

WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def grams(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute_groups(rows, threshold=neardups.THRESHOLD):
    """Sorted (doc_id, class_id, n_links) and, by place, the class's least place."""
    sets = [grams(t or "") for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x in range(len(rows)):
        for y in range(x + 1, len(rows)):
            if sets[x] and sets[y] and len(sets[x] & sets[y]) >= threshold * len(sets[x] | sets[y]):
                links[x] += 1
                links[y] += 1
                root[max(find(x), find(y))] = min(find(x), find(y))
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return ordered((i, least[find(k)], links[k]) for k, (i, _) in enumerate(rows)), [find(k) for k in range(len(rows))]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x) for x in r])


def brute_pairs(rows, threshold=neardups.THRESHOLD):
    """Pairs of different sets by the least ids that have them."""
    least = {}
    for i, t in rows:
        if g := frozenset(grams(t or "")):
            least.setdefault(g, []).append(i)
    least = [(g, min((i for i in v if i is not None), default=None)) for g, v in least.items()]
    out = []
    for k, (a, i) in enumerate(least):
        for b, j in least[k + 1 :]:
            if len(a & b) >= threshold * len(a | b):
                out.append((*sorted((i, j), key=lambda x: (x is None, x)), round(len(a & b) / len(a | b), 9)))
    return ordered(out)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    vocabulary = ["w%d" % i for i in range(3000)]
    rows, i = [], 0
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 3, 8, 60, 200)))]
        for _ in range(rng.choice((1, 1, 2, 5, 12))):
            words = list(base)
            for _ in range(rng.choice((0, 0, 1, 4, 20))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((i, " ".join(words)))
            i += 1
    return rows


def test_groups_by_brute_force(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string")
    assert ordered(neardups.near_groups(spark, docs).collect()) == brute_groups(corpus)[0]
    got = ordered((r.doc_id, r.other_id, round(r.jaccard, 9)) for r in neardups.near_pairs(spark, docs).collect())
    assert got == brute_pairs(corpus)


def test_large_buckets_and_blocks_are_cut_exactly(spark, corpus, monkeypatch):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string")
    monkeypatch.setattr(neardups, "BLOCK_CLASSES", 4)
    monkeypatch.setattr(neardups, "LINK_CLASSES", 3)
    assert ordered(neardups.near_groups(spark, docs).collect()) == brute_groups(corpus)[0]


def long_rows():
    """Ids that are shared by, and missing from, long texts, some copies and near copies of others."""
    rng = random.Random(5)
    text = {k: " ".join(f"{k}{rng.randrange(900)}" for _ in range(200)) for k in "ABCD"}
    near = text["D"].replace(" ", " new ", 1)
    return [(1, text["C"]), (8, text["C"]), (8, text["B"]), (2, text["B"]), (8, text["A"]), (None, text["A"]), (9, text["D"]), (9, near), (9, text["D"]), (None, near), (None, near), (3, text["A"] + " more")]


@pytest.mark.parametrize("turn", [1, -1])
def test_shared_ids_and_long_texts(spark, turn):
    rows = long_rows()[::turn]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want, root = brute_groups(rows)
    assert ordered(neardups.near_groups(spark, docs).collect()) == want
    kept = [(r.doc_id, r.text) for r in neardups.one_of_each(spark, docs).collect()]
    assert len(kept) == len(set(root)) == 4 and set(kept) <= set(rows)
    assert sorted(i for i, _ in kept) == [1, 2, 3, 9]
    assert {root[rows.index(k)] for k in kept} == set(root)


def test_trees_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        base = rng.integers(0, 1 << 62, 400)
        sets = []
        for _ in range(int(rng.integers(0, 80))):
            pick = rng.choice(base[: int(rng.integers(5, 400))], int(rng.integers(1, 60)))
            sets.append(np.unique(pick).astype(np.uint64))
        bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
        values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        for threshold in (0.1, 0.5, 1.0):
            side = rng.integers(0, 2, len(sets)) if rng.random() < 0.5 else None
            a, b, j = join_block(values, bounds, threshold, side)
            got = {(int(x), int(y)): float(z) for x, y, z in zip(a, b, j)}
            want = {}
            for x in range(len(sets)):
                for y in range(x + 1, len(sets)):
                    s = len(np.intersect1d(sets[x], sets[y]))
                    v = s / (len(sets[x]) + len(sets[y]) - s)
                    if v >= threshold and (side is None or side[x] != side[y]):
                        want[x, y] = v
            assert got == pytest.approx(want)
            weight = rng.integers(1, 9, len(sets))
            links, root = link_block(values, bounds, weight, threshold, side)
            label = list(range(len(sets)))
            for x, y in want:
                label = [min(label[x], label[y]) if v in (label[x], label[y]) else v for v in label]
            assert links.tolist() == [sum(weight[y if x == k else x] for x, y in want if k in (x, y)) for k in range(len(sets))]
            assert root.tolist() == label


def test_near_copies_are_accepted_whole():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 60)
    sets = [np.unique(np.append(base, rng.integers(0, 1 << 62, 4))).astype(np.uint64) for _ in range(700)]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    block = Block(np.concatenate(sets), bounds)
    assert all(sure for sure, *_ in block.found(0.5))
    links, root = link_block(np.concatenate(sets), bounds, np.full(700, 2), 0.5)
    assert (links == 2 * 699).all() and not root.any()


def test_one_of_each_group_stays(spark, corpus):
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in corpus], "doc_id bigint, text string, _gone string, a bigint")
    kept = neardups.one_of_each(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute_groups(corpus)[0]})


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert ordered(neardups.near_groups(spark, odd_docs).collect()) == brute_groups(rows)[0]
    kept = neardups.one_of_each(spark, odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1  # of two equal rows one stays
    assert neardups.near_groups(spark, no_docs).count() == neardups.near_pairs(spark, no_docs).count() == neardups.one_of_each(spark, no_docs).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (4, 5), (5, 6), (6, 7), (7, 8), (12, 12), (11, 10)]
    got = {r.node: r.group for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 9)}, 10: 10, 11: 10}


# -- suffixes ----------------------------------------------------------------


@pytest.mark.parametrize("spool", [False, True])
def test_suffix_arrays_by_brute_force(tmp_path, monkeypatch, spool):
    rng = np.random.default_rng(4)
    for k in range(300):
        monkeypatch.setattr(suffixes, "BUCKET_RUNS", int(rng.integers(1, 30)))
        x = rng.integers(0, rng.integers(1, 8), rng.integers(0, 50))
        if k % 3 == 0:
            x = np.repeat(x, rng.integers(1, 5, len(x)))
        if k % 4 == 0:
            x = np.tile(x, 3)
        got = suffixes.suffix_array(x, str(tmp_path) if spool else None, 64)
        want = sorted(range(len(x)), key=lambda i: x[i:].tolist())
        assert got.tolist() == want
        common = suffixes.common_prefixes(x, got, 6)
        for a, b, n in zip(want, want[1:], common[1:]):
            m = 0
            while m < 6 and max(a, b) + m < len(x) and x[a + m] == x[b + m]:
                m += 1
            assert n == m
    assert not list(tmp_path.iterdir())


def brute_states(rows):
    """By row: for each word 0, 1 (in a first occurrence) or 2 (in a later one). Equal rows are one document."""
    windows, state = {}, {}
    for row in set(rows):
        w = WORD.findall((row[1] or "").lower())
        state[row] = [0] * len(w)
        for k in range(len(w) - passages.PASSAGE + 1):
            windows.setdefault(tuple(w[k : k + passages.PASSAGE]), set()).add((row, k))
    for places in windows.values():
        if len(places) > 1:
            first = min(places, key=lambda p: (p[0][0] is None, p[0][0] or 0, UIDS[p[0]], p[1]))
            for row, k in places:
                for j in range(k, k + passages.PASSAGE):
                    state[row][j] = max(state[row][j], 1 + ((row, k) != first))
    return state


UIDS = {}


def with_uids(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in docs.select("*", passages._uid(docs, "doc_id", "text").alias("uid")).collect():
        UIDS[r.doc_id, r.text] = r.uid
    return docs


def states(rows, spans):
    """States of rows, of which no two share an id."""
    got = {r[0]: [0] * len(WORD.findall((r[1] or "").lower())) for r in rows}
    for r in spans:
        for j in range(r.start_word, r.end_word):
            assert not got[r.doc_id][j]
            got[r.doc_id][j] = 1 + r.later
    return {r: got[r[0]] for r in rows}


@pytest.fixture(scope="module")
def passage_rows():
    rng = random.Random(8)
    vocabulary = ["v%d" % i for i in range(900)]
    shared = [[rng.choice(vocabulary) for _ in range(n)] for n in (49, 50, 51, 70, 160)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((0, 10, 40, 120, 300)))]
        for _ in range(rng.choice((0, 1, 1, 2))):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(shared)
        rows.append((i, ", ".join(words)))
    rows.append((60, "again " * 130))
    rows.append((61, "one two three " * 40))
    rows.append((62, rows[5][1].upper()))
    return rows


def test_passages_by_brute_force(spark, passage_rows):
    docs = with_uids(spark, passage_rows)
    want = brute_states(passage_rows)
    for options in ({}, {"shard_words": 300, "memory": 100}):
        spans = passages.repeated_passages(spark, docs, **options).collect()
        assert states(passage_rows, spans) == want


def cut(text, state):
    return [w for w, s in zip(WORD.findall(text), state) if s < 2]


def test_cutting_passages(spark, passage_rows):
    docs = with_uids(spark, passage_rows).selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars", "'x' AS _runs")
    want = brute_states(passage_rows)
    kept = passages.without_copies(spark, docs)
    assert kept.columns == docs.columns
    got = {r.doc_id: r for r in kept.collect()}
    for row in passage_rows:
        words = cut(row[1], want[row])
        if not words and row[1]:
            assert row[0] not in got
        else:
            assert WORD.findall(got[row[0]].text) == words and got[row[0]].n_chars == len(got[row[0]].text)
    assert passages.cut_words("a, b c. D", [(1, 3)]) == "a, D"
    assert passages.cut_words("ä b", [(0, 1)]) == "b" and passages.cut_words("a b!", [(0, 2)]) == ""


@pytest.mark.parametrize("turn", [1, -1])
def test_passages_of_shared_ids(spark, turn):
    rows = long_rows()[::turn]
    docs = with_uids(spark, rows)
    want = brute_states(rows)
    expected = ordered((i, " ".join(cut(t, want[i, t]))) for i, t in rows if cut(t, want[i, t]))
    assert ordered((r.doc_id, " ".join(WORD.findall(r.text))) for r in passages.without_copies(spark, docs).collect()) == expected
    spans = sorted((str(r.doc_id), r.end_word - r.start_word, r.later) for r in passages.repeated_passages(spark, docs).collect())
    assert spans == sorted((str(i), n, state == 2) for (i, _), s in want.items() for state in (1, 2) for n in lengths(s, state))


def lengths(states, wanted):
    return [len(x) for x in re.findall(f"{wanted}+", "".join(map(str, states)))]


def test_large_shards_spool(tmp_path, monkeypatch):
    """Half a million words at the registered memory: queues go through files, and the order is right."""
    spooled = []
    spool = suffixes.BucketQueue.spool
    monkeypatch.setattr(suffixes.BucketQueue, "spool", lambda self: (spooled.append(self.held), spool(self)))
    rng = np.random.default_rng(6)
    x = np.repeat(rng.integers(0, 5000, passages.SHARD_WORDS // 2), rng.integers(1, 4, passages.SHARD_WORDS // 2))
    x[300_000:400_000] = x[100_000:200_000]
    got = suffixes.suffix_array(x, str(tmp_path))
    assert spooled and min(spooled) > suffixes.MEMORY and not list(tmp_path.iterdir())
    rank = np.empty(len(x) + 1, dtype=np.int64)
    rank[got], rank[-1] = np.arange(len(x)), -1
    assert len(np.unique(got)) == len(x)
    a, b = got[:-1], got[1:]
    assert ((x[a] < x[b]) | ((x[a] == x[b]) & (rank[a + 1] < rank[b + 1]))).all()


def test_odd_passages(spark, odd_docs, no_docs):
    assert passages.without_copies(spark, odd_docs).count() == odd_docs.count()
    assert passages.repeated_passages(spark, no_docs).count() == passages.without_copies(spark, no_docs).count() == 0
    repeated = spark.createDataFrame([(1, "w " * 3 + "x y z " * 5)] * 3, "doc_id bigint, text string")
    assert passages.repeated_passages(spark, repeated).count() == 0


def test_sketches_of_small_sets():
    values = np.array([5, 9], dtype=np.uint64)
    out = neardups.sketches(values, np.array([0, 1, 2]))
    assert out.shape == (2, neardups.SKETCH) and (out[0] == np.uint64(5) * neardups._FACTORS).all()
    both = neardups.sketches(values, np.array([0, 2]))
    assert (both == np.minimum(out[0], out[1])).all()
    g, bounds = neardups.gram_sets(pa.array(["a b c a b c a", "", None, "x", "A, b; C"], pa.string()))
    assert np.diff(bounds).tolist() == [3, 0, 0, 1, 1]


def test_sketches_tell_similarity():
    rng = np.random.default_rng(1)
    for n in (2, 30, 3000):
        values = rng.integers(0, 1 << 63, 3 * n).astype(np.uint64)
        pairs = [np.sort(values[: 2 * n]), np.sort(values[n:])]  # one third is shared
        out = neardups.sketches(np.concatenate(pairs), np.array([0, 2 * n, 4 * n]))
        assert 20 <= (out[0] == out[1]).sum() <= 60
