import itertools
import time

import numpy as np
import pytest

from mergeloom.llm import html, neighbours
from tables import SF


def test_blocks_of_messy_pages():
    page = '<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=1>Home</a><li><a href=2>More &amp; more</a></ul></nav><!-- <p>no</p> --><div class="main x"><p>One <b>bold<br>word</b><p>Two</div>tail<script>unclosed'
    got = [(b.text, b.path[-1] if b.path else "") for b in html.leaf_blocks(page)]
    assert got == [("Home", "li"), ("More & more", "li"), ("One bold word", "p"), ("Two", "p"), ("tail", "body")]
    assert html.leaf_blocks(page)[0].linked == 4 and "main" in html.leaf_blocks(page)[2].names
    assert html.leaf_blocks("") == [] and [b.text for b in html.leaf_blocks("plain < text")] == ["plain < text"]
    assert [b.text for b in html.leaf_blocks("<p" * 2000 + "x")] != []


def test_viterbi_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(50):
        field = html.ChainField(rng.normal(size=len(html.NAMES)), rng.normal(size=(2, 2)))
        feats = [[int(f) for f in rng.integers(0, len(html.NAMES), 3)] for _ in range(int(rng.integers(1, 9)))]

        def weight(labels):
            w = sum(field.weight[f] for fs, y in zip(feats, labels) for f in fs if y)
            return w + sum(field.step[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=len(feats)), key=weight)
        assert weight(field.decode(feats)) == pytest.approx(weight(best))
    assert html.ChainField(np.zeros(len(html.NAMES)), np.zeros((2, 2))).decode([]) == []


def test_held_out_pages(spark):
    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")
    field = html.fit_field(pages.where("page_id % 2 = 0"))
    right = total = blind = 0
    for r in pages.where("page_id % 2 = 1").collect():
        blocks = html.leaf_blocks(r.html)
        want = html.marked_labels(blocks)
        right += sum(a == b for a, b in zip(field.decode(html.features(blocks)), want))
        plain = html.leaf_blocks(r.html.replace("article>", "div>").replace("nav>", "div>").replace("footer>", "div>"))
        blind += sum(a == b for a, b in zip(field.decode(html.features(plain)), want))
        total += len(blocks)
    assert right / total > 0.98 and blind / total > 0.85


def test_odd_pages(spark):
    rows = [(1, None, "u"), (2, "", "u"), (3, "<p></p>", "u"), (4, "no markup at all, but a sentence of some length.", "u"), (4, "<p>x", "u"), (None, "<div>y</div>", "u"), (5, "<div>" * 3000 + "deep" + "<p>text. " * 3000, "u")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, text string")
    got = html.extract(pages, html.fit_field(pages)).collect()
    assert [r.page_id for r in got] == [r[0] for r in rows]
    assert got[0].text is None and got[1].text == "" and got[2].n_blocks == 0 and got[6].n_blocks == 3001
    empty = spark.createDataFrame([], "page_id bigint, html string")
    assert html.extract(empty, html.fit_field(empty)).count() == 0


def brute(ids, x, k):
    x = neighbours.unit(x.astype(np.float32))
    s = np.round((x @ x.T).astype(float), 6)
    out = {}
    for i in range(len(ids)):
        near = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i])[:k]
        out[ids[i]] = [n for _, n in near]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.vec_id, []).append(r.neighbour_id)
    return np.mean([len(set(found.get(i, ())) & set(n)) / len(n) for i, n in want.items()])


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_recall_of_every_row(spark, sf):
    df = spark.read.parquet(f"{SF.replace('0.001', sf)}/embeddings.parquet")
    rows = df.collect()
    want = brute([r.vec_id for r in rows], np.array([r.embedding for r in rows]), 10)
    got = neighbours.nearest(spark, df).collect()
    assert recall(got, want) >= 0.9
    assert {r.vec_id for r in got} == set(want) and len(got) == 10 * len(want)


def test_parts_are_split_again(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 60)
    monkeypatch.setattr(neighbours, "FANOUT", 5)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    df = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet")
    rows = df.collect()
    want = brute([r.vec_id for r in rows], np.array([r.embedding for r in rows]), 10)
    got = neighbours.nearest(spark, df, every=5).collect()
    assert recall(got, {i: n for i, n in want.items() if i % 5 == 0}) >= 0.9
    assert {r.vec_id for r in got} == {i for i in want if i % 5 == 0}


def test_few_parts_and_equal_vectors(spark, monkeypatch):
    """A third of all vectors are equal and one is far from all: every query still gets k neighbours, in right order."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    monkeypatch.setattr(neighbours, "PART_ROWS", 20)
    monkeypatch.setattr(neighbours, "FANOUT", 4)
    rng = np.random.default_rng(3)
    x = np.concatenate((np.tile(rng.normal(size=6), (70, 1)), rng.normal(size=(139, 6)), [[9.0, -9, 9, -9, 9, -9]])).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = neighbours.nearest(spark, df).collect()
    assert len(got) == 10 * len(x)
    assert recall(got, brute(list(range(len(x))), x, 10)) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.9, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, [1.0, None]), (None, [1.0, 0.0]), (10, []), (3, [0.9, 0.1]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id bigint, embedding array<float>, part string, stored int")
    got = [(r.vec_id, r.rank, r.neighbour_id) for r in sorted(neighbours.nearest(spark, df, k=2).collect(), key=lambda r: (r.vec_id, r.rank))]
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2), (11, 1, 3), (11, 2, 1)]
    assert neighbours.nearest(spark, df.limit(0)).count() == 0
    assert neighbours.nearest(spark, df.where("vec_id = 1")).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = neighbours.unit(rng.normal(size=(600, 8)).astype(np.float32))
    row, col, _ = neighbours.top_neighbours(x, np.arange(600), x, np.arange(600), 5)
    graph = [col[row == i] for i in range(600)]
    part = neighbours.balanced_parts(x, graph, 6)
    size = np.bincount(part, minlength=6)
    assert size.max() <= np.ceil(100 * 1.05) and size.sum() == 600
    cut = np.mean([part[a] != part[b] for a, b in zip(row, col)])
    mixed = rng.permutation(part)
    assert cut < 0.7 * np.mean([mixed[a] != mixed[b] for a, b in zip(row, col)])


@pytest.mark.parametrize("unit", ["<a", "<a ", "<a x='", '<a x="', "<script", "<script ", "<!", "<!--", "<?", "</", "</b", "<div>", "<b>", "</x>", "<div></x>", "<p>a</p>", "<a href=x>y", "&amp", "<style></style ", "a <b c='\"' ", "<i><b></i>"])
def test_long_pages_take_linear_time(unit):
    page = "<" + unit[1:] * 1_000_000 if unit == "<a" else unit * (1_000_000 // len(unit))
    began = time.process_time()
    html.leaf_blocks(page)
    assert time.process_time() - began < 12


def test_unclosed_names():
    began = time.process_time()
    assert [b.text for b in html.leaf_blocks("<" + "a" * 1_000_000)] == ["<" + "a" * 1_000_000]
    assert time.process_time() - began < 1


def test_gradient_by_differences():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (3, 5, len(html.NAMES))).astype(float)
    here = np.arange(5) < np.array([[5], [3], [1]])
    x, y = x * here[..., None], rng.integers(0, 2, (3, 5)) * here
    weight, step = rng.normal(size=len(html.NAMES)), rng.normal(size=(2, 2))
    value, grads = html.loss(weight, step, x, y, here, 0.01)
    total = 0.0
    for k in range(3):  # the likelihood itself, over all labellings
        n = int(here[k].sum())
        score = lambda labels: sum(weight @ x[k, t] * labels[t] for t in range(n)) + sum(step[a, b] for a, b in zip(labels, labels[1:]))  # noqa: B023, E731
        total += np.log(sum(np.exp(score(z)) for z in itertools.product((0, 1), repeat=n))) - score(y[k, :n].tolist())
    assert value == pytest.approx(total / 3 + 0.005 * ((weight**2).sum() + (step**2).sum()))
    for array, g in zip((weight, step), grads):
        for at in list(np.ndindex(array.shape))[:60]:
            kept, sides = array[at], []
            for d in (1e-5, -1e-5):
                array[at] = kept + d
                sides.append(html.loss(weight, step, x, y, here, 0.01)[0])
            array[at] = kept
            assert g[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4, abs=1e-6)
