import itertools

import numpy as np
import pyarrow as pa
import pytest

from mergeloom.llm import languages, quality, toxicity
from mergeloom.llm.text import text_buffers
from mergeloom.llm.transducer import Transducer
from tables import SF


def score(text, lexicon=None):
    total, threat, n = toxicity.score_texts(pa.array([text], pa.string()), lexicon or toxicity.built_in())
    return round(float(total[0]), 6), round(float(threat[0]), 6), int(n[0])


def test_clauses_not_words_are_scored():
    assert score("You are an idiot.")[0] == 1.5
    assert score("An idiot of a machine")[0] == 1.0
    assert score("You are not an idiot.")[0] == 0.2
    assert score("She said you are an idiot")[0] == 0.4
    assert score("She said: no. An idiot!")[0] == 1.0
    assert score("I will kill you")[:2] == (2.0, 2.0)
    assert score("I will not kill you")[:2] == (0.0, 0.0)
    assert score("kill the process")[:2] == (0.0, 0.0)
    assert score("He said I will kill you")[1] < toxicity.THREAT_WEIGHT
    assert score("Idiot, moron")[0] == 2.0
    assert score("") == score(None) == (0.0, 0.0, 0)
    assert score("IDIOT!! YOU!!")[0] == 1.0


def by_rules(symbols):
    """(score, threat) of a clause by plain rules, mark by mark."""
    weight = {"A": (1.0, 1.5), "a": (0.2, 0.2), "Q": (0.4, 0.4), "q": (0.1, 0.1), "B": (0.0, toxicity.THREAT_WEIGHT), "b": (0.0, 0.0), "G": (0.4, 0.4), "g": (0.0, 0.0)}
    marks, intent, denied, told = [], 0, "", False
    for x in symbols:
        y = {"I": "A", "H": "B" if intent else "O"}.get(x, x)
        intent = 3 if x in "FS" else 0 if x == "P" else max(0, intent - (x not in "CN"))
        z = y.lower() if denied and y in "AB" else y
        denied = "just" if y == "N" else {"just": {**dict.fromkeys("CFTSY", "light"), "O": "far"}, "light": {"C": "light", "F": "light", "O": "far"}, "far": {"C": "far", "F": "far"}}.get(denied, {}).get(y, "")
        marks.append({"A": "Q", "B": "G", "a": "q", "b": "g"}.get(z, z) if told else z)
        told |= z == "R"
    total = threat = 0.0
    for k, x in enumerate(marks):
        if x in weight:
            before = "".join(marks[max(0, k - 3) : k]).rpartition("P")[2]
            behind = "".join(marks[k + 1 : k + 4]).partition("P")[0]
            aimed = "T" in before + behind or x == "A" and "Y" in before
            total += weight[x][aimed]
            threat += weight[x][aimed] if x in "BGbg" else 0
    return total, threat


def test_documents_by_rules():
    words = {x: [w for w in line.split() if w.isascii()] for x, line in toxicity.VOCABULARY.items()} | {"O": ["table", "green", "walk"], "P": [","]}
    rng = np.random.default_rng(12)
    texts, want = [], []
    for _ in range(400):
        total, threat, n, text = 0.0, 0.0, 0, ""
        for _ in range(rng.integers(0, 4)):
            symbols = rng.choice(list("IIHHTTYNRFSCPOO"), rng.integers(1, 9)).tolist()
            while symbols[0] == "P":
                symbols.pop(0)
                symbols.append("O")
            symbols = [x for k, x in enumerate(symbols) if x != "P" or symbols[k - 1] != "P"]
            text += " ".join(rng.choice(words[x]) for x in symbols).replace(" ,", ",") + ". "
            score_, threat_ = by_rules(symbols)
            total, threat, n = total + score_, max(threat, threat_), n + sum(x != "P" for x in symbols)
        texts.append(text)
        want.append((round(total, 6), n))
        assert score(text)[0] == round(total, 6), text
        assert score(text)[2] == n and abs(score(text)[1] - threat) < 1e-6 or "H" not in text, text


def test_contractions_and_distant_negations():
    for text in ("You aren't an idiot", "You aren\u2019t an idiot", "You are not an idiot", "You are never ever an idiot", "You can't be such an idiot"):
        assert score(text)[0] == 0.2
    assert score("It's not here you idiot")[0] == 1.5
    assert score("We won the game you idiot")[0] == 1.5
    for text in ("I won't kill you", "I won\u2019t kill you", "I am not going to kill you", "I will never ever kill you", "we couldn't hurt you"):
        assert score(text)[:2] == (0.0, 0.0)


def test_threats_need_intent_and_a_target():
    for text in ("I will kill you", "I'll kill you", "we are going to hurt you", "Go kill yourself", "Ich werde dich töten", "je vais te tuer"):
        assert score(text)[1] >= toxicity.THREAT_WEIGHT
    for text in ("If you kill your process", "Kill your process", "I will kill your process", "They shoot; you watch", "The shots killed them", "Did the storm hurt you?"):
        assert score(text)[:2] == (0.0, 0.0)
    assert score("Your idiot brother")[0] == 1.5


def all_paths(machine, symbols):
    best = None
    todo = [(machine.start, 0.0, 0)]
    while todo:
        state, w, k = todo.pop()
        if k == len(symbols):
            if state in machine.final:
                w += machine.final[state]
                best = w if best is None or w > best else best
            continue
        for _, v, to in machine.arcs.get(state, {}).get(symbols[k], ()):
            todo.append((to, w + v, k + 1))
    return best


def test_composition_and_best_path_by_brute_force():
    a = Transducer(0, {0: 0.0, 1: 0.5})
    a.arc(0, "x", "p", 1.0, 0).arc(0, "x", "q", 0.0, 1).arc(1, "x", "p", 2.0, 0).arc(1, "y", "q", -1.0, 1).arc(0, "y", "p", 0.0, 0)
    b = Transducer(0, {0: 0.0, 1: -0.25})
    b.arc(0, "p", "1", 0.0, 1).arc(0, "q", "1", 3.0, 0).arc(1, "p", "2", 1.0, 0).arc(1, "q", "2", 0.0, 1)
    both = a.compose(b).numbered()
    for n in range(5):
        for symbols in itertools.product("xy", repeat=n):
            want = None
            paths = [(a.start, b.start, 0.0)]
            for s in symbols:
                paths = [(i, j, w + v + u) for p, q, w in paths for o, v, i in a.arcs.get(p, {}).get(s, ()) for _, u, j in b.arcs.get(q, {}).get(o, ())]
            ends = [w + a.final[p] + b.final[q] for p, q, w in paths if p in a.final and q in b.final]
            want = max(ends, default=None)
            assert both.best(symbols) == want
    machine = toxicity.grammar()
    for symbols in itertools.product(toxicity.SYMBOLS, repeat=4):
        assert machine.best(symbols) == all_paths(machine, symbols)


def test_toxicity_of_odd_documents(spark, odd_docs, no_docs, no_labels, odd_labels):
    for labels in (no_labels, odd_labels):
        lexicon = toxicity.fit_lexicon(spark, odd_docs, labels)
        got = toxicity.score_documents(odd_docs, lexicon).collect()
        assert len(got) == odd_docs.count() and not any(r.toxic for r in got)
        kept = toxicity.keep_clean(odd_docs, lexicon)
        assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    lexicon = toxicity.fit_lexicon(spark, no_docs, no_labels)
    assert toxicity.score_documents(no_docs, lexicon).count() == toxicity.keep_clean(no_docs, lexicon).count() == 0


def test_learned_insults(spark):
    words = [f"w{i}x" for i in range(300)]
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(400):
        text = [words[k] for k in rng.integers(0, 300, 60)]
        toxic = i % 5 == 0
        if toxic:
            for k in rng.integers(0, 60, 3):
                text[k] = "blurgh" + "abc"[int(rng.integers(0, 3))]
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lexicon = toxicity.fit_lexicon(spark, docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = {r.doc_id: r.toxic for r in toxicity.score_documents(docs, lexicon).collect()}
    assert got == {i: bool(t) for i, t in labels}
    assert score("such a blurghzz", lexicon)[0] == 1.0


def test_quality_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit_quality(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in quality.score_documents(docs, model).collect()}
    raw = np.zeros(1 << quality.BITS)
    texts = {r.doc_id: r.text for r in docs.collect()}

    def one_bucket(data: bytes) -> int:
        return int(quality.buckets(pa.array([data.decode()]))[0][0])

    for text in texts.values():
        at, _, _ = quality.buckets(pa.array([text]))
        np.add.at(raw, at, 1)
    assert np.array_equal(raw, quality.count_buckets(docs.select("text")))
    for i, text in list(texts.items())[:40]:
        tokens = text.split()
        at, _, _ = quality.buckets(pa.array([text]))
        assert len(at) == 2 * len(tokens) - 1
        assert sorted(at[: len(tokens)].tolist()) == sorted(one_bucket(t.encode()) for t in tokens)
        assert got[i].score == pytest.approx(float(np.mean(model.ratio[at]))) and got[i].keep == (got[i].score >= model.threshold)


def test_quality_counts_all_trusted_documents(spark):
    docs = spark.range(12_000).selectExpr("id AS doc_id", "concat(IF(id % 3 = 0, 'poor junk', 'fine prose'), ' w', id % 997, IF(id % 3 = 0, ' end', ' and more')) AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 3 > 0 AS INT) AS quality")
    model = quality.fit_quality(spark, docs, labels)
    trusted, raw = quality.count_buckets(docs.where("doc_id % 3 > 0").select("text")), quality.count_buckets(docs.select("text"))
    assert trusted.sum() == 8000 * 9 and np.array_equal(model.ratio, quality.log_ratio(trusted, raw))


def test_quality_threshold_by_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(spark, docs, labels)
    rows = docs.join(labels, "doc_id").where("text IS NOT NULL AND quality IS NOT NULL").select("text", "quality").collect()
    grams = [np.bincount(quality.buckets(pa.array([r.text]))[0], minlength=1 << quality.BITS) for r in rows]
    trusted, raw = sum(g for g, r in zip(grams, rows) if r.quality == 1), quality.count_buckets(docs.select("text"))
    scores = [float(quality.log_ratio(trusted - g * r.quality, raw) @ g) / max(1, g.sum()) for g, r in zip(grams, rows)]
    cost = {c: sum(quality.GOOD_WEIGHT * (s < c) if r.quality else s >= c for s, r in zip(scores, rows)) for c in scores}
    assert len(set(r.quality for r in rows)) == 2
    assert model.threshold == pytest.approx(min(cost, key=lambda c: (cost[c], c)))


def test_quality_of_odd_documents(spark, odd_docs, no_docs, no_labels, odd_labels):
    model = quality.fit_quality(spark, odd_docs, no_labels)
    assert all(r.keep for r in quality.score_documents(odd_docs, model).collect())
    model = quality.fit_quality(spark, odd_docs, odd_labels)
    got = quality.score_documents(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(r.score == 0 for r in got if r.n_grams == 0)
    kept = quality.keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.keep for r in got)
    assert quality.score_documents(no_docs, quality.fit_quality(spark, no_docs, no_labels)).count() == 0


def test_quality_separates_labelled_documents(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score_documents(docs, quality.fit_quality(spark, docs, labels)).join(labels, "doc_id").select("quality", "keep").collect()
    good, bad = [r.keep for r in got if r.quality == 1], [r.keep for r in got if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.35


def test_languages_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    train = docs.where("doc_id % 2 = 0")
    got = languages.identify(docs.where("doc_id % 2 = 1"), languages.fit_languages(spark, train)).join(docs, "doc_id").collect()
    assert np.mean([r.language == r.lang for r in got]) > 0.98
    assert np.mean([r.accepted for r in got]) > 0.97


def test_language_sums_by_brute_force():
    rng = np.random.default_rng(1)
    model = languages.LanguageModel(["a", "b"], rng.normal(size=(1 << languages.BITS, 2)).astype(np.float32), np.array([0.1, -0.2]))
    texts = ["Hello, World", "", "ab", "abc", "Ünï 12", "x" * 50]
    logits, size = model.logits(pa.array(texts))
    for text, row, n in zip(texts, logits, size):
        data, offsets = text_buffers(pa.array([text.lower()]))
        grams = [int(g) for at, _, _ in languages.subwords(data, offsets) for g in at]
        assert n == len(grams) == sum(max(0, len(data) - k + 1) for k in (3, 4))
        want = (model.table[grams].mean(axis=0) if grams else 0) + model.bias
        assert np.allclose(row, want, atol=1e-5)


def test_noise_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = languages.fit_languages(spark, docs)
    rng = np.random.default_rng(2)
    noise = ["".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 30)) for _ in range(30)]
    got = languages.identify(spark.createDataFrame(list(enumerate(noise)), "doc_id bigint, text string"), model).collect()
    assert np.mean([r.accepted for r in got]) < 0.7


def test_languages_of_odd_documents(spark, odd_docs, no_docs):
    got = languages.identify(odd_docs, languages.fit_languages(spark, odd_docs)).collect()
    assert len(got) == odd_docs.count()
    for r, d in zip(got, odd_docs.collect()):
        if not d.text:
            assert r.language is None and r.confidence == 0 and not r.accepted
    assert languages.fit_languages(spark, no_docs) is None
    assert languages.identify(no_docs, None).count() == 0
    assert [r.accepted for r in languages.identify(odd_docs, None).collect()] == [False] * odd_docs.count()
