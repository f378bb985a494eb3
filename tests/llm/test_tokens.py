import gc
import random
import sys
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from mergeloom import Vocabulary
from mergeloom.llm.automaton import compile_automaton, decode_flat, encode_documents
from mergeloom.llm.counts import TokenCounter, count_documents, prove_whole
from mergeloom.llm.packing import Packer, pack, pack_counts, pack_documents
from test_kernels import random_vocabulary


def test_automaton_accepts_exactly_the_encodings():
    rng = random.Random(1)
    for _ in range(150):
        v, letters = random_vocabulary(rng)
        machine = compile_automaton(v)
        for _ in range(10):
            data = b"".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
            assert machine.encode(data) == v.encode(data)
        for a in range(len(v)):
            for b in range(len(v)):
                assert machine.arc(a, b) == (v.encode(v.tokens[a] + v.tokens[b]) == [a, b])


def test_whole_tokens_are_proved():
    v = Vocabulary([b"a", b"b", b"c", b"d", b"bc", b"ab", b"cd", b"abcd"], strict=False)
    assert v.encode(b"abcd") != [7]
    assert prove_whole(v) == {"a", "b", "c", "d", "bc", "ab", "cd"}


def test_counts_and_tokens(spark, vocab, odd_docs, no_docs):
    counter = TokenCounter(vocab, prove_whole(vocab))
    encoded = [(r.doc_id, r.tokens, r.n_tokens, r.round_trip) for r in encode_documents(spark, odd_docs).collect()]
    counts = [(r.doc_id, r.n_tokens) for r in count_documents(spark, odd_docs).collect()]
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert [i for i, *_ in encoded] == [i for i, _ in counts] == [i for i, _ in texts]
    for (_, tokens, n, same), (_, m), (_, text) in zip(encoded, counts, texts):
        if text is None:
            assert tokens is n is same is m is None
        else:
            assert vocab.decode(tokens) == text.encode() and same and n == m == len(tokens) == counter.count(text)
    assert encode_documents(spark, no_docs).count() == count_documents(spark, no_docs).count() == 0


def test_counts_of_many_blanks(vocab):
    counter = TokenCounter(vocab, prove_whole(vocab))
    lines = "    x = 1\n" * 9000
    texts = ["plain words", " " * 40_000, None, " " * 65_536 + "word", lines, "", "a" + " " * 65_536 + "b c", "last one"]
    got = counter.column(pa.array(texts)).to_pylist()
    assert got == [None if t is None else counter.pieces(t) for t in texts]


def test_decoding_emits_labels(vocab):
    machine = compile_automaton(vocab)
    labels, at = machine.labels()
    ids = np.array([15496, 11, 995, 0])
    assert decode_flat(ids, labels, at).tobytes() == b"Hello, world!"
    assert decode_flat(ids[:0], labels, at).tobytes() == b""


class Slow:
    """Sum of squares by trying every open window."""

    def __init__(self, window):
        self.window, self.fill = window, []

    def put(self, size):
        def cost(fills):
            return sum(n * n for level, n in Counter(fills).items() if level < self.window)

        options = [(cost([*self.fill, size]), 0, None)]
        for level in sorted({f for f in self.fill if f + size <= self.window}):
            k = self.fill.index(level)
            options.append((cost([*self.fill[:k], level + size, *self.fill[k + 1 :]]), -level, k))
        _, level, k = min(options, key=lambda o: (o[0], o[1]))
        if k is None:
            self.fill.append(size)
        else:
            self.fill[k] += size
        return -level


def test_packing_minimises_the_sum_of_squares():
    rng = random.Random(2)
    for _ in range(60):
        window = rng.randint(1, 12)
        fast, slow = Packer(window), Slow(window)
        for _ in range(40):
            size = rng.randint(1, window)
            if size < window:
                assert fast.put(size)[1] == slow.put(size)


def test_places_fill_windows_without_overlap():
    rng = random.Random(3)
    sizes = [rng.choice((0, 1, 5, 99, 100, 101, 350)) for _ in range(300)]
    taken = {}
    whole = Counter()
    for item, window, start, item_start, n in pack(sizes, 100):
        assert item_start == whole[item]
        whole[item] += n
        for k in range(start, start + n):
            assert taken.setdefault((window, k), item) == item and k < 100
    assert all(whole[i] == s for i, s in enumerate(sizes)) and len(taken) == sum(sizes)


def test_packing_documents(spark, odd_docs, no_docs):
    got = pack_documents(spark, odd_docs, window=64, shard_docs=4).collect()
    counts = Counter()
    for r in count_documents(spark, odd_docs).collect():
        counts[r.doc_id] += r.n_tokens or 0
    placed = Counter()
    cells = set()
    for r in got:
        placed[r.doc_id] += r.n_tokens
        for k in range(r.start, r.start + r.n_tokens):
            assert (r.shard, r.window, k) not in cells and k < 64
            cells.add((r.shard, r.window, k))
    assert placed == Counter({k: v for k, v in counts.items() if v})
    assert sorted(got) == sorted(pack_documents(spark, odd_docs, window=64, shard_docs=4).collect())
    assert pack_documents(spark, no_docs).count() == 0
    zero = spark.createDataFrame([(1, 0), (2, None)], "doc_id bigint, n_tokens bigint")
    assert pack_counts(spark, zero).count() == 0


def test_merges_side_by_side_are_the_encoding():
    rng = random.Random(4)
    for _ in range(30):
        tokens = [bytes((i,)) for i in range(256)]
        while len(tokens) < 400:
            t = rng.choice(tokens[97:101] + tokens[256:]) + rng.choice(tokens[97:101] + tokens[256:])
            if len(t) <= 12 and t not in tokens:
                tokens.append(t)
        rng.shuffle(tokens)
        v = Vocabulary(tokens)
        counter = TokenCounter(v, frozenset())
        data = [bytes(rng.choice(b"abcd" if rng.random() < 0.9 else range(256)) for _ in range(rng.randint(1, 60))) for _ in range(300)] + [b"a" * n for n in range(1, 60)]
        bounds = np.concatenate(([0], np.cumsum([len(d) for d in data])))
        assert counter.counted(np.frombuffer(b"".join(data), dtype=np.uint8), bounds).tolist() == [len(v.encode(d)) for d in data]
    assert TokenCounter(Vocabulary([bytes((i,)) for i in range(256)]), frozenset()).count("only bytes é") == 13


def test_counts_of_chunks_are_those_of_whole_texts(vocab):
    rng = random.Random(5)
    counter = TokenCounter(vocab, prove_whole(vocab))
    parts = ["the", "Word", "élan", "don't", "x1", "22", ".", ",", "end.", "où?", "a.\nSh", "\n", "\t", " ", "", "你好", "😀", "-", "(so", "I'LL", "’s", "_", "ñ!"]
    texts = ["".join(rng.choice(parts) + rng.choice((" ", " ", "")) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    exact = [sum(len(vocab.encode(p.encode())) for p in counter.pattern.findall(t)) for t in texts]
    assert counter.column(pa.array(texts, pa.string())).to_pylist() == exact


def distinct_words(n: int) -> list[str]:
    rng = random.Random(6)
    return [" ".join("".join(rng.choices("etaoinshrdlu", k=9)) for _ in range(100)) for _ in range(n // 100)]


def test_words_are_counted_without_a_call_each(vocab):
    counter = TokenCounter(vocab, prove_whole(vocab))
    texts, calls = pa.array(distinct_words(20_000)), 0

    def seen(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(seen)
    try:
        counter.column(texts)
    finally:
        sys.setprofile(None)
    assert calls < 10_000


def test_counting_keeps_nothing(vocab):
    counter = TokenCounter(vocab, prove_whole(vocab))
    texts = distinct_words(100_000)
    counter.column(pa.array(texts[:10]))
    gc.collect()
    tracemalloc.start()
    try:
        for k in range(0, len(texts), 100):
            counter.column(pa.array(texts[k : k + 100]))
        gc.collect()
        assert tracemalloc.get_traced_memory()[0] < 1 << 20
    finally:
        tracemalloc.stop()
