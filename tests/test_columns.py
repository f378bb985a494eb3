import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mergeloom import CL, Tokenizer, Vocabulary, read_vocabulary, write_vocabulary
from mergeloom.functions.pieces import CL as CL_PIECES
from mergeloom.functions.pieces import O2 as O2_PIECES
from mergeloom.functions.pieces import PieceEncoder
from mergeloom.operators.chunks import Slices, chunk_bounds, chunk_tokens, longest_prefix, truncate_tokens
from mergeloom.operators.incremental import append_counts, prepend_counts
from mergeloom.operators.intervals import count_range
from mergeloom.operators.vocabulary import batch_totals, decode_by_join, next_match, token_frequency
from mergeloom.sources.ranks import is_loaded, scan_rank_file
from mergeloom.streaming.append import stream_append_counts, stream_token_counts
from test_kernels import CASES

GOLDEN = [("Hello, world!", [15496, 11, 995, 0]), ("hello world", [31373, 995]), ("abc", [39305]), ("abcabc", [39305, 39305]), ("don’t", [9099, 447, 247, 83]), ("a\n \n b", [64, 198, 220, 198, 275]), ("你好A", [19526, 254, 25001, 121, 32]), ("12345", [10163, 2231]), (" ", [220]), ("", []), (None, None)]


@pytest.fixture(scope="module")
def tok(spark):
    return Tokenizer.load(spark)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, text string")


def test_encode_count_decode(tok, texts):
    got = texts.select("i", tok.encode("text").alias("ids"), tok.count("text").alias("n"), tok.encode_pieces(tok.split("text")).alias("slow"), tok.decode(tok.encode("text")).alias("back")).orderBy("i").collect()
    for r, (text, ids) in zip(got, GOLDEN):
        assert r.ids == r.slow == ids and r.back == text
        assert r.n == (None if ids is None else len(ids))


def test_java_patterns(spark, tok):
    o2 = Tokenizer.load(spark, pattern="o2")
    df = spark.createDataFrame([(c[0],) for c in CASES], "text string").select(tok.split("text").alias("cl"), o2.split("text").alias("o2"))
    for r, (_, cl, o2_) in zip(df.collect(), CASES):
        if cl is not None:
            assert r.cl == cl.split("|") and r.o2 == (o2_ or cl).split("|")


@pytest.mark.parametrize("limit", [0, 1, 3, 4, 9])
def test_count_till_limit(tok, texts, limit):
    for r, (_, ids) in zip(texts.select("i", tok.count_till_limit("text", limit).alias("n"), tok.without_pattern().count_raw("text", limit).alias("raw")).orderBy("i").collect(), GOLDEN):
        assert r.n == (len(ids) if ids is not None and len(ids) <= limit else None)


def test_limits_must_not_be_negative(tok):
    with pytest.raises(ValueError):
        tok.count_till_limit("text", -1)
    with pytest.raises(ValueError):
        tok.count_raw("text", -1)
    with pytest.raises(ValueError):
        truncate_tokens(tok, "text", -1)
    with pytest.raises(ValueError):
        tok.raw("text", "unknown")


def test_decode_of_bad_ids(spark, tok):
    df = spark.createDataFrame([(0, [15496]), (1, [50256]), (2, [-1]), (3, []), (4, None), (5, [447])], "i int, ids array<int>")
    want = ["Hello", None, None, "", None, None]
    assert [r.t for r in df.select("i", tok.decode("ids").alias("t")).orderBy("i").collect()] == want
    joined = {r.i: r.data for r in decode_by_join(df, scan_rank_file(spark), "i", "ids").collect()}
    assert joined[0] == b"Hello" and joined[1] is None and joined[3] == b"" and joined[4] is None and joined[5] == tok.vocab.tokens[447]


def test_incomplete_vocabulary_and_custom_pattern(spark):
    small = Tokenizer(spark, Vocabulary([b"a", b"b", b"ab"], strict=False), CL)
    df = spark.createDataFrame([("abab",), ("abc",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(small.encode("t").alias("x")).collect()] == [[2, 2], None, [], None]
    assert [r.x for r in df.select(small.count("t").alias("x")).collect()] == [2, None, 0, None]
    own = Tokenizer.load(spark, pattern=r"a|[^a]+")
    assert df.select(own.split("t").alias("x")).first().x == ["a", "b", "a", "b"]
    assert [r.x for r in df.select(own.without_pattern().split("t").alias("x")).collect()] == [["abab"], ["abc"], [], None]


def test_vocabulary_table(spark, vocab, tmp_path):
    write_vocabulary(spark, vocab, str(tmp_path / "v"))
    back = read_vocabulary(spark, str(tmp_path / "v"))
    assert back.tokens == vocab.tokens and back.splits == vocab.splits and back.next_prefixes == vocab.next_prefixes
    assert is_loaded("/opt/tokenizers/byte_bpe_50k.tiktoken") and not is_loaded("elsewhere")
    with pytest.raises(TypeError):
        Tokenizer(spark, None)


def test_sql_functions(spark, tok, texts):
    tok.register("t")
    texts.createOrReplaceTempView("texts")
    r = spark.sql("SELECT t_encode_pieces(array('Hello', ',')) a, t_count_pieces(array('Hello', ',')) b, t_decode(array(15496)) c").first()
    assert (r.a, r.b, r.c) == ([15496, 11], 2, "Hello")
    whole = spark.sql("SELECT i, t_encode(text) a, t_count(text) b FROM texts ORDER BY i").collect()
    assert [r.a for r in whole] == [ids for _, ids in GOLDEN]
    assert [r.b for r in whole] == [None if ids is None else len(ids) for _, ids in GOLDEN]
    tok.without_pattern().register("raw")
    assert spark.sql("SELECT raw_count('Hello, world!') n").first().n == len(tok.vocab.encode(b"Hello, world!"))


def test_totals_and_frequency(tok, texts):
    encoded = texts.select(tok.encode("text").alias("ids"))
    r = batch_totals(encoded, "ids").first()
    assert (r.n_texts, r.total_tokens) == (len(GOLDEN), sum(len(x or []) for _, x in GOLDEN))
    assert {x.token: x.n for x in token_frequency(encoded, "ids").collect()}[39305] == 3
    assert batch_totals(encoded.limit(0), "ids").first().total_tokens == 0


def test_next_match(spark):
    df = spark.createDataFrame([(0, "Hello there"), (1, ""), (2, None), (3, "Hello there")], "i int, t string")
    got = {r.i: r.id for r in next_match(df, scan_rank_file(spark), "t", 128).collect()}
    assert got == {0: 15496, 1: None, 2: None, 3: 15496}


LONG = "The quick brown fox, jumps over   the lazy dog.\n\n It doesn't stop: " * 8 + "x" * 90 + " ünïcödé 你好你好"


@pytest.mark.parametrize("limit, overlap", [(1, 0), (7, 0), (7, 3), (50, 10), (1000, 5)])
def test_chunks(spark, tok, limit, overlap):
    from mergeloom.functions.pieces import PieceEncoder

    encode = PieceEncoder(tok.vocab.encode_short)
    count = lambda s: len(encode.text(s)) >> 2
    got = chunk_bounds(LONG, limit, overlap, count, tok.vocab.max_len, True)
    assert got[0][0] == 0 and got[-1][1] == len(LONG)
    for (a, b, n), (c, d, _) in zip(got, got[1:]):
        assert a < c <= b < d
        assert count(LONG[c:b]) <= overlap
    for a, b, n in got:
        assert n == count(LONG[a:b]) and (n <= limit or b - a == 1)
    df = spark.createDataFrame([(LONG,), ("",), (None,)], "t string")
    rows = [r.c for r in df.select(chunk_tokens(tok, "t", limit, overlap).alias("c")).collect()]
    assert [tuple(x) for x in rows[0]] == got and rows[1:] == [[], None]


PARTS = ["The", " concerning", " environmental", " a", "  ", "   b", " ", "\n", "\r\n", "\n\n  x", "\t", "don't", "'ll", "/", "//\n", " ...", "12345", " 9", "你好", "é", "\u2019", "\u00a0", "\u3000z", "\x1c", "\x85", "\u180e", "_", "(\n", "HTTPServer", " İ"]


@pytest.mark.parametrize("pattern", [CL_PIECES, O2_PIECES, None])
def test_cuts_are_the_longest(vocab, pattern):
    if pattern is None:
        count = lambda s: len(vocab.encode(s.encode()))
    else:
        encode = PieceEncoder(vocab.encode_short, pattern)
        count = lambda s: len(encode.pieces(s)) >> 2
    rng = random.Random(7)
    for _ in range(120):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 24)))
        slices = Slices(text, count, vocab.max_len, pattern is not None)
        n = len(text)
        for _ in range(6):
            start, limit = rng.randrange(n), rng.randint(1, 12)
            end = slices.prefix(start, limit)
            assert end == max((e for e in range(start + 1, n + 1) if count(text[start:e]) <= limit), default=start), (text, start, limit)
            stop = rng.randint(start + 1, n)
            assert slices.size(start, stop) == count(text[start:stop]), (text, start, stop)
            back = slices.tail(start, stop, limit)
            assert back == min((b for b in range(start + 1, stop) if count(text[b:stop]) <= limit), default=stop), (text, start, stop, limit)


@pytest.mark.parametrize("name", ["cl", "o2"])
def test_cuts_count_each_word_once(spark, vocab, name):
    from mergeloom.operators.chunks import Words, _counter
    from mergeloom.functions.columns import worker_encoder

    pattern = Tokenizer(spark, vocab, name).pattern
    plain, words = _counter(vocab, pattern)
    encoder = worker_encoder(vocab, pattern)
    rng = random.Random(11)
    more = [*PARTS, " word.", " Ünï,", " it's", " word\nword\r\nword", " x" * 300, " " + "line\n" * 40, " 好.", " ª", " \u0301a", " a\u0301."]
    for _ in range(150):
        text = "".join(rng.choice(more) for _ in range(rng.randint(1, 60)))
        calls: list[str] = []
        count = lambda s: calls.append(s) or len(encoder.pieces(s)) >> 2
        limit, n = rng.randint(1, 40), len(text)
        overlap = rng.randrange(limit)
        bounds = chunk_bounds(text, limit, overlap, plain, vocab.max_len, True, words)
        assert bounds == chunk_bounds(text, limit, overlap, count, vocab.max_len, True)
        assert all(k == count(text[a:b]) for a, b, k in bounds) and bounds[-1][1] == n
    calls.clear()
    Slices("one two three " * 2_000 + "end", count, vocab.max_len, True, Words(count)).size(0, 28_003)
    assert len(calls) < 500  # a count a block and a word, not one for each place


def test_limits_stop_early(vocab):
    data = "".join(random.Random(3).choice(PARTS) for _ in range(400)).encode()
    counts = vocab.prefix_counts(data)
    for limit in (1, 2, 5, 20):
        for end in (0, 1, 90, 200, 500, len(data)):
            assert vocab.count_within(data[:end], limit) == (counts[min(end, len(data))] if counts[min(end, len(data))] <= limit else None)
    encode = PieceEncoder(vocab.encode_short)
    for text in ("one two " * 300, "one  two " * 300, " lead", "", "a " * 127, "a " * 128 + "b", "x " + "a " * 128):
        n = len(encode.text(text)) >> 2
        for limit in (0, 1, 128, 129, 130, n - 1, n, n + 1):
            assert encode.count_within(text, limit) == (n if n <= limit else None)


def test_truncate(spark, tok):
    from mergeloom.functions.pieces import PieceEncoder

    encode = PieceEncoder(tok.vocab.encode_short)
    count = lambda s: len(encode.text(s)) >> 2
    text = LONG[:260]
    for limit in (0, 1, 2, 5, 17, 40, 500):
        best = max(k for k in range(len(text) + 1) if count(text[:k]) <= limit)
        assert longest_prefix(text, 0, limit, count, tok.vocab.max_len, True) == best
    df = spark.createDataFrame([("Hello, world!",), ("",), (None,)], "t string")
    assert [r.t for r in df.select(truncate_tokens(tok, "t", 2).alias("t")).collect()] == ["Hello,", "", None]


def test_decoding_takes_little_memory(vocab):
    from mergeloom.functions.columns import decode_lists, worker_tokens

    rng, n = random.Random(5), len(vocab)
    lists = [None, [], [None], [n], [-1], [0, n - 1]] + [[rng.randrange(n) for _ in range(rng.choice((0, 1, 30, 900)))] for _ in range(2_000)] + [[7] * 200_000, [7] * 200_000 + [n], []]
    column = pa.array(lists, pa.list_(pa.int32()))
    want = [None if x is None else vocab.decode(x) for x in lists]
    tokens = worker_tokens(vocab)
    for at in (0, 1, 5, len(lists)):
        assert decode_lists(column[at:], tokens).to_pylist() == want[at:]
    for x in ([None], [[]], [[], None]):
        assert decode_lists(pa.array(x, pa.list_(pa.int32())), tokens).to_pylist() == [None if y is None else b"" for y in x]
    tracemalloc.start()
    decode_lists(column[:2_000], tokens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6  # numpy's; Arrow's is the result and a run of rows


def test_a_workers_memory_is_bounded(spark, tok):
    from mergeloom.functions.columns import worker_encoder
    from mergeloom.functions.pieces import WORKER_ENTRIES, sliced

    texts = pa.array(["x" * 20_000, None] * 1_000)
    tracemalloc.start()
    got = sliced(texts, len, pa.int32())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [20_000, None] * 1_000 and peak < 4e6
    assert sliced(texts[:0], len, pa.int32()).to_pylist() == []
    one = worker_encoder(tok.vocab, tok.pattern)
    for i in range(0, 3 * WORKER_ENTRIES, 1_000):
        one.text(" ".join(f"w{k:x}" for k in range(i, i + 1_000)))
    assert all(len(m) + len(m.old) <= 2 * WORKER_ENTRIES for m in (one.first, one.rest, one.memo))
    long = "word " * 2_000  # more than any two tokens hold
    df = spark.createDataFrame([(long,)], "t string")
    assert df.select(truncate_tokens(tok, "t", 2).alias("t")).first().t == "word word"
    assert df.select(truncate_tokens(tok, "t", 1 << 30).alias("t")).first().t == long


def test_ranges(spark, tok):
    df = spark.createDataFrame([("Hello, world!", 0, 5), ("Hello, world!", 3, 13), ("abc", 1, 1), ("abc", 2, 9), (None, 0, 0), ("abc", None, 1)], "t string, a int, b int")
    raw = tok.without_pattern()
    got = [r.n for r in df.select(count_range(raw, "t", F.col("a"), F.col("b")).alias("n")).collect()]
    assert got == [1, len(tok.vocab.encode(b"lo, world!")), 0, None, None, None]


def test_append_and_prepend(spark, tok):
    rows = [("k", 2, " world"), ("k", 1, "Hello"), ("k", 3, None), ("l", 1, ""), (None, 1, "ab")]
    df = spark.createDataFrame(rows, "key string, pos int, text string")
    raw = tok.without_pattern()
    count = lambda s: len(tok.vocab.encode(s.encode()))
    got = {(r.key, r.pos): (r.n_bytes, r.n_tokens) for r in append_counts(raw, df, "key", "pos", "text").collect()}
    assert got == {("k", 1): (5, count("Hello")), ("k", 2): (11, count("Hello world")), ("k", 3): (11, count("Hello world")), ("l", 1): (0, 0), (None, 1): (2, count("ab"))}
    got = {(r.key, r.pos): r.n_tokens for r in prepend_counts(raw, df, "key", "pos", "text").collect()}
    assert got[("k", 2)] == count(" worldHello")
    # nulls first, ties by text; rows of a key in any number of batches
    rows = [(1.5, None, "c"), (1.5, 2, "b"), (1.5, 2, "a"), (1.5, 2, None), (2.0, 1, "")]
    df = spark.createDataFrame(rows, "key double, pos int, text string")
    got = sorted((r.key, -1 if r.pos is None else r.pos, r.n_bytes, r.n_tokens) for r in append_counts(raw, df, "key", "pos", "text").collect())
    assert got == [(1.5, -1, 1, 1), (1.5, 2, 1, 1), (1.5, 2, 2, count("ca")), (1.5, 2, 3, count("cab")), (2.0, 1, 0, 0)]


def test_streams(spark, tok, tmp_path):
    source, schema = str(tmp_path / "in"), "key string, pos int, text string, at timestamp"
    parts = [[("k", 1, "Hel", "2020-01-01 00:00:00"), ("l", 1, "x" * 700, "2020-01-01 00:10:00")], [("k", 2, "lo wor", "2020-01-01 00:20:00")], [("k", 4, "d", "2020-01-01 03:00:00"), ("k", 3, "l", "2020-01-01 00:30:00"), ("l", 2, None, "2020-01-01 00:30:00")]]
    for p in parts:
        spark.createDataFrame(p, "key string, pos int, text string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = stream_append_counts(tok.without_pattern(), stream, "key", "pos", "text").writeStream.format("memory").queryName("grown").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.key: (r.n_bytes, r.n_tokens) for r in spark.sql("SELECT key, max_by(struct(n_bytes, n_tokens), n_bytes) s FROM grown GROUP BY key").select("key", "s.*").collect()}
    count = lambda s: len(tok.vocab.encode(s.encode()))
    assert last == {"k": (11, count("Hello world")), "l": (700, count("x" * 700))}
    q = stream_token_counts(tok, stream, "at", "text").writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n_texts for r in spark.table("hours").collect()) == [1, 5]
