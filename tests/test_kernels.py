import random

import pytest
import regex
import tiktoken

from mergeloom import Vocabulary
from mergeloom.functions import patterns
from mergeloom.functions.pieces import CL, O2, PieceEncoder
from mergeloom.operators.incremental import Appender, Prepender
from mergeloom.operators.intervals import IntervalIndex
from mergeloom.sources.ranks import parse_ranks

T1 = Vocabulary([bytes([c]) for c in range(97, 123)] + [b"ab", b"bc", b"abc"], strict=False)


def tiny(tokens: str) -> Vocabulary:
    return Vocabulary([t.encode() for t in tokens.split()], strict=False)


@pytest.mark.parametrize("text, ids", [("", []), ("a", [0]), ("ab", [26]), ("abc", [28]), ("abcabc", [28, 28]), ("bcab", [27, 26]), ("aab", [0, 26]), ("abcab", [28, 26]), ("bbc", [1, 27])])
def test_small_vocabulary(text, ids):
    data = text.encode()
    for name in ("encode", "encode_heap", "encode_table", "encode_greedy", "encode_minimal"):
        assert getattr(T1, name)(data) == ids, name
    assert T1.decode(ids) == data


@pytest.mark.parametrize(
    "tokens, text, exact, greedy, minimal",
    [
        ("a b c d bc ab cd", "abcd", [0, 4, 3], [5, 6], [5, 6]),
        ("a b c ab ba abba bac", "babbab", [1, 3, 1, 3], [4, 1, 4, 1], [1, 5, 1]),
        ("a b aa", "aaaaa", [2, 2, 0], [2, 2, 0], [0, 2, 2]),
    ],
)
def test_vocabularies_that_part_the_encoders(tokens, text, exact, greedy, minimal):
    v, data = tiny(tokens), text.encode()
    assert v.encode(data) == v.encode_heap(data) == exact
    assert v.encode_greedy(data) == greedy
    assert v.encode_minimal(data) == minimal


def test_derived_tables():
    left, right = T1.splits
    assert (left[28], right[28]) == (26, 2)
    assert T1.pairs == {(0, 1): 26, (1, 2): 27, (26, 2): 28}
    assert T1.next_prefixes[26:] == [0, 1, 26]
    assert not T1.valid_pair(0, 1)
    assert T1.valid_pair(2, 0)
    assert T1.prefix_tokens(b"abcab") == [0, 26, 28, 0, 26]
    assert T1.prefix_counts(b"abcab") == [0, 1, 1, 1, 2, 2]
    assert T1.next_match(b"abd") == 26 and T1.next_match(b"") is None


def test_bytes_outside_the_vocabulary():
    for name in ("encode", "encode_heap", "encode_table", "encode_greedy", "encode_minimal", "prefix_tokens"):
        assert getattr(T1, name)(b"a!b") is None, name
    with pytest.raises(ValueError):
        Vocabulary([b"a"])
    with pytest.raises(ValueError):
        Vocabulary([b"a", b"a"], strict=False)


def random_vocabulary(rng):
    letters = [b"a", b"b", b"c"][: rng.randint(2, 3)]
    tokens = list(letters)
    for _ in range(60):
        if len(tokens) >= 14:
            break
        v = Vocabulary(tokens, strict=False)
        new = rng.choice(tokens) + rng.choice(tokens)
        if new not in tokens and len(v.encode(new)) == 2:
            tokens.append(new)
    return Vocabulary(tokens, strict=False), letters


def test_encoders_agree_on_random_vocabularies():
    rng = random.Random(4)
    for _ in range(150):
        v, letters = random_vocabulary(rng)
        data = b"".join(rng.choice(letters) for _ in range(rng.randint(1, 25)))
        want = v.encode(data)
        assert v.encode_heap(data) == v.encode_table(data) == v.encode_short(data) == want
        counts = [len(v.encode(data[:k])) for k in range(len(data) + 1)]
        assert v.prefix_counts(data) == counts
        assert len(v.encode_minimal(data)) <= len(want)
        index = IntervalIndex(v, data)
        for _ in range(8):
            a, b = sorted(rng.randint(0, len(data)) for _ in range(2))
            assert index.count(a, b) == len(v.encode(data[a:b]))
        x, y = (rng.randrange(len(v)) for _ in range(2))
        assert v.valid_pair(x, y) == (v.encode(v.tokens[x] + v.tokens[y]) == [x, y])


def test_growing_texts():
    rng = random.Random(5)
    for _ in range(60):
        v, letters = random_vocabulary(rng)
        data = b"".join(rng.choice(letters) for _ in range(rng.randint(1, 200)))
        cut = rng.randint(0, len(data))
        grown = Appender(v).extend(data[:cut])
        assert grown.token_count == len(v.encode(data[:cut]))
        grown = Appender.restore(v, grown.state()).extend(data[cut:])
        assert grown.token_count == len(v.encode(data)) and len(grown) == len(data)
        whole = Appender(v, whole=True).extend(data).truncate(cut)
        assert whole.token_count == len(v.encode(data[:cut])) and len(whole) == cut
        back = Prepender(v).extend(data)
        assert back.token_count == len(v.encode(data[::-1]))
        assert back.truncate(cut).token_count == len(v.encode(data[:cut][::-1]))


CASES = [
    ("Hello, world!", "Hello|,| world|!", None),
    ("I'm we'LL don't", "I|'m| we|'LL| don|'t", "I'm| we'LL| don't"),
    ("’tis don’t", "’tis| don|’t", None),
    ("a\n \n b", "a|\n \n| b", None),
    ("x  \n\n  \n y", "x|  \n\n  \n| y", None),
    ("你好A", "你好A", "你好|A"),
    ("12345", "123|45", None),
    ("foo   bar", "foo|  | bar", None),
    ("end  ", "end|  ", None),
    ("a/b//\n/c", "a|/b|//\n|/c", "a|/b|//\n/|c"),
    ("HTTPServer's", "HTTPServer|'s", "HTTPServer's"),
    ("\t\tx = 1;", "\t|\tx| =| |1|;", None),
    ("a᠎b", None, None),
]


@pytest.mark.parametrize("text, cl, o2", CASES)
def test_worker_patterns(text, cl, o2):
    if cl is not None:
        assert CL.findall(text) == cl.split("|")
        assert O2.findall(text) == (o2 or cl).split("|")


def test_against_another_tokenizer(vocab):
    other = tiktoken.Encoding("other", pat_str=patterns.CL, mergeable_ranks=vocab.ranks, special_tokens={})
    mine = PieceEncoder(vocab.encode_short)
    rng = random.Random(6)
    texts = [c[0] for c in CASES] + ["", " ", "  ", " a", "a ", "a  b", "the, end.\n\nNext  line \n x", "a b", "x\u0085y", "é" * 300, "ab" * 500]
    for _ in range(64):
        piece = b"".join(vocab.tokens[rng.randrange(len(vocab))] for _ in range(rng.choice((3, 30, 300))))
        texts.append(piece.decode("utf-8", "ignore"))
    for text in texts:
        got = mine.text(text)
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == other.encode_ordinary(text), text
        assert regex.sub(r"\s", "", "".join(CL.findall(text))) == regex.sub(r"\s", "", text)


def test_rank_files():
    assert parse_ranks(["YQ== 0", "", "Yg== 1"]) == [b"a", b"b"]
    with pytest.raises(ValueError):
        parse_ranks(["YQ== 0", "Yg== 2"])


def test_grown_texts_join_encodings(vocab):
    from mergeloom.operators.incremental import Grown, _Chunks

    rng = random.Random(2)
    made = [(vocab, ["The", " a", "  ", "\n", "aaaa", "a", " aaa", "===", "=", "你好", " ünï", "'ll", "-" * 50, " " * 70, "x" * 33])]
    for _ in range(60):
        letters, tokens = rng.choice((" a", "ab ", "abc")), [bytes((c,)) for c in range(256)]
        for _ in range(rng.randint(1, 40)):
            pool = [c.encode() for c in letters] + tokens[256:]
            token = rng.choice(pool) + rng.choice(pool) if rng.random() < 0.95 else "".join(rng.choices(letters, k=3)).encode()
            if token not in tokens and len(token) < 12:
                tokens.append(token)
        made.append((Vocabulary(tokens), letters))
    assert {v.linked for v, _ in made} == {True, False}
    for v, parts in made:
        chunks, ahead, back, there, here = _Chunks(v), None, None, "", ""
        for turn in range(40):
            if turn % 8 == 0:
                ahead, back, there, here = Grown(v, chunks), Grown(v, chunks), "", ""
            text = "".join(rng.choices(parts, k=rng.randint(0, 6)))
            there, here = there + text, text + here
            assert ahead.append(text).token_count == len(v.encode(there.encode())) and list(ahead.ids) == v.encode(there.encode()), (v.tokens[256:], there)
            assert back.prepend(text).token_count == len(v.encode(here.encode())) and list(back.ids) == v.encode(here.encode()), (v.tokens[256:], here)
            assert ahead.n_bytes == back.n_bytes == len(there.encode())
    # a word that was met before costs a look, not a search at each of its bytes
    chunks, calls = _Chunks(vocab), []
    chunks.make, make = lambda c: calls.append(c) or make(c), chunks.make
    grown = Grown(vocab, chunks).append("the cat sat on the mat")
    first = len(calls)
    for _ in range(500):
        grown.append(" the cat sat on the mat")
    assert len(calls) <= first + 2 and grown.token_count == len(vocab.encode(("the cat sat on the mat" + " the cat sat on the mat" * 500).encode()))
