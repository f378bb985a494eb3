"""Cutting texts by token budget, at character boundaries.

Token counts don't grow steadily as a text grows, and a cut changes the pieces at
the cut.  But a blank before a character that isn't white space, and the end of a
run of newlines, always begin a piece: counts on both sides add up.  Texts are
counted once between these places; only what lies beside a cut is counted again.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from mergeloom.functions.columns import Tokenizer, worker_encoder
from mergeloom.functions.pieces import BY_JAVA, ENDS, Memo, PieceEncoder, sliced

CHUNKS = "array<struct<start:int,end:int,n_tokens:int>>"
#: Where every named pattern begins a piece, whatever stands before or behind: a blank before STARTS, LINES.
STARTS = regex.compile(r"[\w!-/:-@\[-`{-~]")  # behind a blank
LINES = regex.compile(r"(?<=[\r\n])(?=[\w!-.:-@\[-`{-~])")
BLOCK = 128  # words that are counted together
LONG = 64  # characters of a word within which lines' starts are sought


def _furthest(fits, far: int, widest: int) -> int:
    """The greatest distance 0..far that fits; 0 always does.

    Short ways are searched whole.  Long ones are galloped and bisected; as counts may
    fall again, the search then goes on until `widest` distances in a row didn't fit.
    """
    if far <= widest:
        return next((d for d in range(far, 0, -1) if fits(d)), 0)
    low, high = 0, 1
    while high < far and fits(high):
        low, high = high, min(far, 2 * high)
    while high - low > 1:
        middle = (low + high) // 2
        if fits(middle):
            low = middle
        else:
            high = middle
    best, d = low, low + 1
    while d <= far and d - best <= widest:
        if fits(d):
            best = d
        d += 1
    return best


class Words(Memo):
    """word -> tokens of a blank and the word; None unless a piece begins at that blank."""

    entries = 180_000  # numbers, no lists: about 25 MB a generation

    def __init__(self, count, encoder: PieceEncoder | None = None):
        super().__init__()
        self.count, self.plain = count, encoder is not None and encoder.plain
        self.encoder = encoder

    def make(self, word: str) -> int | None:
        if self.plain and word.isalpha():  # one piece, which needn't be in the encoder's memos too
            return len(self.encoder.encode_piece((" " + word).encode()))
        if self.plain and word and word[-1] in ENDS and word[:-1].isalpha():
            n = self[word[:-1]]
            return n and n + (len(self.encoder.piece(word[-1])) >> 2)
        return self.count(" " + word) if STARTS.match(word) else None


class Slices:
    """Token counts of a text's slices, from counts between places that are taken when first needed.

    Places are blanks before words and, in long words, starts of lines.  `split` says that
    a named pattern splits the text; else it is one piece and has no such places.
    `words` may outlive the text.
    """

    def __init__(self, text: str, count, widest: int, split: bool, words: Words | None = None):
        self.text, self.count, self.widest = text, count, widest
        self.words = Words(count) if words is None else words
        self.at, self.rest = 0, text if split else None  # what isn't searched yet, and where it starts
        self.cuts: list[int] = []
        self.upto: list[int] = []  # tokens between the first place and each

    def _cut(self, at: int) -> None:
        self.upto.append(self.upto[-1] + self.count(self.text[self.cuts[-1] : at]) if self.cuts else 0)
        self.cuts.append(at)

    def _more(self) -> bool:
        """Whether the next block of words could be searched; it may have no places."""
        if self.rest is None:
            return False
        parts, at = self.rest.split(" ", BLOCK), self.at
        if len(parts) > BLOCK:
            self.rest = parts.pop()
            self.at += len(parts) + sum(map(len, parts))
        else:
            self.rest = None
        counts = list(map(self.words.__getitem__, parts)) if at else [None, *map(self.words.__getitem__, parts[1:])]
        whole = 0  # tokens of the word before, if a place is before and behind it
        for k, (word, n) in enumerate(zip(parts, counts)):
            here = at - 1  # the blank's
            if n is None:
                whole = 0
            else:
                if whole:
                    self.upto.append(self.upto[-1] + whole)
                    self.cuts.append(here)
                else:
                    self._cut(here)
                whole = n
            if len(word) > LONG and ("\n" in word or "\r" in word):
                for m in LINES.finditer(word, 1):
                    self._cut(at + m.start())
                    whole = 0
            at += len(word) + 1
        return True

    def size(self, start: int, end: int) -> int:
        """Tokens of text[start:end]."""
        while (not self.cuts or self.cuts[-1] <= end - 2) and self._more():
            pass
        i, j = bisect_right(self.cuts, start), bisect_right(self.cuts, end - 2) - 1
        if i > j:
            return self.count(self.text[start:end])
        return self.count(self.text[start : self.cuts[i]]) + self.upto[j] - self.upto[i] + self.count(self.text[self.cuts[j] : end])

    def prefix(self, start: int, limit: int) -> int:
        """End of the longest slice from `start` with at most `limit` tokens."""
        text, n = self.text, len(self.text)
        if limit <= 0 or start >= n:
            return start
        while (not self.cuts or self.cuts[-1] <= start) and self._more():
            pass
        i, at, base, stop = bisect_right(self.cuts, start), start, 0, n
        if i < len(self.cuts):
            stop = self.cuts[i] + 1
            spare = limit - self.count(text[start : self.cuts[i]])
            while self.upto[-1] - self.upto[i] < spare and self._more():
                pass
            # the last place before which tokens are left; beyond the next one there are none
            j = bisect_left(self.upto, spare + self.upto[i], i) - 1
            if j >= i:
                at, base = self.cuts[j], limit - spare + self.upto[j] - self.upto[i]
                stop = self.cuts[j + 1] + 1 if j + 1 < len(self.cuts) else n
        far = min(stop, n, at + (limit - base) * self.widest) - at
        fits = lambda d: (self.size(start, at + 1) if d == 1 else base + self.count(text[at : at + d])) <= limit
        return at + _furthest(fits, far, self.widest)

    def tail(self, start: int, end: int, limit: int) -> int:
        """Start, behind `start`, of the longest slice to `end` with at most `limit` tokens."""
        text = self.text
        if limit <= 0:
            return end
        while (not self.cuts or self.cuts[-1] <= end - 2) and self._more():
            pass
        least, j = bisect_right(self.cuts, start), bisect_right(self.cuts, end - 2) - 1
        at, base, i = end, 0, j + 1
        if least <= j:
            last = self.count(text[self.cuts[j] : end])
            i = max(least, bisect_right(self.upto, last + self.upto[j] - limit, 0, j + 1))
            if i <= j:
                at, base = self.cuts[i], last + self.upto[j] - self.upto[i]
        low = max(start + 1, self.cuts[i - 1] if i > least else 0, at - (limit - base) * self.widest)
        return at - _furthest(lambda d: base + self.count(text[at - d : at]) <= limit, at - low, self.widest)


def longest_prefix(text: str, start: int, limit: int, count, widest: int, split: bool, words: Words | None = None) -> int:
    """End of a longest slice text[start:end] with at most `limit` tokens."""
    return Slices(text, count, widest, split, words).prefix(start, limit)


def chunk_bounds(text: str, limit: int, overlap: int, count, widest: int, split: bool = False, words: Words | None = None) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of consecutive chunks of at most `limit` tokens, in characters.

    A chunk starts where the one before ended, or earlier by the longest tail of it
    with at most `overlap` tokens.  A character of more than `limit` tokens is a chunk.
    """
    slices = Slices(text, count, widest, split, words)
    out, start = [], 0
    while start < len(text):
        end = max(start + 1, slices.prefix(start, limit))
        out.append((start, end, slices.size(start, end)))
        if end >= len(text):
            break
        start = slices.tail(start, end, overlap)
    return out


_COUNTERS: dict[tuple, tuple] = {}


def _counter(vocab, pattern):
    """The worker's (count of a text's tokens, memo of words)."""
    key = (id(vocab), pattern)
    if key not in _COUNTERS:
        encoder = None
        if pattern is None:
            count = lambda s: len(vocab.encode(s.encode()))
        else:
            encoder = worker_encoder(vocab, pattern)
            count = lambda s: len(encoder.text(s)) >> 2
        _COUNTERS[key] = count, Words(count, encoder)
    return _COUNTERS[key]


def _checked(tok: Tokenizer) -> None:
    if tok.pattern is not None and tok.pattern not in BY_JAVA:
        raise ValueError("cutting needs a named pattern or none")
    if not tok.vocab.strict:
        raise ValueError("cutting needs a complete vocabulary")


def truncate_tokens(tok: Tokenizer, text: Column | str, limit: int) -> Column:
    """The longest prefix, at a character boundary, of at most `limit` tokens; null stays null."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    _checked(tok)
    shared, pattern = tok._shared, tok.pattern

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        vocab = shared.value
        count, words = _counter(vocab, pattern)
        return sliced(texts, lambda t: t[: longest_prefix(t, 0, limit, count, vocab.max_len, pattern is not None, words)], pa.string())

    # no prefix that fits is longer, and what follows a prefix doesn't count
    return cut(F.left(F.col(text) if isinstance(text, str) else text, F.lit(min(limit * tok.vocab.max_len, (1 << 31) - 1))))


def chunk_tokens(tok: Tokenizer, text: Column | str, limit: int, overlap: int = 0) -> Column:
    """array<struct<start, end, n_tokens>> of chunks, in characters; [] for "", null for null."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap below it")
    _checked(tok)
    shared, pattern = tok._shared, tok.pattern

    @F.arrow_udf(CHUNKS)
    def chunk(texts: pa.Array) -> pa.Array:
        vocab = shared.value
        count, words = _counter(vocab, pattern)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n_tokens", pa.int32())]))
        return sliced(texts, lambda t: [{"start": a, "end": b, "n_tokens": n} for a, b, n in chunk_bounds(t, limit, overlap, count, vocab.max_len, pattern is not None, words)], kind)

    return chunk(F.col(text) if isinstance(text, str) else text)
