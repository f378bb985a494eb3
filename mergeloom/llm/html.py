"""Operator 9: main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks (text between block-level tags); the field labels the
chain of blocks as content or boilerplate from ancestor-tag and text features and is
decoded by Viterbi.  It is trained on pages whose blocks are labelled: a few built in,
and a bounded sample of pages that mark their content with <article> or <main>.  Half
of the time those marking tags are hidden from training, so that pages without them
are labelled by the rest.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = 400
TRAINED_BLOCKS = 300
DEEPEST = 512
#: No part is tried in two ways, and what isn't closed ends at the next tag or takes the rest: time grows with the page.
_ATTRIBUTES = r"""((?:"[^"]*+"|'[^']*+'|[^<>"'])*+)"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|title|textarea|select)\b{_ATTRIBUTES}>.*?(?:</\1\s*+>|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/<>]*+){_ATTRIBUTES}>",
    re.S | re.I,
)
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS = ("article", "main", "nav", "footer", "header", "aside")
TAGS = ("p", "li", "ul", "ol", "table", "td", "tr", "h1", "h2", "h3", "h4", "pre", "blockquote", "form", "figure", "dl", "dd", "section", "div", "body")
ANCESTORS = (*MARKS, *TAGS, "head")
NAMES = [f"in_{t}" for t in MARKS] + [f"in_{t}" for t in TAGS] + [f"own_{t}" for t in (*MARKS, *TAGS)]
NAMES += ["words_0_4", "words_5_9", "words_10_24", "words_25_79", "words_80", "links_none", "links_some", "links_most", "ends_sentence", "sentences_2", "commas", "first", "last", "in_first_tenth", "in_last_tenth", "copyright", "class_good", "class_bad", "bias"]
AT = {n: i for i, n in enumerate(NAMES)}
_GOOD = re.compile(r"article|content|post|story|entry|body|text", re.I)
_BAD = re.compile(r"\bad\b|ads?[-_]|banner|comment|footer|header|menu|nav|promo|related|share|side|social|sponsor|widget|cookie", re.I)
_NAMED = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@dataclass
class Block:
    """Text of a leaf block, its ancestors' tags (those that matter, the nearest last), linked characters, class and id words."""

    text: str
    path: tuple
    linked: int
    names: str


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of a page in order; malformed markup is closed as browsers roughly do.

    Elements deeper than `DEEPEST` are siblings of each other.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    around: Counter = Counter()
    text: list[str] = []
    where: tuple = ()
    names = ""
    linked = depth = 0

    def flush():
        nonlocal linked
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            if words and "head" not in where:
                out.append(Block(words, where, min(linked, len(words)), names))
            text.clear()
        linked = 0

    def add(piece: str):
        nonlocal where, names, linked
        if not text:
            if piece.isspace():
                return
            near = next((t for t, _ in reversed(stack) if t not in INLINE), None)
            where = (*(t for t in ANCESTORS if around[t] and t != near), *([near] if near else []))
            names = " ".join(n for _, n in stack[-3:] if n)
        text.append(piece)
        if depth:
            linked += len(piece)

    def close(k: int, only: bool = False):
        """Takes element k, and those in it, off the stack."""
        nonlocal depth
        gone = stack[k : k + 1] if only else stack[k:]
        del stack[k : k + len(gone)]
        for t, _ in gone:
            around[t] -= 1
            depth -= t == "a"

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[4]
        if tag is None:
            continue
        tag = tag.lower()
        if m[3]:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1) if around[tag] else ():
                if stack[k][0] == tag:
                    close(k, tag in INLINE)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
        elif tag in VOID:
            if tag == "br" and text:
                text.append(" ")
            elif tag not in INLINE and tag != "br":
                flush()
        else:
            if tag not in INLINE:
                flush()
                while stack and stack[-1][0] in INLINE:
                    close(len(stack) - 1)
                if tag in ("p", "li", "td", "tr", "dd", "dt", "option", "h1", "h2", "h3") and stack and stack[-1][0] in (tag, "p"):
                    close(len(stack) - 1)
                elif stack and stack[-1][0] == "p":
                    close(len(stack) - 1)
            if len(stack) == DEEPEST:
                close(DEEPEST - 1)
            named = _NAMED.findall(m[5]) if m[5] and ("class" in m[5] or "id" in m[5]) else ()
            stack.append((tag, " ".join("".join(x) for x in named)))
            around[tag] += 1
            depth += tag == "a"
    if at < len(page):
        add(page[at:])
    flush()
    return out


def features(blocks: list[Block]) -> list[list[int]]:
    """Feature numbers of each block."""
    n, out = len(blocks), []
    for i, b in enumerate(blocks):
        own = b.path[-1] if b.path else ""
        f = [AT["bias"]]
        f += [AT[x] for x in {f"in_{t}" for t in b.path} if x in AT]
        if f"own_{own}" in AT:
            f.append(AT[f"own_{own}"])
        words = b.text.count(" ") + 1
        f.append(AT["words_0_4" if words < 5 else "words_5_9" if words < 10 else "words_10_24" if words < 25 else "words_25_79" if words < 80 else "words_80"])
        share = b.linked / len(b.text)
        f.append(AT["links_none" if share == 0 else "links_some" if share < 0.5 else "links_most"])
        if b.text[-1] in ".!?…\"”":
            f.append(AT["ends_sentence"])
        if b.text.count(". ") > 1:
            f.append(AT["sentences_2"])
        if "," in b.text:
            f.append(AT["commas"])
        if "©" in b.text or "copyright" in b.text.lower():
            f.append(AT["copyright"])
        if i == 0:
            f.append(AT["first"])
        if i == n - 1:
            f.append(AT["last"])
        if i * 10 < n:
            f.append(AT["in_first_tenth"])
        if (n - 1 - i) * 10 < n:
            f.append(AT["in_last_tenth"])
        if b.names:
            if _GOOD.search(b.names):
                f.append(AT["class_good"])
            if _BAD.search(b.names):
                f.append(AT["class_bad"])
        out.append(f)
    return out


@dataclass
class ChainField:
    """Binary linear-chain field: weights of content against boilerplate, and a 2 x 2 transition table."""

    weight: np.ndarray
    step: np.ndarray

    def decode(self, feats: list[list[int]]) -> list[int]:
        """Likeliest labels (Viterbi); ties go to boilerplate."""
        if not feats:
            return []
        w = self.weight.tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        back, a, b = [], 0.0, sum(w[f] for f in feats[0])
        for fs in feats[1:]:
            e = sum(w[f] for f in fs)
            from_a, from_b = a + s01 >= b + s11, a + s00 >= b + s10
            a, b, last = (a + s00 if from_b else b + s10), (a + s01 if from_a else b + s11) + e, (0 if from_b else 1, 0 if from_a else 1)
            back.append(last)
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 150, rate: float = 0.15, decay: float = 1e-3, seed: int = 3) -> ChainField:
    """Maximum likelihood by Adam on forward-backward gradients; half the pages hide the marking tags."""
    rng = np.random.default_rng(seed)
    hidden = {AT[f"in_{t}"] for t in MARKS} | {AT[f"own_{t}"] for t in MARKS}
    pages = [(f, y) for f, y in pages if f]
    n, size = len(pages), max((len(f) for f, _ in pages), default=0)
    weight, step = np.zeros(len(NAMES)), np.zeros((2, 2))
    if not n:
        return ChainField(weight, step)
    x = np.zeros((n, size, len(NAMES)), dtype=np.float32)
    y = np.zeros((n, size), dtype=np.int64)
    here = np.zeros((n, size), dtype=bool)
    for i, (f, label) in enumerate(pages):
        blind = rng.random() < 0.5
        for t, fs in enumerate(f):
            x[i, t, [k for k in fs if not (blind and k in hidden)]] = 1
        y[i, : len(label)], here[i, : len(f)] = label, True
    m = [np.zeros_like(weight), np.zeros_like(step)]
    v = [np.zeros_like(weight), np.zeros_like(step)]
    for k in range(1, rounds + 1):
        _, grads = loss(weight, step, x, y, here, decay)
        for i, (value, g) in enumerate(zip((weight, step), grads)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            value -= rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
    return ChainField(weight, step)


def loss(weight, step, x, y, here, decay: float):
    """(mean negative log-likelihood of labels y with a squared penalty, its gradients), by forward-backward.

    x is pages by places by features; `here` says which places a page has.
    """
    n, size = y.shape
    flat = x.reshape(n * size, -1)
    e = np.zeros((n, size, 2))
    e[..., 1] = (flat @ weight).reshape(n, size)
    fwd, bwd = np.zeros((n, size, 2)), np.zeros((n, size, 2))
    fwd[:, 0] = e[:, 0]
    for t in range(1, size):
        nxt = np.logaddexp(fwd[:, t - 1, 0, None] + step[0], fwd[:, t - 1, 1, None] + step[1]) + e[:, t]
        fwd[:, t] = np.where(here[:, t, None], nxt, fwd[:, t - 1])
    for t in range(size - 2, -1, -1):
        nxt = np.logaddexp(step[:, 0] + (e[:, t + 1, 0] + bwd[:, t + 1, 0])[:, None], step[:, 1] + (e[:, t + 1, 1] + bwd[:, t + 1, 1])[:, None])
        bwd[:, t] = np.where(here[:, t + 1, None], nxt, 0.0)
    total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    p = np.exp(fwd[..., 1] + bwd[..., 1] - total[:, None]) * here
    pairs = fwd[:, :-1, :, None] + step + (e + bwd)[:, 1:, None, :] - total[:, None, None, None]
    expected = (np.exp(np.minimum(pairs, 0)) * here[:, 1:, None, None]).sum(axis=(0, 1))
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (y[:, :-1][here[:, 1:]], y[:, 1:][here[:, 1:]]), 1)
    seen = (y * here).reshape(-1) @ flat
    value = (total.sum() - seen @ weight - (seen_pairs * step).sum()) / n + decay / 2 * ((weight**2).sum() + (step**2).sum())
    return value, [(p.reshape(-1) @ flat - seen) / n + decay * weight, (expected - seen_pairs) / n + decay * step]


def marked_labels(blocks: list[Block]) -> list[int] | None:
    """Labels of a page that marks its content: blocks inside <article> or <main>, asides excepted."""
    inside = [int(("article" in b.path or "main" in b.path) and not {"nav", "aside", "footer"} & set(b.path)) for b in blocks]
    return inside if any(inside) else None


BUILT_IN = [
    "<body><div class=menu><a href=/>+Home</a> <a href=/a>+About</a></div><h1>*Title of the text</h1><p>*First sentence, which is long enough to be prose. And a second one follows.</p><p>*More prose is here, with a comma, and it ends.</p><div class=footer>+Copyright someone</div></body>",
    "<body><ul><li><a href=1>+News</a><li><a href=2>+Sports</a><li><a href=3>+Contact</a></ul><div id=content><h2>*Heading</h2><p>*The paragraph says something at length. It goes on for a while, as prose does.</p><ul><li>*one point of a list in the text</li><li>*another point, a bit longer</li></ul></div><div id=sidebar><p>+Subscribe now</p><a href=4>+Related story</a></div></body>",
    "<body><table><tr><td><a href=1>+Login</a><td>+Search</table><div class=post><p>*Today we write about things. They matter, and here is why.</p><blockquote>*A quotation that is quite long and ends with a stop.</blockquote><p>*Closing words follow here, and that is all of it.</p></div><p>+All rights reserved ©</p></body>",
]


def built_in_pages() -> list[tuple[list[list[int]], list[int]]]:
    """Labelled pages of the module; * and + before a text give its label."""
    out = []
    for page in BUILT_IN:
        blocks = leaf_blocks(page)
        label = [int(b.text[0] == "*") for b in blocks]
        for b in blocks:
            b.text = b.text.replace("*", "").replace("+", "")
        out.append((features(blocks), label))
    return out


def fit_field(pages: DataFrame, rows: int = PAGES, id_col: str = "page_id", html_col: str = "html") -> ChainField:
    """Train on the built-in pages and on at most `rows` pages that mark their content.

    They are chosen, among those that have one of the marking tags, by a hash of the id;
    pages of more than `TRAINED_BLOCKS` blocks, or without an id, are passed over.
    """
    ids = pages.where(F.col(id_col).isNotNull() & F.col(html_col).cast("string").rlike(r"(?i)<(article|main)\b")).select(F.col(id_col).cast("bigint").alias("_id")).distinct()
    chosen = ids.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    html = pages.select(F.col(id_col).cast("bigint").alias("_id"), F.col(html_col).cast("string").alias("html")).join(F.broadcast(chosen), "_id")

    def run(batches):
        for batch in batches:
            ids, feats, labels = [], [], []
            for i, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blocks = leaf_blocks(page or "")
                label = marked_labels(blocks) if len(blocks) <= TRAINED_BLOCKS else None
                if label:
                    ids.append(i)
                    feats.append(features(blocks))
                    labels.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(feats, pa.list_(pa.list_(pa.int32()))), pa.array(labels, pa.list_(pa.int32()))], ["id", "feats", "labels"])

    got = html.select("_id", "html").mapInArrow(run, "id bigint, feats array<array<int>>, labels array<int>").toArrow().sort_by("id")
    learned = list(zip(got.column("feats").to_pylist(), got.column("labels").to_pylist()))
    return train(built_in_pages() * max(1, len(learned) // 30) + learned)


def extract(pages: DataFrame, field: ChainField, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_blocks, n_kept) of every row: content blocks, one a line.

    A null page gives null text and counts of 0, an empty one "" and 0; repeated rows
    and null ids are treated like any other row; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            texts, n, kept = [], [], []
            for page in batch.column(1).to_pylist():
                if page is None:
                    texts.append(None)
                    n.append(0)
                    kept.append(0)
                    continue
                blocks = leaf_blocks(page)
                good = [b.text for b, y in zip(blocks, shared.value.decode(features(blocks))) if y]
                texts.append("\n".join(good))
                n.append(len(blocks))
                kept.append(len(good))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(kept, pa.int32())], ["page_id", "text", "n_blocks", "n_kept"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, text string, n_blocks int, n_kept int")
