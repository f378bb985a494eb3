"""Operator 1: toxicity by a weighted finite-state pattern grammar.

Words become symbols (insulting word, harming word, target, possessive, negation,
reporting, intent, first person, light word, break, other); six transducers rewrite and
weigh a clause's symbols, and their composition's heaviest path is the clause's score:

    insult     an insulting word is an insult
    threat     a harming word up to three words after intent or a first person is a threat
    negation   one after a negation, with light words and one other between, is marked as negated
    reporting  one after a reporting verb is marked as reported
    target     one with a target beside it is marked as aimed (an insult also by a possessive before)
    scoring    weighs what is marked; a threat counts only when aimed

A document is rejected if its clauses' scores, over its words, reach a density, or
if one clause holds an aimed, unreported threat that isn't negated.

The built-in vocabulary is small; further insults are whole words and word
beginnings that a bounded sample of labelled documents shows to be toxic.  The
typographic apostrophe counts as the plain one, and the t of "n't" is a negation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.llm.neardups import gram_sets
from mergeloom.llm.samples import labelled_sample
from mergeloom.llm.text import hash_spans, mix, slices, span_sums, text_buffers, tidy, words
from mergeloom.llm.transducer import Transducer
from mergeloom.session import written

LABELLED_ROWS = 8_000
LEAST_DENSITY = 0.003
LEAST_EVIDENCE = 22.0
THREAT_WEIGHT = 2.0
PREFIXES = (4, 5, 6, 7, 8, 9)

VOCABULARY = {
    "I": "idiot idiots moron morons imbecile stupid dumb loser losers scum trash pathetic worthless disgusting clown clowns dumbass scumbag degenerate vermin filth "
    "trottel dummkopf vollidiot abschaum arschloch connard imbécile abruti ordure salaud débile gilipollas imbécil estúpido estúpida basura escoria",
    "H": "kill murder slaughter stab shoot strangle hurt destroy exterminate töten umbringen erschießen erstechen tuer massacrer égorger matar asesinar apuñalar matarte matarlos",
    "T": "you yourself yourselves u them du dich dir euch ihnen tu te toi vous usted ustedes ti vosotros",
    "Y": "your yours dein deine deinen euer eure ton ta tes votre vos tus vuestro vuestra",
    "N": "not never no cannot dont wont cant isnt arent didnt doesnt nicht kein keine keinen niemals pas jamais aucun nunca jamás ningún",
    "R": "said says say told wrote writes called calls calling quoted quote alleged claimed reported sagte schrieb nannte meinte dit écrit appelé déclaré dijo escribió llamó afirmó",
    "F": "will ll going gonna go shall must should want werde werden will soll vais allons veux voy vamos quiero",
    "S": "i we ich wir je nous yo nosotros",
    "C": "a an the to is are am be was were m re s such so really very just ein eine ist sind bist sehr un une est es sont très eres es muy una",
}
SYMBOLS = "IHTYNRFSCPO"


def grammar() -> Transducer:
    """The composed machine; inputs are symbols of `SYMBOLS`."""
    plain = set(SYMBOLS) - set("IH")
    insult = Transducer(0, final={0: 0.0})
    for x in plain | set("IH"):
        insult.arc(0, x, "A" if x == "I" else x, 0.0, 0)
    threat = Transducer(0, final={k: 0.0 for k in range(4)})
    for k in range(4):
        for x in plain | set("AH"):
            y = ("B" if k else "O") if x == "H" else x
            threat.arc(k, x, y, 0.0, 3 if x in "FS" else 0 if x == "P" else max(0, k - (x not in "CN")))
    # 1: just after a negation; 2: light words came between; 3: another word did
    negation = Transducer(0, final={k: 0.0 for k in range(4)})
    onward = {1: dict.fromkeys("CFTSY", 2) | {"O": 3}, 2: dict.fromkeys("CF", 2) | {"O": 3}, 3: dict.fromkeys("CF", 3)}
    for state in range(4):
        for x in plain | set("AB"):
            to = 1 if x == "N" else onward.get(state, {}).get(x, 0)
            negation.arc(state, x, x.lower() if state and x in "AB" else x, 0.0, to)
    reporting = Transducer(0, final={0: 0.0, 1: 0.0})
    quoted = {"A": "Q", "B": "G", "a": "q", "b": "g"}
    for x in plain | set("ABab"):
        reporting.arc(0, x, x, 0.0, 1 if x == "R" else 0)
        reporting.arc(1, x, quoted.get(x, x), 0.0, 1)
    # a target up to three symbols before, or (guessed, then verified) up to three behind
    cores = {"A": "J", "B": "K"} | {x: x for x in "abQGqg"}
    target = Transducer((0, 0), final={(k, m): 0.0 for k in range(4) for m in range(4)})
    for k in range(4):
        for m in range(4):
            for x in plain | set(cores):
                aimed = k or m and x == "A"
                left = (3 if x == "T" else 0 if x == "P" else max(0, k - 1), 3 if x == "Y" else 0 if x == "P" else max(0, m - 1))
                target.arc((k, m), x, cores.get(x, x) if aimed else x, 0.0, left)
                if x in "AB" and not aimed:
                    target.arc((k, m), x, cores[x], 0.0, ("due", 3))
    for k in (1, 2, 3):
        for x in plain | set(cores):
            if x == "T":
                target.arc(("due", k), x, x, 0.0, (3, 0))
            elif k > 1 and x != "P":
                target.arc(("due", k), x, cores.get(x, x), 0.0, ("due", k - 1))
    weights = {"A": 1.0, "J": 1.5, "a": 0.2, "Q": 0.4, "q": 0.1, "K": THREAT_WEIGHT, "B": 0.0, "b": 0.0, "G": 0.4, "g": 0.0}
    scoring = Transducer(0, final={0: 0.0})
    for x in plain | set(weights):
        scoring.arc(0, x, "", weights.get(x, 0.0), 0)
    machine = insult
    for part in (threat, negation, reporting, target, scoring):
        machine = machine.compose(part)
    return machine.numbered()


def _key(word: str) -> int:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(word_keys(data, np.array([0]), np.array([len(data)]))[0])


def word_keys(data, start, end) -> np.ndarray:
    """Hashes of whole words; those of word beginnings are unmixed and can't meet them."""
    return mix(hash_spans(data, start, end)) | np.uint64(1)


def prefix_keys(data, start, k: int) -> np.ndarray:
    return mix(hash_spans(data, start, start + k) + np.uint64(k)) & ~np.uint64(1)


@dataclass
class Lexicon:
    """Symbols of word hashes, learned insults included, and what a document needs to be rejected."""

    keys: np.ndarray
    codes: np.ndarray
    prefixes: dict
    density: float = LEAST_DENSITY

    def __post_init__(self):
        order = np.argsort(self.keys)
        self.keys, self.codes = self.keys[order], self.codes[order]
        self.core = self.keys[np.isin(self.codes, (SYMBOLS.index("I"), SYMBOLS.index("H")))]
        self.gates = {0: _gate(self.core)} | {k: _gate(v) for k, v in self.prefixes.items()}
        self.machine, self.memo = None, {}

    def insults(self, data, start, end) -> np.ndarray:
        """Whether a word is an insult or a threat."""
        hit = np.zeros(len(start), dtype=bool)
        keys = word_keys(data, start, end)
        _mark(hit, np.arange(len(start)), keys, self.core, self.gates[0])
        for k, learned in self.prefixes.items():
            long = np.flatnonzero(end - start >= k)
            _mark(hit, long, prefix_keys(data, start[long], k), learned, self.gates[k])
        return hit

    def symbols(self, data, start, end) -> np.ndarray:
        """Codes of words, as places in `SYMBOLS`."""
        out = np.full(len(start), SYMBOLS.index("O"), dtype=np.uint8)
        keys = word_keys(data, start, end)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        out[known] = self.codes[at[known]]
        learned = self.insults(data, start, end) & (out != SYMBOLS.index("H"))
        out[learned] = SYMBOLS.index("I")
        back = np.maximum(start - 2, 0)
        cut = (end - start == 1) & (start > 1) & (data[start] == 116) & (data[start - 1] == 39) & (data[back] == 110)  # n't
        out[cut] = SYMBOLS.index("N")
        return out

    def clause(self, codes: bytes) -> float:
        """Score of a clause given as codes; long stretches of other words are shortened first."""
        other = bytes([SYMBOLS.index("O")])
        while other * 6 in codes:
            codes = codes.replace(other * 6, other * 5)
        got = self.memo.get(codes)
        if got is None:
            if self.machine is None:
                self.machine = grammar()
            got = self.machine.best(SYMBOLS[c] for c in codes) or 0.0
            if len(self.memo) > 200_000:
                self.memo.clear()
            if len(codes) <= 200:
                self.memo[codes] = got
        return got

    def __reduce__(self):
        return Lexicon, (self.keys, self.codes, self.prefixes, self.density)


def _gate(keys: np.ndarray) -> np.ndarray:
    gate = np.zeros(1 << 16, dtype=bool)
    gate[(keys >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int64)] = True
    return gate


def _mark(hit, rows, keys, wanted, gate) -> None:
    if not len(wanted) or not len(rows):
        return
    maybe = np.flatnonzero(gate[(keys >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(wanted, keys[maybe]), len(wanted) - 1)
    hit[rows[maybe[wanted[at] == keys[maybe]]]] = True


def built_in() -> Lexicon:
    found: dict[int, int] = {}
    for symbol, line in VOCABULARY.items():
        for w in line.split():
            found.setdefault(_key(w), SYMBOLS.index(symbol))
    return Lexicon(np.array(list(found), dtype=np.uint64), np.array(list(found.values()), dtype=np.uint8), {})


_BREAK = np.zeros(256, dtype=bool)
_BREAK[[10, 13, 33, 46, 59, 63]] = True
_PAUSE = np.zeros(256, dtype=bool)
_PAUSE[[34, 40, 41, 44, 58]] = True


def _folded(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_buffers(pc.replace_substring(pc.utf8_lower(col), "\u2019", "'"))


def score_texts(col: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of clause scores, heaviest clause's threat weight, words) of each text."""
    data, offsets = _folded(col)
    start, end, first = words(data, offsets, True)
    n = len(offsets) - 1
    total, threat, size = np.zeros(n), np.zeros(n), np.diff(first)
    if not len(start):
        return total, threat, size
    hit = lexicon.insults(data, start, end)
    if hit.any():
        marks = np.union1d(np.flatnonzero(_BREAK[data]), offsets)
        clause = np.searchsorted(marks, start, side="right")
        told = np.unique(clause[hit])
        keep = np.flatnonzero(np.isin(clause, told))
        codes = lexicon.symbols(data, start[keep], end[keep])
        after = np.minimum(end[keep], len(data) - 1)
        pause = _PAUSE[data[after]] & (end[keep] < len(data))
        bounds = np.flatnonzero(np.r_[True, np.diff(clause[keep]) > 0, True])
        doc = np.searchsorted(first, keep[bounds[:-1]], side="right") - 1
        p, h = SYMBOLS.index("P"), SYMBOLS.index("H")
        for k, row in enumerate(doc):
            a, b = bounds[k], bounds[k + 1]
            part = codes[a:b]
            if pause[a:b].any():
                part = np.insert(part, np.flatnonzero(pause[a:b]) + 1, p)
            got = lexicon.clause(part.tobytes())
            total[row] += got
            if h in part:
                without = part.copy()
                without[without == h] = SYMBOLS.index("O")
                threat[row] = max(threat[row], got - lexicon.clause(without.tobytes()))
    return total, threat, size


def without_copies(sample: DataFrame) -> DataFrame:
    """One text of those that share any of three minwise 3-grams: near copies would fake evidence."""

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                values, bounds = gram_sets(part.column(0))
                rows = np.flatnonzero(np.diff(bounds))
                keys = [np.minimum.reduceat(mix(values + np.uint64(k)), bounds[rows]).view(np.int64) if len(rows) else np.zeros(0, dtype=np.int64) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(rows)).columns, *map(pa.array, keys)], ["text", "label", "k0", "k1", "k2"])

    out = sample.select("text", F.col("label").cast("int")).mapInArrow(run, "text string, label int, k0 bigint, k1 bigint, k2 bigint")
    for k in ("k0", "k1", "k2"):
        row = F.struct("text", "label", "k0", "k1", "k2")
        out = out.groupBy(k).agg(F.min_by(row, F.struct(F.xxhash64("text"), "label")).alias("row")).select("row.*")
    return written(sample.sparkSession, out.select("text", "label"), "distinct")


def _features(col: pa.Array) -> np.ndarray:
    """Distinct (row, feature) pairs' features: hashes of whole words and of word beginnings."""
    data, offsets = _folded(col)
    start, end, first = words(data, offsets, True)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    keys, rows = [word_keys(data, start, end)], [row]
    for k in PREFIXES:
        long = np.flatnonzero(end - start >= k)
        keys.append(prefix_keys(data, start[long], k))
        rows.append(row[long])
    keys, rows = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    return keys[np.r_[True, (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])]]


def _feature_counts(sample: DataFrame, only: np.ndarray | None) -> DataFrame:
    shared = None if only is None else sample.sparkSession.sparkContext.broadcast(only)

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                keys = _features(part.column(0))
                if shared is not None:
                    keys = keys[np.isin(keys, shared.value)]
                keys, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    return sample.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def fit_lexicon(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, least: float = LEAST_EVIDENCE) -> Lexicon:
    """The built-in lexicon and the insults that at most `rows` labelled documents show.

    A word, or a beginning of words, is learned if toxic documents hold it far more
    often than others by a likelihood ratio test, and hardly any other does.  With no
    labels, or of one kind only, the built-in lexicon is returned.
    """
    lexicon = built_in()
    sample = without_copies(labelled_sample(spark, docs, labels, "toxic", rows))
    have = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sum(n for k, n in have.items() if k), have.get(0, 0)
    if not toxic or not clean:
        return lexicon
    a = _feature_counts(sample.where("label <> 0"), None).where("n >= 3").toPandas()
    keys = np.sort(a["key"].to_numpy().astype(np.int64).view(np.uint64))
    b = _feature_counts(sample.where("label = 0"), keys).toPandas()
    in_toxic = dict(zip(a["key"], a["n"]))
    in_clean = dict(zip(b["key"], b["n"]))
    k = np.array(list(in_toxic), dtype=np.int64)
    x = np.array([in_toxic[i] for i in k.tolist()], dtype=float)
    y = np.array([in_clean.get(i, 0) for i in k.tolist()], dtype=float)
    learned = k[(evidence(x, y, toxic, clean) >= least) & ((x / toxic) >= 12 * (y + 0.5) / clean)].view(np.uint64)
    whole = learned[(learned & np.uint64(1)).astype(bool)]
    whole = whole[~np.isin(whole, lexicon.keys)]
    starts = np.sort(learned[~(learned & np.uint64(1)).astype(bool)])
    grown = Lexicon(np.concatenate((lexicon.keys, whole)), np.concatenate((lexicon.codes, np.full(len(whole), SYMBOLS.index("I"), dtype=np.uint8))), {n: starts for n in PREFIXES} if len(starts) else {})
    grown.density = fit_density(sample, grown)
    return grown


def evidence(x, y, toxic: int, clean: int) -> np.ndarray:
    """Likelihood ratio statistic of x of `toxic` against y of `clean` documents."""
    def part(n, size, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return n * np.log(p) + (size - n) * np.log(1 - p)

    both = (x + y) / (toxic + clean)
    return 2 * (part(x, toxic, x / toxic) + part(y, clean, y / clean) - part(x, toxic, both) - part(y, clean, both))


def fit_density(sample: DataFrame, lexicon: Lexicon) -> float:
    """The density that divides the labelled sample best, a clean document counting five times."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                total, _, size = score_texts(part.column(0), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(total / np.maximum(size, 1)), part.column(1).cast(pa.int32())], ["density", "label"])

    got = sample.select("text", "label").mapInArrow(run, "density double, label int").toPandas()
    density, label = got["density"].to_numpy(), got["label"].to_numpy() != 0
    cuts = np.linspace(LEAST_DENSITY, 0.015, 25)
    loss = [5 * np.sum(~label & (density >= c)) + np.sum(label & (density < c)) for c in cuts]
    return float(cuts[int(np.argmin(loss))])


def score_documents(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, density, threat, toxic) of every row.

    A null or empty text scores 0 and isn't toxic; repeated rows and null ids are
    scored like any other row; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                total, threat, size = score_texts(part.column(1), shared.value)
                density = total / np.maximum(size, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(total), pa.array(density), pa.array(threat), pa.array(rejected(density, threat, shared.value))],
                    ["doc_id", "score", "density", "threat", "toxic"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, density double, threat double, toxic boolean")


def rejected(density: np.ndarray, threat: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    return (density >= lexicon.density) | (threat >= THREAT_WEIGHT)


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows whose text isn't toxic, with the columns they came with.

    Rows with a null or empty text stay, and so do repeated rows and rows without an id
    or with a shared one if their text isn't toxic.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    place = docs.columns.index("text")

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                total, threat, size = score_texts(part.column(place), shared.value)
                yield part.filter(pa.array(~rejected(total / np.maximum(size, 1), threat, shared.value)))

    return docs.mapInArrow(run, docs.schema)
