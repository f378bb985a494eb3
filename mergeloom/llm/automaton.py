"""Operator 3: byte-pair encoding by a tokenization automaton.

The automaton reads *tokens* and accepts exactly the sequences that byte-pair
merging produces.  It starts as one state with a loop for each single byte; merge
number k of (u, v) then adds a gadget: the state that u enters is copied, the copy
loses its arc v, every arc u is redirected to the copy, and wherever an arc u
started an arc uv is added that enters what v entered from the old state.

States are thus one per token (the state its arcs enter).  Their rows would hold
|V|^2 arcs, nearly all shared with the state they were copied from, so a row is
kept as (copied from, at which merge, arcs lost since), and transitions are
tabulated when first used; `arc` is the exact row lookup.

Every prefix of a byte string has exactly one accepted path, so a piece is
encoded by one pass over its positions: from the state reached at i, follow the
arcs whose labels match the bytes at i.  Decoding emits the arcs' labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.columns import gather_lists
from mergeloom.functions.kernels import Vocabulary
from mergeloom.functions.pieces import PieceEncoder, pack_lists
from mergeloom.llm.text import slices, text_buffers
from mergeloom.sources.ranks import DEFAULT_RANKS, load_vocabulary

TABLE_ENTRIES = 2_000_000
_HERE: dict[int, "MergeAutomaton"] = {}


class MergeAutomaton:
    """Deterministic automaton over tokens, compiled from the merges in rank order."""

    def __init__(self, tokens, left, right):
        self.tokens, self.left, self.right = tuple(tokens), list(left), list(right)
        n = len(self.tokens)
        self.base = [self.left[k] == k for k in range(n)]
        self.lost: dict[int, int] = {}  # state * n + arc -> the merge whose gadget removed it
        for k in range(n):
            if not self.base[k]:
                self.gadget(k)
        self.rows: dict[int, dict[int, bool]] = {}  # tabulated transitions of a state
        self.entries = 0
        self.trie: dict = {}  # arc labels: byte -> (deeper, token or -1)
        for k, token in enumerate(self.tokens):
            node = self.trie
            for byte in token[:-1]:
                node = node.setdefault(byte, ({}, -1))[0]
            node[token[-1]] = (node.get(token[-1], ({},))[0], k)
        self.encoder = PieceEncoder(self.encode)

    def gadget(self, k: int) -> None:
        """Merge k: the state u enters loses v; uv's state is a copy of v's, made now."""
        self.lost[self.left[k] * len(self.tokens) + self.right[k]] = k

    def arc(self, state: int, token: int) -> bool:
        """Whether `token` may follow the token that entered `state`."""
        n, lost, base, left, right = len(self.tokens), self.lost, self.base, self.left, self.right
        before = n  # gadgets numbered below this have been applied
        while True:
            gone = lost.get(state * n + token)
            if gone is not None and gone < before:
                return False
            if not base[token] and (token >= state or base[state]):
                token, before = left[token], token + 1  # added beside its left part's arc, after that gadget's removal
            elif not base[state]:
                state, before = right[state], state  # copied from the right part's state, before its own gadget
            else:
                return True

    def encode(self, data: bytes) -> list[int]:
        """Labels of the only accepted path over the bytes; [] for b""."""
        size = len(data)
        if not size:
            return []
        trie, rows = self.trie, self.rows
        entered, back = [-1] * (size + 1), [0] * (size + 1)
        node = trie
        for end, byte in enumerate(data, 1):  # any token may come first
            got = node.get(byte)
            if got is None:
                break
            node, token = got
            if token >= 0:
                entered[end] = token
        for i in range(1, size):
            state = entered[i]
            if state < 0:
                continue
            row = rows.get(state)
            if row is None:
                row = rows[state] = {}
            node, end = trie, i
            for byte in data[i:]:
                got = node.get(byte)
                if got is None:
                    break
                node, token = got
                end += 1
                if token >= 0:
                    ok = row.get(token)
                    if ok is None:
                        ok = row[token] = self.arc(state, token)
                        self.entries += 1
                    if ok:
                        entered[end], back[end] = token, i
        if self.entries > TABLE_ENTRIES:
            rows.clear()
            self.entries = 0
        out, end = [], size
        while end:
            if entered[end] < 0:
                raise ValueError("a byte of the text isn't in the vocabulary")
            out.append(entered[end])
            end = back[end]
        return out[::-1]

    def __reduce__(self):
        return _restore, (self.tokens, np.array(self.left, dtype=np.int32), np.array(self.right, dtype=np.int32))

    def labels(self) -> tuple[np.ndarray, np.ndarray]:
        """(all label bytes, offsets) for decoding."""
        lens = np.fromiter(map(len, self.tokens), dtype=np.int64, count=len(self.tokens))
        return np.frombuffer(b"".join(self.tokens), dtype=np.uint8), np.concatenate(([0], np.cumsum(lens)))


def _restore(tokens, left, right) -> MergeAutomaton:
    key = hash(tokens)
    if key not in _HERE:
        _HERE[key] = MergeAutomaton(tokens, left.tolist(), right.tolist())
    return _HERE[key]


def compile_automaton(vocab: Vocabulary) -> MergeAutomaton:
    left, right = vocab.splits
    return MergeAutomaton(vocab.tokens, left, right)


def decode_flat(ids: np.ndarray, labels: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes of the ids' labels, concatenated."""
    return gather_lists(at[ids], at[ids + 1] - at[ids], labels)


def encode_documents(spark: SparkSession, docs: DataFrame, ranks: str = DEFAULT_RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip) of every row.

    `round_trip` says that decoding the tokens gives the text's bytes.  A null text
    gives null tokens, n_tokens and round_trip; "" gives [], 0 and true.  Rows that
    repeat, and rows with a null id, are encoded like any other; other columns are
    not read.
    """
    shared = spark.sparkContext.broadcast(compile_automaton(load_vocabulary(spark, ranks)))

    def run(batches):
        machine: MergeAutomaton = shared.value
        labels, at = machine.labels()
        one = machine.encoder.text
        for batch in batches:
            for part in slices(batch):
                packed = [None if t is None else one(t) for t in part.column(1).to_pylist()]
                lists = pack_lists(packed)
                sizes = np.array([0 if p is None else len(p) >> 2 for p in packed], dtype=np.int64)
                null = np.array([p is None for p in packed], dtype=bool)
                ids = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
                data, ends = text_buffers(part.column(1))
                lens = np.concatenate(([0], np.cumsum(at[ids + 1] - at[ids])))
                stops = lens[np.concatenate(([0], np.cumsum(sizes)))]
                back = decode_flat(ids, labels, at)
                if np.array_equal(stops, ends) and np.array_equal(back, data):
                    same = np.ones(part.num_rows, dtype=bool)
                else:
                    same = np.array([np.array_equal(back[stops[i] : stops[i + 1]], data[ends[i] : ends[i + 1]]) for i in range(part.num_rows)], dtype=bool)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes.astype(np.int32), mask=null), pa.array(same, mask=null)], ["doc_id", "tokens", "n_tokens", "round_trip"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, tokens array<int>, n_tokens int, round_trip boolean")
