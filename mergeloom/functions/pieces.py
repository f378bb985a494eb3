"""Splitting by the named patterns inside a worker, with memoised encodings.

A blank between two characters that aren't white space always begins a piece
(no alternative of the split patterns can cross it), so a text is cut at blanks
first and each distinct chunk goes through the pattern once.  A text with any
other blank (runs, or blanks beside line ends) takes the pattern as a whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import regex

from mergeloom.functions import patterns as P


def _compiled(java: str):
    """The same pattern in the `regex` module's syntax."""
    spelled = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), java)
    return regex.compile(spelled.replace(r"\z", r"\Z"))


CL, O2 = _compiled(P.CL), _compiled(P.O2)
BY_JAVA = {P.CL: CL, P.O2: O2}
MEMO_ENTRIES = 250_000
WORKER_ENTRIES = 60_000  # of a worker that holds little else: full soon, so memory doesn't follow the input
SLICE = 64  # rows of a batch that are Python objects at once
ENDS = frozenset(".,;:!?")


class Memo(dict):
    """make(key) by key, bounded: what a full generation held stays at hand for one more."""

    entries = MEMO_ENTRIES

    def __init__(self):
        self.old: dict = {}

    def __missing__(self, key: str):
        got = self.old.get(key, self)
        if got is self:
            got = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


class _Chunks(Memo):
    """chunk -> the packed ids of `lead` + chunk; None where a chunk may not be taken alone."""

    def __init__(self, owner: "PieceEncoder", lead: str):
        super().__init__()
        self.owner, self.lead, self.entries = owner, lead, owner.entries

    def make(self, chunk: str):
        owner = self.owner
        if not chunk:
            return None if self.lead else b""
        if owner.plain and chunk.isalpha():
            return owner.packed(self.lead + chunk)
        if owner.plain and chunk[-1] in ENDS and chunk[:-1].isalpha():
            return self[chunk[:-1]] + owner.piece(chunk[-1])
        if chunk[0].isspace() or chunk[-1].isspace():
            return None
        return owner.pieces(self.lead + chunk)


class _Pieces(Memo):
    def __init__(self, owner: "PieceEncoder"):
        super().__init__()
        self.make, self.entries = owner.packed, owner.entries


class PieceEncoder:
    """Texts to packed int32 ids through `encode(piece bytes) -> ids`."""

    def __init__(self, encode, pattern=CL, entries: int = MEMO_ENTRIES):
        self.encode_piece, self.pattern, self.entries = encode, pattern, entries
        self.plain = pattern is CL  # letters, with a blank before and a mark behind, need no pattern
        self.first, self.rest = _Chunks(self, ""), _Chunks(self, " ")
        self.memo = _Pieces(self)

    def packed(self, piece: str) -> bytes:
        return array("i", self.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()

    def piece(self, piece: str) -> bytes:
        return self.memo[piece]

    def pieces(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.pattern.findall(text)))

    def text(self, text: str) -> bytes:
        head, *parts = text.split(" ")
        try:
            return b"".join((self.first[head], *map(self.rest.__getitem__, parts)))
        except TypeError:
            return self.pieces(text)

    def count_within(self, text: str, limit: int) -> int | None:
        """Token count if it is at most the limit; stops soon after exceeding it."""
        n, left, chunks = 0, text, self.first
        try:
            while left is not None and n <= limit:
                head, *parts = left.split(" ", 128)
                left = parts.pop() if len(parts) == 128 else None
                n += (len(chunks[head]) + sum(map(len, map(self.rest.__getitem__, parts)))) >> 2
                chunks = self.rest
        except TypeError:
            n = 0
            for m in self.pattern.finditer(text):
                n += len(self.memo[m[0]]) >> 2
                if n > limit:
                    break
        return n if n <= limit else None


def sliced(values: pa.Array, one, kind: pa.DataType) -> pa.Array:
    """one(value) of each value, null for null; few rows at a time are Python objects."""
    parts = [pa.array([None if v is None else one(v) for v in values.slice(i, SLICE).to_pylist()], kind) for i in range(0, len(values), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def pack_lists(packed: list[bytes | None]) -> pa.Array:
    """array<int> column from packed ids; None is null."""
    sizes = np.array([0 if p is None else len(p) >> 2 for p in packed], dtype=np.int64)
    at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    null = np.array([p is None for p in packed] + [False], dtype=bool)
    values = np.frombuffer(b"".join(p for p in packed if p is not None), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(at, mask=null) if null.any() else pa.array(at), pa.array(values))
