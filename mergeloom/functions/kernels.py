"""Byte-pair kernels: what runs inside an Arrow batch when the JVM can't.

The encoding is defined as: start from single bytes, keep merging the adjacent
pair whose concatenation has the lowest id, leftmost on ties, until no adjacent
pair is a token.  `Vocabulary.encode` computes that; the other encoders are the
alternatives that are specified on their own.
"""

from __future__ import annotations

import hashlib
import heapq

MEMO_LIMIT = 200_000
FOLLOW_LIMIT = 200_000
_HERE: dict[tuple, "Vocabulary"] = {}


def _restore(tokens: tuple[bytes, ...], strict: bool, key: str) -> "Vocabulary":
    """One instance per process: tables and memo outlive a task."""
    at = (key, strict)
    if at not in _HERE:
        _HERE[at] = Vocabulary(tokens, strict=strict)
    return _HERE[at]


class _Follows(dict):
    """left * size + right -> whether token right may directly follow token left; bounded."""

    def __init__(self, vocab: "Vocabulary"):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, key: int) -> bool:
        got = self.vocab._may_follow(*divmod(key, len(self.vocab)))
        if len(self) >= FOLLOW_LIMIT:
            self.clear()
        self[key] = got
        return got


class Vocabulary:
    """Token bytes by id, with everything derived from them.

    ``strict`` demands all 256 single bytes.  Without it, a text that holds a
    byte outside the vocabulary encodes to None.
    """

    def __init__(self, tokens, strict: bool = True):
        self.tokens = tuple(bytes(t) for t in tokens)
        self.strict = strict
        if not self.tokens:
            raise ValueError("a vocabulary needs at least one token")
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        if len(self.ranks) != len(self.tokens) or b"" in self.ranks:
            raise ValueError("tokens must be distinct and not empty")
        missing = [i for i in range(256) if bytes((i,)) not in self.ranks]
        if strict and missing:
            raise ValueError(f"{len(missing)} single bytes are missing; pass strict=False to allow that")
        self.max_len = max(map(len, self.tokens))
        self.memo: dict[bytes, tuple[int, ...] | None] = {}
        self._splits = self._next = self._pairs = self._tails = self._whole = self._linked = None
        self.follows = _Follows(self)

    def __len__(self) -> int:
        return len(self.tokens)

    def __reduce__(self):
        key = hashlib.sha256(b"\0".join(self.tokens)).hexdigest()
        return _restore, (self.tokens, self.strict, key)

    # -- exact encoding ----------------------------------------------------

    def encode(self, data: bytes) -> list[int] | None:
        """Exact encoding; [] for b"", None if a byte has no token."""
        if len(data) <= 48:
            got = self._scan(data)
        else:
            got = self._heap(data)
        return None if got is None else [self.ranks[p] for p in got]

    def encode_short(self, data: bytes) -> list[int]:
        """`encode` for a complete vocabulary, tuned to short pieces."""
        if len(data) > 48:
            return self.encode(data)
        rank, never = self.ranks.get, 1 << 60
        whole = rank(data)
        if whole is not None and whole in self.whole:
            return [whole]
        at = list(range(len(data) + 1))
        costs = [rank(data[i : i + 2], never) for i in range(len(data) - 1)]
        while costs:
            best = min(costs)
            if best == never:
                break
            i = costs.index(best)
            del at[i + 1], costs[i]
            if i < len(costs):
                costs[i] = rank(data[at[i] : at[i + 2]], never)
            if i:
                costs[i - 1] = rank(data[at[i - 1] : at[i + 1]], never)
        return [self.ranks[data[a:b]] for a, b in zip(at, at[1:])]

    @property
    def whole(self) -> frozenset[int]:
        """Ids whose bytes encode to themselves alone."""
        if self._whole is None:
            self._whole = frozenset(i for i, t in enumerate(self.tokens) if self.encode(t) == [i])
        return self._whole

    def encode_memo(self, piece: bytes) -> tuple[int, ...] | None:
        """`encode` for pieces that recur; the memo is bounded."""
        got = self.memo.get(piece, 0)
        if got == 0:
            ids = self.encode(piece)
            got = None if ids is None else tuple(ids)
            if len(self.memo) >= MEMO_LIMIT:
                self.memo.clear()
            if len(piece) <= 64:
                self.memo[piece] = got
        return got

    def _scan(self, data: bytes, below: int | None = None) -> list[bytes] | None:
        """Merge by repeated minimum; quadratic, for short inputs."""
        ranks, top = self.ranks, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        if not self.strict and any(p not in ranks for p in parts):
            return None
        costs = [ranks.get(parts[i] + parts[i + 1], top) for i in range(len(parts) - 1)]
        limit = top if below is None else below
        while costs:
            best = min(costs)
            if best >= limit:
                break
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], top)
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], top)
        return parts

    def _heap(self, data: bytes) -> list[bytes] | None:
        """The same merges from a heap of (id, position): n log n."""
        ranks, n = self.ranks, len(data)
        if not self.strict and any(data[i : i + 1] not in ranks for i in range(n)):
            return None
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            r = ranks.get(data[i : i + 2])
            if r is not None:
                queue.append((r, i, i + 2))
        heapq.heapify(queue)
        while queue:
            _, i, e = heapq.heappop(queue)
            m = end[i]
            if m < 0 or m >= n or end[m] != e or m == e:
                continue
            end[i], end[m] = e, -1
            if e < n:
                before[e] = i
                r = ranks.get(data[i : end[e]])
                if r is not None:
                    heapq.heappush(queue, (r, i, end[e]))
            p = before[i]
            if p >= 0:
                r = ranks.get(data[p:e])
                if r is not None:
                    heapq.heappush(queue, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(data[i : end[i]])
            i = end[i]
        return out

    # -- derived tables ----------------------------------------------------

    @property
    def splits(self) -> tuple[list[int], list[int]]:
        """(left, right): the pair each token was merged from; its own id if primitive."""
        if self._splits is None:
            left, right = [], []
            for i, t in enumerate(self.tokens):
                parts = self._scan(t, below=i) if len(t) > 1 else None
                ok = parts is not None and len(parts) == 2
                left.append(self.ranks[parts[0]] if ok else i)
                right.append(self.ranks[parts[1]] if ok else i)
            self._splits = (left, right)
        return self._splits

    @property
    def linked(self) -> bool:
        """Whether tokens of which each may follow the one before always are an encoding: each has been merged from two lower ones."""
        if self._linked is None:
            left = self.splits[0]
            self._linked = all(len(self.tokens[i]) == 1 or left[i] != i for i in self.whole)
        return self._linked

    @property
    def pairs(self) -> dict[tuple[int, int], int]:
        """(left, right) -> id of the token merged from them."""
        if self._pairs is None:
            left, right = self.splits
            self._pairs = {(a, b): i for i, (a, b) in enumerate(zip(left, right)) if a != i}
        return self._pairs

    @property
    def next_prefixes(self) -> list[int | None]:
        """Id of each token's longest proper prefix that is a token."""
        if self._next is None:
            ranks = self.ranks
            self._next = [next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks), None) for t in self.tokens]
        return self._next

    @property
    def tails(self) -> set[bytes]:
        """Every suffix of every token: bounds the backward search for tokens ending at a place."""
        if self._tails is None:
            self._tails = {t[k:] for t in self.tokens for k in range(len(t))}
        return self._tails

    def valid_pair(self, a: int, b: int) -> bool:
        """Whether token b may directly follow token a in an encoding.

        A pair is impossible if a piece on a's right edge and one on b's left
        edge would have merged before either was used up inside a or b.
        """
        return self.follows[a * len(self.tokens) + b]

    def _may_follow(self, a: int, b: int) -> bool:
        left, right = self.splits
        pairs, never = self.pairs, 1 << 60
        edge_b, x, used = [], b, never
        while True:
            edge_b.append((x, used))
            if left[x] == x:
                break
            x, used = left[x], x
        ok, y, used_y = True, a, never
        while ok:
            for x, used_x in edge_b:
                k = pairs.get((y, x))
                if k is not None and k < used_y and k <= used_x:
                    ok = False
                    break
            if right[y] == y:
                break
            y, used_y = right[y], y
        return ok

    def next_match(self, data: bytes) -> int | None:
        """Longest token that the data starts with."""
        for k in range(min(self.max_len, len(data)), 0, -1):
            got = self.ranks.get(data[:k])
            if got is not None:
                return got
        return None

    # -- other encoders ----------------------------------------------------

    def ending_at(self, data: bytes, end: int):
        """Tokens that end at a place, longest first."""
        tails, ranks, found = self.tails, self.ranks, []
        k = 1
        while k <= end:
            s = data[end - k : end]
            if s not in tails:
                break
            r = ranks.get(s)
            if r is not None:
                found.append(r)
            k += 1
        return reversed(found)

    def prefix_tokens(self, data: bytes) -> list[int] | None:
        """Last token of the encoding of every non-empty prefix."""
        last: list[int] = []
        for end in range(1, len(data) + 1):
            t = self.last_token(data, end, last)
            if t is None:
                return None
            last.append(t)
        return last

    def last_token(self, data: bytes, end: int, last: list[int]) -> int | None:
        """Last token of the encoding of data[:end], given those of all shorter prefixes."""
        for t in self.ending_at(data, end):
            start = end - len(self.tokens[t])
            if start == 0 or self.valid_pair(last[start - 1], t):
                return t
        return None

    def encode_table(self, data: bytes) -> list[int] | None:
        """Exact encoding read back from `prefix_tokens`."""
        last = self.prefix_tokens(data)
        if last is None:
            return None
        out, end = [], len(data)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return out[::-1]

    def encode_heap(self, data: bytes) -> list[int] | None:
        got = self._heap(data)
        return None if got is None else [self.ranks[p] for p in got]

    def encode_greedy(self, data: bytes) -> list[int] | None:
        """Longest match first; not a BPE encoding in general."""
        out, i, ranks, top = [], 0, self.ranks, self.max_len
        while i < len(data):
            for k in range(min(top, len(data) - i), 0, -1):
                r = ranks.get(data[i : i + k])
                if r is not None:
                    out.append(r)
                    i += k
                    break
            else:
                return None
        return out

    def encode_minimal(self, data: bytes) -> list[int] | None:
        """Fewest tokens; on ties the longest last token at every place."""
        n = len(data)
        best: list[tuple[int, int] | None] = [(0, -1)] + [None] * n
        for end in range(1, n + 1):
            for t in self.ending_at(data, end):
                prev = best[end - len(self.tokens[t])]
                if prev is not None and (best[end] is None or prev[0] + 1 < best[end][0]):
                    best[end] = (prev[0] + 1, t)
            if best[end] is None and self.strict:
                return None
        if best[n] is None:
            return None
        out, end = [], n
        while end:
            t = best[end][1]
            out.append(t)
            end -= len(self.tokens[t])
        return out[::-1]

    def decode(self, ids) -> bytes | None:
        """Concatenated bytes; None if an id is unknown."""
        n, tokens = len(self.tokens), self.tokens
        out = []
        for i in ids:
            if i is None or not 0 <= i < n:
                return None
            out.append(tokens[i])
        return b"".join(out)

    def prefix_counts(self, data: bytes) -> list[int] | None:
        """Token counts of all prefixes, the empty one included."""
        last = self.prefix_tokens(data)
        if last is None:
            return None
        counts = [0]
        for end, t in enumerate(last, 1):
            counts.append(counts[end - len(self.tokens[t])] + 1)
        return counts

    def count_within(self, data: bytes, limit: int) -> int | None:
        """Token count if it is at most the limit, else None."""
        if len(data) > limit * self.max_len:
            return None
        if len(data) <= 64 * limit + self.max_len:
            ids = self.encode(data)
            return None if ids is None or len(ids) > limit else len(ids)
        # an encoding without its last token is an encoding: after max_len prefixes over the limit none comes below it
        last, counts, over = [], [0], 0
        for end in range(1, len(data) + 1):
            t = self.last_token(data, end, last)
            if t is None:
                return None
            last.append(t)
            counts.append(counts[end - len(self.tokens[t])] + 1)
            over = over + 1 if counts[end] > limit else 0
            if over == self.max_len:
                return None
        return counts[-1] if counts[-1] <= limit else None
