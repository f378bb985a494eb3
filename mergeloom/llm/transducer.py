"""Weighted finite-state transducers over small alphabets: composition and best paths."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Transducer:
    """arcs[state][symbol] = [(output, weight, next state)]; weights add, the best path is the heaviest."""

    start: object
    final: dict = field(default_factory=dict)
    arcs: dict = field(default_factory=dict)

    def arc(self, state, symbol, output, weight, to) -> "Transducer":
        self.arcs.setdefault(state, {}).setdefault(symbol, []).append((output, weight, to))
        return self

    def compose(self, other: "Transducer") -> "Transducer":
        """self, then other on its output; states are pairs, those out of reach are left out."""
        out = Transducer((self.start, other.start))
        todo, seen = [out.start], {out.start}
        while todo:
            a, b = state = todo.pop()
            if a in self.final and b in other.final:
                out.final[state] = self.final[a] + other.final[b]
            for symbol, arcs in self.arcs.get(a, {}).items():
                for middle, w1, to1 in arcs:
                    for output, w2, to2 in other.arcs.get(b, {}).get(middle, ()):
                        to = (to1, to2)
                        out.arc(state, symbol, output, w1 + w2, to)
                        if to not in seen:
                            seen.add(to)
                            todo.append(to)
        return out

    def numbered(self) -> "Transducer":
        """The same machine with states 0.., for compact tables."""
        names: dict = {}
        number = lambda s: names.setdefault(s, len(names))
        out = Transducer(number(self.start))
        for state, by in self.arcs.items():
            for symbol, arcs in by.items():
                for output, weight, to in arcs:
                    out.arc(number(state), symbol, output, weight, number(to))
        out.final = {number(s): w for s, w in self.final.items()}
        return out

    def best(self, symbols) -> float | None:
        """Weight of the heaviest accepting path (Viterbi); None if there is none."""
        at = {self.start: 0.0}
        for x in symbols:
            nxt: dict = {}
            for state, w in at.items():
                for _, v, to in self.arcs.get(state, {}).get(x, ()):
                    if w + v > nxt.get(to, float("-inf")):
                        nxt[to] = w + v
            at = nxt
        return max((w + self.final[s] for s, w in at.items() if s in self.final), default=None)
