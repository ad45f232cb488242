"""Generalised suffix automata over sequences of hashable symbols."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """All substrings of several sequences; about two states for each symbol at most.

    `least[state]` is the smallest owner (a number given with each sequence) in which the
    state's substrings occur, once `finish` has run.
    """

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.least: list[int | None] = [None]

    def _state(self, length: int, link: int, arcs: dict, least: int | None) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        self.least.append(least)
        return len(self.link) - 1

    def _split(self, p: int, q: int, symbol: Hashable) -> int:
        """The state for the substrings of q that are no longer than those of p and one symbol."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), None)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: Iterable[Hashable], owner: int = 0) -> None:
        last, least = 0, self.least
        for symbol in sequence:
            if (q := self.next[last].get(symbol)) is not None:
                last = self._split(last, q, symbol)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}, None), last
                while p >= 0 and symbol not in self.next[p]:
                    self.next[p][symbol] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, self.next[p][symbol], symbol)
                last = new
            if least[last] is None or owner < least[last]:
                least[last] = owner

    def finish(self) -> None:
        """Carries the smallest owners from longer substrings to their suffixes."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            p, mine = self.link[v], self.least[v]
            if p > 0 and mine is not None and (self.least[p] is None or mine < self.least[p]):
                self.least[p] = mine

    def match(self, sequence: Sequence[Hashable], cap: int) -> Iterable[tuple[int, int]]:
        """Matching statistics: for each position the state and the length, `cap` at most, of the longest substring that ends there."""
        arcs, link, length = self.next, self.link, self.length
        v = n = 0
        for symbol in sequence:
            while (w := arcs[v].get(symbol)) is None and v:
                v = link[v]
                n = length[v]
            if w is None:
                n = 0
            else:
                v = w
                n += 1
                if n > cap:
                    n = cap
                while length[link[v]] >= n and v:
                    v = link[v]
            yield v, n
