"""A suffix automaton over sequences of words, which gives matching statistics as it grows."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator


class SuffixAutomaton:
    """All substrings of the sequences added so far; a substring never spans two sequences."""

    def __init__(self) -> None:
        self.moves: list[dict[Hashable, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, moves: dict[Hashable, int], link: int) -> int:
        self.moves.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.moves) - 1

    def _split(self, at: int, symbol: Hashable) -> int:
        """The state of the longest string at ``at`` followed by symbol, split off if it is longer."""
        to = self.moves[at][symbol]
        if self.length[to] == self.length[at] + 1:
            return to
        copy = self._state(self.length[at] + 1, dict(self.moves[to]), self.link[to])
        self.link[to] = copy
        while at >= 0 and self.moves[at].get(symbol) == to:
            self.moves[at][symbol] = copy
            at = self.link[at]
        return copy

    def add(self, symbols: Iterable[Hashable]) -> Iterator[int]:
        """Adds a sequence; for each position, the length of the longest string ending there that was there before."""
        last, size = 0, 0
        for symbol in symbols:
            size += 1
            if symbol in self.moves[last]:
                last = self._split(last, symbol)
                yield size
                continue
            now, at = self._state(size, {}, 0), last
            while at >= 0 and symbol not in self.moves[at]:
                self.moves[at][symbol] = now
                at = self.link[at]
            if at >= 0:
                self.link[now] = self._split(at, symbol)
            last = now
            yield self.length[self.link[now]]
