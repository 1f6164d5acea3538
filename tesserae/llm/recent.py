"""A bounded dictionary of what was encoded before, for one Python task."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import filterfalse

#: Letters of the longest string that is remembered.
LONGEST = 64


class Recent:
    """Remembers up to `most` strings that stood in at least two lists of one call; all others for that call only."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.now: dict[str, bytes] = {}
        self.once: list[str] = []

    def _trim(self) -> None:
        for w in self.once:
            del self.now[w]
        self.once = []
        if len(self.now) > self.most:
            self.now = {}

    def of(self, wanted: Iterable[Iterable[str]], make: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """A dictionary that has every string of these lists; `make` gives the values of new ones."""
        wanted = list(wanted)
        self._trim()
        new: set[str] = set()
        twice: set[str] = set()
        known = self.now.__contains__
        for strings in wanted:
            fresh = set(filterfalse(known, strings))
            twice |= new & fresh
            new |= fresh
        if new:
            rest = list(new)
            self.now.update(zip(rest, make(rest), strict=True))
        self.once = [w for w in new if w not in twice or len(w) > LONGEST]
        return self.now

    def each(self, strings: list[str], often: list[bool], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The values of distinct strings, of which new ones are remembered if they are marked as frequent."""
        self._trim()
        found = list(map(self.now.get, strings))
        new = [i for i, v in enumerate(found) if v is None]
        for i, v in zip(new, make([strings[i] for i in new]) if new else [], strict=True):
            found[i] = v
            if often[i] and len(strings[i]) <= LONGEST:
                self.now[strings[i]] = v
        return found
