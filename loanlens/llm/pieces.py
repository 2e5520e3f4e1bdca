"""Texts cut where byte-level BPE certainly has a word boundary.

A space that stands before a character which is no white space always begins a new word, so a text
can be cut before each such space and every piece encoded alone. Pieces repeat, so each distinct
one is encoded once for each cache.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from loanlens.llm.words import Kept

#: Python's white space holds all of Unicode's, so a cut is left out at most.
_WIDE = re.compile(r" \s| $")
_CUT = re.compile(r" (?=\S)")


def cut(text: str) -> list[str]:
    """Pieces; each but the first is to be read with a space before it."""
    return _CUT.split(text) if _WIDE.search(text) else text.split(" ")


class Cache:
    """What distinct pieces encode to. It is emptied when it holds `limit` pieces, which bounds the
    memory and changes no result."""

    def __init__(self, encode: Callable[[list[str]], Iterator], limit: int = 1 << 18) -> None:
        self.encode, self.limit = encode, limit
        self.first: dict = Kept()
        self.other: dict = Kept()

    def of(self, texts: list[str]) -> Iterator[list]:
        """For each text the values of its pieces."""
        split = [cut(text) for text in texts]
        self._fill(self.first, (pieces[0] for pieces in split), "")
        self._fill(self.other, (x for pieces in split for x in pieces[1:]), " ")
        for pieces in split:
            values = list(map(self.other.__getitem__, pieces[1:]))
            values.insert(0, self.first[pieces[0]])
            yield values

    def _fill(self, known: dict, pieces: Iterator[str], lead: str) -> None:
        if len(known) > self.limit:
            known.clear()
        missing = list(set(pieces).difference(known))
        if missing:
            known.update(zip(missing, self.encode([lead + x for x in missing]), strict=True))
