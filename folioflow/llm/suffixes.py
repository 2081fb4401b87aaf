"""The Burrows-Wheeler order and common prefixes of many aligned strings, built column by column.

Strings of a group are laid out so that equal substrings of interest stand in the
same columns. A symbol is then a byte with its column, so the suffixes that begin in
one column are one segment of the collection's transform, and a round that puts in
the column before writes one more segment and leaves the others as they are: segments
are made and read one after the other, and only the newest is held.

A round inserts one symbol of every string. The suffixes that begin with a symbol
stand in the order in which the last segment's transform holds it, so a stable sort by
symbol gives the new segment. Two neighbours with the same symbol have a common prefix
one longer than the least one between their places before; others have none.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last] for each range."""
    turn = np.argsort(-last)
    cuts = np.empty(2 * len(turn), np.int64)
    cuts[::2], cuts[1::2] = first[turn], last[turn] + 1
    out = np.empty(len(turn), values.dtype)
    # By falling ends, a range ends at or after the next one's start, so what lies between ranges is never read.
    out[turn] = np.minimum.reduceat(np.append(values, values.dtype.type(0)), cuts)[::2] if len(turn) else 0
    return out


class Segments:
    """The rows of one column at a time, from the last column to the first.

    rows has the strings with a symbol in the column, by group and then by their
    suffixes from there; common the length of each row's common prefix with the row
    before, 0 for the first of a group. leads are the columns that strings begin
    before the one at which they are aligned; groups do not decrease.
    """

    def __init__(self, strings: Sequence[bytes], leads: Sequence[int], groups: Sequence[int]):
        sizes = np.array([len(s) for s in strings], np.int64)
        lead = np.array(leads, np.int64)
        self.begin = (lead.max(initial=0) - lead).astype(np.int64)
        self.end = self.begin + sizes
        self.column = int(self.end.max(initial=0))
        self._groups = np.array(groups, np.int64)
        self._grid = np.zeros((self.column, len(strings)), np.uint8)
        of = np.repeat(np.arange(len(strings)), sizes)
        at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes - self.begin, sizes)
        self._grid[at, of] = np.frombuffer(b"".join(strings), np.uint8)
        self._by_end = np.argsort(self.end, kind="stable")
        self._ends = self.end[self._by_end]
        self.rows = np.zeros(0, np.int64)
        self.common = np.zeros(0, np.int32)

    def insert(self) -> None:
        """Go on to the column before."""
        self.column -= 1
        self._leave()
        self._enter()
        rows, common = self.rows, self.common
        symbols = self._groups[rows] << 8 | self._grid[self.column, rows]
        turn = np.argsort(symbols, kind="stable")
        symbols = symbols[turn]
        alike = np.flatnonzero(symbols[1:] == symbols[:-1])
        self.common = np.zeros(len(rows), np.int32)
        self.common[alike + 1] = _least(common, turn[alike] + 1, turn[alike + 1]) + 1
        self.rows = rows[turn]

    def _leave(self) -> None:
        """Take out strings that begin after this column; a row's prefix in common is then the least on the way to its new neighbour."""
        stay = np.flatnonzero(self.begin[self.rows] <= self.column)
        if len(stay) < len(self.rows):
            cuts = np.append(0, stay[:-1] + 1) if len(stay) else stay
            self.common = np.minimum.reduceat(self.common[: stay[-1] + 1], cuts) if len(stay) else self.common[:0]
            self.rows = self.rows[stay]

    def _enter(self) -> None:
        """Put strings that end with this column, whose suffix is empty so far, before the others of their groups."""
        a, b = np.searchsorted(self._ends, [self.column + 1, self.column + 2])
        new = np.sort(self._by_end[a:b])
        if len(new):
            rows = np.concatenate([new, self.rows])
            turn = np.argsort(self._groups[rows], kind="stable")
            self.rows = rows[turn]
            self.common = np.concatenate([np.zeros(len(new), np.int32), self.common])[turn]


def repeated_starts(strings: Sequence[bytes], leads: Sequence[int], groups: Sequence[int], window: int) -> list[np.ndarray]:
    """For each string the starts, in order, of its substrings of window bytes that another string of its group has in the same columns."""
    segments = Segments(strings, leads, groups)
    found_in, found_at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while segments.column:
        segments.insert()
        common = np.append(segments.common, 0)
        hit = segments.rows[np.maximum(common[:-1], common[1:]) >= window]
        found_in.append(hit)
        found_at.append(segments.column - segments.begin[hit])
    of, at = np.concatenate(found_in), np.concatenate(found_at)
    turn = np.lexsort((at, of))
    return np.split(at[turn], np.searchsorted(of[turn], np.arange(1, len(strings)))) if len(strings) else []
