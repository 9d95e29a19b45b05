"""Shortest-pack-first packing over a histogram of lengths.

Lengths are placed longest first, each into the packs that are filled least
among those with room, or into new packs. Packs that hold the same lengths are
one pattern with a count, so the work and the plan depend on how many different
lengths there are, not on how many documents. A slot (length, rank) of a pattern
holds, in its pack number j, the document number rank + j of that length.

Documents may be cut, so packs need not stay short. With a gap of G ids in all
packs together, the G // size packs filled least are taken apart: their contents,
one after another, fill the gaps of the others, one after another, and are cut
where a gap ends. That leaves less than one pack's size of padding in total, and
every document outside those packs stays whole. Where a piece goes follows from
running sums over patterns; the plan holds no cut.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from typing import NamedTuple

import numpy as np


class Slot(NamedTuple):
    length: int
    rank: int


class Pattern(NamedTuple):
    count: int
    slots: tuple[Slot, ...]

    @property
    def filled(self) -> int:
        return sum(s.length for s in self.slots)


def _later(pattern: Pattern, by: int, count: int) -> Pattern:
    """``count`` packs of ``pattern`` after its first ``by``."""
    return Pattern(count, tuple(Slot(s.length, s.rank + by) for s in pattern.slots))


def place(histogram: Mapping[int, int], size: int) -> list[Pattern]:
    """Patterns of packs of at most ``size`` that hold every length of ``histogram`` whole."""
    if any(not 0 < length <= size for length in histogram):
        raise ValueError(f"lengths must be from 1 to {size}")
    room: dict[int, list[Pattern]] = {}  # by the space that is left
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        spaces = [-space for space in room if space >= length]
        heapq.heapify(spaces)
        while left and spaces and -spaces[0] >= length:
            space = -spaces[0]
            pattern = room[space].pop()
            taken = min(left, pattern.count)
            if taken < pattern.count:
                room[space].append(_later(pattern, taken, pattern.count - taken))
            if not room[space]:
                del room[space]
                heapq.heappop(spaces)
            rest = space - length
            if rest not in room:
                room[rest] = []
                heapq.heappush(spaces, -rest)
            room[rest].append(Pattern(taken, (*pattern.slots, Slot(length, rank))))
            rank, left = rank + taken, left - taken
        # new packs: one with room for more of this length is the shortest, so it gets the next
        most = size // length
        for held, count in ((most, left // most), (left % most, 1)):
            if held and count:
                slots = tuple(Slot(length, rank + k * count) for k in range(held))
                room.setdefault(size - held * length, []).append(Pattern(count, slots))
                rank += held * count
    return [p for space in sorted(room) for p in room[space]]


def taken_apart(patterns: list[Pattern], size: int) -> tuple[list[Pattern], list[Pattern]]:
    """``patterns``, fullest first, and those of them whose contents fill up the others."""
    kept = sorted(patterns, key=lambda p: -p.filled)
    left = sum(p.count * (size - p.filled) for p in kept) // size
    apart = []
    while left:
        pattern = kept.pop()
        n = min(left, pattern.count)
        apart.append(_later(pattern, 0, n))
        if n < pattern.count:
            kept.append(_later(pattern, n, pattern.count - n))
        left -= n
    return kept, apart


class Plan:
    """Where the pieces of any document go, told by its length and rank.

    All arrays have a row per slot or per pattern of the histogram's packing.
    """

    def __init__(self, histogram: Mapping[int, int], size: int):
        kept, apart = taken_apart(place(histogram, size), size)
        rows = []
        for k, p in enumerate([*kept, *apart]):
            at = 0
            for s in p.slots:
                rows.append((s.length, s.rank, k, at))
                at += s.length
        rows.sort()
        self.size, self.n_kept = size, len(kept)
        self.length, self.rank, self.pattern, self.at = np.array(rows, dtype=np.int64).reshape(-1, 4).T.copy()
        self.lengths, self.first_slot = np.unique(self.length, return_index=True)
        count, fill = (
            np.array([v(p) for p in [*kept, *apart]], dtype=np.int64) for v in (lambda p: p.count, lambda p: p.filled)
        )
        self.fill = fill
        n = self.n_kept
        #: The first sequence of a kept pattern; the first id of one taken apart.
        self.base = np.concatenate((np.cumsum(count[:n]) - count[:n], np.cumsum((count * fill)[n:]) - (count * fill)[n:]))
        self.sequences = int(count[:n].sum())
        #: Gaps before each kept pattern; patterns without a gap are at the front.
        gap = size - fill[:n]
        self.gap, self.gaps_before = gap, np.cumsum(count[:n] * gap) - count[:n] * gap

    def _cells(self, ids: np.ndarray) -> np.ndarray:
        """The sequence whose gap each id of the contents taken apart fills."""
        k = np.searchsorted(self.gaps_before, ids, side="right") - 1
        return self.base[k] + (ids - self.gaps_before[k]) // self.gap[k]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """For every piece of the documents: document, start, size, sequence, offset."""
        slot = np.zeros(len(length), dtype=np.int64)
        for k, n in enumerate(self.lengths):
            mine = np.flatnonzero(length == n)
            lo = self.first_slot[k]
            hi = self.first_slot[k + 1] if k + 1 < len(self.lengths) else len(self.length)
            slot[mine] = lo + np.searchsorted(self.rank[lo:hi], rank[mine], side="right") - 1
        pattern, pack = self.pattern[slot], rank - self.rank[slot]
        whole = pattern < self.n_kept
        # contents taken apart, as places in the run of all of them
        first = np.where(whole, 0, self.base[pattern] + pack * self.fill[pattern] + self.at[slot])
        sequence = self.base[pattern] + pack
        cut = np.flatnonzero(~whole)
        sequence[cut] = self._cells(first[cut])
        n = np.ones(len(length), dtype=np.int64)
        n[cut] = self._cells(first[cut] + length[cut] - 1) - sequence[cut] + 1
        doc = np.repeat(np.arange(len(length)), n)
        sequence = sequence[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start, size, offset = np.zeros(len(doc), dtype=np.int64), length[doc].astype(np.int64), self.at[slot[doc]]
        part = np.flatnonzero(~whole[doc])
        into = np.searchsorted(self.base[: self.n_kept], sequence[part], side="right") - 1
        gap = self.gaps_before[into] + (sequence[part] - self.base[into]) * self.gap[into]
        a, b = first[doc[part]], first[doc[part]] + length[doc[part]]
        lo, hi = np.maximum(a, gap), np.minimum(b, gap + self.gap[into])
        start[part], size[part], offset[part] = lo - a, hi - lo, self.fill[into] + lo - gap
        return doc, start, size, sequence, offset
