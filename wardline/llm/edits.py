"""Near words of many shards at once, by columns.

Of the pairs of words of a shard, those whose letters rule it out are dropped by counting
bits (each letter that only one string has is an edit); the others get their edit distance
by the bit-parallel automaton of Levenshtein states, one step per letter for all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np

#: Longest string, in letters, that fits the bits of a state.
LONGEST = 64
#: Pairs that are looked at together; it bounds what a task holds.
BLOCK = 1_000_000

_NONE = np.uint64(0)
_ONE = np.uint64(1)


def spans(counts: np.ndarray, most: int = BLOCK) -> Iterator[slice]:
    """Slices of ``counts`` whose sums are at most ``most``, or single entries."""
    ends = np.cumsum(counts)
    at, done = 0, 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield slice(at, to)
        at, done = to, int(ends[to - 1])


def ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, position) of every position in the ranges ``starts`` to ``starts + counts``."""
    which = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return which, np.arange(len(which)) + np.repeat(starts - before, counts)


def distances(x: np.ndarray, x_size: np.ndarray, y: np.ndarray, y_size: np.ndarray) -> np.ndarray:
    """Edits between the strings in the rows of ``x`` and ``y``: letters as numbers from 1, filled up with 0."""
    out = np.where(x_size == 0, y_size, x_size).astype(np.int64)
    for width, kind in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)):
        rows = np.flatnonzero((x_size > width // 2 * (width > 8)) & (x_size <= width))
        for span in spans(np.full(len(rows), width), 4 * BLOCK):
            some = rows[span]
            a, b, m, n = x[some, :width], y[some], x_size[some], y_size[some]
            if a.shape[1] < width:
                a = np.pad(a, ((0, 0), (0, width - a.shape[1])))
            one, last = kind(1), (m - 1).astype(kind)
            up, down = np.full(len(some), np.iinfo(kind).max, kind), np.zeros(len(some), kind)
            edits = m.astype(np.int64)
            for j in range(int(n.max(initial=0))):
                equal = np.packbits(a == b[:, j : j + 1], axis=1, bitorder="little").view(kind)[:, 0]
                vertical = equal | down
                across = (((equal & up) + up) ^ up) | equal
                more, less = down | ~(across | up), up & across
                edits += np.where(j < n, (more >> last & one).astype(np.int64) - (less >> last & one).astype(np.int64), 0)
                more, less = (more << one) | one, less << one
                up, down = less | ~(vertical | more), more & vertical
            out[some] = edits
    return out


class _Sort(NamedTuple):
    """A sort of strings by word: range of its forms, letters that all and that any of them have, and bounds."""

    start: np.ndarray
    count: np.ndarray
    least: np.ndarray
    most: np.ndarray
    edits: np.ndarray
    asks: np.ndarray


class Words:
    """Distinct words with their forms as columns; ``long`` are those that have a string too long for ``near``."""

    def __init__(self, words: Sequence[str], forms: Callable[[str], Sequence]) -> None:
        of = [forms(w) for w in words]
        self.long = np.array([any(len(f.text) > LONGEST for f in fs) for fs in of], bool)
        flat = sorted(((f.sort, w, f) for w, fs in enumerate(of) if not self.long[w] for f in fs), key=lambda x: x[:2])
        texts = [f.text for _, _, f in flat]
        self.size = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters, codes = np.unique(points, return_inverse=True)
        self.text = np.zeros((len(texts), int(self.size.max(initial=1))), np.uint8 if len(letters) < 255 else np.uint32)
        row, column = ranges(np.zeros(len(texts), np.int64), self.size)
        self.text[row, column] = codes + 1
        # a bit for the n-th occurrence of a letter
        order = np.lexsort((column, codes, row))
        first = np.ones(len(order), bool)
        first[1:] = (row[order][1:] != row[order][:-1]) | (codes[order][1:] != codes[order][:-1])
        nth = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        bit = _ONE << ((codes[order] + nth * 41) % 64).astype(np.uint64)
        self.bag = np.zeros(len(texts), np.uint64)
        if len(order):
            starts = np.flatnonzero(np.r_[True, row[order][1:] != row[order][:-1]])
            self.bag[row[order][starts]] = np.bitwise_or.reduceat(bit, starts)
        self.edits = np.array([f.edits for _, _, f in flat], np.int64)
        self.cost = np.array([f.cost for _, _, f in flat], np.int64)
        self.asks = np.array([f.asks for _, _, f in flat], bool)
        word = np.array([w for _, w, _ in flat], np.int64)
        sorts = np.array([s for s, _, _ in flat], object)
        self.sorts: list[_Sort] = []
        for sort in dict.fromkeys(sorts):
            at = np.flatnonzero(sorts == sort)
            lead = np.flatnonzero(np.r_[True, word[at][1:] != word[at][:-1]])
            mine = word[at][lead]

            def column_of(values: np.ndarray, kind: type, empty: int = 0, mine: np.ndarray = mine) -> np.ndarray:
                out = np.full(len(words), empty, kind)
                out[mine] = values
                return out

            self.sorts.append(_Sort(
                column_of(at[lead], np.int64),
                column_of(np.diff(np.r_[lead, len(at)]), np.int64),
                column_of(np.bitwise_and.reduceat(self.bag[at], lead), np.uint64),
                column_of(np.bitwise_or.reduceat(self.bag[at], lead), np.uint64),
                column_of(np.maximum.reduceat(self.edits[at], lead), np.int8, -1),
                column_of(np.logical_or.reduceat(self.asks[at], lead), bool),
            ))
        self.families: list[tuple[_Sort, list[_Sort]]] = []
        for sort in self.sorts:
            for n, (head, members) in enumerate(self.families):
                both = (head.count > 0) & (sort.count > 0)
                if both.any() and (head.least[both] == sort.least[both]).all() and (head.most[both] == sort.most[both]).all():
                    own = head.count > 0
                    pick = lambda a, b: np.where(own, a, b)  # noqa: B023, E731
                    joined = head._replace(count=np.maximum(head.count, sort.count), least=pick(head.least, sort.least), most=pick(head.most, sort.most), edits=np.maximum(head.edits, sort.edits), asks=head.asks | sort.asks)
                    self.families[n] = (joined, [*members, sort])
                    break
            else:
                self.families.append((sort, [sort]))

    def _open(self, sort: _Sort, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Positions of the pairs whose letters leave it open that strings of a sort are near."""
        asks, there = sort.asks, sort.count > 0
        if asks.all():
            at = np.arange(len(a))
        else:
            at = np.flatnonzero((asks[a] | asks[b]) & there[a] & there[b])
            a, b = a[at], b[at]
        most = np.maximum(sort.edits[a], sort.edits[b])
        near = np.flatnonzero(np.bitwise_count(sort.least[a] & ~sort.most[b]) <= most)
        at, a, b, most = at[near], a[near], b[near], most[near]
        return at[np.bitwise_count(sort.least[b] & ~sort.most[a]) <= most]

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, edits) of the pairs of words ``a, b`` of which some form of one asks for one of the other within the edits allowed."""
        told = np.full(len(a), 127, np.int8)
        told[a == b] = 0
        for family, members in self.families:
            could = self._open(family, a, b)
            could = could[told[could] > 0]
            for sort in members:
                at = could[self._open(sort, a[could], b[could])] if len(members) > 1 else could
                for span in spans(sort.count[a[at]] * sort.count[b[at]]):
                    some = at[span]
                    pair, x = ranges(sort.start[a[some]], sort.count[a[some]])
                    n, y = ranges(sort.start[b[some]][pair], sort.count[b[some]][pair])
                    pair, x = pair[n], x[n]
                    most = np.maximum(self.edits[x], self.edits[y])
                    open_ = (self.asks[x] | self.asks[y]) & (np.abs(self.size[x] - self.size[y]) <= most) & (np.bitwise_count(self.bag[x] & ~self.bag[y]) <= most) & (np.bitwise_count(self.bag[y] & ~self.bag[x]) <= most)
                    pair, x, y, most = pair[open_], x[open_], y[open_], most[open_]
                    edits = distances(self.text[x], self.size[x], self.text[y], self.size[y])
                    met = edits <= most
                    np.minimum.at(told, some[pair[met]], (edits + np.maximum(self.cost[x], self.cost[y]))[met].astype(np.int8))
        at = np.flatnonzero(told < 127)
        return at, told[at].astype(np.int64)
