"""A logarithmic family of suffix arrays over byte strings.

A batch of strings gets a suffix array of its own, is merge-scanned against the arrays already held, and arrays
of about equal size are merged, so sizes grow geometrically and each suffix is moved a logarithmic number of
times. Only the first ``depth`` bytes of a suffix matter here: two suffixes match if those are equal. A batch is
sorted by prefix doubling, so suffixes end up with equal ranks exactly if their bytes are equal; of those, one
stands for all in the arrays that are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes that one sort takes: three ranks of this many bits share a 64-bit number.
MOST_BYTES = 1 << 21
WORD = 8


def ranks(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The place of each suffix ``at`` in the order of their first ``depth`` bytes; equal bytes have equal places.

    Ranks by the first five bytes are doubled to ten, twenty and so on; two ranks of half the length, the second
    shifted so that both lie within the depth, give the last ones. Whatever stands behind a string only
    moves places that no suffix asks for."""
    n = len(text)
    if n > MOST_BYTES:
        raise ValueError(f"{n} bytes are more than one sort takes")
    bits = np.uint64(max(n, 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)

    def ranked(key: np.ndarray) -> np.ndarray:
        packed = key << bits
        packed |= np.arange(len(key), dtype=np.uint64)
        packed.sort()
        where = (packed & low).view(np.int64)
        packed >>= bits
        place = np.zeros(len(key), np.uint32)
        np.cumsum(packed[1:] != packed[:-1], dtype=np.uint32, out=place[1:])
        out = np.empty(len(key), np.uint32)
        out[where] = place
        return out

    def pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        key = one.astype(np.uint64)
        key <<= bits
        key[: len(two)] |= two
        return key

    if not len(at):
        return np.zeros(0, np.int64)
    h = min(5, depth)
    x = np.concatenate([text, np.zeros(h, np.uint8)]).astype(np.uint64)
    key = x[:n].copy()
    for k in range(1, h):
        key <<= np.uint64(8)
        key |= x[k : n + k]
    rank = ranked(key)
    while 2 * h <= depth:
        rank = ranked(pair(rank, rank[h:]))
        h *= 2
    return ranked(pair(rank[at], rank[at + (depth - h)])).astype(np.int64)


@dataclass
class Level:
    """text: strings one after another, eight zeros behind them; at: starts of distinct suffixes in order; name: of each suffix."""

    text: np.ndarray
    at: np.ndarray
    name: np.ndarray

    def word(self, i: np.ndarray, column: int) -> np.ndarray:
        """Eight bytes of the suffixes i, from 8 * column on, as numbers that sort as they do."""
        every = np.ndarray((len(self.text) - WORD + 1,), "<u8", self.text, 0, (1,))
        return every[self.at[i] + WORD * column].byteswap()


def _bounds(level: Level, c: int, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within each range [lo, hi) of level, whose suffixes agree before column c, the part whose column c equals x."""

    def bound(a: np.ndarray, b: np.ndarray, x: np.ndarray, behind: bool) -> np.ndarray:
        a, b = a.copy(), b.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            v = level.word(mid, c)
            right = v <= x[open_] if behind else v < x[open_]
            a[open_] = np.where(right, mid + 1, a[open_])
            b[open_] = np.where(right, b[open_], mid)
            open_ = open_[a[open_] < b[open_]]
        return a

    first = bound(lo, hi, x, False)
    last = first.copy()
    some = np.flatnonzero(first < hi)
    some = some[level.word(first[some], c) == x[some]]
    last[some] = bound(first[some] + 1, hi[some], x[some], True)
    return first, last


def scan(level: Level, new: Level, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where in level each of new's suffixes belongs, whether it is there, and which of level's are in new. Both are
    in order, so ranges narrow column by column, and most suffixes differ within the first."""
    every = np.arange(len(new.at))
    mine, own = level.word(np.arange(len(level.at)), 0), new.word(every, 0)
    lo, hi = np.searchsorted(mine, own, "left"), np.searchsorted(mine, own, "right")
    del mine
    live = every[lo < hi]
    for c in range(1, depth // WORD):
        if not len(live):
            break
        x = new.word(live, c)
        one = hi[live] - lo[live] == 1
        single, several = live[one], live[~one]
        v, w = level.word(lo[single], c), x[one]
        lo[single] += v < w
        hi[single] = np.where(v == w, hi[single], lo[single])
        if len(several):
            lo[several], hi[several] = _bounds(level, c, x[~one], lo[several], hi[several])
        live = live[lo[live] < hi[live]]
    found, there = np.zeros(len(new.at), bool), np.zeros(len(level.at), bool)
    found[live] = True
    there[lo[live]] = True  # suffixes of a level are distinct
    return lo, found, there


def merged(level: Level, new: Level, where: np.ndarray, found: np.ndarray, shift: int = 0) -> Level:
    """Both in one order; new suffixes that level has are left out, and new's names go up by shift."""
    fresh = np.flatnonzero(~found)
    put = where[fresh] + np.arange(len(fresh))
    n = len(level.at) + len(fresh)
    at, name = np.empty(n, np.int32), np.empty(n, np.int32)
    old = np.ones(n, bool)
    old[put] = False
    at[put], name[put] = new.at[fresh] + (len(level.text) - WORD), new.name[fresh] + shift
    at[old], name[old] = level.at, level.name
    return Level(np.concatenate([level.text[:-WORD], new.text]), at, name)


def starts(lengths: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Where the first ``suffixes`` suffixes of each string begin, when strings stand one after another."""
    total = int(suffixes.sum())
    begin = np.cumsum(lengths) - lengths
    return np.repeat(begin, suffixes) + np.arange(total) - np.repeat(np.cumsum(suffixes) - suffixes, suffixes)


class SuffixFamily:
    """add() takes strings and how many of each one's first suffixes count; every suffix must have ``depth`` bytes.
    ``matched[name]`` tells whether a suffix's first depth bytes have been seen at another suffix."""

    def __init__(self, depth: int) -> None:
        assert depth % WORD == 0, "suffixes are compared eight bytes at a time"
        self.depth, self.levels, self.matched = depth, [], np.zeros(0, bool)

    def add(self, strings: list[bytes], suffixes: np.ndarray) -> int:
        """Returns the name of the first new suffix; names count on through the strings."""
        first = len(self.matched)
        total = int(suffixes.sum())
        self.matched = np.concatenate([self.matched, np.zeros(total, bool)])
        if not total:
            return first
        text = np.frombuffer(b"".join(strings) + bytes(WORD), np.uint8)
        at = starts(np.fromiter(map(len, strings), np.int64, len(strings)), suffixes)
        rank = ranks(text[:-WORD], at, self.depth)
        times = np.bincount(rank)
        self.matched[first:] = times[rank] > 1
        stands = np.empty(len(times), np.int32)
        stands[rank[::-1]] = np.arange(total - 1, -1, -1)  # the first of equals
        del rank
        new = Level(text, at[stands].astype(np.int32), stands + np.int32(first))
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            where, found, there = scan(level, new, self.depth)
            self.matched[new.name[found]] = True
            self.matched[level.name[there]] = True
            if len(level.at) <= 2 * len(new.at):
                new = merged(level, new, where, found)
                self.levels.pop()
        self.levels.append(new)
        return first

    def whole(self) -> Level | None:
        """All levels in one."""
        while len(self.levels) > 1:
            new, level = self.levels.pop(), self.levels.pop()
            where, found, _ = scan(level, new, self.depth)
            self.levels.append(merged(level, new, where, found))
        return self.levels[0] if self.levels else None
