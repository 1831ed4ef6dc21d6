"""A run-length index (r-index) of a text collection: run-compressed Burrows-Wheeler transform with suffix samples at
run ends, and matching statistics by streaming patterns through it.

The collection is a list of byte strings, each ended by its own separator, smaller than any byte and
ordered as the strings are.  Kept are head and start of each run, the text position of its first and last row,
and the rows at which a class of suffixes begins that agree in their first ``depth`` bytes, with the first text position of
each class; suffixes themselves are not kept.  Two small tables give the run and the class of a row.
"""

from __future__ import annotations

import numpy as np

from .rounds import Powers, between, sums_of

_POWERS = Powers(0xA0761D6478BD642F | 1)
_PACK = 7  # nine-bit symbols in 63 bits


def packed(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The next seven symbols of every position in one number, zeros from the separator on."""
    n = len(text)
    padded = np.zeros(n + _PACK, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for k in range(_PACK):
        key |= padded[k : k + n] << np.uint64(9 * (_PACK - 1 - k))
    near = np.flatnonzero(ends - np.arange(n) < _PACK)
    gone = (9 * (_PACK - (ends[near] - near))).astype(np.uint64)
    key[near] = key[near] >> gone << gone
    return key


def suffix_order(text: np.ndarray, ends: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Suffix array of a collection.

    ``text`` holds bytes + 1 and 0 for separators, ``ends`` the position of the separator after each position.  Suffixes are sorted by
    their first seven symbols, then by prefix doubling; only rows not yet told apart are sorted again.
    """
    n = len(text)
    left = ends - np.arange(n)  # symbols before the separator
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int64)
    at = np.flatnonzero(new)
    rank[order] = np.repeat(at, np.diff(np.r_[at, n]))  # rank: first row of the group
    reach = _PACK
    while True:
        tied = np.zeros(n, bool)
        tied[:-1] |= ~new[1:]
        tied |= ~new
        rows = np.flatnonzero(tied)
        if not len(rows):
            return order
        pos = order[rows]
        done = left[pos] < reach  # the suffix ends within what was compared: its separator, so its place, decides
        nxt = np.where(done, ends[pos], np.minimum(pos + reach, n - 1))
        # separators are ranked by place, below every other symbol
        second = np.where(done, ends[pos], n + rank[nxt])
        key2 = (rank[pos].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        again = np.argsort(key2)
        pos, key2 = pos[again], key2[again]
        order[rows] = pos
        fresh = np.ones(len(rows), bool)
        fresh[1:] = key2[1:] != key2[:-1]
        new[rows] = fresh
        first = np.flatnonzero(fresh)
        rank[pos] = np.repeat(rows[first], np.diff(np.r_[first, len(rows)]))
        reach *= 2


class RunIndex:
    def __init__(self, strings: list[bytes], depth: int):
        self.depth = depth
        sizes = np.asarray([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        n = int(sizes.sum() + len(sizes))
        raw = np.frombuffer(b"\x00".join(strings) + b"\x00", np.uint8)
        text = raw.astype(np.int16) + 1
        text[self.starts + sizes] = 0
        ends = np.repeat(self.starts + sizes, sizes + 1)
        self.text, self.ends, self.key = text, ends, packed(text, ends)
        order = suffix_order(text, ends, self.key)
        before = text[order - 1].copy()
        whole = np.zeros(n, bool)
        whole[self.starts] = True
        before[whole[order]] = 0  # what stands before a string is a separator
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)  # separators differ from each other
        at = np.flatnonzero(head)
        self.n, self.run_start, self.run_head = n, at, before[at]
        last = np.r_[at[1:], n] - 1
        self.first_at, self.last_at = order[at], order[last]  # sampled run ends
        count = np.bincount(text, minlength=258)
        self.below = np.cumsum(count) - count  # rows that start with a smaller symbol
        size = last - at + 1
        self.run_at = np.repeat(np.arange(len(at), dtype=np.int32), size)  # the run of a row: a table is quicker than a search in run_start
        by = np.argsort(self.run_head, kind="stable")
        self.of_head = by  # runs of each symbol in row order
        self.head_edge = np.searchsorted(self.run_head[by], np.arange(259))
        ranked = np.cumsum(size[by]) - size[by]
        self.rank_before = np.empty(len(at), np.int64)  # rows of the same symbol in earlier runs
        self.rank_before[by] = ranked - ranked[np.minimum(self.head_edge[self.run_head[by]], max(len(by) - 1, 0))]
        self.classes, self.first_place = self._classes(order)

    def _classes(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows where a suffix differs in its first ``depth`` symbols from the row before (or is shorter), and the
        smallest text position of each such class."""
        # a hash of the next ``depth`` symbols first: only rows that agree in it are compared
        sums = sums_of(self.text.astype(np.uint64) + np.uint64(0x9E3779B9), _POWERS)
        full = np.flatnonzero(self.ends - np.arange(self.n) >= self.depth)
        hashed = np.full(self.n, -1, np.int64).view(np.uint64)
        hashed[full] = between(sums, full, full + self.depth, _POWERS)
        h, room = hashed[order], (self.ends - np.arange(self.n))[order] >= self.depth
        agree = (h[1:] == h[:-1]) & room[1:] & room[:-1]
        like = np.flatnonzero(agree)
        agree[like] = self._common(order[like + 1], order[like], self.depth) >= self.depth
        begin = np.flatnonzero(np.r_[True, ~agree]) if len(order) else np.zeros(0, np.int64)
        self.class_at = np.repeat(np.arange(len(begin), dtype=np.int32), np.diff(np.r_[begin, self.n]))
        return begin, np.minimum.reduceat(order, begin) if len(order) else order

    def _common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Symbols that suffixes at a and b share, up to ``most``; separators end it."""
        room = np.minimum(np.minimum(self.ends[a] - a, self.ends[b] - b), most)
        out = room.copy()
        live, k = np.flatnonzero(room > 0), 0
        while len(live):
            differ = self.key[a[live] + k] ^ self.key[b[live] + k]
            off = np.flatnonzero(differ)
            if len(off):
                own, x, lead = live[off], differ[off], np.zeros(len(off), np.int64)
                for j in range(1, _PACK):
                    lead += (x >> np.uint64(9 * (_PACK - j))) == 0
                out[own] = np.minimum(room[own], k + lead)
            k += _PACK
            live = live[(differ == 0) & (room[live] > k)]
        return out

    def _run_of(self, row: np.ndarray) -> np.ndarray:
        return self.run_at[row]

    def matching_statistics(self, patterns: list[bytes]):
        """For each pattern, right to left in lock step: yields (offset, lanes, length, row, place) at every step: the
        longest match that starts at the offset (up to the pattern's end), a row and a text position of it."""
        sizes = np.asarray([len(p) for p in patterns], np.int64)
        most = int(sizes.max()) if len(sizes) else 0
        flat = np.frombuffer(b"".join(patterns), np.uint8).astype(np.int64) + 1
        base = np.cumsum(sizes) - sizes
        lanes = np.arange(len(patterns))
        length = np.zeros(len(patterns), np.int64)
        row = np.zeros(len(patterns), np.int64)
        place = np.full(len(patterns), self.last_at[0] if self.n else 0)
        if self.n:
            place[:] = self.first_at[0]
        for back in range(1, most + 1):
            lanes = lanes[sizes[lanes] >= back]
            at = sizes[lanes] - back
            c = flat[base[lanes] + at]
            q, ln, pl = row[lanes], length[lanes], place[lanes]
            run = self._run_of(q)
            hit = self.run_head[run] == c
            miss = np.flatnonzero(~hit)
            if len(miss):
                q, ln, pl, run, lost = self._jump(miss, c, q, ln, pl, run)
            else:
                lost = np.zeros(len(lanes), bool)
            row[lanes] = np.where(lost, 0, self.below[c] + self.rank_before[run] + q - self.run_start[run])
            place[lanes] = np.where(lost, self.first_at[0], pl - 1)
            length[lanes] = np.where(lost, 0, ln + 1)
            yield at, lanes, length[lanes], row[lanes], place[lanes]

    def _jump(self, miss, c, q, ln, pl, run):
        """Move lanes whose row is not preceded by their symbol to the end of the run before or the start of the run
        behind that is, whichever shares more with the match so far."""
        q, ln, pl, run = q.copy(), ln.copy(), pl.copy(), run.copy()
        lo, hi = self.head_edge[c[miss]], self.head_edge[c[miss] + 1]
        # runs of the symbol are in row order inside of_head[lo:hi]: find the first behind the present run
        k = self._first_behind(c[miss], run[miss], lo, hi)
        has_up, has_down = k > lo, k < hi
        lost = np.zeros(len(q), bool)
        lost[miss] = ~has_up & ~has_down
        up = self.of_head[np.where(has_up, k - 1, 0)]
        down = self.of_head[np.where(has_down, np.minimum(k, len(self.of_head) - 1), 0)]
        here = pl[miss]
        most = ln[miss]
        both = np.zeros((2, len(miss)), np.int64)
        for side, (ok, spot) in enumerate(((has_up, self.last_at[up]), (has_down, self.first_at[down]))):
            i = np.flatnonzero(ok)
            if len(i):
                both[side, i] = np.minimum(self._common(here[i], spot[i], int(most[i].max()) if len(i) else 0), most[i])
            both[side, ~ok] = -1
        take_up = both[0] >= both[1]
        q[miss] = np.where(take_up, np.r_[self.run_start, self.n][up + 1] - 1, self.run_start[down])
        pl[miss] = np.where(take_up, self.last_at[up], self.first_at[down])
        run[miss] = np.where(take_up, up, down)
        ln[miss] = np.maximum(np.maximum(both[0], both[1]), 0)
        return q, ln, pl, run, lost

    def _first_behind(self, c, run, lo, hi):
        if not hasattr(self, "_head_row"):
            # runs in order of (symbol, row) as one sorted key
            self._head_row = self.run_head[self.of_head].astype(np.int64) * (len(self.run_head) + 1) + self.of_head
        return np.clip(np.searchsorted(self._head_row, c * (len(self.run_head) + 1) + run, "right"), lo, hi)

    def class_of(self, row: np.ndarray) -> np.ndarray:
        return self.class_at[row]
