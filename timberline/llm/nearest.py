"""Nearest denser set: for word sets with a density, the most similar of the denser ones, exactly.

A tile of sets is an index from words to its sets. The HOT words that most of its sets hold, if more than one in SHARE do, are bits of
each set instead; all others have postings. Of a set x, h words are bits, so a set y that overlaps in more than h shares a word with
postings: counting x over its postings gives every such y and how many of these words it shares, and the bits of those that may still
reach the best similarity add the rest. No y has to be read for that. Any other y shares bits alone, so it is smaller than a size
that follows from h and from the best found so far, and shares one of the rarest bits of x: the fewer of the two are compared.
Pairs are met in memory, CHUNK of them at once or those of one set; none is written."""

from __future__ import annotations

import numpy as np

HOT, SHARE = 1024, 64
CHUNK = 200_000  # few enough for the processor's cache
_SLACK = 1e-9


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... of length[i] each, end to end."""
    ends = np.cumsum(length)
    return np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def _chunks(work: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows with CHUNK of work at most, or of one row."""
    total, at, out = np.cumsum(work), 0, []
    while at < len(work):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, "right")))
        out.append((at, to))
        at = to
    return out


class Tile:
    """Sets by ids, densities and words (flat, from at[i] to at[i + 1], no word twice in a set)."""

    def __init__(self, ids: np.ndarray, density: np.ndarray, at: np.ndarray, flat: np.ndarray):
        order = np.lexsort((ids, -density))  # the denser first; a rank is a place in this order
        size = np.diff(at)[order]
        flat = flat[_ranges(at[:-1][order], size)]
        by_word = np.argsort(flat, kind="stable")
        flat = flat[by_word]
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.empty(0, np.int64)
        self.ids, self.less_dense, self.size = ids[order], -density[order], size
        self.words, self.ends = flat[first], np.append(first, len(flat))
        self.posts = np.repeat(np.arange(len(order), dtype=np.int32), size)[by_word]
        k = np.diff(self.ends)
        hot = np.flatnonzero(k > max(64, len(order) // SHARE))
        hot = hot[np.argsort(k[hot], kind="stable")][-HOT:]  # bits from rare to common
        self.bit = np.full(len(k), -1, np.int32)
        self.bit[hot] = np.arange(len(hot))
        self.hot = hot
        self.bits = np.zeros((-(-len(hot) // 64), len(order)), np.uint64)
        for b, w in enumerate(hot):
            self.bits[b >> 6, self.posts[self.ends[w] : self.ends[w + 1]]] |= np.uint64(1 << (b & 63))
        self.by_size = np.argsort(size, kind="stable").astype(np.int32)
        self.sizes = size[self.by_size]

    def _denser(self, ids: np.ndarray, density: np.ndarray) -> np.ndarray:
        """How many sets of the tile are denser, or as dense with a smaller id."""
        lo, hi = (np.searchsorted(self.less_dense, -density, side) for side in ("left", "right"))
        for i in np.flatnonzero(hi > lo):
            lo[i] += np.searchsorted(self.ids[lo[i] : hi[i]], ids[i])
        return lo

    def _upto(self, begin: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many of posts[begin[i]:end[i]], which ascend, are below rank[i]."""
        lo, hi = begin.copy(), end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            a, b = lo[open_], hi[open_]
            mid = (a + b) >> 1
            below = self.posts[mid] < rank[open_]
            lo[open_], hi[open_] = np.where(below, mid + 1, a), np.where(below, b, mid)
            open_ = open_[lo[open_] < hi[open_]]
        return lo - begin

    def nearest(self, ids: np.ndarray, density: np.ndarray, at: np.ndarray, flat: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each set the id of the most similar denser set of the tile, the smallest of equals, and the similarity; 0 and -1 if
        none has a similarity of `least`."""
        rows, size = len(ids), np.diff(at)
        parent, best = np.zeros(rows, np.int64), np.full(rows, -1.0)
        if not rows or not len(self.words):
            return parent, best
        denser = self._denser(ids, density)
        slot = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
        known = self.words[slot] == flat
        begin, bit = self.ends[slot], np.where(known, self.bit[slot], -1)
        row = np.repeat(np.arange(rows), size)
        above = self._upto(begin, np.where(known, self.ends[slot + 1], begin), denser[row])  # denser sets with the word
        posts = np.where(bit < 0, above, 0)
        mine = np.zeros((len(self.bits), rows), np.uint64)
        on = np.flatnonzero(bit >= 0)
        on = on[np.lexsort((bit[on], row[on]))]  # of each row from rare to common
        np.bitwise_or.at(mine, (bit[on] >> 6, row[on]), np.uint64(1) << (bit[on] & 63).astype(np.uint64))
        h = np.bincount(row[on], minlength=rows)

        def compare(x: np.ndarray, y: np.ndarray, shared: np.ndarray) -> None:
            """x in order; shared: words of postings that x and y share."""
            if not len(x):
                return
            part = slice(x[0], x[-1] + 1)
            t = np.maximum(best[part], least)
            f = t / (1 + t)
            i, n = x - x[0], self.size[y]
            may = np.flatnonzero(shared >= f[i] * n + (f * size[part] - h[part] - _SLACK)[i])
            x, y, n, shared = x[may], y[may], n[may], shared[may]
            if not len(x):
                return
            for m, b in zip(mine, self.bits):
                shared = shared + np.bitwise_count(m[x] & b[y])
            s = shared / (size[x] + n - shared)
            first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            top = np.maximum.reduceat(s, first)
            who = np.minimum.reduceat(np.where(s == np.repeat(top, np.diff(first, append=len(x))), self.ids[y], np.iinfo(np.int64).max), first)
            x = x[first]
            new = (top >= least) & ((top > best[x]) | (top == best[x]) & (who < parent[x]))
            best[x[new]], parent[x[new]] = top[new], who[new]

        for a, b in _chunks(np.add.reduceat(posts, at[:-1])):
            w = slice(at[a], at[b])
            pair = np.sort(np.repeat(row[w], posts[w]) << 32 | self.posts[_ranges(begin[w], posts[w])])
            last = np.flatnonzero(np.concatenate((pair[1:] != pair[:-1], [True]))) if len(pair) else np.empty(0, np.int64)
            compare(pair[last] >> 32, pair[last] & 0xFFFFFFFF, np.diff(last, prepend=-1))

        # what shares bits alone: up to h of them, of sizes lo to hi; all but short - 1 of the bits of x must meet one
        t = np.maximum(best, least)
        lo = np.searchsorted(self.sizes, t * size - _SLACK)
        hi = np.maximum(lo, np.searchsorted(self.sizes, h * (1 + t) / t - size + _SLACK, "right"))
        hi = np.where(denser > 0, hi, lo)
        short = np.ceil(t / (1 + t) * (size + self.sizes[np.minimum(lo, len(self.sizes) - 1)]) - _SLACK).astype(np.int64)
        place = np.arange(len(on)) - np.repeat(np.cumsum(h) - h, h)
        rare = np.where(place <= (h - short)[row[on]], above[on], 0)
        by_bits = np.bincount(row[on], rare, rows).astype(np.int64)
        scan = np.where(hi - lo <= by_bits, hi - lo, 0)
        rare[(hi - lo <= by_bits)[row[on]]] = 0
        for a, b in _chunks(scan):
            x, y = np.repeat(np.arange(a, b), scan[a:b]), self.by_size[_ranges(lo[a:b], scan[a:b])]
            keep = np.flatnonzero(y < denser[x])
            compare(x[keep], y[keep], np.zeros(len(keep), np.int64))
        ends = np.cumsum(h)
        for a, b in _chunks(np.bincount(row[on], rare, rows).astype(np.int64)):
            w = slice(ends[a] - h[a], ends[b - 1])
            y = self.posts[_ranges(begin[on[w]], rare[w])]
            compare(np.repeat(row[on[w]], rare[w]), y, np.zeros(len(y), np.int64))
        return parent, best
