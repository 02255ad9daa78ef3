"""A compressed full-text index over one shard of segments, and matching statistics by backward search.

Suffixes are sorted by prefix doubling to a bounded depth (queries are no longer than that), the transform is held in a
wavelet matrix of packed bits with block counts, and all queries advance together, one character a step, as NumPy arrays.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with a count before every word: rank in constant time for whole arrays of positions."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 2) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = n - int(bits.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(low)


class WaveletMatrix:
    """rank of a symbol over a sequence of symbols below 2 ** levels."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels = levels
        self.bits: list[BitVector] = []
        for k in range(levels - 1, -1, -1):
            b = (seq >> k & 1).astype(np.uint8)
            self.bits.append(BitVector(b))
            one = b.astype(bool)
            seq = np.concatenate([seq[~one], seq[one]])

    def rank_from_start(self, symbol: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Where position `pos` of each symbol's run ends up; the run's own start is subtracted by the caller's table."""
        p = pos
        for k, v in zip(range(self.levels - 1, -1, -1), self.bits):
            r = v.rank1(p)
            p = np.where(symbol >> k & 1, v.zeros + r, p - r)
        return p


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes sorted by their first `depth` symbols at least; the rank of every suffix at each doubling. text: symbols < 2**16, ends in 0."""
    n = len(text)
    width = 8 if int(text.max()) < 256 else 4
    shift = np.uint64(64 // width)
    key = np.zeros(n, np.uint64)
    padded = np.zeros(n + width, np.uint64)
    padded[:n] = text
    for j in range(width):
        key = key << shift | padded[j : j + n]
    ranks: list[tuple[int, np.ndarray]] = []
    h = width
    while True:
        order = np.argsort(key)
        s = key[order]
        new = np.empty(n, bool)
        new[0] = False
        np.not_equal(s[1:], s[:-1], out=new[1:])
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32)
        ranks.append((h, rank))
        if h >= depth or int(rank.max()) == n - 1:
            return order, ranks
        nxt = np.zeros(n, np.uint64)
        nxt[: n - h] = rank[h:].astype(np.uint64) + np.uint64(1)
        key = rank.astype(np.uint64) << np.uint64(32) | nxt
        h *= 2


def _smaller(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest positions to the left and right with a smaller value, by pointer jumping; lcp[0] and lcp[-1] are -1."""
    n = len(lcp)
    prev = np.maximum(np.arange(-1, n - 1), 0)
    act = np.arange(1, n)
    while len(act):
        j = prev[act]
        more = (lcp[j] >= lcp[act]) & (j > 0)
        act = act[more]
        prev[act] = prev[j[more]]
    nxt = np.minimum(np.arange(1, n + 1), n - 1)
    act = np.arange(n - 2, -1, -1)
    while len(act):
        j = nxt[act]
        more = (lcp[j] >= lcp[act]) & (j < n - 1)
        act = act[more]
        nxt[act] = nxt[j[more]]
    return prev, nxt


class SharedIndex:
    """Index over segments of several owners; a pattern counts where it occurs in segments of two owners at least."""

    def __init__(self, segments: list[np.ndarray], owners: np.ndarray, several: np.ndarray, least: int):
        self.least = least
        lens = np.array([len(s) for s in segments], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]]) if len(segments) else np.zeros(0, np.int64)
        self.lens = lens
        n = int(lens.sum() + len(lens))
        raw = np.zeros(n, np.uint32)
        for s, a in zip(segments, self.starts):
            raw[a : a + len(s)] = s + np.uint32(1)
        alphabet, text = np.unique(raw, return_inverse=True)
        self.text = text.astype(np.int32)
        owner = np.repeat(np.arange(len(segments)), lens + 1)
        order, ranks = suffix_order(text, least + 1)
        self.n = n
        levels = max(1, int(len(alphabet) - 1).bit_length())
        bwt = self.text[order - 1]  # the suffix at 0 is preceded by the final separator
        self.wm = WaveletMatrix(bwt, levels)
        first = np.searchsorted(np.sort(bwt), np.arange(len(alphabet)))
        # in a wavelet matrix the run of a symbol starts where position 0 ends up
        syms = np.arange(len(alphabet), dtype=np.int32)
        self.offset = first - self.wm.rank_from_start(syms, np.zeros(len(alphabet), np.int64))
        # lengths of common prefixes of neighbours, no longer than `least` + 1 and within their segments
        end = np.repeat(self.starts + lens, lens + 1)
        i, j = order[:-1], order[1:]
        l = np.zeros(n - 1, np.int64)
        for h, r in reversed(ranks):
            a, b = np.minimum(i + l, n - 1), np.minimum(j + l, n - 1)
            l += np.where(r[a] == r[b], h, 0)
        for _ in range(ranks[0][0] - 1):
            a, b = np.minimum(i + l, n - 1), np.minimum(j + l, n - 1)
            go = (self.text[a] == self.text[b]) & (l < least + 2)
            if not go.any():
                break
            l += go
        l = np.minimum(np.minimum(l, least + 1), np.minimum(end[i] - i, end[j] - j))
        self.lcp = np.concatenate([[-1], l, [-1]]).astype(np.int32)
        self.prev, self.next = _smaller(self.lcp)
        # runs of rows that agree on least - 1 symbols, to drop the last symbol of a full-length match
        cut = np.flatnonzero(self.lcp < least - 1)
        k = np.searchsorted(cut, np.arange(n), side="right") - 1
        self.run_start, self.run_end = cut[k], cut[k + 1]
        own = owners[owner[order]]
        change = np.concatenate([[True], own[1:] != own[:-1]])
        self.last_other = np.maximum.accumulate(np.where(change, np.arange(n), 0)) - 1
        self.many = np.concatenate([[0], np.cumsum(several[owner[order]])])

    def _counts(self, sp: np.ndarray, ep: np.ndarray) -> np.ndarray:
        e = np.maximum(ep - 1, 0)
        return (ep > sp) & ((self.last_other[e] >= sp) | (self.many[ep] > self.many[np.minimum(sp, self.n)]))

    def matching(self, asked: np.ndarray | None = None) -> np.ndarray:
        """For every position of the segments asked (all by default): length of the longest match, at most `least`, that starts there and counts."""
        out = np.zeros(self.n, np.int32)
        lens = self.lens if asked is None else np.where(asked, self.lens, 0)
        m = len(lens)
        sp, ep, ln = np.zeros(m, np.int64), np.full(m, self.n, np.int64), np.zeros(m, np.int64)
        order = np.argsort(-lens)
        sorted_lens = lens[order]
        for t in range(int(lens.max()) if m else 0):
            act = order[: np.searchsorted(-sorted_lens, -t, side="left")]
            pos = self.starts[act] + lens[act] - 1 - t
            full = act[ln[act] >= self.least]
            if len(full):
                s = sp[full]
                sp[full], ep[full], ln[full] = self.run_start[s], self.run_end[s], self.least - 1
            c = self.text[pos]
            todo = np.arange(len(act))
            while len(todo):
                a = act[todo]
                cc = c[todo]
                both = self.wm.rank_from_start(np.concatenate([cc, cc]), np.concatenate([sp[a], ep[a]])) + np.tile(self.offset[cc], 2)
                ns, ne = both[: len(a)], both[len(a) :]
                ok = self._counts(ns, ne)
                g = a[ok]
                sp[g], ep[g] = ns[ok], ne[ok]
                ln[g] += 1
                fail = a[~ok]
                todo = todo[~ok]
                at_root = ln[fail] == 0
                todo = todo[~at_root]
                fail = fail[~at_root]
                if len(fail):  # to the parent: the longest prefix that occurs in more places
                    s, e = sp[fail], ep[fail]
                    ls, le = self.lcp[s], self.lcp[e]
                    left = ls >= le
                    d = np.where(left, ls, le)
                    ps = np.where(left, self.prev[s], self.prev[e])
                    ne2 = np.where(left, self.next[s], self.next[e])
                    root = d <= 0
                    sp[fail] = np.where(root, 0, ps)
                    ep[fail] = np.where(root, self.n, ne2)
                    ln[fail] = np.maximum(d, 0)
            out[pos] = ln[act]
        return out
