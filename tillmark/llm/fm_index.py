"""FM-index over integer symbols: suffix array by doubling, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of ``s`` (>= 0) where 0 ends a run: no comparison passes a 0, and zeros stand in text order."""
    n = len(s)
    zeros = s == 0
    rank = s.astype(np.int64) + int(zeros.sum())
    rank[zeros] = np.arange(int(zeros.sum()))
    k = 1
    while True:
        order_key = rank
        if k > 1 or True:
            nxt = np.zeros(n, np.int64)
            nxt[: n - k] = rank[k:] + 1 if k < n else 0
            order_key = rank * (int(rank.max(initial=0)) + 2) + nxt if n else rank
        order = np.argsort(order_key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([0], np.diff(order_key[order]) != 0)))[:n] if n else 0
        if not n or new[order[-1]] == n - 1 or k >= n:
            return order
        rank, k = new, 2 * k


class BitVector:
    """Bits with rank in constant time: 64-bit words and the number of ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Rank and access over symbols below ``2 ** levels``."""

    def __init__(self, s: np.ndarray, levels: int) -> None:
        self.levels, self.bits, self.zeros = levels, [], []
        for k in range(levels - 1, -1, -1):
            b = (s >> k) & 1
            self.bits.append(BitVector(b))
            self.zeros.append(int(len(s) - b.sum()))
            s = np.concatenate((s[b == 0], s[b == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``c`` stands before position ``i``."""
        begin = np.zeros_like(i)
        for depth, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = (c >> (self.levels - 1 - depth)) & 1 == 1
            r_i, r_b = bits.rank(i), bits.rank(begin)
            i = np.where(one, zeros + r_i, i - r_i)
            begin = np.where(one, zeros + r_b, begin - r_b)
        return i - begin

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            one, r = bits.get(i), bits.rank(i)
            c = (c << 1) | one
            i = np.where(one, zeros + r, i - r)
        return c


class FMIndex:
    """Counts and locates patterns of symbols 1 to ``sigma`` in runs that are ended by 0."""

    def __init__(self, s: np.ndarray, sigma: int, sample: int = 16) -> None:
        if not len(s) or s[-1] != 0:
            s = np.concatenate((s, [0]))
        sa = suffix_array(s)
        bwt = s[sa - 1]  # of position 0 the last symbol, a 0
        self.wavelet = WaveletMatrix(bwt, max(1, int(sigma).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=sigma + 1))))
        keep = (sa % sample == 0) | (bwt == 0)
        self.sampled, self.places = BitVector(keep), sa[keep]

    def _step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.first[c] + self.wavelet.rank(c, i)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``[lo, hi)`` of each pattern (one in each row of the matrix), by backward search."""
        live = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.first[-1])
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            lo[live], hi[live] = self._step(c, lo[live]), self._step(c, hi[live])
            live = live[hi[live] > lo[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: steps back to a sampled one; starts of runs are sampled, so no step passes a 0."""
        at, moved, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            i = at[open_]
            hit = self.sampled.get(i)
            done = open_[hit]
            out[done] = self.places[self.sampled.rank(at[done])] + moved[done]
            open_ = open_[~hit]
            i = at[open_]
            at[open_] = self._step(self.wavelet.access(i), i)
            moved[open_] += 1
        return out
