"""A compressed FM-index over word codes: backward search on a wavelet matrix, vectorised over many patterns.

Suffixes are sorted to a depth of at least the threshold, which suffices for backward search of patterns up to that
length: an interval of a pattern is a union of whole equal-prefix groups, so ties beyond the depth don't matter.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with block counts; rank1(i) = ones before i."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        self.counts = np.zeros(len(self.blocks) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.blocks), out=self.counts[1:])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[block] + np.bitwise_count(self.blocks[block] & mask)


class WaveletMatrix:
    def __init__(self, codes: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits: list[BitVector] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = ((codes >> level) & 1).astype(np.uint8)
            self.bits.append(BitVector(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            codes = np.concatenate([codes[bit == 0], codes[bit == 1]])
        self.first = self.descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def descend(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            one = (code >> (self.levels - 1 - k)) & 1
            ones = bits.rank1(i)
            i = np.where(one == 1, zeros + ones, i - ones)
        return i

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of code before i."""
        return self.descend(code, i) - self.first[code]


class FMIndex:
    """Over texts (arrays of codes >= 1), each with a number: owners. Code 0 ends each text."""

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray, sigma: int, threshold: int):
        self.threshold, self.sigma = threshold, sigma
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        joined = np.zeros(int(lengths.sum()) + 1, np.int32)
        ends = np.cumsum(lengths)
        for t, end in zip(texts, ends):
            joined[end - 1 - len(t) : end - 1] = t
        n = self.n = len(joined)

        # ranks by 1, 2, 4, ... codes; kept are the one that leads to the threshold and the last
        ranks, depth = {1: joined}, 1
        order = np.argsort(joined, kind="stable").astype(np.int32)
        needed = {1 << (threshold.bit_length() - 1), 1 << (max(1, threshold - 1).bit_length() - 1)}
        while depth < threshold:
            r = ranks[depth]
            key = r.astype(np.int64) * (n + 1)
            key[: n - depth] += r[depth:] + 1
            order = np.argsort(key, kind="stable").astype(np.int32)
            key = key[order]
            new = np.ones(n, np.int32)
            new[1:] = key[1:] != key[:-1]
            del key
            nxt = np.empty(n, np.int32)
            nxt[order] = np.cumsum(new, dtype=np.int32) - 1
            if depth not in needed:
                del ranks[depth]
            depth *= 2
            ranks[depth] = nxt
        self.low, self.high = self._groups(ranks, order, threshold - 1) if threshold > 1 else (np.zeros(n, np.int32), np.full(n, n, np.int32))
        starts = self._groups(ranks, order, threshold)[0]
        del ranks
        first = np.flatnonzero(starts == np.arange(n))
        owner = np.append(np.repeat(owners, lengths), np.iinfo(np.int64).max)[order]
        #: The smallest owner of each group of equal prefixes, and each row's group.
        self.least = np.minimum.reduceat(owner, first)
        self.group = np.cumsum(np.bincount(first, minlength=n), dtype=np.int32) - 1
        bwt = joined[order - 1]
        counts = np.bincount(bwt, minlength=sigma)
        self.before = np.cumsum(counts) - counts
        self.tree = WaveletMatrix(bwt, sigma)

    def _groups(self, ranks: dict, order: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of the suffix order: first row and row past the last with the same ``depth`` codes."""
        half = max(d for d in ranks if d <= depth)
        a = ranks[half][order]
        shifted = order + (depth - half)
        b = np.where(shifted < self.n, ranks[half][np.minimum(shifted, self.n - 1)], -1)
        new = np.ones(self.n, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.append(np.flatnonzero(new), self.n).astype(np.int32)
        group = np.cumsum(new, dtype=np.int32) - 1
        return at[group], at[group + 1]

    def step(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of code + pattern."""
        known = code < self.sigma
        c = np.where(known, code, 0)
        low, high = self.before[c] + self.tree.rank(c, low), self.before[c] + self.tree.rank(c, high)
        return low, np.where(known, high, low)

    def owners_of(self, patterns: list[np.ndarray]) -> list[np.ndarray]:
        """For each pattern and start: the smallest owner of a text that holds the ``threshold`` codes from there, or
        the largest integer. The patterns are streamed from right to left; a match that reaches the threshold is cut
        back by one code, so matching statistics are known up to the threshold. Where a match of length q can't be
        extended to the left, no longer match ends where it ended, and matching begins again one place before."""
        t, none = self.threshold, np.iinfo(np.int64).max
        lengths = np.array([len(p) for p in patterns])
        offsets = np.cumsum(lengths) - lengths
        flat = np.concatenate(patterns) if patterns else np.zeros(0, np.int64)
        found = np.full(len(flat), none)
        lane = np.flatnonzero(lengths >= t)
        at, length = lengths[lane] - 1, np.zeros(len(lane), np.int64)
        low, high = np.zeros(len(lane), np.int64), np.full(len(lane), self.n)
        base = offsets[lane]
        while len(base):
            full = length == t
            if full.any():
                low[full], high[full] = self.low[low[full]], self.high[high[full] - 1]
                length[full] = t - 1
            new_low, new_high = self.step(flat[base + at], low, high)
            ok = new_low < new_high
            # a dead end at length q: the match's last code is given up
            at = np.where(ok, at - 1, np.where(length > 0, at + length - 1, at - 1))
            length = np.where(ok, length + 1, 0)
            low, high = np.where(ok, new_low, 0), np.where(ok, new_high, self.n)
            hit = length == t
            if hit.any():
                found[base[hit] + at[hit] + 1] = self.least[self.group[low[hit]]]
            alive = (at >= 0) & (at + length + 1 >= t)
            if not alive.all():
                base, at, length, low, high = (x[alive] for x in (base, at, length, low, high))
        return [found[o : o + n] for o, n in zip(offsets, lengths)]
