"""FM-index of a shard of text: suffix array, Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``codes`` (ints >= 1; the end sorts first) in lexicographic order, by prefix doubling.

    The first ranks come from as many symbols as fit 62 bits; after that only positions in groups of equal rank are sorted again.
    """
    n = len(codes)
    bits = max(1, int(codes.max(initial=1)).bit_length())
    h = max(1, min(n, 62 // bits))
    key = np.zeros(n, np.int64)
    for j in range(h):
        key <<= bits
        key[: n - j] |= codes[j:]
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.empty(n, bool)
    new[:1] = True
    ordered = key[sa]
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    rank[sa] = np.repeat(starts, np.diff(np.append(starts, n)))
    at = np.arange(n)
    while True:
        single = new & np.append(new[1:], True)
        at = at[~single]
        if not len(at):
            return sa
        pos = sa[at]
        after = pos + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        # the members of a group have its first place as rank, so groups stay in their order
        order = np.argsort(rank[pos] * (n + 1) + second, kind="stable")
        pos, second = pos[order], second[order]
        first = rank[pos]
        sa[at] = pos
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        starts = np.flatnonzero(new)
        rank[pos] = np.repeat(at[starts], np.diff(np.append(starts, len(at))))
        h *= 2


class WaveletMatrix:
    """Ranks of any symbol in a sequence, one bit of the symbol at a time."""

    def __init__(self, codes: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.sums, self.zeros = [], [], []
        cur = codes.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> np.uint32(level)) & np.uint32(1)
            packed = np.packbits(bit.astype(bool), bitorder="little")
            packed = np.append(packed, np.zeros(16 - len(packed) % 8, np.uint8)).view(np.uint64)
            self.words.append(packed)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64))
            self.zeros.append(int(len(cur) - bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        self.start = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, pos: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            mask = (np.uint64(1) << (pos & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.sums[k][pos >> 6] + np.bitwise_count(self.words[k][pos >> 6] & mask)
            pos = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, pos - ones)
        return pos

    def rank(self, symbol: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._descend(symbol, pos) - self.start[symbol]


class FMIndex:
    """Full-text index of a sequence of ints >= 1. A closing 0 is added."""

    def __init__(self, codes: np.ndarray, sample: int = 16):
        text = np.append(codes, 0).astype(np.int64)
        self.n = len(text)
        sigma = int(text.max()) + 1
        sa = suffix_array(text + 1)
        self.bwt = text[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.tree = WaveletMatrix(self.bwt, sigma)
        self.sigma, self.sample = sigma, sample
        marked = sa % sample == 0
        self.marked_rank = np.cumsum(marked) - marked
        self.marked = marked
        self.samples = sa[marked]

    def ranges(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern (symbols; any outside the text's alphabet doesn't occur) its rows [lo, hi), by backward search of all at once."""
        m = len(patterns)
        lengths = np.array([len(p) for p in patterns], np.int64)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.concatenate(patterns).astype(np.int64) if m else np.zeros(0, np.int64)
        live, step = np.flatnonzero(lengths > 0), 0
        hi[lengths == 0] = 0
        while len(live):
            symbol = flat[offsets[live + 1] - 1 - step]
            known = (symbol > 0) & (symbol < self.sigma)
            hi[live[~known]] = lo[live[~known]]
            live, symbol = live[known], symbol[known]
            lo[live] = self.first[symbol] + self.tree.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.tree.rank(symbol, hi[live])
            step += 1
            live = live[(lo[live] < hi[live]) & (lengths[live] > step)]
        return lo, hi

    def positions(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back until a sampled one."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            hit = self.marked[rows[live]]
            out[live[hit]] = self.samples[self.marked_rank[rows[live[hit]]]] + steps
            live = live[~hit]
            symbol = self.bwt[rows[live]]
            rows[live] = self.first[symbol] + self.tree.rank(symbol, rows[live])
            steps += 1
        return out
