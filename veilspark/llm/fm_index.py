"""An FM-index over byte symbols: Burrows-Wheeler transform in a wavelet matrix, backward search in numpy.

Suffixes are sorted by their first ``depth`` symbols, then by place, which is enough for patterns of that length.
Of the suffix array only the first place of each pattern of ``depth`` symbols that occurs again is kept.
"""

from __future__ import annotations

import numpy as np

LEVELS = 8


class RankBits:
    """A bit vector with running counts: ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray):
        self.levels, self.zeros = [], []
        now = symbols
        for level in range(LEVELS - 1, -1, -1):
            bit = (now >> level) & 1
            self.levels.append(RankBits(bit))
            self.zeros.append(int((bit == 0).sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))
        every = np.arange(1 << LEVELS)
        self.starts = self._walk(every, np.zeros(1 << LEVELS, dtype=np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(at)
            at = np.where((symbol >> (LEVELS - 1 - i)) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._walk(symbol, at) - self.starts[symbol]


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes, sorted by their first ``depth`` symbols, then by place; and which rows begin a new prefix."""
    n, rank, size = len(symbols), symbols.astype(np.int64) + 1, 1
    order = np.argsort(rank, kind="stable")
    new = np.diff(rank[order], prepend=0) != 0
    while size < depth:
        step = min(size, depth - size)  # the second half may overlap the first
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - step)] = rank[step:]
        key = rank * (int(rank.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=-1) != 0
        rank[order] = np.cumsum(new)
        size += step
    return order, new


class FMIndex:
    def __init__(self, symbols: np.ndarray, depth: int):
        symbols = np.append(symbols, 0)  # the end is a symbol that no pattern holds
        order, new = suffix_order(symbols, depth)
        self.matrix = WaveletMatrix(symbols[order - 1])
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=1 << LEVELS))))
        self.n = len(symbols)
        again = new & ~np.append(new[1:], True)
        self.again, self.places = RankBits(again), order[again].astype(np.int32)

    def search(self, patterns: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of patterns, one a row, all extended to the left together.

        With ``own`` the patterns are taken from the text: one whose interval is down to a single row is met nowhere else,
        and is not extended further (its row is then that of its end).
        """
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        open_ = np.arange(len(patterns))
        for i in range(patterns.shape[1] - 1, -1, -1):
            symbol, at = patterns[open_, i].astype(np.int64), np.concatenate((low[open_], high[open_]))
            ends = self.first[np.concatenate((symbol, symbol))] + self.matrix.rank(np.concatenate((symbol, symbol)), at)
            low[open_], high[open_] = ends[: len(open_)], ends[len(open_) :]
            if own:
                open_ = open_[high[open_] - low[open_] > 1]
                if not len(open_):
                    break
        return low, high

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first place of intervals of patterns of ``depth`` symbols; -1 where there is one occurrence or none."""
        out = np.full(len(low), -1, dtype=np.int64)
        several = np.flatnonzero(high - low > 1)
        out[several] = self.places[self.again.rank(low[several])]
        return out
