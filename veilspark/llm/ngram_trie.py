"""An n-gram trie in Elias-Fano levels: flat buffers, monotone pointers, quantised log probabilities."""

from __future__ import annotations

import numpy as np


class BitRows:
    """A bit vector with counts before each 64-bit word; finds the place of the k-th one or zero."""

    def __init__(self, ones_at: np.ndarray, size: int):
        bits = np.zeros(-(-max(size, 1) // 64) * 64, dtype=np.uint8)
        bits[ones_at] = 1
        self.rows = np.packbits(bits).reshape(-1, 8)
        per_row = bits.reshape(-1, 64).sum(1, dtype=np.int64)
        self.ones = np.concatenate(([0], np.cumsum(per_row)))
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    def place(self, k: np.ndarray, of_ones: bool) -> np.ndarray:
        """Word by its count before, byte by its running count, bit by a table."""
        before = self.ones if of_ones else self.zeros
        row = np.searchsorted(before, k, side="right") - 1
        bytes_ = self.rows[row] if of_ones else ~self.rows[row]
        upto = np.cumsum(np.bitwise_count(bytes_), axis=1, dtype=np.uint8)
        left = (k - before[row]).astype(np.uint8)
        byte = (upto <= left[:, None]).sum(1)
        at = np.arange(len(k))
        left -= np.where(byte > 0, upto[at, byte - 1], 0).astype(np.uint8)
        return row * 64 + byte * 8 + NTH_BIT[bytes_[at, byte], left]


# Place of the n-th one in each byte, first bit highest.
NTH_BIT = np.argsort(1 - np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1), axis=1, kind="stable")


class EliasFano:
    """A non-decreasing sequence: low parts in whole bytes, high parts in unary."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, dtype=np.int64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        share = max(1, (top + 1) // max(1, self.n)).bit_length() - 1
        self.shift = next(s for s in (0, 8, 16, 32) if s >= share or s == 32)
        self.low = (values & ((1 << self.shift) - 1)).astype({0: np.uint8, 8: np.uint8, 16: np.uint16, 32: np.uint32}[self.shift])
        self.buckets = (top >> self.shift) + 1
        self.high = BitRows((values >> self.shift) + np.arange(self.n), self.n + self.buckets)

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self.high.place(i, True) - i) << self.shift) | self.low[i].astype(np.int64)

    def _bucket_start(self, h: np.ndarray) -> np.ndarray:
        start = np.zeros(len(h), dtype=np.int64)
        some = h > 0
        start[some] = self.high.place(h[some] - 1, False) - (h[some] - 1)
        return np.minimum(start, self.n)

    def successor(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value not under each target, and whether it is the target."""
        if not self.n:
            return np.zeros(len(target), dtype=np.int64), np.zeros(len(target), dtype=bool)
        h = np.minimum(target >> self.shift, self.buckets)
        low = target & ((1 << self.shift) - 1)
        a, b = self._bucket_start(h), self._bucket_start(np.minimum(h + 1, self.buckets))
        end = b.copy()
        while (open_ := a < b).any():
            mid = (a + b) // 2
            less = open_ & (self.low[np.minimum(mid, self.n - 1)] < low)
            a = np.where(less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        return a, (a < end) & (self.low[np.minimum(a, self.n - 1)] == low)

    def nbytes(self) -> int:
        return self.low.nbytes + self.high.rows.nbytes + self.high.ones.nbytes + self.high.zeros.nbytes


class Quantised:
    """Values of at most 0 in 16-bit steps between the least of them and 0."""

    def __init__(self, values: np.ndarray):
        self.step = max(1e-12, -float(values.min()) / 65535) if len(values) else 1.0
        self.codes = np.round(-values / self.step).astype(np.uint16)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return -self.step * self.codes[i]


class Level:
    """Children of the level above: pointers to where each context's children begin, and their words.

    A context's words follow the last value of the context before, so that all values rise and one Elias-Fano sequence
    holds them. A word is sought relative to its context: the pointer gives the context's first child, the value before
    it what the context's words were added to, and the successor of the sum is the child if it is equal.
    """

    def __init__(self, parents: int, parent: np.ndarray, word: np.ndarray, log_p: np.ndarray | None = None, log_back: np.ndarray | None = None):
        """Rows come sorted by parent and word."""
        begin = np.searchsorted(parent, np.arange(parents + 1))
        last = np.zeros(parents + 1, dtype=np.int64)
        filled = np.flatnonzero(np.diff(begin))
        last[filled + 1] = word[begin[filled + 1] - 1] + 1
        self.pointers, self.words = EliasFano(begin), EliasFano(word + 1 + np.cumsum(last)[parent])
        self.top = float(log_p.max()) if log_p is not None and len(log_p) else 0.0
        self.codes = None if log_p is None else Quantised(log_p - self.top)
        self.log_back = None if log_back is None else Quantised(log_back)

    def find(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Index of each (context, word) in this level, -1 where there is none."""
        begin, end = self.pointers.at(parent), self.pointers.at(parent + 1)
        before = np.where(begin > 0, self.words.at(np.maximum(begin - 1, 0)), 0) if self.words.n else begin
        i, hit = self.words.successor(before + word + 1)
        return np.where(hit & (i < end), i, -1)

    def log_p(self, i: np.ndarray) -> np.ndarray:
        return self.codes[i] + self.top

    def nbytes(self) -> int:
        return self.pointers.nbytes() + self.words.nbytes() + sum(q.codes.nbytes for q in (self.codes, self.log_back) if q is not None)
