"""An FM-index over sequences of integers: backward search by rank in a wavelet matrix of the Burrows-Wheeler transform.

Suffixes are ordered by their first ORDER symbols only, which serves patterns of fewer symbols. Many patterns are searched at once.
"""

from __future__ import annotations

import numpy as np

ORDER = 64
_BLOCK = 16


class _Bits:
    """A bit vector, 64 to a word, with the ones counted before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.append(bits, np.zeros(128 - n % 64, bool)), bitorder="little").view(np.uint64)
        self.words = packed
        self.before = np.zeros(len(packed) + 1, np.int64)
        np.cumsum(np.bitwise_count(packed), out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        below = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(below)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, size: int):
        self.levels, self.zeros = [], []
        self.height = max(1, int(size - 1).bit_length())
        v = values
        for k in range(self.height - 1, -1, -1):
            bit = (v >> k) & 1 == 1
            self.levels.append(_Bits(bit))
            self.zeros.append(len(v) - self.levels[-1].ones)
            v = np.concatenate([v[~bit], v[bit]])
        self.start = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(i)
            i = np.where((symbol >> (self.height - 1 - k)) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place i."""
        return self._down(symbol, i) - self.start[symbol]


class FMIndex:
    """The index of `text` (symbols 1 to size-1; 0 parts the sequences). `owner` has a number for each place of the text."""

    def __init__(self, text: np.ndarray, size: int, owner: np.ndarray):
        n, rank = len(text), text.astype(np.int64)
        k = 1
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[: max(0, n - k)] = rank[k:]
            key = rank * (int(rank.max(initial=0)) + 1) + nxt
            order = np.argsort(key)
            if 2 * k >= ORDER:
                break
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]])) if n else order
            k *= 2
        self.n = n
        self.matrix = WaveletMatrix(text[order - 1] if n else text, size)  # before the first symbol stands the last, a separator
        self.smaller = np.zeros(size + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=size), out=self.smaller[1:])
        self.owner = owner[order]
        blocks = -(-n // _BLOCK)
        padded = np.full(max(1, blocks) * _BLOCK, np.iinfo(np.int64).max)
        padded[:n] = self.owner
        self.padded, self.table = padded, [padded.reshape(-1, _BLOCK).min(1)]
        while len(self.table[-1]) > 1 << len(self.table) - 1:
            last, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[: len(last) - half], last[half:]) if len(last) > half else last)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one symbol more in front."""
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.smaller[symbol]
        return base + both[: len(lo)], base + both[len(lo) :]

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least owner in each interval; intervals aren't empty."""
        out = np.full(len(lo), np.iinfo(np.int64).max)
        a, b = -(-lo // _BLOCK), hi // _BLOCK  # whole blocks
        for k in range(_BLOCK):
            left, right = lo + k, hi - 1 - k
            np.minimum(out, np.where((left < hi) & (left < a * _BLOCK), self.padded[np.minimum(left, len(self.padded) - 1)], out), out=out)
            np.minimum(out, np.where((right >= lo) & (right >= b * _BLOCK), self.padded[np.maximum(right, 0)], out), out=out)
        wide = np.flatnonzero(b > a)
        if len(wide):
            a, b = a[wide], b[wide]
            level = np.frexp((b - a).astype(np.float64))[1] - 1
            for k in np.unique(level):
                at = level == k
                x, y = a[at], b[at] - (1 << int(k))
                out[wide[at]] = np.minimum(out[wide[at]], np.minimum(self.table[k][x], self.table[k][y]))
        return out
