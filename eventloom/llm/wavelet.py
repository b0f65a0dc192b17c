"""Wavelet matrix over small classes of bytes: how often a class occurs before a place, for many places at once."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Bits:
    """A bit vector that answers how many ones lie before a place, from sums at every 64th bit."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        raw = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        raw[: len(packed)] = packed
        self.words = raw.view("<u8")
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << rest) - np.uint64(1)))


class Wavelet:
    """Classes 0 to 2**depth - 1 of a sequence, a bit vector for each of their bits, highest first; zeros go before ones from level to level."""

    def __init__(self, classes: np.ndarray, depth: int) -> None:
        self.length, self.levels = len(classes), []
        for shift in range(depth - 1, -1, -1):
            bits = (classes >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bits)))
            if shift:
                classes = np.concatenate([classes[~bits], classes[bits]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often `symbol` occurs before each place of `at`."""
        low, at = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for shift, bits in self.levels:
            ones_low, ones = bits.ones(low), bits.ones(at)
            low, at = (bits.zeros + ones_low, bits.zeros + ones) if symbol >> shift & 1 else (low - ones_low, at - ones)
        return at - low

    def count(self, symbols: Iterable[int], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many places of start..end (end exclusive) hold one of the symbols: the ranks of each combined."""
        return sum((self.rank(s, end) - self.rank(s, start) for s in symbols), np.zeros(len(start), np.int64))

    def behind(self, symbols: Iterable[int], start: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The smallest place in start..end with `wanted` of the symbols between start and it, by bisection on ranks; `end` where there are fewer."""
        symbols, low, high = tuple(symbols), start.copy(), end.copy()
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.count(symbols, start, middle) >= wanted
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return low
