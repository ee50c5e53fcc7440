"""Bit vectors with ranks, the parts of wavelet trees."""

from __future__ import annotations

import numpy as np


class Ranks:
    """A bit vector with constant-time ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self._count()

    def _count(self) -> None:
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    @classmethod
    def of_words(cls, words: np.ndarray) -> Ranks:
        """The vector of these 64-bit words."""
        out = cls.__new__(cls)
        out.words = words
        out._count()
        return out

    def __call__(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)
