"""Elias-Fano code of a non-decreasing sequence, with select.

A value is split into low bits, stored as they are, and a high part, stored in
unary in a bit vector: the i-th one stands at ``high_i + i``.  ``select`` finds
that one through samples of every ``SAMPLE``-th one, so a value is read
without a table of all values.  A sequence of n values up to u takes about
``n * (2 + log2(u / n))`` bits.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 64
_HEAD = struct.Struct("<QBQQI")


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.packbits(((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(ones[-1]) + 1 if n else 0), np.uint8)
        unary[ones] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + \
            self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple["EliasFano", int]:
        """(the sequence, the position after it)."""
        n, bits, low, high, samples = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        a = np.frombuffer(data, np.uint8, low, at)
        b = np.frombuffer(data, np.uint8, high, at + low)
        return cls(n, bits, a, b, np.frombuffer(data, "<u4", samples, at + low + high)), at + low + high + 4 * samples

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            out |= ((self.low[bit >> 3] >> (bit & 7)) & 1).astype(np.uint64) << np.uint64(k)
        return out

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample on, whole bytes are counted."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = (byte << 3) + (word & -word).bit_length() - 1
        return (one - i) << self.low_bits | int(self._low(np.array([i], np.int64))[0])

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        i = np.arange(self.n, dtype=np.int64)
        return (ones - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)
