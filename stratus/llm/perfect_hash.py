"""A minimal perfect hash of 128-bit digests, built and asked with numpy."""

from __future__ import annotations

import numpy as np

_LEVELS = 64


def as_words(digests: list[bytes]) -> np.ndarray:
    """16-byte digests as rows of two 64-bit words."""
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    h = keys[:, 0] ^ (keys[:, 1] + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) + keys[:, 1]
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Slots 0 to n-1 for n distinct digests.

    At every level the digests that are alone in their bit take the next slots, the others go on to the
    next level.  Each slot keeps its digest, so an unknown digest is told from a known one that hashes alike.
    """

    def __init__(self, keys: np.ndarray):
        self.stored = np.zeros_like(keys)
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        rest, base = np.arange(len(keys)), 0
        while len(rest):
            if len(self.levels) == _LEVELS:
                raise ValueError("digests are not distinct")
            size = len(rest) + len(rest) // 4 + 1
            at = (_hash(keys[rest], len(self.levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            rank = np.cumsum(bits) - 1
            alone = bits[at]
            self.stored[base + rank[at[alone]]] = keys[rest[alone]]
            self.levels.append((bits, rank, base))
            base += int(alone.sum())
            rest = rest[~alone]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for one that is not in the table."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, (bits, rank, base) in enumerate(self.levels):
            at = (_hash(keys[rest], level) % np.uint64(len(bits))).astype(np.int64)
            met = bits[at]
            slot = base + rank[at[met]]
            same = (self.stored[slot] == keys[rest[met]]).all(axis=1)
            out[rest[met]] = np.where(same, slot, -1)
            rest = rest[~met]
        return out
