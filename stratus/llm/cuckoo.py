"""A cuckoo filter and the index of live digests built on it."""

from __future__ import annotations

import random
from array import array
from collections import deque
from collections.abc import Iterator

import xxhash

SLOTS = 4
KICKS = 200


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each key has two buckets, told apart by its fingerprint.

    ``insert`` returns False once a key finds no place after ``KICKS`` moves.  A
    fingerprint has then been pushed out, so the owner has to build a larger filter
    from its stored keys.  ``delete`` may only be called for a key that is in the filter.
    """

    def __init__(self, buckets: int):
        self.mask = buckets - 1
        if buckets < 1 or buckets & self.mask:
            raise ValueError("buckets must be a power of two")
        self.table = array("H", bytes(2 * SLOTS * buckets))
        self._random = random.Random(buckets)

    def place(self, key: bytes) -> tuple[int, int]:
        """(fingerprint, first bucket) of a key."""
        h = xxhash.xxh3_64_intdigest(key)
        return 1 + (h >> 48) % 65535, h & self.mask

    def other(self, mark: int, bucket: int) -> int:
        return (bucket ^ (mark * 0x9E3779B1 >> 7)) & self.mask

    def _slot(self, mark: int, bucket: int) -> int:
        for s in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if self.table[s] == mark:
                return s
        return -1

    def contains(self, mark: int, bucket: int) -> bool:
        return self._slot(mark, bucket) >= 0 or self._slot(mark, self.other(mark, bucket)) >= 0

    def insert(self, mark: int, bucket: int) -> bool:
        for b in (bucket, self.other(mark, bucket)):
            s = self._slot(0, b)
            if s >= 0:
                self.table[s] = mark
                return True
        b = self._random.choice((bucket, self.other(mark, bucket)))
        for _ in range(KICKS):
            s = SLOTS * b + self._random.randrange(SLOTS)
            self.table[s], mark = mark, self.table[s]
            b = self.other(mark, b)
            s = self._slot(0, b)
            if s >= 0:
                self.table[s] = mark
                return True
        return False

    def delete(self, mark: int, bucket: int) -> None:
        s = self._slot(mark, bucket)
        if s < 0:
            s = self._slot(mark, self.other(mark, bucket))
        self.table[s] = 0


class Live:
    """What is stored of a live digest: its rows and the largest of them."""

    __slots__ = ("digest", "rows", "top")

    def __init__(self, digest: bytes, rows: int, top: tuple):
        self.digest, self.rows, self.top = digest, rows, top


class LiveDigests:
    """Index of live digests: the filter answers for absent ones, stored keys decide a hit.

    Keys are stored in the bucket that the filter gives them, so a hit is verified
    against the few whole digests of one bucket.  When the filter overflows, it is built
    anew with twice the buckets from the stored keys.  ``limit`` bounds the live digests:
    beyond it ``overfull`` is true and ``evict`` deletes the oldest half and returns them.
    """

    def __init__(self, buckets: int = 256, limit: int | None = None):
        self.limit, self.size, self.resizes = limit, 0, 0
        self.arrivals: deque[bytes] = deque()
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.filter = CuckooFilter(buckets)
        self.stored: dict[int, list[Live]] = {}

    def find(self, digest: bytes) -> Live | None:
        mark, bucket = self.filter.place(digest)
        if not self.filter.contains(mark, bucket):
            return None
        return next((x for x in self.stored.get(bucket, ()) if x.digest == digest), None)

    def _enter(self, entry: Live) -> bool:
        mark, bucket = self.filter.place(entry.digest)
        self.stored.setdefault(bucket, []).append(entry)
        return self.filter.insert(mark, bucket)

    def add(self, digest: bytes, rows: int, top: tuple) -> bool:
        """Add rows of a digest; whether it is new."""
        entry = self.find(digest)
        if entry is not None:
            entry.rows += rows
            entry.top = max(entry.top, top)
            return False
        self.size += 1
        if self.limit:
            self.arrivals.append(digest)
        placed = self._enter(Live(digest, rows, top))
        while not placed:
            keys = list(self.entries())
            self._empty(2 * (self.filter.mask + 1))
            self.resizes += 1
            placed = all([self._enter(x) for x in keys])
        return True

    def remove(self, digest: bytes, rows: int = 1) -> bool:
        """Take rows of a digest away; whether it died with them.  An absent digest is left absent."""
        entry = self.find(digest)
        if entry is None:
            return False
        entry.rows -= rows
        if entry.rows > 0:
            return False
        self._drop(entry)
        return True

    def _drop(self, entry: Live) -> None:
        mark, bucket = self.filter.place(entry.digest)
        self.filter.delete(mark, bucket)
        self.stored[bucket].remove(entry)
        if not self.stored[bucket]:
            del self.stored[bucket]
        self.size -= 1

    def entries(self) -> Iterator[Live]:
        for bucket in self.stored.values():
            yield from bucket

    def slices(self, size: int = 20_000) -> Iterator[list[Live]]:
        entries = list(self.entries())
        for at in range(0, len(entries), size):
            yield entries[at:at + size]

    @property
    def overfull(self) -> bool:
        return bool(self.limit) and self.size >= self.limit

    def evict(self) -> list[Live]:
        out = []
        for _ in range((len(self.arrivals) + 1) // 2):
            entry = self.find(self.arrivals.popleft())
            if entry is not None:  # else it has died since
                out.append(entry)
                self._drop(entry)
        return out
