"""A cuckoo filter over 128-bit keys, kept as bytes so that it can live in a table."""

from __future__ import annotations

import numpy as np

SLOTS = 4
MAX_KICKS = 500
_FULL = 0.9


class FilterFull(Exception):
    """No place was found; the filter must be rebuilt with twice as many buckets."""


def _fingerprints(low: np.ndarray) -> np.ndarray:
    """16 bits, never 0: 0 marks an empty slot."""
    part = (low.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
    return np.where(part == 0, np.uint16(1), part)


def _steps(prints: np.ndarray) -> np.ndarray:
    """What a fingerprint adds (by exclusive or) to get from one of its buckets to the other."""
    return (prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)


class CuckooFilter:
    """Says "surely not" or "perhaps"; unlike a Bloom filter it can forget a key again."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, n_keys: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * _FULL < n_keys:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def doubled(self) -> CuckooFilter:
        """An empty filter of twice the size."""
        return CuckooFilter(np.zeros((2 * len(self.table), SLOTS), np.uint16))

    def _places(self, high: np.ndarray, low: np.ndarray):
        mask = np.uint64(len(self.table) - 1)
        prints = _fingerprints(low)
        first = high.view(np.uint64) & mask
        return prints, first, first ^ (_steps(prints) & mask)

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(high, low)
        wanted = prints[:, None]
        found = (self.table[first] == wanted) | (self.table[second] == wanted)
        return found.any(axis=1)

    def insert(self, high: np.ndarray, low: np.ndarray) -> None:
        """Adds each key once; raises ``FilterFull``, after which the filter must be rebuilt."""
        prints, first, second = self._places(high, low)
        for mark, a, b in zip(prints.tolist(), first.tolist(), second.tolist()):
            self._put(mark, a, b)

    def _put(self, mark: int, a: int, b: int) -> None:
        table, mask = self.table, len(self.table) - 1
        for place in (a, b):
            row = table[place]
            for slot in range(SLOTS):
                if not row[slot]:
                    row[slot] = mark
                    return
        place = a
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            mark, table[place, slot] = int(table[place, slot]), mark
            place ^= int(_steps(np.array([mark], np.uint16))[0]) & mask
            row = table[place]
            for free in range(SLOTS):
                if not row[free]:
                    row[free] = mark
                    return
        raise FilterFull

    def delete(self, high: np.ndarray, low: np.ndarray) -> None:
        """Forgets keys that had been inserted; one copy of each fingerprint goes."""
        prints, first, second = self._places(high, low)
        for mark, a, b in zip(prints.tolist(), first.tolist(), second.tolist()):
            for place in (a, b):
                hits = np.flatnonzero(self.table[place] == mark)
                if len(hits):
                    self.table[place, hits[0]] = 0
                    break
            else:
                raise KeyError("key is not in the filter")


def built(high: np.ndarray, low: np.ndarray) -> CuckooFilter:
    """A filter of all given keys, as large as they need."""
    made = CuckooFilter.sized(len(high))
    while True:
        try:
            made.insert(high, low)
            return made
        except FilterFull:
            made = made.doubled()
