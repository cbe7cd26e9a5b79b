"""Minimal perfect hashing with fingerprints over sets of 128-bit hashed keys, vectorised."""

from __future__ import annotations

import numpy as np

_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
_TAIL = np.array([(1 << i) - 1 for i in range(8)], dtype=np.uint8)
#: Room per key on each level; a level places those keys that meet no other.
_ROOM = 2
_MOST_LEVELS = 48


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser; every seed gives another, independent function."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class _Bits:
    """A bit array with ranks: one packed bit a slot, and a running count a byte."""

    def __init__(self, flags: np.ndarray):
        self._rank(np.packbits(flags, bitorder="little"), flags.size)

    @classmethod
    def of(cls, packed: np.ndarray, size: int) -> _Bits:
        made = cls.__new__(cls)
        made._rank(packed, size)
        return made

    def _rank(self, packed: np.ndarray, size: int) -> None:
        self.size, self.packed = size, packed
        per_byte = _ONES[self.packed]
        self.before = (np.cumsum(per_byte, dtype=np.int64) - per_byte).astype(np.uint32)
        self.total = int(per_byte.sum(dtype=np.int64))

    def get(self, slots: np.ndarray) -> np.ndarray:
        return (self.packed[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1

    def rank(self, slots: np.ndarray) -> np.ndarray:
        byte = slots >> 3
        return self.before[byte].astype(np.int64) + _ONES[self.packed[byte] & _TAIL[slots & 7]]


class SealedSet:
    """A sealed set of keys: a slot for each by a minimal perfect hash, and a fingerprint in that slot.

    Keys are two 64-bit halves: ``place`` decides the slot, ``check`` the fingerprint. About 10 bits a key
    and the fingerprint remain; the keys do not. Asking for a key of the set always answers yes; asking for
    any other answers yes with a chance of at most 2**-bits.
    """

    def __init__(self, place: np.ndarray, check: np.ndarray, bits: int = 16):
        place, first = np.unique(place.astype(np.uint64), return_index=True)
        check = check.astype(np.uint64)[first]
        self.bits, self.n, self.levels = bits, place.size, []
        rest = place
        while rest.size:
            if len(self.levels) == _MOST_LEVELS:
                raise ValueError("hash halves are not independent")
            slots = self._slots(rest, len(self.levels), max(64, _ROOM * rest.size))
            met = np.bincount(slots, minlength=max(64, _ROOM * rest.size))
            self.levels.append(_Bits(met == 1))
            rest = rest[met[slots] != 1]
        self.bases = self._bases()
        self.prints = np.zeros(self.n, dtype=np.uint16 if bits <= 16 else np.uint32)
        self.prints[self.slot(place)] = self._print(check)

    @staticmethod
    def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys, level) % np.uint64(size)).astype(np.int64)

    def _print(self, check: np.ndarray) -> np.ndarray:
        return (mix(check.astype(np.uint64), 101) >> np.uint64(64 - self.bits)).astype(self.prints.dtype)

    def slot(self, place: np.ndarray) -> np.ndarray:
        """0 .. n-1, all different, for the keys of the set; anything or -1 for others."""
        out = np.full(place.size, -1, dtype=np.int64)
        left = np.arange(place.size)
        keys = place.astype(np.uint64)
        for level, bits in enumerate(self.levels):
            slots = self._slots(keys[left], level, bits.size)
            hit = bits.get(slots) == 1
            out[left[hit]] = self.bases[level] + bits.rank(slots[hit])
            left = left[~hit]
            if not left.size:
                break
        return out

    def contains(self, place: np.ndarray, check: np.ndarray) -> np.ndarray:
        slots = self.slot(place)
        out = np.zeros(place.size, dtype=bool)
        there = slots >= 0
        out[there] = self.prints[slots[there]] == self._print(check[there])
        return out

    def to_bytes(self) -> bytes:
        """Bits and fingerprints alone; ranks are counted again when they are read."""
        head = np.array([self.bits, self.n, len(self.levels), *(b.size for b in self.levels)], dtype="<i8")
        return head.tobytes() + b"".join(b.packed.tobytes() for b in self.levels) + self.prints.astype(self.prints.dtype.newbyteorder("<")).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> SealedSet:
        bits, n, count = (int(x) for x in np.frombuffer(data, "<i8", 3))
        sizes = np.frombuffer(data, "<i8", count, 24)
        made, at = cls.__new__(cls), 24 + 8 * count
        made.bits, made.n, made.levels = bits, n, []
        for size in sizes:
            packed = np.frombuffer(data, np.uint8, -(-int(size) // 8), at)
            made.levels.append(_Bits.of(packed, int(size)))
            at += packed.size
        made.bases = made._bases()
        made.prints = np.frombuffer(data, "<u2" if bits <= 16 else "<u4", n, at)
        return made

    def _bases(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([b.total for b in self.levels])]).astype(np.int64)

    @property
    def nbytes(self) -> int:
        return self.prints.nbytes + sum(b.packed.nbytes + b.before.nbytes for b in self.levels)
