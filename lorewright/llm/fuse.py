"""Static membership structures over 64-bit keys, built with vectorised peeling.

* :class:`FuseFilter`: 3-wise binary fuse filter with one byte a slot (about
  1.13 bytes a key at size; false positives 1 in 256, no false negatives);
* :class:`PerfectHash`: minimal perfect hash in levels of bit arrays.
"""

from __future__ import annotations

import math

import numpy as np

from ._words import mix64


class FuseFilter:
    """Binary fuse filter of a fixed set of keys."""

    def __init__(self, seed: int, length: int, count: int, slots: np.ndarray):
        self.seed, self.length, self.count, self.slots = seed, length, count, slots

    @staticmethod
    def _positions(keys: np.ndarray, seed: int, length: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(keys ^ np.uint64(seed))
        span = np.uint64(count * length)
        first = ((h >> np.uint64(32)) * span >> np.uint64(32)).astype(np.int64)
        mask = length - 1
        low = h.astype(np.int64)
        second = (first + length) ^ ((low >> 18) & mask)
        third = (first + 2 * length) ^ (low & mask)
        return np.stack([first, second, third]), mix64(h).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Build over distinct ``keys`` (uint64); an empty set gives a filter that holds nothing."""
        n = len(keys)
        if not n:
            return cls(0, 0, 0, np.zeros(0, np.uint8))
        length = min(1 << 18, max(4, 1 << int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))))
        factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(max(n, 2)))
        count = max(1, -(-int(n * factor) // length) - 2 + 1)
        for seed in range(1, 200):
            where, print_ = cls._positions(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64), length, count)
            order = cls._peel(where, (count + 2) * length)
            if order is not None:
                slots = np.zeros((count + 2) * length, np.uint8)
                for own, slot in reversed(order):
                    # A slot is still 0 when its key is set: the two others decide.
                    slots[slot] = print_[own] ^ slots[where[0, own]] ^ slots[where[1, own]] ^ slots[where[2, own]]
                return cls(seed * 0x9E3779B97F4A7C15 % (1 << 64), length, count, slots)
            if seed % 10 == 0:
                count += max(1, count // 8)
        raise ValueError("keys aren't distinct")

    @staticmethod
    def _peel(where: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        n = where.shape[1]
        degree = np.bincount(where.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        ids = np.arange(n)
        for row in where:
            np.bitwise_xor.at(owner, row, ids)
        left, order = n, []
        front = np.flatnonzero(degree == 1)
        while len(front):
            own, at = np.unique(owner[front], return_index=True)
            slot = front[at]
            order.append((own, slot))
            left -= len(own)
            touched = where[:, own].ravel()
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(owner, touched, np.tile(own, 3))
            touched = np.unique(touched)
            front = touched[degree[touched] == 1]
        return order if left == 0 else None

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """True for every key of the set, and for 1 in 256 others."""
        if not len(self.slots):
            return np.zeros(len(keys), bool)
        where, print_ = self._positions(keys, self.seed, self.length, self.count)
        return (self.slots[where[0]] ^ self.slots[where[1]] ^ self.slots[where[2]]) == print_

    def dumps(self) -> bytes:
        return np.array([self.seed, self.length, self.count], np.uint64).tobytes() + self.slots.tobytes()

    @classmethod
    def loads(cls, data: bytes) -> FuseFilter:
        seed, length, count = (int(x) for x in np.frombuffer(data, np.uint64, 3))
        return cls(seed, length, count, np.frombuffer(data, np.uint8, offset=24))


class PerfectHash:
    """Minimal perfect hash: key -> 0 .. n-1, any value for other keys.

    Each level is a bit array of twice the keys that are left; keys that are
    alone on their bit stay there, the others go on.  A key's number is the
    rank of its bit.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self._starts = np.concatenate([[0], np.cumsum([int(np.bitwise_count(x).sum()) for x in levels])]).astype(np.int64)
        self._ranks = [np.concatenate([[0], np.cumsum(np.bitwise_count(x), dtype=np.int64)]) for x in levels]

    @staticmethod
    def _bit(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return ((mix64(keys ^ np.uint64((level + 1) * 0xD1B54A32D192ED03 % (1 << 64))) >> np.uint64(32)) * np.uint64(words * 64) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Build over distinct keys (uint64)."""
        levels = []
        while len(keys):
            words = max(1, -(-2 * len(keys) // 64))
            bit = cls._bit(keys, len(levels), words)
            alone = np.bincount(bit, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[bit]]
            if len(levels) > 200:
                raise ValueError("keys aren't distinct")
        return cls(levels)

    def __len__(self) -> int:
        return int(self._starts[-1])

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys; -1 for a key that surely isn't of the set."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, level in enumerate(self.levels):
            bit = self._bit(keys[left], k, len(level))
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            value = level[word] >> shift
            hit = (value & np.uint64(1)).astype(bool)
            below = level[word] & ((np.uint64(1) << shift) - np.uint64(1))
            out[left[hit]] = (self._starts[k] + self._ranks[k][word] + np.bitwise_count(below))[hit]
            left = left[~hit]
            if not len(left):
                break
        return out

    def dumps(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], np.uint64)
        return head.tobytes() + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def loads(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.uint64, 1)[0])
        sizes = np.frombuffer(data, np.uint64, n, 8).astype(np.int64)
        at, levels = 8 + 8 * n, []
        for size in sizes:
            levels.append(np.frombuffer(data, np.uint64, int(size), at))
            at += 8 * int(size)
        return cls(levels)
