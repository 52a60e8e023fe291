"""Minimal perfect hashing of distinct 32-bit keys, built in segments.

Levels of bit arrays: a key that has its slot of a level alone sets that bit and is
done, the others go to the next level.  A key's number is the count of set bits
before its own, so n keys get the numbers 0 to n - 1.  Keys that were not built in
get some number too, so the built keys are kept by number and compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from worklore.llm.textscan import _mixed

SEGMENTS = 256


def segment_of(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys.astype(np.uint64) + np.uint64(0x51ED)) & np.uint64(SEGMENTS - 1)).astype(np.int64)


def _slots(keys: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    return (_mixed(keys.astype(np.uint64) + np.uint64((level + 1) << 34)) % np.asarray(size, np.uint64)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits of every level, all bits, keys by number) of distinct keys."""
    sizes, bits, ordered, left = [], [], [], keys
    while len(left):
        size = max(64, 2 * len(left))
        slot = _slots(left, len(sizes), size)
        alone = np.bincount(slot, minlength=size) == 1
        placed = alone[slot]
        by = np.argsort(slot[placed])
        sizes.append(size)
        bits.append(alone)
        ordered.append(left[placed][by])
        left = left[~placed]
    none = np.zeros(0, bool), np.zeros(0, np.uint32)
    return sizes, np.concatenate(bits or [none[0]]), np.concatenate(ordered or [none[1]]).astype(np.uint32)


@dataclass
class Lookup:
    """Numbers of keys in some segments, one after another in the order given."""

    sizes: np.ndarray  # (level, segment), 0 where a segment has no such level
    starts: np.ndarray  # (level, segment): where that level's bits begin
    bits: np.ndarray
    rank: np.ndarray
    keys: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[int, list[int], np.ndarray, np.ndarray]]) -> Lookup:
        """parts: (segment, sizes, bits, keys by number)."""
        depth = max((len(p[1]) for p in parts), default=0)
        sizes, starts = np.zeros((depth, SEGMENTS), np.int64), np.zeros((depth, SEGMENTS), np.int64)
        at = 0
        for segment, own, bits, _ in parts:
            sizes[: len(own), segment] = own
            starts[: len(own), segment] = at + np.cumsum([0, *own])[:-1] if own else 0
            at += len(bits)
        bits = np.concatenate([np.zeros(0, bool), *(p[2] for p in parts)])
        rank = np.cumsum(bits, dtype=np.int32) - bits.astype(np.int32)
        return cls(sizes, starts, bits, rank, np.concatenate([np.zeros(0, np.uint32), *(p[3] for p in parts)]))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for keys that were not built in."""
        out = np.full(len(keys), -1, np.int64)
        segment, left = segment_of(keys), np.arange(len(keys))
        for level in range(len(self.sizes)):
            size = self.sizes[level, segment[left]]
            left = left[size > 0]
            place = self.starts[level, segment[left]] + _slots(keys[left], level, size[size > 0])
            hit = self.bits[place]
            out[left[hit]] = self.rank[place[hit]]
            left = left[~hit]
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        return np.where(known, out, -1)
