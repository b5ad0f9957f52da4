"""Minimal perfect hash of one bucket of 64-bit key hashes: bit arrays by level, ranks by counting.

A key that is alone on its bit of a level is settled there; the others go on to the next level.
Its slot is the number of set bits before its own, so n keys get the slots 0 to n - 1.
"""

from __future__ import annotations

import numpy as np

MAX_LEVELS = 48
ROOM = 1.7  # bits of a level for each key still open


def _spread(keys: np.ndarray, level: int) -> np.ndarray:
    """Mix 64 bits; every level has its own hash."""
    x = keys ^ np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """Bits of each level, all levels packed one after the other, and the slot of every key.

    Keys are distinct uint64. Two keys that no level parts can't be distinct.
    """
    open_, where, sizes, levels = keys, np.full(len(keys), -1, dtype=np.int64), [], []
    left, base = np.arange(len(keys)), 0
    while len(left):
        if len(sizes) == MAX_LEVELS:
            raise ValueError("keys are not distinct")
        m = max(8, int(len(left) * ROOM))
        at = (_spread(open_[left], len(sizes)) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        settled = alone[at]
        where[left[settled]] = at[settled] + base
        sizes.append(m)
        levels.append(alone)
        base += m
        left = left[~settled]
    bits = np.concatenate(levels) if levels else np.zeros(0, dtype=bool)
    rank = np.cumsum(bits) - 1
    return sizes, np.packbits(bits).tobytes(), rank[where] if len(keys) else where


def slots(keys: np.ndarray, sizes: list[int], packed: bytes) -> np.ndarray:
    """The slot of each key; -1 for a key that meets no set bit (it is surely not in the index)."""
    bits = np.unpackbits(np.frombuffer(packed, np.uint8))[: sum(sizes)]
    rank = np.cumsum(bits, dtype=np.int64) - 1
    found, left, base = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0
    for level, m in enumerate(sizes):
        at = (_spread(keys[left], level) % np.uint64(m)).astype(np.int64) + base
        hit = bits[at] == 1
        found[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + m
    return found
