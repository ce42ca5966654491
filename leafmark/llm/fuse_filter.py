"""Static 3-wise binary-fuse filters over 64-bit keys: 16-bit fingerprints, about 18 bits a key, no false negatives."""

from __future__ import annotations

import math

import numpy as np

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
TRIES = 100


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64((seed * 0x9E3779B97F4A7C15) & int(MASK))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _shape(n: int) -> tuple[int, int]:
    """Length of a segment (a power of two) and number of start segments."""
    length = 1 << max(2, min(18, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
    return length, max(1, -(-int(n * factor + 32) // length) - 2)


def _slots(h: np.ndarray, length: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key, in three adjoining segments, and its fingerprint."""
    base = ((h >> np.uint64(32)) * np.uint64(starts) >> np.uint64(32)).astype(np.int64) * length
    mask = np.uint64(length - 1)
    part = [(h >> np.uint64(s) & mask).astype(np.int64) for s in (0, 18)]
    third = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40) & mask).astype(np.int64)
    slots = np.stack([base + part[0], base + length + part[1], base + 2 * length + third])
    return slots, ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, start segments, fingerprints) of distinct or repeated uint64 keys."""
    keys = np.unique(keys.astype(np.uint64))
    length, starts = _shape(len(keys))
    size = (starts + 2) * length
    for seed in range(TRIES):
        if seed and seed % 10 == 0:  # an unlucky shape: a little more room
            starts, size = starts + 1, size + length
        slots, prints = _slots(_mix(keys, seed), length, starts)
        order = _peel(slots, size)
        if order is None:
            continue
        cells = np.zeros(size, dtype=np.uint16)
        for own, members in reversed(order):
            three = slots[:, members]
            cells[own] = 0
            cells[own] = prints[members] ^ cells[three[0]] ^ cells[three[1]] ^ cells[three[2]]
        return seed, length, starts, cells.tobytes()
    raise ValueError("no seed peels these keys")


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (slot, key) where the key is the slot's last one; None if a core remains."""
    n = slots.shape[1]
    count = np.bincount(slots.ravel(), minlength=size)
    held = np.zeros(size, dtype=np.int64)
    for row in slots:
        np.bitwise_xor.at(held, row, np.arange(n))
    order, left, ready = [], n, np.flatnonzero(count == 1)
    while len(ready):
        members, first = np.unique(held[ready], return_index=True)
        order.append((ready[first], members))
        left -= len(members)
        touched = slots[:, members].ravel()
        np.subtract.at(count, touched, 1)
        np.bitwise_xor.at(held, touched, np.tile(members, 3))
        touched = np.unique(touched)
        ready = touched[count[touched] == 1]
    return order if left == 0 else None


def contains(keys: np.ndarray, seed: int, length: int, starts: int, cells: bytes) -> np.ndarray:
    """True where the key may be a member; always true for members."""
    slots, prints = _slots(_mix(keys.astype(np.uint64), seed), length, starts)
    at = np.frombuffer(cells, dtype=np.uint16)
    return (at[slots[0]] ^ at[slots[1]] ^ at[slots[2]]) == prints
