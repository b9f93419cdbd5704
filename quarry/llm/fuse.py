"""Static binary-fuse filters (three slots a key, 8-bit fingerprints), built and asked in numpy.

After Graf and Lemire, "Binary Fuse Filters: Fast and Smaller Than Xor Filters" (2022).  A filter
never denies a key it was built from; it wrongly admits about one key in 256.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


@dataclass
class Filter:
    seed: int
    segment: int  # slots a segment
    slots: np.ndarray  # uint8

    def tobytes(self) -> bytes:
        return np.array([self.seed, self.segment], dtype="<i8").tobytes() + self.slots.tobytes()

    @staticmethod
    def frombytes(blob: bytes) -> "Filter":
        seed, segment = np.frombuffer(blob[:16], dtype="<i8")
        return Filter(int(seed), int(segment), np.frombuffer(blob[16:], dtype=np.uint8))


def _places(keys: np.ndarray, seed: int, segment: int, n_slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots (3 x n, in three consecutive segments) and fingerprints of the keys."""
    with np.errstate(over="ignore"):
        h = _mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        first = ((h >> np.uint64(32)) * np.uint64(n_slots // segment - 2)) >> np.uint64(32)
        g = _mix(h ^ np.uint64(0x5851F42D4C957F2D))
    inside = [(g >> np.uint64(s)) % np.uint64(segment) for s in (0, 21, 42)]
    slots = np.stack([(first + np.uint64(i)) * np.uint64(segment) + inside[i] for i in range(3)]).astype(np.int64)
    return slots, (h & np.uint64(0xFF)).astype(np.uint8)


def contains(f: Filter, keys: np.ndarray) -> np.ndarray:
    slots, prints = _places(keys, f.seed, f.segment, len(f.slots))
    return (f.slots[slots[0]] ^ f.slots[slots[1]] ^ f.slots[slots[2]]) == prints


def build(keys: np.ndarray) -> Filter:
    """The filter of a set of 64-bit keys (repeats count once).

    Peeling goes in rounds: every slot with one key left frees that key.  Keys freed in one round do
    not touch each other's freeing slot, so a whole round is assigned at once, in reverse order.
    """
    keys = np.unique(keys)
    n = len(keys)
    segment = max(4, 1 << int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))
    seed = 0
    while True:
        seed += 1
        n_slots = max(3, -(-int(n * factor) // segment) + 2) * segment
        slots, prints = _places(keys, seed, segment, n_slots)
        rounds, alive = [], np.ones(n, dtype=bool)
        count = np.bincount(slots.ravel(), minlength=n_slots)
        owner = np.zeros(n_slots, dtype=np.int64)  # xor of the live keys' numbers in a slot
        for row in slots:
            np.bitwise_xor.at(owner, row, np.arange(n))
        while True:
            free = np.flatnonzero(count == 1)
            who, at = np.unique(owner[free], return_index=True)
            if not len(who):
                break
            rounds.append((who, free[at]))
            alive[who] = False
            for row in slots[:, who]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, who)
        if not alive.any():
            break
        if seed % 8 == 0:
            factor += 0.1
    table = np.zeros(n_slots, dtype=np.uint8)
    for who, at in reversed(rounds):
        s = slots[:, who]
        table[at] = 0
        table[at] = prints[who] ^ table[s[0]] ^ table[s[1]] ^ table[s[2]]
    return Filter(seed, segment, table)
