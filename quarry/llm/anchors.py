"""Places in byte strings that are chosen by their surroundings alone (numpy, used inside tasks).

In every window of WINDOW places the one whose GRAM-byte string has the least hash is an anchor
(of equal ones the leftmost).  Equal byte strings that cover a window therefore have an anchor at
the same offset, wherever they stand.
"""

from __future__ import annotations

import numpy as np

from quarry.llm.shingles import mix

GRAM = 16
SEGMENT = 1 << 20   # places handled at once, so memory does not follow the length of a text
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on (len - GRAM + 1 values)."""
    h = _BYTES[data]
    span = 1
    while span < GRAM:
        h = h[:-span] * _A + h[span:] * _B  # both halves, told apart by the factors
        h ^= h >> np.uint64(29)
        span *= 2
    return h


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values: running minima of blocks, from both ends."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def anchors(data: np.ndarray, sizes: np.ndarray, width: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the strings that lie one after the other in ``data`` (``sizes`` are their lengths).

    Returns the places that have ``right`` bytes of their string from there on, and a 64-bit key of
    these ``right`` bytes (equal bytes have equal keys; different ones hardly ever).
    """
    end_of = np.repeat(np.cumsum(sizes), sizes)  # the end of each byte's string
    found = [_segment(data[a:a + SEGMENT + width + GRAM + right], end_of[a:a + SEGMENT + width + GRAM + right] - a, width, right, a)
             for a in range(0, len(data), SEGMENT)]
    places = np.concatenate([p for p, _ in found]) if found else np.empty(0, np.int64)
    keys = np.concatenate([k for _, k in found]) if found else np.empty(0, np.uint64)
    places, first = np.unique(places, return_index=True)  # segments overlap
    return places, keys[first]


def _segment(data: np.ndarray, end_of: np.ndarray, width: int, right: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the windows that start in a segment, and their keys."""
    if len(data) < max(width + GRAM - 1, right):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = gram_hashes(data)
    places = np.arange(len(grams), dtype=np.uint64)
    least = _window_minimum((mix(grams) >> np.uint64(32) << np.uint64(32)) | places, width)[:SEGMENT] & np.uint64(0xFFFFFFFF)
    inside = np.arange(len(least)) + (width + GRAM - 1) <= end_of[:len(least)]
    chosen = np.unique(least[inside]).astype(np.int64)
    chosen = chosen[(chosen + right <= end_of[chosen]) & (chosen + right <= len(data))]
    key = np.zeros(len(chosen), dtype=np.uint64)
    for at in [*range(0, right - GRAM, GRAM), right - GRAM]:
        key = mix(key * _A + grams[chosen + at])
    return chosen + shift, key
