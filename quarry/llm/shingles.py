"""Word shingles of a text as sorted 64-bit values (numpy, used inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                         0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct ``width``-word shingles, sorted; a shorter text is one shingle, no words none.

    A-Z are lower-cased; words are runs of characters other than ASCII white space.  Equal shingles
    have equal values; that two different ones of one comparison agree is a chance of 2**-64 a pair.
    """
    words = (text or "").encode().lower().split()  # bytes: ASCII rules only
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    total = np.full(len(words) - span + 1, span, dtype=np.uint64)
    for i in range(span):
        total = total + hashes[i:len(words) - span + 1 + i] * _MULTIPLIERS[i]
    return np.unique(mix(total))


def set_name(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles, as two signed 64-bit values."""
    digest = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)
