"""Sorted runs of byte strings: front coding, and merging with a loser tree that keeps prefixes.

After Bingmann, Sanders and Schimek, "Communication-Efficient String Sorting" (2020).  A run states
each string as the length of the prefix it shares with the one before and the rest.  In the tree
every loser remembers how long a prefix it shares with the string that went out last; a contest
looks at bytes only when both remember the same length, and only beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def merge(runs: Sequence[tuple[Sequence[int], Sequence[bytes]]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs (shared prefix lengths, strings).

    Returns, in the merged order, the run that each string is from and the prefix length it shares
    with the string before.  Strings of one run keep their order.
    """
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r[1] for r in runs] + [()] * (k - len(runs))
    shared = [r[0] for r in runs] + [()] * (k - len(runs))
    at = [0] * k
    size = [len(s) for s in strings]
    head = [s[0] if s else b"" for s in strings]
    known = [0 if n else -1 for n in size]  # prefix shared with the last one out; -1: the run is used up
    loser = [0] * k

    def contest(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)."""
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        if ka < 0:
            return a, b
        x, y = head[a], head[b]
        h = common_prefix(x, y, ka)
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    winners = list(range(k))
    node = k
    while len(winners) > 1:  # the first round, from the leaves up
        node //= 2
        above = []
        for i in range(node):
            w, lose = contest(winners[2 * i], winners[2 * i + 1])
            loser[node + i] = lose
            above.append(w)
        winners = above
    best = winners[0]
    order, prefix = [], []
    for _ in range(sum(size)):
        order.append(best)
        prefix.append(known[best])
        i = at[best] = at[best] + 1
        if i < size[best]:
            head[best], known[best] = strings[best][i], shared[best][i]
        else:
            head[best], known[best] = b"", -1
        node = (best + k) // 2
        while node:
            other = loser[node]
            if known[other] >= known[best]:
                best, loser[node] = contest(best, other)
            node //= 2
    return order, prefix


def pack_run(strings: Sequence[bytes], extra: Sequence[bytes], more: np.ndarray) -> bytes:
    """A sorted run, front-coded and squeezed, with a short byte string and a flag for each string."""
    shared = [0] * len(strings)
    for i in range(1, len(strings)):
        shared[i] = common_prefix(strings[i - 1], strings[i])
    rest = [s[n:] for s, n in zip(strings, shared)]
    numbers = np.array([shared, list(map(len, rest)), list(map(len, extra)), more], dtype="<u2")
    raw = numbers.tobytes() + b"".join(rest) + b"".join(extra)
    return len(strings).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_run(blob: bytes) -> tuple[list[int], list[bytes], list[bytes], np.ndarray]:
    """(shared prefix lengths, strings, extras, flags) of a packed run."""
    n, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    raw = pa.decompress(blob[16:], size, codec="zstd", asbytes=True)
    numbers = np.frombuffer(raw[:8 * n], dtype="<u2").reshape(4, n)
    at, strings, extra, last = 8 * n, [], [], b""
    shared, rests, extras = (numbers[i].tolist() for i in range(3))
    for common, rest in zip(shared, rests):
        last = last[:common] + raw[at:at + rest]
        strings.append(last)
        at += rest
    for length in extras:
        extra.append(raw[at:at + length])
        at += length
    return shared, strings, extra, numbers[3].astype(np.int64)
