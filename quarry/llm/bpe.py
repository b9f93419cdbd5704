"""Byte-pair encoding by speculation and verification (numpy tables, used inside tasks).

A greedy longest match proposes the tokens of a pre-token.  The proposal is the true encoding if
every token encodes itself and no adjacent pair could have merged across its border; both checks
are vectorised over all distinct pairs of a batch and remembered.  Pre-tokens that fail are merged
exactly, lowest rank first, leftmost first.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Iterable

import numpy as np
import regex
from pyspark import SparkFiles

#: The pattern with which byte-level vocabularies split text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NEVER = 1 << 60
MAX_IDS = 1 << 24        # more than any vocabulary has
SHORT_WORD = 24          # bytes up to which a list of ranks is faster than a heap
CACHED_WORDS = 150_000   # a worker remembers this many pre-tokens, twice: newer and older ones
CACHED_PAIRS = 1_000_000
CACHED_CHARS = 48        # longer pre-tokens are encoded but not remembered


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteBpe:
    """A byte-level vocabulary: its merges, and what the compatibility checks need of them."""

    def __init__(self, spec: dict):
        model, chars = spec["model"], byte_chars()
        to_byte = {c: b for b, c in chars.items()}
        raw = {t: bytes(to_byte[c] for c in t) for t in model["vocab"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if not t["normalized"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for text, token in model["vocab"].items():
            self.token_bytes[token] = raw[text]
        for text, token in self.special.items():
            self.token_bytes[token] = text.encode()
        self.longest = max(map(len, raw.values()))
        self.byte_token = [model["vocab"][chars[b]] for b in range(256)]
        # rank[t]: when t is made; single bytes exist from the start
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.merges: dict[int, int] = {}  # pair -> rank and merged token in one number
        self.size = size
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a_id, b_id, c_id = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            if self.left[c_id] < 0:
                self.left[c_id], self.right[c_id], self.rank[c_id] = a_id, b_id, rank
            self.merges.setdefault(a_id * size + b_id, rank * MAX_IDS + c_id)
        codes = np.array(sorted(self.merges), dtype=np.int64)
        self._codes, self._ranks = codes, np.array([self.merges[c] // MAX_IDS for c in codes.tolist()], dtype=np.int64)
        self._pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.by_bytes = self._proposable({raw[t]: i for t, i in model["vocab"].items()})

    def _proposable(self, by_bytes: dict[bytes, int]) -> dict[bytes, int]:
        """Tokens that encode themselves: their halves do, and nothing merges across before they are made."""
        made = np.flatnonzero(self.rank >= 0)
        ok = self.rank < 0
        fits = self._no_merge_across(self.left[made], self.right[made], self.rank[made])
        for token, fit in sorted(zip(made.tolist(), fits.tolist()), key=lambda x: self.rank[x[0]]):
            ok[token] = fit and ok[self.left[token]] and ok[self.right[token]]
        return {b: t for b, t in by_bytes.items() if ok[t]}

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self._codes, code), len(self._codes) - 1)
        return np.where(self._codes[at] == code, self._ranks[at], NEVER)

    def _no_merge_across(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge joins the right edge of ``a`` and the left edge of ``b`` (before a rank).

        While ``a`` and ``b`` are built, the pieces at the border are an x on a's right edge and a y on
        b's left edge.  Going back in time from the finished tokens, the younger piece is taken apart
        first.  A pair (x, y) merges if its rank comes before x and before y are used up; of equal
        ranks the leftmost is merged first: that is x's own merge, but not y's.
        """
        x, y = a.copy(), b.copy()
        x_end = np.full(len(a), NEVER) if before is None else before.copy()
        y_end = x_end.copy()
        if before is not None:
            y_end -= 1  # the token's own merge, at ``before``, is the one that must come
        fine, live = np.ones(len(a), dtype=bool), np.arange(len(a))
        while len(live):
            xs, ys = x[live], y[live]
            rank = self._pair_rank(xs, ys)
            clash = (rank < NEVER) & (rank < x_end[live]) & (rank <= y_end[live])
            fine[live[clash]] = False
            xr, yr = self.rank[xs], self.rank[ys]
            go_on = ~clash & ((xr >= 0) | (yr >= 0))
            live, xs, ys, xr, yr = live[go_on], xs[go_on], ys[go_on], xr[go_on], yr[go_on]
            # of equal ranks the left piece was made first, so the right one is taken apart first
            first = xr > yr
            i, j = live[first], live[~first]
            x_end[i], x[i] = xr[first], self.right[xs[first]]
            y_end[j], y[j] = yr[~first], self.left[ys[~first]]
        return fine

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match (every single byte is a token)."""
        found, at, n, longest, table = [], 0, len(word), self.longest, self.by_bytes
        while at < n:
            end = min(n, at + longest)
            while (token := table.get(word[at:end])) is None:
                end -= 1
            found.append(token)
            at = end
        return found

    def merge(self, word: bytes) -> list[int]:
        """The exact encoding: merges of the lowest rank first, of equal ranks the leftmost."""
        piece = [self.byte_token[b] for b in word]
        if len(piece) > SHORT_WORD:
            return self._merge_long(piece)
        size, get = self.size, self.merges.get
        found = [get(a * size + b, NEVER) for a, b in zip(piece, piece[1:])]
        while found and (best := min(found)) < NEVER:
            i = found.index(best)
            piece[i] = best % MAX_IDS
            del piece[i + 1], found[i]
            if i:
                found[i - 1] = get(piece[i - 1] * size + piece[i], NEVER)
            if i < len(found):
                found[i] = get(piece[i] * size + piece[i + 1], NEVER)
        return piece

    def _merge_long(self, piece: list[int]) -> list[int]:
        """The same with a heap of (merge, place) over a linked list of pieces."""
        n, size, merges = len(piece), self.size, self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := merges.get(piece[i] * size + piece[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            merge, i = heapq.heappop(heap)
            j = after[i] if piece[i] >= 0 else n
            if j >= n or merges.get(piece[i] * size + piece[j]) != merge:
                continue  # one of the two has changed since
            piece[i], piece[j] = merge % MAX_IDS, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (m := merges.get(piece[p] * size + piece[q])) is not None:
                    heapq.heappush(heap, (m, p))
        return [t for t in piece if t >= 0]

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Packed ids (little-endian unsigned 32 bits) of distinct pre-tokens."""
        words = list(words)
        raw = [w.encode() for w in words]
        proposed = [self.propose(b) for b in raw]
        lengths = np.array([len(p) for p in proposed], dtype=np.int64)
        flat = np.array([t for p in proposed for t in p], dtype=np.int64)
        bad = set()
        if len(flat) > 1:
            word_of = np.repeat(np.arange(len(words)), lengths)
            inside = np.flatnonzero(word_of[1:] == word_of[:-1])
            codes, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
            bad = set(word_of[inside][~self._compatible(codes)[back]].tolist())
        out = {}
        for i, word in enumerate(words):
            out[word] = pack(self.merge(raw[i]) if i in bad else proposed[i])
        return out

    def _compatible(self, codes: np.ndarray) -> np.ndarray:
        if len(self._pairs) > CACHED_PAIRS:
            self._pairs.clear()
        known = self._pairs
        new = np.array([c for c in codes.tolist() if c not in known], dtype=np.int64)
        if len(new):
            known.update(zip(new.tolist(), self._no_merge_across(new // self.size, new % self.size).tolist()))
        return np.array([known[c] for c in codes.tolist()], dtype=bool)

    def _parts(self, text: str) -> list[list[str]]:
        """The pre-tokens of a text, as lists; a special string stands in a list by itself."""
        if not hasattr(self, "_split"):
            self._split = regex.compile(SPLIT)
            names = sorted(self.special, key=len, reverse=True)
            self._special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        if self._special is None or not any(s in text for s in self.special):
            return [self._split.findall(text)]
        return [[part] if part in self.special else self._split.findall(part) for part in self._special.split(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts; special strings inside a text become their token."""
        cut = [self._parts(t) for t in texts]
        different = {w for parts in cut for words in parts for w in words}
        if len(self.words) > CACHED_WORDS:  # words that come again move from the older memory to the newer
            self.older, self.words = self.words, {}
        cache, older = self.words, self.older
        new = different - cache.keys()
        cache.update({w: older[w] for w in new & older.keys()})
        known = self.encode_words(new - older.keys() - self.special.keys())
        cache.update(known)
        cache.update({s: int(i).to_bytes(4, "little") for s, i in self.special.items()})
        packed = [b"".join([cache[w] for words in parts for w in words]) for parts in cut]
        for w in known:
            if len(w) > CACHED_CHARS:
                del cache[w]
        return packed

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are not UTF-8 become replacement characters."""
        table = self.token_bytes
        return b"".join([table[i] for i in np.frombuffer(packed, dtype="<u4").tolist()]).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def loaded(name: str) -> ByteBpe:
    """The vocabulary file that was sent with ``addFile`` under ``name``; one a worker process."""
    if name not in _LOADED:
        with open(SparkFiles.get(name), encoding="utf-8") as file:
            _LOADED[name] = ByteBpe(json.load(file))
    return _LOADED[name]
