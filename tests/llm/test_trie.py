import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quarry.llm import prefix_trie

from .conftest import WORDS

SCHEMA = "conv_id long, turn long, role string, text string, depth string, a string, slice int, row string, conv string"


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(role, text) for _, _, role, _, text in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for s in members:
        children[s[:-1]] += bool(s)
    for s, m in members.items():
        for d in range(len(s) + 1):
            saved[s[:d]] += (len(m) - 1) * len(WORDS.findall(s[-1][1])) if s else 0
            leaves[s[:d]] += not children[s]
    digest = lambda s: hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()
    return sorted(((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s], digest(s))
                   for s, m in members.items()), key=repr)


def trie(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1, "z", "c") for r in rows], SCHEMA).repartition(3)
    out = prefix_trie.prefix_trie(df)
    assert out.columns[:8] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.drop("a", "b").collect()), key=repr)


def odd_conversations():
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "a", "", None, "x\ty  z"]))
            for c in range(90) for t in range(rnd.randint(1, 6))]
    rows += [(c, t, "user", "the same") for c in range(200, 260) for t in range(3)]          # many copies
    rows += [(c, t, "user", "the same") for c in range(260, 280) for t in range(2)]          # proper prefixes of them
    rows += [(301, 0, "user", "short, its group's first is absent"), (322, None, "u", "null"), (322, 0, "u", "zero"),
             (323, 1, "u", "tie"), (323, 1, "u", "another tie"), (323, 1, "u", "tie"), (None, 0, "user", "nobody"),
             (340, 0, "ab", "c"), (340, 1, "a", "bc"), (360, 0, "user", "w " * 30_000)]
    return rows


def test_equals_plain_trie(spark):
    rows = odd_conversations()
    assert trie(spark, rows) == plain_trie(rows)


def test_long_conversations_and_hubs_are_cut(spark, monkeypatch):
    """Slices of 4 turns, lists in blocks of 8 ids, and hubs from two children on give the same trie."""
    monkeypatch.setattr(prefix_trie, "SLICE", 4)
    monkeypatch.setattr(prefix_trie, "END_IDS", 8)
    monkeypatch.setattr(prefix_trie, "MAX_HUBS", 100)
    rnd = random.Random(8)
    rows = [(c, t, "user", rnd.choice("ab")) for c in range(60) for t in range(rnd.randint(0, 12))]
    rows += [(400, t, "user", "ab"[t % 3 == 0]) for t in range(200)] + [(420, t, "user", "ab"[t % 3 == 0]) for t in range(150)]
    assert trie(spark, rows) == plain_trie(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "nobody")]])
def test_no_conversation(spark, rows):
    assert trie(spark, rows) == []
