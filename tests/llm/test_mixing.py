import random
from collections import defaultdict

import pytest

from quarry.llm import mixing

from .conftest import WORDS


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    """Shares by weight; what is above the cap is reshared until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        level = total / sum(weight[s] for s in open_)
        capped = [s for s in open_ if weight[s] * level > epochs * sizes[s]]
        if not capped:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in capped:
            target[s] = epochs * sizes[s]
            total -= target[s]
            open_.remove(s)
    return target


def table(seed, n=400):
    rnd = random.Random(seed)
    return [(i, "w " * rnd.randint(0, 30), rnd.choice(["a", "a", "a", "b", "é", "Z", None, "tiny" if i < 9 else "a"])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_takes(documents, seed):
    given = table(seed)
    rows = mixing.mix(documents(given)).collect()
    size_of, source_of = {i: len(WORDS.findall(t)) for i, t, _ in given}, {i: s for i, _, s in given}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i in size_of:
        sizes[source_of[i]] += size_of[i]
    target = plain_targets(sizes)
    assert len(rows) == len(given)
    for r in rows:
        s = source_of[r.doc_id]
        assert (r.size, r.source_size) == (size_of[r.doc_id], sizes[s])
        assert r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) < 1
    again = mixing.mix(documents(given, partitions=7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_of_odd_rows(documents, odd_texts):
    rows = mixing.mix(documents([(i, t, "s") for i, t in odd_texts])).collect()
    assert len(rows) == len(odd_texts)
    assert all(r.taken == r.size for r in rows)  # one source gets its own size
    assert mixing.mix(documents([(1, "a", "s")]).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(documents([(1, None, None), (2, "", "a")])).collect()] == [0, 0]


def test_repeats_give_the_taken_words(documents):
    given = table(5, 150) + [(900, None, "a"), (901, "", "b"), (None, "x y z", "tiny")]
    docs = documents(given)
    decisions = mixing.mix(docs)
    mixed = mixing.repeat_taken(docs, decisions)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.doc_id] += len(WORDS.findall(r.text))
    assert words == {r.doc_id: r.taken for r in decisions.collect() if r.taken}
