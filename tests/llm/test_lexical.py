import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from quarry.llm import lexical

from .conftest import LOWER

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k=10):
    terms = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    terms = [(i, c, sum(c.values())) for i, c in terms if c]
    n_docs, n_terms = len(terms), sum(n for _, _, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    queries = defaultdict(set)
    for item, text in items:
        queries[item].update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, wanted in queries.items():
        scored = []
        for i, c, n in terms:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in wanted if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, documents, docs, items, **options):
    queries = spark.createDataFrame([(*x, "z", 1) for x in items], "item_id long, text string, id string, score int")
    out = lexical.search(documents(docs), queries, **options)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, out.collect()), key=repr)


def corpus():
    rnd = random.Random(2)
    common, rare = [f"w{i}" for i in range(12)], [f"r{i}é" for i in range(60)]
    text = lambda: " ".join(rnd.choice(rare) if rnd.random() < 0.1 else rnd.choice(common) for _ in range(rnd.randint(1, 60)))
    docs = [(i, text()) for i in range(400)]
    items = [(i, " ".join(text() for _ in range(rnd.randint(1, 3)))) for i in range(25)]
    return docs, items


def test_equals_plain_search(spark, documents):
    docs, items = corpus()
    docs += [(500, docs[3][1]), (501, docs[3][1]), (502, docs[3][1].upper())]  # ties go by id
    assert found(spark, documents, docs, items, k=5) == plain_search(docs, items, 5)


def test_blocks_of_queries(spark, documents):
    docs, items = corpus()
    assert found(spark, documents, docs[:100], items, query_bytes=1500) == plain_search(docs[:100], items)


def test_odd_rows(spark, documents, odd_texts):
    items = [(1, "ONE x alpha"), (1, "none"), (2, None), (3, ""), (4, "\x85 日本 é́"), (None, "other a"), (5, "absent"), (6, "x" * 50_000), (6, "x" * 50_000)]
    docs = [r[:2] for r in odd_texts]
    assert found(spark, documents, docs, items) == plain_search(docs, items)
    assert found(spark, documents, [], items) == [] == found(spark, documents, docs, [])
    assert found(spark, documents, [(1, None), (2, " ")], items) == []


def test_accumulators_close_but_the_best_stay_exact():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        size, k = int(rnd.integers(1, 60)), int(rnd.integers(1, 8))
        terms = []
        for scale in sorted(rnd.integers(1, 1000, size=rnd.integers(1, 9)).tolist(), reverse=True):
            place = np.flatnonzero(rnd.random(size) < rnd.random())
            terms.append((place, rnd.integers(0, scale + 1, size=len(place))))
        whole = np.zeros(size, np.int64)
        for place, gain in terms:
            whole[place] += gain
        limited = lexical.accumulate(terms, size, k, 0)
        kth = lexical._kth(whole, k)
        best = whole >= max(kth, 1)
        assert (limited[best] == whole[best]).all() and np.isin(limited, np.append(whole, 0)).all()
        assert ((limited == whole) | (limited == 0)).all()


def test_accumulators_are_limited():
    rare = (np.arange(3), np.array([900, 800, 700]))
    common = (np.arange(1000), np.full(1000, 10))
    assert (lexical.accumulate([rare, common], 1000, 3, 0) > 0).sum() == 3
