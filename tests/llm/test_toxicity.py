import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import toxicity
from quarry.llm.terms import cut

from .conftest import SF001


def every_segment(values):
    """All maximal scoring segments by definition: the best one, then those left and right of it."""
    if not len(values):
        return []
    total = np.concatenate([[0], np.cumsum(values)])
    best = max(((total[j] - total[i], -(j - i), -i) for i in range(len(values)) for j in range(i + 1, len(values) + 1)))
    if best[0] <= 0:
        return []
    start = -best[2]
    end = start - best[1]
    return every_segment(values[:start]) + [best[0]] + every_segment(values[end:])


def test_segments_equal_their_definition():
    rnd = np.random.default_rng(4)
    for _ in range(300):
        values = rnd.integers(-60, 50, size=rnd.integers(0, 25)) + rnd.random() / 7
        found = toxicity.maximal_segments(values)
        assert [s for s, _, _ in found] == sorted(s for s, _, _ in found)
        assert all(abs(values[s:e].sum() - x) < 1e-6 for s, e, x in found)
        assert np.allclose([x for _, _, x in found], every_segment(values))


def test_scan_is_linear():
    values = np.tile([1.0, -0.5, 2.0, -3.0], 200_000)
    assert len(toxicity.maximal_segments(values)) == 200_000


def test_scores_follow_counts():
    counts = np.zeros((toxicity.LEVELS, 2, toxicity.BUCKETS), np.int32)
    at = toxicity.buckets(pa.array(["badword", "plainword", "badwolf", "unseen"], pa.large_string()))
    for level in range(toxicity.LEVELS):
        counts[level, 1, at[level][0]] += 50
        counts[level, 0, at[level][1]] += 50
    bad, plain, stem, unseen = toxicity.scores(toxicity.token_scores(counts, np.array([900, 100])), at)
    assert bad > stem > unseen > plain and abs(unseen + toxicity.DRIFT) < 1e-9


def test_extreme_value_law_is_recovered():
    rnd = np.random.default_rng(0)
    n = rnd.integers(50, 2000, size=20_000)
    most = np.log(0.02 * n / -np.log(rnd.random(len(n)))) / 1.7  # P(max <= s) = exp(-K n exp(-rate s))
    rate, k = toxicity.fit_extremes(np.maximum(most, 0), n)
    assert abs(rate - 1.7) < 0.1 and abs(np.log(k / 0.02)) < 0.2


def texts(n, seed):
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(10 ** 6)}" for _ in range(300)]
    for i in range(n):
        body = rnd.choices(words, k=rnd.randint(30, 120))
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            body.insert(rnd.randrange(len(body)), rnd.choice(["idiot", "Scum,", "moron!"]))
        yield i, " ".join(body), int(toxic)


def test_odd_rows(spark, documents, odd_texts):
    rows = list(texts(400, 1))
    docs = documents([r[:2] for r in rows] + [(1000 + (i or 0), t) for i, t in odd_texts] + [(2000, "You idiot, you scum, you moron"), (2000, None)])
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(0, 1, 0), (None, 0, 1), (5, 0, None), (9999, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert out.count() == docs.count()
    got = {r.doc_id: r for r in out.collect() if r.doc_id < 1000}
    hit = [got[i].score >= 0.5 for i, _, y in rows if y]
    assert sum(hit) >= 0.95 * len(hit) and not any(got[i].score >= 0.3 for i, _, y in rows if not y)
    assert all(len(got[i].passages) >= 1 for i, _, y in rows if y and got[i].score > 0.9)
    two = sorted(out.filter("doc_id = 2000").collect(), key=lambda r: r.score)
    assert two[0].score < 0.3 <= two[1].score and two[0].passages == [] and two[1].passages[0].end == 6
    again = toxicity.score(docs, toxicity.fit(docs.repartition(5), labels)).select("doc_id", F.round("score", 9)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out.select("doc_id", F.round("score", 9)).collect()))


def test_without_labels_of_both_kinds(spark, documents):
    docs = documents([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()] == [1.0, 1.0]
    assert toxicity.score(documents([]), toxicity.fit(documents([]), one)).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    held = toxicity.held_out(F.col("doc_id"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels.filter(~held))).join(labels.filter(held), "doc_id").toPandas()
    ranks = scored["score"].rank()
    toxic = scored["toxic"] == 1
    n1, n0 = toxic.sum(), (~toxic).sum()
    assert (ranks[toxic].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.9
    assert (scored["score"][~toxic] >= 0.3).mean() < 0.05


def test_terms_are_cut_like_a_pattern():
    import re
    pattern, lower = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [None, "", "Ab c\x85d é x", "  ", "Z-9_z\x00Ünï日本😀", "x" * 10_000]
    row, term = cut(pa.array(["skipped", *texts]).slice(1))
    assert list(zip(row.tolist(), term.to_pylist())) == [(i, w) for i, t in enumerate(texts) for w in pattern.findall((t or "").translate(lower))]
