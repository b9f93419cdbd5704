"""Statistics: check values and invariants."""

import pytest

from conftest import SF001
from quarry.functions import stats
from quarry.operators import evaluation as ev
from quarry.plans import fixtures as fx


@pytest.mark.parametrize("n10,n01,p", [
    (3, 12, 0.035156250), (0, 0, 1.0), (5, 5, 1.0), (400, 480, 0.007707305), (0, 9, 0.003906250),
    (12, 3, 0.035156250),
])
def test_mcnemar_exact(spark, n10, n01, p):
    df = spark.createDataFrame([(n10, n01)], "n10 long, n01 long")
    stat, pv = stats.mcnemar_exact("n10", "n01")
    row = df.select(stat.alias("s"), pv.alias("p")).collect()[0]
    assert row["s"] == min(n10, n01)
    assert row["p"] == pytest.approx(p, abs=1e-9)


@pytest.mark.parametrize("n,c,k,expected", [
    (5, 0, 1, 0.0), (5, 5, 1, 1.0), (5, 2, 1, 0.4), (5, 4, 2, 1.0), (5, 1, 2, 0.4), (1, 0, 2, None), (1, 1, 2, None), (1, 0, 1, 0.0),
])
def test_pass_at_k_single(spark, n, c, k, expected):
    df = spark.createDataFrame([(n, c)], "n long, c long")
    got = df.select(stats.pass_at_k("n", "c", k).alias("v")).collect()[0]["v"]
    assert got is None if expected is None else got == pytest.approx(expected, abs=1e-12)


def test_pass_at_2_by_model(spark):
    from collections import defaultdict
    from math import comb
    tally = defaultdict(lambda: [0, 0])
    for r in fx.fx_samples(spark, SF001).collect():
        tally[r["model"], r["problem"]][0] += 1
        tally[r["model"], r["problem"]][1] += r["passed"]
    for r in ev.pass_at_k_by_model(fx.fx_samples(spark, SF001), 2).collect():
        own = [v for (m, _), v in tally.items() if m == r["model"]]
        scores = [1 - comb(n - c, 2) / comb(n, 2) for n, c in own if n >= 2]
        assert (r["problems"], r["scored"]) == (len(own), len(scores)) and len(scores) < len(own)
        assert r["pass_at_2"] == pytest.approx(sum(scores) / len(scores))


def test_comparisons_reject_what_cannot_be_paired(spark):
    ddl = "model string, problem long, passed boolean"
    rows = [("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, True), ("b", 2, True), ("b", 2, False), ("c", 1, True), ("c", 2, True), ("c", 3, False)]
    res = spark.createDataFrame(rows, ddl)
    with pytest.raises(ev.IncomparableResults, match="b: 1 duplicates, b: 1 gaps, zz: absent") as error:
        ev.compare_all_pairs(res, ["a", "b", "zz"])
    assert sorted((r["model"], r["fault"], r["problem"]) for r in error.value.table.collect() if r["problem"]) == \
        [("b", "duplicate", 2), ("b", "gap", 3)]
    assert ev.compare_all_pairs(res, ["a", "c"]).count() == 1
    with pytest.warns(UserWarning, match="no results for zz"):
        assert [r["model"] for r in ev.compare_to_baseline(res, "a", ["zz", "c"]).collect()] == ["c"]
    with pytest.raises(ev.IncomparableResults, match="zz: absent"):
        ev.compare_to_baseline(res, "zz", ["a"])
    report = ev.evaluation_report(res.where("model <> 'b'"), "a", ["a", "c", "zz"])
    assert [r["model"] for r in report["absent"].collect()] == ["zz"] and report["vs_baseline"].count() == 1
    with pytest.raises(ev.IncomparableResults):
        ev.evaluation_report(res, "a", ["b", "c"])


def test_contingency_check_values(spark):
    res = fx.fx_results(spark, SF001)
    rates = {r["model"]: (r["passed"], r["total"]) for r in ev.pass_rates(res).collect()}
    assert rates["copilot"] == (286, 399) and rates["m135"] == (164, 399)
    cells = ev.contingency(ev.align_pairs(res, "copilot", "m135")).collect()[0]
    assert (cells["n11"], cells["n10"], cells["n01"], cells["n00"]) == (121, 165, 43, 70)


def test_pair_statistics_invariants(spark):
    res = fx.fx_results(spark, SF001)
    pairs = ev.compare_all_pairs(res, fx.MODEL_ORDER).collect()
    assert len(pairs) == 6
    for r in pairs:
        assert r["n11"] + r["n10"] + r["n01"] + r["n00"] == r["total_1"] == r["total_2"] == 399
        assert 0.0 <= r["p_value"] <= 1.0
        assert r["n11"] + r["n10"] == r["passed_1"] and r["n11"] + r["n01"] == r["passed_2"]


def test_pair_statistics_of_many_models(spark):
    """500 models in one job, without a column per model: blocks of models, chunks of problems."""
    import numpy as np
    import pandas as pd
    n, problems = 500, 300
    rnd = np.random.default_rng(6)
    outcome = rnd.random((n, problems)) < rnd.random((n, 1))
    models = [f"m{i}" for i in range(n)]
    long = pd.DataFrame({"model": np.repeat(models, problems), "problem": np.tile(np.arange(problems), n), "passed": outcome.ravel()})
    res = spark.createDataFrame(long)
    got = {(r["model_1"], r["model_2"]): (r["n11"], r["n10"], r["n01"], r["n00"], r["passed_1"], r["total_2"])
           for r in ev.pair_statistics(res, models).select("model_1", "model_2", "n11", "n10", "n01", "n00", "passed_1", "total_2").collect()}
    assert len(got) == n * (n - 1) // 2
    x = outcome.astype(int)
    n11, own = x @ x.T, x.sum(axis=1)
    for i in range(n):
        for j in range(i + 1, n):
            assert got[models[i], models[j]] == (n11[i, j], own[i] - n11[i, j], own[j] - n11[i, j], problems - own[i] - own[j] + n11[i, j], own[i], problems)


def test_pair_statistics_in_blocks_and_chunks(spark, monkeypatch):
    """Blocks of two models and many chunks count what one block and one chunk do."""
    res = fx.fx_results_with_gaps(spark, SF001)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    once = key(ev.compare_all_pairs(res, fx.MODEL_ORDER, strict=False))
    monkeypatch.setattr(ev, "MODEL_BLOCK", 2)
    monkeypatch.setattr(ev, "BITS", 64)
    assert key(ev.compare_all_pairs(res, fx.MODEL_ORDER, strict=False)) == once


def test_align_pairs_rejects_gaps(spark):
    res = fx.fx_results_with_gaps(spark, SF001)
    with pytest.raises(ValueError, match="do not cover the same problems"):
        ev.align_pairs(res, "m17b", "copilot")


def test_select_models_validates(spark):
    res = fx.fx_results(spark, SF001)
    with pytest.raises(ValueError, match="unknown models"):
        ev.select_models(res, ["m999"], known=fx.MODEL_ORDER)
    with pytest.raises(ValueError, match="no results"):
        ev.select_models(res, ["m999"])


def test_odds_ratio_undefined_is_null(spark):
    df = spark.createDataFrame([(3, 0, 2, 2), (3, 1, 0, 2), (2, 2, 1, 3)], "a long, b long, c long, d long")
    got = [r["o"] for r in df.select(stats.odds_ratio("a", "b", "c", "d").alias("o")).collect()]
    assert got[0] is None and got[1] is None and got[2] == pytest.approx(3.0)


def test_mcnemar_against_exact_binomial(spark):
    import random
    from fractions import Fraction
    from math import comb
    rnd = random.Random(3)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(0, 1), (1, 0), (2000, 2100)]
    df = spark.createDataFrame(pairs, "n10 long, n01 long")
    stat, pv = stats.mcnemar_exact("n10", "n01")
    got = [r["p"] for r in df.select(pv.alias("p")).collect()]
    for (a, b), p in zip(pairs, got):
        n, k = a + b, min(a, b)
        exact = min(Fraction(1), 2 * Fraction(sum(comb(n, i) for i in range(k + 1)), 2 ** n))
        assert p == pytest.approx(float(exact), abs=1e-9, rel=1e-9)


def test_mcnemar_of_large_counts(spark):
    """1e-9 of exact fractions up to 10^4 on each side; 10^8 discordant pairs without an array of that length."""
    import time
    from fractions import Fraction
    from math import comb, erfc, sqrt
    pairs = [(10_000, 9_900), (9_999, 10_000), (4_000, 5_000), (100, 9_000), (7_000, 7_001)]
    stat, pv = stats.mcnemar_exact("n10", "n01")
    got = [r["p"] for r in spark.createDataFrame(pairs, "n10 long, n01 long").select(pv.alias("p")).collect()]
    for (a, b), p in zip(pairs, got):
        n, k = a + b, min(a, b)
        term, total = comb(n, k), 0
        for i in range(k, -1, -1):
            total, term = total + term, term * i // (n - i + 1)
        exact = min(Fraction(1), 2 * Fraction(total, 2 ** n))
        assert p == pytest.approx(float(exact), rel=1e-9, abs=1e-300)
    large = spark.createDataFrame([(50_000_000 - d, 50_000_000 + d) for d in (0, 1, 1000, 10_000, 25_000)] * 20, "n10 long, n01 long")
    began = time.time()
    got = [r["p"] for r in large.select(pv.alias("p")).collect()]
    assert time.time() - began < 60
    for d, p in zip((0, 1, 1000, 10_000, 25_000), got):  # the normal law with a correction of half a step
        assert p == pytest.approx(min(1.0, erfc((d - 0.5) / sqrt(5e7))), rel=1e-3)


def test_pass_at_k_against_exact(spark):
    import random
    from fractions import Fraction
    from math import comb
    rnd = random.Random(5)
    rows = []
    for _ in range(300):
        n = rnd.randint(1, 40)
        rows.append((n, rnd.randint(0, n), rnd.randint(1, 10)))
    df = spark.createDataFrame(rows, "n long, c long, k long")
    for k in sorted({r[2] for r in rows}):
        sub = [r for r in rows if r[2] == k]
        got = [r["v"] for r in spark.createDataFrame(sub, "n long, c long, k long")
               .select(stats.pass_at_k("n", "c", k).alias("v")).collect()]
        for (n, c, _), v in zip(sub, got):
            if n < k:
                assert v is None
            else:
                assert v == pytest.approx(float(1 - Fraction(comb(n - c, k), comb(n, k))), abs=1e-12)


def test_pair_statistics_brute_force_with_gaps(spark):
    import random
    from fractions import Fraction
    from itertools import combinations
    from math import comb
    rnd = random.Random(9)
    models = ["m0", "m1", "m2", "m3", "m4"]
    rows = [(m, p, rnd.random() < 0.3 + 0.1 * i) for i, m in enumerate(models)
            for p in range(400) if rnd.random() > 0.1]
    res = spark.createDataFrame(rows, "model string, problem long, passed boolean")
    got = {(r["model_1"], r["model_2"]): r for r in ev.compare_all_pairs(res, models, strict=False).collect()}
    by = {m: {p: ok for mm, p, ok in rows if mm == m} for m in models}
    assert len(got) == 10
    for a, b in combinations(models, 2):
        common = set(by[a]) & set(by[b])
        n11 = sum(by[a][p] and by[b][p] for p in common)
        n10 = sum(by[a][p] and not by[b][p] for p in common)
        n01 = sum(not by[a][p] and by[b][p] for p in common)
        n00 = len(common) - n11 - n10 - n01
        r = got[(a, b)]
        assert (r["n11"], r["n10"], r["n01"], r["n00"]) == (n11, n10, n01, n00)
        n, k = n10 + n01, min(n10, n01)
        p = min(Fraction(1), 2 * Fraction(sum(comb(n, i) for i in range(k + 1)), 2 ** n))
        assert r["p_value"] == pytest.approx(float(p), abs=1e-9)
        pa, pb = sum(by[a].values()), sum(by[b].values())
        fa, fb = len(by[a]) - pa, len(by[b]) - pb
        assert (r["passed_1"], r["total_1"], r["passed_2"], r["total_2"]) == (pa, len(by[a]), pb, len(by[b]))
        assert r["odds_ratio"] == pytest.approx((pa / fa) / (pb / fb))
