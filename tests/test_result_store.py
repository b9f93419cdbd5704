"""Counts kept up to date equal a full run, after appending, correcting, withdrawing and repeating batches."""

import random
import tempfile

from quarry.operators import evaluation as ev
from quarry.operators import result_store as rs

DDL = "file string, model string, problem long, passed boolean"


def rows(df):
    return sorted(tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_batches_equal_a_full_run(spark):
    rnd = random.Random(4)
    store = tempfile.mkdtemp(prefix="quarry-store-", dir="/tmp") + "/counts"
    current, step = {}, 0
    for batch in range(4):
        files = rnd.sample([f"f{i}" for i in range(8)], 3)
        gone = [f for f in rnd.sample(sorted(current), min(len(current), 1)) if f not in files]
        new = {f: [(f, f"m{rnd.randint(0, 2)}", rnd.randint(0, 5), rnd.random() < 0.5) for _ in range(rnd.randint(0, 30))] for f in files}
        df = spark.createDataFrame([r for f in files for r in new[f]], DDL)
        withdrawn = spark.createDataFrame([(f,) for f in gone + [f for f in files if not new[f]]], "file string")
        for _ in range(1 + batch % 2):  # every second batch is applied twice
            rs.apply_batch(df, store, batch, withdrawn)
        current.update(new)
        for f in gone:
            del current[f]
        full = spark.createDataFrame([r for f in current.values() for r in f], DDL)
        held = rs.counts(spark, store)
        assert rows(rs.results_of_counts(held)) == rows(full.select("model", "problem", "passed"))
        assert rows(rs.pass_rates_of_counts(held)) == rows(ev.pass_rates(full))
        assert rows(rs.outcome_counts_of_counts(held)) == rows(ev.outcome_counts(full))
        assert rows(rs.pass_at_k_of_counts(held, 2)) == rows(ev.pass_at_k_by_model(full, 2))
        step += 1
    assert step == 4


def test_an_empty_store_has_no_counts(spark):
    store = tempfile.mkdtemp(prefix="quarry-store-", dir="/tmp") + "/counts"
    assert rs.counts(spark, store).count() == 0
    rs.apply_batch(spark.createDataFrame([], DDL), store, 0)
    assert rs.counts(spark, store).count() == 0
