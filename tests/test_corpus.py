"""Corpus preparation: invariants of token rows, sampling and batches."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from quarry.operators import corpus as cp
from quarry.plans import queries_corpus as qc


@pytest.fixture(scope="module")
def corpus(spark):
    return cp.create_corpus(qc.cleaned(spark, SF001), qc.vocab(spark, SF001)).cache()


def test_token_rows_have_fixed_length(corpus):
    bad = corpus.where((F.size("input_ids") != cp.MAX_LENGTH) | (F.size("attention_mask") != cp.MAX_LENGTH))
    assert bad.count() == 0


def test_mask_counts_tokens(spark, corpus):
    texts = qc.texts(spark, SF001).select("id", F.size(cp.tokenize("text")).alias("n"))
    joined = corpus.join(texts, "id").select(
        "n", F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("m"))
    assert joined.where(F.col("m") != F.least("n", F.lit(cp.MAX_LENGTH))).count() == 0


def test_sample_exact_size_and_reproducible(spark):
    rows = qc.cleaned(spark, SF001)
    a = [r["id"] for r in cp.sample_exact(rows, 100, seed=3).collect()]
    b = [r["id"] for r in cp.sample_exact(rows, 100, seed=3).collect()]
    assert len(a) == 100 and sorted(a) == sorted(b) and len(set(a)) == 100
    assert cp.sample_exact(rows, 10**6, seed=3).count() == rows.count()
    with pytest.raises(ValueError):
        cp.sample_exact(rows, 0)


def test_sample_exact_is_the_smallest_keys(spark):
    import hashlib
    rows = qc.cleaned(spark, SF001)
    ids = [r["id"] for r in rows.select("id").collect()]
    wanted = sorted(ids, key=lambda i: (hashlib.md5(f"5:{i}".encode()).hexdigest(), i))[:300]
    assert sorted(r["id"] for r in cp.sample_exact(rows, 300, seed=5).collect()) == sorted(wanted)


def test_encode_keeps_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "b b zz"), (2, None), (3, "")], "id long, text string")
    vocab = cp.build_vocab(df, 2)
    out = cp.encode(df, vocab)
    b, a = (vocab.where(F.col("token") == t).first()["id"] for t in "ba")
    assert sorted((r["id"], r["ids"]) for r in out.collect()) == sorted([(1, [a, b]), (1, [b, b, cp.UNK_ID]), (2, []), (3, [])])
    names = cp.preview_tokens(out.withColumnRenamed("ids", "input_ids"), vocab)
    assert sorted(r["decoded"] for r in names.collect()) == ["", "", "a b", "b b <unk>"]


def test_vocabulary_beyond_its_bound_is_joined(spark, monkeypatch):
    """The same ids and tokens by the join, with a token in every text, rows that repeat and null lists."""
    from quarry.operators import lookup
    texts = qc.texts(spark, SF001).unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "the the"), (-3, "the the")], "id long, text string"))
    vocab = cp.build_vocab(texts, 500)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    held = cp.encode(texts, vocab)
    names = cp.preview_tokens(held.withColumnRenamed("ids", "input_ids"), vocab)
    expected = key(held), key(names)
    monkeypatch.setattr(lookup, "LOOKUP_MAX_BYTES", 10)
    monkeypatch.setattr(lookup, "BLOCK_ROWS", 7)
    joined = cp.encode(texts, vocab)
    assert "CoGroup" in joined._jdf.queryExecution().toString()
    assert (key(joined), key(cp.preview_tokens(held.withColumnRenamed("ids", "input_ids"), vocab))) == expected


def test_batches_are_answered_in_parts(spark):
    """rows are whole across the parts of a batch, and texts stay behind."""
    from quarry.operators import lookup
    sizes = [0, 1, 255, 256, 257, 3, 70_000, 512, None, 140_000, 2]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, n int").coalesce(1)
    word = lambda i: F.concat(F.lit("w"), (i % 60).cast("string"))
    rows = df.withColumn("x", F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.col("n")), word)).when(F.col("n") == 0, F.array().cast("array<string>")))
    table = spark.createDataFrame([(f"w{i}", i) for i in range(50)], "token string, id int")
    out = lookup.map_elements(rows, "x", table, "token", "id", -1)
    assert lookup.ROWS_AT_ONCE < 10_000
    for records in ("10000", "7"):  # rows that go on in the next batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        try:
            got = out.orderBy("id").collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert [(r["id"], r["n"]) for r in got] == list(enumerate(sizes))
        assert [r["x"] for r in got] == [[i % 60 if i % 60 < 50 else -1 for i in range(1, (n or 0) + 1)] for n in sizes]
    texts = spark.createDataFrame([(1, "a b")], "id long, text string")
    assert cp.encode(texts, cp.build_vocab(texts, 5), keep_text=False).columns == ["id", "ids"]


def test_whole_texts_are_encoded(spark):
    df = spark.createDataFrame([(1, "a b " * 3000)], "id long, text string")
    vocab = cp.build_vocab(df, 2)
    assert len(cp.encode(df, vocab).first()["ids"]) == 6000
    assert len(cp.encode(df, vocab, max_tokens=10).first()["ids"]) == 10


def test_contradictory_variants_are_rejected():
    assert cp.require_variant("1.7b", signature=True) == "1-7B_signature"
    assert cp.require_variant("135m") == "135m" and cp.require_variant("360m", baseline=True) == "360m_baseline"
    with pytest.raises(ValueError, match="unknown model"):
        cp.require_variant("7b")
    with pytest.raises(ValueError, match="signature or baseline"):
        cp.require_variant("135m", signature=True, baseline=True)


def test_training_batches(spark):
    ids = spark.range(0, 37).withColumnRenamed("id", "id").repartition(5)
    out = {r["id"]: (r["row_index"], r["micro_batch"], r["step"])
           for r in cp.training_batches(ids, "135m").collect()}
    assert out[0] == (0, 0, 0) and out[9] == (9, 2, 1) and out[36] == (36, 9, 4)
    with pytest.raises(ValueError):
        cp.training_batches(ids, "7b")


def test_model_variants(spark):
    rows = {r["model"]: r for r in cp.model_variants(spark).collect()}
    assert len(rows) == 9
    assert rows["1.7b_signature"]["directory"] == "1-7B_signature"
    assert not any(r["signature"] and r["baseline"] for r in rows.values())


def test_latest_checkpoint_version_order(spark):
    paths = spark.createDataFrame([("a", "m/checkpoint-9"), ("a", "m/checkpoint-10"), ("a", "m/tok"),
                                   ("b", "x/config")], "model string, path string")
    got = {r["model"]: r["checkpoint"] for r in cp.latest_checkpoint(paths).collect()}
    assert got == {"a": "m/checkpoint-10"}
    models = spark.createDataFrame([("a",), ("b",)], "model string")
    assert [r["model"] for r in cp.models_without_checkpoint(paths, models).collect()] == ["b"]


def test_latest_checkpoint_ties_are_deterministic(spark):
    paths = spark.createDataFrame([("a", "x/checkpoint-5"), ("a", "y/checkpoint-5"), ("a", "w/checkpoint-4")],
                                  "model string, path string")
    assert cp.latest_checkpoint(paths.repartition(3)).collect()[0]["checkpoint"] == "y/checkpoint-5"


def test_epoch_orders_are_permutations(spark):
    from quarry.operators.ordering import permuted
    for n in (1, 2, 3, 5, 10, 101, 961, 962, 5000):
        rows = spark.range(n).select(*[permuted(F.col("id"), F.lit(n), seed, F.lit(epoch)).alias(f"p{seed}_{epoch}")
                                       for seed, epoch in ((1, 0), (1, 1), (2, 0))]).toPandas()
        for c in rows:
            assert sorted(rows[c]) == list(range(n))
        if n > 100:
            assert all((rows[a] != rows[b]).mean() > 0.9 for a, b in (("p1_0", "p1_1"), ("p1_0", "p2_0")))
            assert abs(rows["p1_0"].corr(rows.index.to_series())) < 0.2
    epochs = cp.training_epochs(spark.range(37), "135m", 2, seed=3)
    assert "Exchange" not in epochs.select("id", "position")._jdf.queryExecution().executedPlan().toString().split("Scan")[0].replace("BroadcastExchange", "")
    assert epochs.groupBy("epoch", "step").count().where("count > 8").count() == 0 and epochs.count() == 74
