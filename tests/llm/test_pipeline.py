import importlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import mixing, quality, queries

from .conftest import LOWER, SF, SF001, sha
from .test_copies import plain_components
from .test_rules import plain_statistics

TABLES = "documents pages conversations labels benchmark".split()


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output rows on the smallest tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = corpus_pipeline.materialise(stage(spark, docs, SF), f"test-{name}")
        out[name] = docs.collect(), result.collect(), docs.columns, result.columns
        docs = result
    return out


def test_columns_stay(stages):
    for name, (_, _, before, after) in stages.items():
        assert name == "bpe" or after == before


def test_quality_rejects_what_the_rules_say(spark, stages):
    given, left, _, _ = stages["quality_rules"]
    rules = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    verdict = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(given), rules).collect()}
    assert {r.doc_id for r in left} == {i for i, kept in verdict.items() if kept}
    for r in left:
        n_words, *_, repeated = plain_statistics(r.text)
        assert n_words >= 20 and 100 * repeated <= 30 * n_words


def test_exact_dedup_keeps_the_largest_id(stages):
    given, left, _, _ = stages["exact_dedup"]
    last = {}
    for r in given:
        key = r.text.translate(LOWER)
        last[key] = max(last.get(key, -1), r.doc_id)
    assert {r.doc_id for r in left} == set(last.values()) and len(left) == len(last)


def test_near_dedup_keeps_one_of_each_component(stages):
    given, left, _, _ = stages["near_dedup"]
    comps = plain_components([(r.doc_id, r.text) for r in given], 5, 80)
    assert sorted(r.doc_id for r in left) == sorted({c for _, _, c in comps})


def test_mix_repeats_what_it_takes(spark, stages):
    given, left, _, _ = stages["source_mix"]
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(spark.createDataFrame(given)).collect()}
    copies = {}
    for r in left:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert copies == {i: t for i, (t, _) in taken.items() if t}


def test_encoding_is_the_library_s(stages):
    given, left, _, _ = stages["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [library.encode(r.text, add_special_tokens=False).ids for r in given]
    assert sorted((r.doc_id, bytes(r.ids), r.n_tokens, r.decoded_sha256) for r in left) == \
        sorted((r.doc_id, np.array(i, "<u4").tobytes(), len(i), sha(r.text)) for r, i in zip(given, ids))


def test_run_is_the_stages_in_turn(spark, stages):
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "decoded_sha256").collect()
    assert sorted(map(tuple, rows)) == sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in stages["bpe"][1])


def test_all_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    found = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    expected = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    df = queries.QUERIES[name](spark, SF001)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr) == expected
