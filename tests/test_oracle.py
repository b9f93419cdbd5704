"""Every registered query against its DuckDB oracle at sf0.01 (the correctness gate)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from conftest import SF001  # noqa: E402
from oracle_check import TABLES, rows_key  # noqa: E402
from type_check import SPARK_TO_DUCK  # noqa: E402

ORACLES = entry.oracle_sql()
# the training-data queries have tests of their own
QUERIES = entry.QUERIES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    yield c
    c.close()


def test_every_query_has_an_oracle():
    missing = sorted(set(QUERIES) - set(ORACLES))
    assert missing == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    rel = con.sql(ORACLES[name])
    stypes = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
              for f in df.schema.fields}
    assert stypes == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    cur = con.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    order = [ocols.index(c) for c in cols]
    want = [tuple(r[i] for i in order) for r in cur.fetchall()]
    assert len(got) == len(want)
    assert rows_key(got) == rows_key(want)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["id", "doc_string", "function_header", "function_body",
                          "has_internal_comments", "has_constraints"]
