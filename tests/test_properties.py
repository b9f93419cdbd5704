"""Random code texts: Spark's line walks (E4-E6) against DuckDB window formulations."""

import random

import duckdb
import pytest

from quarry.functions import code as C
from quarry.functions.text import SPLITLINES_PATTERN
from quarry.plans.queries_completions import clean_sql, fix_sql, format_sql
from quarry.plans.registry import with_ctes

POOL = ["if x", "if a; b; end", "for i in xs", "  while ok", "end", "  end", "end ", "else",
        "  elseif y", "format(z)", "iffy", "endless", "function g(a)", "   ", "", "y = a+b",
        "x==1", "f( a , b )", "catch e", "begin", "struct S", "mutable struct T", "let q", "try",
        "finally", "  return x, y", "function h(x) x end", "a<b || !c",
        "\u00a0end", "\u3000if y", "\x1cfunction k()\x1c", "end\u2003", "x\u00a0=\u00a01"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(20261202)
    out = []
    for i in range(400):
        lines = [rnd.choice(POOL) for _ in range(rnd.randint(1, 25))]
        if lines[-1] == "":
            lines[-1] = "end"
        out.append((i, "\n".join(lines)))
    return out


@pytest.fixture(scope="module")
def duck(texts):
    con = duckdb.connect()
    con.execute("CREATE TABLE docs(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO docs VALUES (?, ?)", texts)
    # split("\n") lines, for E6
    con.execute("""CREATE VIEW doc_lines AS
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos FROM docs""")
    # splitlines() lines (all line boundaries, no trailing empty piece), for E4 and E5
    pat = SPLITLINES_PATTERN
    con.execute(f"""CREATE VIEW doc_splitlines AS
        SELECT doc_id, unnest(parts) AS line, unnest(generate_series(0, len(parts) - 1)) AS pos
        FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '({pat})$') THEN p[1:len(p) - 1] ELSE p END AS parts
              FROM (SELECT doc_id, text, regexp_split_to_array(text, '{pat}') AS p FROM docs))""")
    return con


def _spark(spark, texts, col):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    return dict(df.select("doc_id", col("text").alias("r")).collect())


def test_fix_block_ends_random(spark, texts, duck):
    want = dict(duck.execute(with_ctes(fix_sql("doc_lines", "e6")) + "SELECT doc_id, fixed FROM e6").fetchall())
    assert _spark(spark, texts, C.fix_block_ends) == want


def test_clean_output_random(spark, texts, duck):
    want = dict(duck.execute(with_ctes(clean_sql("doc_splitlines", "e4")) + "SELECT doc_id, cleaned FROM e4").fetchall())
    assert _spark(spark, texts, C.clean_output) == want


def test_format_code_random(spark, texts, duck):
    want = dict(duck.execute(with_ctes(format_sql("doc_splitlines", "e5")) + "SELECT doc_id, formatted FROM e5").fetchall())
    assert _spark(spark, texts, C.format_code) == want


def test_tokenizer_matches_oracle_on_unicode(spark):
    from quarry.operators.corpus import TOKEN_PATTERN, tokenize
    rnd = random.Random(11)
    alphabet = list("ab_Z09 \n\t.,()=+-") + ["é", "ß", "ü", "中", "文", "😀", " ", " ", "𝔸", "''"]
    texts = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    got = dict(spark.createDataFrame(texts, "doc_id long, text string")
               .select("doc_id", tokenize("text").alias("t")).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE t(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", texts)
    want = dict(con.execute(f"SELECT doc_id, regexp_extract_all(text, '{TOKEN_PATTERN}') FROM t").fetchall())
    assert got == want
