"""Registered queries: sources and sinks (A1-A13), as write -> read round trips.

Each query derives its files from the driver tables with Spark, writes
them below the session's shared checkpoint folder, reads them back with
the operator under test and returns the rows read.  The oracle computes
the same rows straight from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import evaluation as ev
from quarry.operators import repos as rp
from quarry.plans.fixtures import (FX_FUNCTIONS_SQL, FX_RESULTS_SQL, CODE_LINES,
                                   _code_line, fx_code_sql, fx_functions, fx_results, fx_results_with_gaps)
from quarry.plans.queries_completions import fix_sql
from quarry.plans.queries_eval import fx_result_docs
from quarry.plans.registry import load, register, with_ctes, written_once
from quarry.session import scratch_path
from quarry.sources import readers as rd
from quarry.sources import writers as wr


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name).replace("file:", "", 1)


# ------------------------------------------------------------------ repos

def fx_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repository per document; every tenth one is a deny-listed name."""
    docs = load(spark, sf_dir, "documents")
    d = F.col("doc_id")
    deny = F.array(*[F.lit(n) for n in rp.EXCLUDED_REPOS])
    name = F.when(d % 10 == 0, F.element_at(deny, ((d / 10).cast("long") % len(rp.EXCLUDED_REPOS) + 1).cast("int"))) \
        .otherwise(F.concat(F.lit("owner"), (d % 7).cast("string"), F.lit("/pkg"), d.cast("string"),
                            F.lit(".jl")))
    return docs.select(d.alias("doc_id"), name.alias("name"))


FX_REPOS_SQL = f"""fx_repos AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 0
                      THEN [{", ".join(f"'{n}'" for n in rp.EXCLUDED_REPOS)}][(doc_id // 10) % {len(rp.EXCLUDED_REPOS)} + 1]
                      ELSE 'owner' || CAST(doc_id % 7 AS VARCHAR) || '/pkg' || CAST(doc_id AS VARCHAR) || '.jl' END AS name
  FROM documents)"""


@register("a1_repo_list", with_ctes(FX_REPOS_SQL) + "SELECT name FROM fx_repos")
def a1_repo_list(spark, sf_dir):
    repos = fx_repos(spark, sf_dir)
    pages = (repos.groupBy((F.col("doc_id") / 100).cast("long").alias("page"))
             .agg(F.to_json(F.struct(F.collect_list(F.struct("name")).alias("items"))).alias("j")))
    root = _scratch(spark, "repo-list")
    wr.write_file_tree(pages.select(F.concat(F.lit("page_"), F.col("page").cast("string"),
                                             F.lit(".json")).alias("path"),
                                    F.encode("j", "UTF-8").alias("content")), root)
    return rd.repo_list(spark, root)


@register("a2_pending_repos", with_ctes(FX_REPOS_SQL) + """
SELECT name FROM fx_repos r
WHERE NOT EXISTS (SELECT 1 FROM fx_repos p
                  WHERE p.doc_id % 3 <> 0 AND replace(p.name, '/', '_') = replace(r.name, '/', '_'))""")
def a2_pending_repos(spark, sf_dir):
    repos = fx_repos(spark, sf_dir)
    present = repos.where(F.col("doc_id") % 3 != 0).select(rd.repo_dir_name("name").alias("repo_dir"))
    return rp.pending_repos(repos.select("name"), present)


@register("a3_exclude_repos", with_ctes(FX_REPOS_SQL) + """
SELECT name FROM fx_repos WHERE doc_id % 10 <> 0""")
def a3_exclude_repos(spark, sf_dir):
    return rp.exclude_repos(fx_repos(spark, sf_dir).select("name"))


# ------------------------------------------------------------- file trees

def _corpus_tree(spark: SparkSession, sf_dir: str) -> str:
    return written_once(spark, sf_dir, "corpus-tree", lambda: _write_corpus_tree(spark, sf_dir))


def _write_corpus_tree(spark: SparkSession, sf_dir: str) -> str:
    """One file per document: Latin-1, CRLF or UTF-8 bytes; every 7th is not ``.jl``."""
    docs = load(spark, sf_dir, "documents")
    d, text = F.col("doc_id"), F.col("text")
    latin1 = (d % 5 == 1) & ~text.rlike("[^\\x{0}-\\x{ff}]")
    content = (F.when(latin1, F.encode(text, "ISO-8859-1"))
               .when(d % 5 == 2, F.encode(F.replace(text, F.lit("\n"), F.lit("\r\n")), "UTF-8"))
               .otherwise(F.encode(text, "UTF-8")))
    path = F.concat(F.lit("repo_"), F.col("source"), F.lit("/doc_"), d.cast("string"),
                    F.when(d % 7 == 0, F.lit(".txt")).otherwise(F.lit(".jl")))
    root = _scratch(spark, "corpus-tree")
    wr.write_file_tree(docs.select(path.alias("path"), content.alias("content")), root)
    return root


def _listed_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    listed = docs.select(F.concat(F.lit("repo/"), F.col("source")).alias("name")).distinct()
    return listed.where(F.substring_index("name", "src", -1).cast("int") % 4 != 3)


TREE_SQL = """tree AS (
  SELECT doc_id, 'repo_' || source AS repo_dir, 'repo_' || source || '/doc_' || CAST(doc_id AS VARCHAR) || '.jl' AS path,
    text, CASE WHEN doc_id % 5 = 1 AND NOT regexp_matches(text, '[^\\x{0}-\\x{ff}]') THEN CAST(length(text) AS BIGINT)
               WHEN doc_id % 5 = 2 THEN CAST(strlen(replace(text, chr(10), chr(13) || chr(10))) AS BIGINT)
               ELSE CAST(strlen(text) AS BIGINT) END AS length
  FROM documents
  WHERE doc_id % 7 <> 0 AND CAST(split_part(source, 'src', 2) AS INTEGER) % 4 <> 3)"""


@register("a4_corpus_files", with_ctes(TREE_SQL) + "SELECT repo_dir, path, length FROM tree")
def a4_corpus_files(spark, sf_dir):
    root = _corpus_tree(spark, sf_dir)
    return rd.corpus_files(spark, root, _listed_repos(spark, sf_dir), with_content=False)


@register("a4_corpus_files_size_limit", with_ctes(TREE_SQL) + """
SELECT repo_dir, path, length FROM tree WHERE length < 4096""")
def a4_corpus_files_size_limit(spark, sf_dir):
    root = _corpus_tree(spark, sf_dir)
    return rd.corpus_files(spark, root, _listed_repos(spark, sf_dir), limit=4096,
                           with_content=False)


@register("a5_decode_text", with_ctes(TREE_SQL) + "SELECT path, text FROM tree")
def a5_decode_text(spark, sf_dir):
    root = _corpus_tree(spark, sf_dir)
    files = rd.corpus_files(spark, root, _listed_repos(spark, sf_dir))
    return files.select("path", rd.decode_text("content").alias("text"))


# ------------------------------------------------------ records and results

RECORD_WITH_ID = T.StructType([T.StructField("id", T.LongType())] + rd.FUNCTION_RECORD.fields)


@register("a6_read_function_records", with_ctes(FX_FUNCTIONS_SQL) + """
SELECT id, doc_string, function_header, function_body, has_internal_comments, has_constraints FROM fx_functions""")
def a6_read_function_records(spark, sf_dir):
    path = scratch_path(spark, "records")
    wr.write_function_records(fx_functions(spark, sf_dir), path)
    return rd.read_function_records(spark, path, [T.StructField("id", T.LongType())])


@register("a7_write_function_records", with_ctes(FX_FUNCTIONS_SQL) + """
SELECT doc_string, function_header, function_body, has_internal_comments, has_constraints FROM fx_functions""")
def a7_write_function_records(spark, sf_dir):
    path = scratch_path(spark, "records")
    wr.write_function_records(fx_functions(spark, sf_dir).drop("id"), path)
    return rd.read_function_records(spark, path)


def _result_rows(spark, sf_dir) -> DataFrame:
    res = fx_results(spark, sf_dir)
    p = F.col("problem").cast("string")
    return res.select("model", p.alias("problem"), F.concat(F.lit("p"), p).alias("prompt"),
                      F.concat(F.lit("x"), p).alias("prediction"), "passed")


RESULT_ROWS_SQL = FX_RESULTS_SQL + """,
result_rows AS (
  SELECT model, CAST(problem AS VARCHAR) AS problem, 'p' || CAST(problem AS VARCHAR) AS prompt,
         'x' || CAST(problem AS VARCHAR) AS prediction, passed FROM fx_results)"""


@register("a8_read_results_array", with_ctes(RESULT_ROWS_SQL) + """
SELECT model, problem, prompt, prediction, passed FROM result_rows""")
def a8_read_results_array(spark, sf_dir):
    rows = _result_rows(spark, sf_dir)
    arrays = rows.groupBy("model", (F.col("problem").cast("long") / 100).cast("long").alias("chunk")).agg(
        F.to_json(F.collect_list(F.struct("problem", "prompt", "prediction", "passed"))).alias("value"))
    root = _scratch(spark, "results-arrays")
    wr.write_file_tree(arrays.select(
        F.concat(F.lit("model="), F.col("model"), F.lit("/chunk_"), F.col("chunk").cast("string"),
                 F.lit(".json")).alias("path"),
        F.encode("value", "UTF-8").alias("content")), root)
    return rd.read_results_array(spark, root).select("model", "problem", "prompt", "prediction", "passed")


def _result_doc_tree(spark, sf_dir) -> str:
    return written_once(spark, sf_dir, "result-docs", lambda: _write_result_doc_tree(spark, sf_dir))


def _write_result_doc_tree(spark, sf_dir) -> str:
    """Per problem: ``<name>.results.json.gz`` and a sibling completion ``<name>.json.gz``."""
    docs = fx_result_docs(spark, sf_dir)
    b = load(spark, sf_dir, "benchmark")
    comp = b.select(F.concat(F.lit("HumanEval_"), F.col("item_id").cast("string"), F.lit("_x")).alias("name"),
                    F.col("text").alias("prompt"),
                    F.array(_bench_code(), F.col("text")).alias("completions"),
                    F.lit("jl").alias("language"), (F.col("item_id") % 10 / 10).alias("temperature"),
                    F.concat(F.lit("@test f("), F.col("item_id").cast("string"), F.lit(")")).alias("tests"),
                    F.array(F.lit("\nfunction"), F.lit("\nend")).alias("stop_tokens"),
                    F.struct(F.col("item_id").alias("seed"), F.lit(None).cast("string").alias("note")).alias("meta"))
    root = _scratch(spark, "result-docs")
    payload = docs.select(F.concat(F.lit("m/"), F.col("name"), F.lit(".results.json.gz")).alias("path"),
                          F.encode(F.to_json(F.struct(*docs.columns)), "UTF-8").alias("content")).unionByName(
        comp.select(F.concat(F.lit("m/"), F.col("name"), F.lit(".json.gz")).alias("path"),
                    F.encode(F.to_json(F.struct(*comp.columns), {"ignoreNullFields": "false"}), "UTF-8").alias("content")))
    wr.write_file_tree(payload, root, compress="gzip")
    return root


def _bench_code():
    n = len(CODE_LINES)
    return F.array_join(F.transform(
        F.split(F.col("text"), "\n", -1),
        lambda l, i: _code_line((F.col("item_id") * 31 + i * 17 + F.length(l)) % n, CODE_LINES)), "\n")


@register("a9_read_result_docs", """
SELECT 'HumanEval_' || item_id || '_x' AS problem, text AS prompt,
       CASE WHEN item_id % 9 = 0 THEN '' ELSE 'body_' || item_id END AS prediction,
       item_id % 3 <> 0 AS passed
FROM benchmark""")
def a9_read_result_docs(spark, sf_dir):
    root = _result_doc_tree(spark, sf_dir)
    return ev.result_rows(rd.read_result_docs(spark, root))


@register("a10_write_results", """
SELECT 'HumanEval_' || item_id || '_x' AS problem, text AS prompt,
       CASE WHEN item_id % 9 = 0 THEN '' ELSE 'body_' || item_id END AS prediction,
       item_id % 3 <> 0 AS passed, CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS rank
FROM benchmark""")
def a10_write_results(spark, sf_dir):
    rows = ev.order_by_problem_number(ev.result_rows(fx_result_docs(spark, sf_dir)))
    path = scratch_path(spark, "results-out")
    wr.write_results(rows, path)
    schema = T.StructType(rd.RESULT_ROW.fields + [T.StructField("rank", T.LongType())])
    return spark.read.schema(schema).json(path)


@register("a10_write_results_array", """
SELECT 'HumanEval_' || item_id || '_x' AS problem, text AS prompt,
       CASE WHEN item_id % 9 = 0 THEN '' ELSE 'body_' || item_id END AS prediction, item_id % 3 <> 0 AS passed
FROM benchmark""")
def a10_write_results_array(spark, sf_dir):
    """The same export as JSON arrays, one a part file, read back by A8."""
    rows = ev.order_by_problem_number(ev.result_rows(fx_result_docs(spark, sf_dir)))
    path = scratch_path(spark, "results-arrays-out")
    wr.write_results(rows, path, as_array=True)
    return rd.read_results_array(spark, path)


BENCH_CODE_SQL = fx_code_sql(CODE_LINES, "bench_code").replace(
    "FROM documents)", "FROM (SELECT item_id AS doc_id, text FROM benchmark))")


@register("a11_rewrite_completions", with_ctes(BENCH_CODE_SQL, fix_sql("bench_code_lines", "e6")) + """
SELECT 'HumanEval_' || e6.doc_id || '_x' AS name, e6.fixed || chr(10) || 'end' AS completion_0,
       b.text AS completion_1, b.text AS prompt, 'jl' AS language, b.item_id % 10 / 10 AS temperature,
       '@test f(' || b.item_id || ')' AS tests, chr(10) || 'function|' || chr(10) || 'end' AS stop_tokens,
       b.item_id AS seed, true AS note_is_null
FROM e6 JOIN benchmark b ON b.item_id = e6.doc_id""")
def a11_rewrite_completions(spark, sf_dir):
    """Only completion 0 changes; every other field is there as it was, nulls and nested ones too."""
    root = _result_doc_tree(spark, sf_dir)
    out = _scratch(spark, "rewritten")
    wr.rewrite_completions(spark, root, out)
    back = rd.read_completion_texts(spark, out).select("document", F.from_json("document", """name string, prompt string,
        completions array<string>, language string, temperature double, tests string, stop_tokens array<string>,
        meta struct<seed:bigint,note:string>""").alias("d"))
    return back.select("d.name", F.element_at("d.completions", 1).alias("completion_0"),
                       F.element_at("d.completions", 2).alias("completion_1"), "d.prompt", "d.language", "d.temperature",
                       "d.tests", F.array_join("d.stop_tokens", "|").alias("stop_tokens"), "d.meta.seed",
                       F.contains("document", F.lit('"note": null')).alias("note_is_null"))


@register("a12_jsonl_to_csv", with_ctes(FX_FUNCTIONS_SQL) + """
SELECT id, doc_string, function_header, function_body, has_internal_comments, has_constraints FROM fx_functions""")
def a12_jsonl_to_csv(spark, sf_dir):
    src, dst = scratch_path(spark, "jsonl"), scratch_path(spark, "csv")
    wr.write_function_records(fx_functions(spark, sf_dir), src)
    wr.jsonl_to_csv(spark, src, dst, RECORD_WITH_ID)
    return wr.read_csv(spark, dst, RECORD_WITH_ID)


@register("a13_missing_inputs", """
SELECT doc_id AS problem FROM labels WHERE toxic = 1""")
def a13_missing_inputs(spark, sf_dir):
    """Labelled problems for which model m17b has no result."""
    expected = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("problem"))
    present = fx_results_with_gaps(spark, sf_dir).where(F.col("model") == "m17b")
    return rp.missing_inputs(expected, present, key="problem")


@register("a13_present_only", with_ctes(FX_RESULTS_SQL) + """
SELECT model, problem, passed FROM fx_results WHERE model IN ('copilot', 'm135')""")
def a13_present_only(spark, sf_dir):
    expected = spark.createDataFrame([("copilot",), ("m135",), ("m1b5",)], "model string")
    kept, _missing = rp.present_only(fx_results(spark, sf_dir), expected)
    return kept


@register("a8_read_model_results", with_ctes(RESULT_ROWS_SQL) + """
SELECT model, problem, prompt, prediction, passed FROM result_rows""")
def a8_read_model_results(spark, sf_dir):
    """Per-model result files ``<model>_results_jl.json``, in chunk folders of <= 100 rows."""
    rows = _result_rows(spark, sf_dir)
    chunk = (F.col("problem").cast("long") / 100).cast("long")
    arrays = rows.groupBy("model", chunk.alias("chunk")).agg(
        F.to_json(F.collect_list(F.struct("problem", "prompt", "prediction", "passed"))).alias("value"))
    root = _scratch(spark, "model-results")
    wr.write_file_tree(arrays.select(
        F.concat(F.lit("chunk_"), F.col("chunk").cast("string"), F.lit("/"), F.col("model"),
                 F.lit("_results_jl.json")).alias("path"),
        F.encode("value", "UTF-8").alias("content")), root)
    return rd.read_model_results(spark, root).select("model", "problem", "prompt", "prediction", "passed")


@register("a6_read_prompts", """
SELECT 'HumanEval_' || item_id AS name, 'bench_' || item_id AS function_name FROM benchmark""")
def a6_read_prompts(spark, sf_dir):
    """Benchmark prompts written as JSON Lines, read back, names taken from the header line."""
    from quarry.operators.preprocess import prompt_function_names
    from quarry.plans.fixtures import fx_prompts
    path = scratch_path(spark, "prompts")
    (fx_prompts(spark, sf_dir)
     .select(F.concat(F.lit("HumanEval_"), F.col("id").cast("string")).alias("name"), "prompt")
     .write.json(path))
    return prompt_function_names(rd.read_prompts(spark, path)).select("name", "function_name")
