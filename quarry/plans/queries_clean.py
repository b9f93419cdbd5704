"""Registered queries: cleaning and decontamination."""

from __future__ import annotations

from quarry.functions.text import PY_WHITESPACE
from quarry.operators import preprocess as pp
from quarry.plans.fixtures import FX_FUNCTIONS_SQL, FX_PROMPTS_SQL, fx_functions, fx_prompts
from quarry.plans.registry import register, sql_chars, with_ctes

WS = sql_chars(PY_WHITESPACE)
RECORD = "id, doc_string, function_header, function_body, has_internal_comments, has_constraints"

# DuckDB building blocks, written independently of the Spark side.
NAME_SQL = "split_part(list_last(string_split({x}, 'function ')), '(', 1)"
BENCH_NAMES_SQL = """bench_names AS (
  SELECT DISTINCT split_part(list_last(string_split(
           CASE WHEN len(string_split(prompt, chr(10))) >= 2
                THEN string_split(prompt, chr(10))[-2] END, 'function ')), '(', 1) AS name
  FROM fx_prompts)"""
NORMALIZED_SQL = """normalized AS (
  SELECT id, doc_string, replace(function_header, ' (', '(') AS function_header,
    CASE WHEN doc_string = '' AND has_internal_comments = false AND has_constraints = false
         THEN '' ELSE function_body END AS function_body,
    has_internal_comments, has_constraints
  FROM fx_functions)"""


def cleaned_ctes(remove_no_docs: bool = False, name: str = "cleaned") -> list[str]:
    """CTEs ending in ``{name}``: the C8 output over fx_functions."""
    source = ("(SELECT * FROM fx_functions WHERE regexp_matches(doc_string, '[a-zA-Z]'))"
              if remove_no_docs else "fx_functions")
    return [FX_FUNCTIONS_SQL, FX_PROMPTS_SQL, BENCH_NAMES_SQL,
            NORMALIZED_SQL.replace("FROM fx_functions", "FROM " + source),
            f"""{name} AS (
  SELECT id, trim(doc_string, {WS}) AS doc_string, trim(function_header, {WS}) AS function_header,
         trim(function_body, {WS}) AS function_body, has_internal_comments, has_constraints
  FROM normalized n
  WHERE NOT EXISTS (SELECT 1 FROM bench_names b
                    WHERE b.name = {NAME_SQL.format(x='n.function_header')}))"""]


def _preprocess_sql(remove_no_docs: bool) -> str:
    return with_ctes(*cleaned_ctes(remove_no_docs)) + f"SELECT {RECORD} FROM cleaned"


@register("c1_require_docs", with_ctes(FX_FUNCTIONS_SQL) + f"""
SELECT {RECORD} FROM fx_functions WHERE regexp_matches(doc_string, '[a-zA-Z]')""")
def c1_require_docs(spark, sf_dir):
    return pp.require_docs(fx_functions(spark, sf_dir))


@register("c2_normalize_header", with_ctes(FX_FUNCTIONS_SQL) + """
SELECT id, replace(function_header, ' (', '(') AS function_header FROM fx_functions""")
def c2_normalize_header(spark, sf_dir):
    return pp.normalize_header(fx_functions(spark, sf_dir)).select("id", "function_header")


@register("c3_blank_undocumented_body", with_ctes(FX_FUNCTIONS_SQL) + """
SELECT id, CASE WHEN doc_string = '' AND NOT has_internal_comments AND NOT has_constraints
                THEN '' ELSE function_body END AS function_body
FROM fx_functions""")
def c3_blank_undocumented_body(spark, sf_dir):
    return pp.blank_undocumented_body(fx_functions(spark, sf_dir)).select("id", "function_body")


@register("c4_prompt_function_names", with_ctes(FX_PROMPTS_SQL) + """
SELECT id, split_part(list_last(string_split(
         CASE WHEN len(string_split(prompt, chr(10))) >= 2
              THEN string_split(prompt, chr(10))[-2] END, 'function ')), '(', 1) AS function_name
FROM fx_prompts""")
def c4_prompt_function_names(spark, sf_dir):
    return pp.prompt_function_names(fx_prompts(spark, sf_dir)).select("id", "function_name")


@register("c5_header_function_name", with_ctes(FX_FUNCTIONS_SQL) + f"""
SELECT id, {NAME_SQL.format(x='function_header')} AS function_name FROM fx_functions""")
def c5_header_function_name(spark, sf_dir):
    return pp.header_function_name(fx_functions(spark, sf_dir)).select("id", "function_name")


@register("c6_decontaminate", with_ctes(FX_FUNCTIONS_SQL, FX_PROMPTS_SQL, BENCH_NAMES_SQL) + f"""
SELECT id, replace(function_header, ' (', '(') AS function_header FROM fx_functions f
WHERE NOT EXISTS (SELECT 1 FROM bench_names b
                  WHERE b.name = {NAME_SQL.format(x="replace(f.function_header, ' (', '(')")})""")
def c6_decontaminate(spark, sf_dir):
    funcs = pp.normalize_header(fx_functions(spark, sf_dir)).select("id", "function_header")
    names = pp.prompt_function_names(fx_prompts(spark, sf_dir))
    return pp.decontaminate(funcs, names)


@register("c7_strip_text", with_ctes(FX_FUNCTIONS_SQL) + f"""
SELECT id, trim(doc_string, {WS}) AS doc_string, trim(function_header, {WS}) AS function_header,
       trim(function_body, {WS}) AS function_body
FROM fx_functions""")
def c7_strip_text(spark, sf_dir):
    return pp.strip_text(fx_functions(spark, sf_dir)).select(
        "id", "doc_string", "function_header", "function_body")


@register("c8_preprocess", _preprocess_sql(False))
def c8_preprocess(spark, sf_dir):
    return pp.preprocess(fx_functions(spark, sf_dir), fx_prompts(spark, sf_dir))


@register("c8_preprocess_remove_no_docs", _preprocess_sql(True))
def c8_preprocess_remove_no_docs(spark, sf_dir):
    return pp.preprocess(fx_functions(spark, sf_dir), fx_prompts(spark, sf_dir),
                         remove_no_docs=True)


BASELINE_SQL = with_ctes(FX_FUNCTIONS_SQL) + f"""
SELECT id, lower(trim(doc_string, {WS})) AS doc_string, trim(function_header, {WS}) AS function_header,
       trim(function_body, {WS}) AS function_body, has_internal_comments, has_constraints
FROM fx_functions"""


@register("c9_baseline_normalize", BASELINE_SQL)
def c9_baseline_normalize(spark, sf_dir):
    return pp.baseline_normalize(fx_functions(spark, sf_dir))


@register("c10_select_corpus_baseline", BASELINE_SQL)
def c10_select_corpus_baseline(spark, sf_dir):
    return pp.select_corpus("baseline", fx_functions(spark, sf_dir))


@register("c10_select_corpus_cleaned", _preprocess_sql(False))
def c10_select_corpus_cleaned(spark, sf_dir):
    return pp.select_corpus("cleaned", fx_functions(spark, sf_dir), fx_prompts(spark, sf_dir))
