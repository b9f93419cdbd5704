"""Registered queries: evaluation and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import evaluation as ev
from quarry.plans.fixtures import (FX_RESULTS_GAPS_SQL, FX_RESULTS_SQL, FX_SAMPLES_SQL,
                                   MODEL_ORDER, fx_results, fx_results_with_gaps, fx_samples)
from quarry.plans.registry import load, register, with_ctes

BASELINE = "copilot"
OTHERS = [m for m in MODEL_ORDER if m != BASELINE]


def round_doubles(df: DataFrame, places: int = 9) -> DataFrame:
    return df.withColumns({f.name: F.round(f.name, places) for f in df.schema.fields
                           if f.dataType.typeName() == "double"})


# ------------------------------------------------------------ result docs

def fx_result_docs(spark, sf_dir) -> DataFrame:
    """Nested result documents (one per benchmark item), as the evaluator writes them."""
    b = load(spark, sf_dir, "benchmark")
    item = F.col("item_id")
    tests = F.when(item % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("@test "), item.cast("string")))
    program = F.concat(F.col("text"), F.lit("body_"), item.cast("string"), tests)
    status = F.when(item % 3 != 0, F.lit("OK")).otherwise(F.lit("Exception"))
    return b.select(
        F.concat(F.lit("HumanEval_"), item.cast("string"), F.lit("_x")).alias("name"),
        F.col("text").alias("prompt"), tests.alias("tests"),
        F.array(F.struct(program.alias("program"), status.alias("status"))).alias("results"))


@register("g1_result_rows", """
SELECT 'HumanEval_' || item_id || '_x' AS problem, text AS prompt,
       CASE WHEN item_id % 9 = 0 THEN '' ELSE 'body_' || item_id END AS prediction,
       item_id % 3 <> 0 AS passed
FROM benchmark""")
def g1_result_rows(spark, sf_dir):
    return ev.result_rows(fx_result_docs(spark, sf_dir))


# G2 on whole documents: prompt = first line, tests = a tail whose length varies.
def _g2_inputs(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    tail = F.expr("substring(text, greatest(length(text) - doc_id % 50 + 1, 1))")
    return docs.select(
        "doc_id", F.col("text").alias("program"),
        F.element_at(F.split("text", "\n", -1), 1).alias("prompt"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(tail).alias("tests"))


@register("g2_prediction_slice", """
WITH x AS (
  SELECT doc_id, text AS program, string_split(text, chr(10))[1] AS prompt,
         CASE WHEN doc_id % 4 = 0 THEN '' ELSE right(text, CAST(least(doc_id % 50, length(text)) AS INTEGER)) END AS tests
  FROM documents)
SELECT doc_id, CASE WHEN tests = '' THEN ''
                    ELSE program[length(prompt) + 1 : length(program) - length(tests)] END AS prediction
FROM x""")
def g2_prediction_slice(spark, sf_dir):
    x = _g2_inputs(spark, sf_dir)
    return x.select("doc_id", ev.prediction_slice("program", "prompt", "tests").alias("prediction"))


@register("g3_passed", """
SELECT 'HumanEval_' || item_id || '_x' AS problem,
       CASE WHEN item_id % 3 <> 0 THEN 'OK' ELSE 'Exception' END AS status,
       item_id % 3 <> 0 AS passed
FROM benchmark""")
def g3_passed(spark, sf_dir):
    docs = fx_result_docs(spark, sf_dir)
    status = F.try_element_at("results", F.lit(1))["status"]
    return docs.select(F.col("name").alias("problem"), status.alias("status"),
                       ev.passed_status(status).alias("passed"))


G4_PROBLEM = ("CASE WHEN doc_id % 7 = 0 THEN lang "
              "ELSE lang || '_' || CAST(doc_id % 50 AS VARCHAR) END")


@register("g4_order_by_problem_number", f"""
SELECT doc_id, problem,
       CAST(row_number() OVER (ORDER BY try_cast(regexp_extract(problem, '(\\d+)', 1) AS BIGINT) NULLS LAST,
                               problem, doc_id) - 1 AS BIGINT) AS rank
FROM (SELECT doc_id, {G4_PROBLEM} AS problem FROM documents)""")
def g4_order_by_problem_number(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    d = F.col("doc_id")
    problem = F.when(d % 7 == 0, F.col("lang")).otherwise(
        F.concat(F.col("lang"), F.lit("_"), (d % 50).cast("string")))
    rows = docs.select("doc_id", problem.alias("problem"))
    return ev.order_by_problem_number(rows, tiebreak=["doc_id"])


def _pass_at_k_sql(k: int) -> str:
    """The share of k-subsets with a correct sample, 1 - C(n-c, k) / C(n, k); no answer below k samples."""
    return f"""
SELECT model, CAST({k} AS INTEGER) AS k, round(avg(score), 9) AS pass_at_k, CAST(count(*) AS BIGINT) AS problems,
       CAST(count(score) AS BIGINT) AS scored
FROM (SELECT model, CASE WHEN n >= {k} THEN 1.0 - list_product(list_transform(range(0, {k}),
                                          lambda j: greatest(n - c - j, 0) / (n - j))) END AS score
      FROM (SELECT model, problem, CAST(count(*) AS BIGINT) AS n, CAST(count_if(passed) AS BIGINT) AS c
            FROM fx_samples GROUP BY model, problem))
GROUP BY model"""


def _pass_at_k_query(k: int):
    def q(spark, sf_dir):
        out = ev.pass_at_k_by_model(fx_samples(spark, sf_dir), k)
        return round_doubles(out.select("model", F.lit(k).alias("k"),
                                        F.col(f"pass_at_{k}").alias("pass_at_k"), "problems", "scored"))
    return q


for _k in (1, 2):
    register(f"g5_pass_at_{_k}", with_ctes(FX_SAMPLES_SQL) + _pass_at_k_sql(_k))(_pass_at_k_query(_k))


@register("g5_pass_at_2_kept_up_to_date", with_ctes(FX_SAMPLES_SQL) + _pass_at_k_sql(2))
def g5_pass_at_2_kept_up_to_date(spark, sf_dir):
    """Samples arrive as files, some wrong; a second batch corrects these and withdraws a file."""
    from quarry.operators import result_store as rs
    from quarry.session import scratch_path
    store = scratch_path(spark, "result-store")
    samples = fx_samples(spark, sf_dir).select(F.concat("model", F.lit("-"), F.col("problem") % 5).alias("file"), "model", "problem", "passed")
    wrong = F.col("file").endswith("-3")
    first = samples.withColumn("passed", F.when(wrong, ~F.col("passed")).otherwise(F.col("passed")))
    stray = samples.where(F.col("file").endswith("-1")).withColumn("file", F.lit("stray"))
    rs.apply_batch(first.unionByName(stray), store, 0)
    rs.apply_batch(samples.where(wrong), store, 1, stray.select("file").distinct())
    out = rs.pass_at_k_of_counts(rs.counts(spark, store), 2)
    return round_doubles(out.select("model", F.lit(2).alias("k"), F.col("pass_at_2").alias("pass_at_k"), "problems", "scored"))


@register("g6_pass_rates", with_ctes(FX_RESULTS_SQL) + """
SELECT model, CAST(count_if(passed) AS BIGINT) AS passed, CAST(count(*) AS BIGINT) AS total,
       round(100.0 * count_if(passed) / count(*), 2) AS percent
FROM fx_results GROUP BY model""")
def g6_pass_rates(spark, sf_dir):
    return ev.pass_rates(fx_results(spark, sf_dir))


@register("g7_outcome_counts", with_ctes(FX_RESULTS_SQL) + """
SELECT model, CAST(count_if(passed) AS BIGINT) AS correct, CAST(count_if(NOT passed) AS BIGINT) AS incorrect
FROM fx_results GROUP BY model""")
def g7_outcome_counts(spark, sf_dir):
    return ev.outcome_counts(fx_results(spark, sf_dir))


@register("g8_select_models", with_ctes(FX_RESULTS_SQL) + """
SELECT model, problem, passed FROM fx_results WHERE model IN ('copilot', 'm135')""")
def g8_select_models(spark, sf_dir):
    return ev.select_models(fx_results(spark, sf_dir), ["copilot", "m135"], known=MODEL_ORDER)


@register("g9_problem_gaps", with_ctes(FX_RESULTS_GAPS_SQL) + """
SELECT coalesce(a.problem, b.problem) AS problem, a.problem IS NOT NULL AS in_a, b.problem IS NOT NULL AS in_b
FROM (SELECT problem FROM fx_results_gaps WHERE model = 'm17b') a
FULL OUTER JOIN (SELECT problem FROM fx_results_gaps WHERE model = 'copilot') b ON a.problem = b.problem
WHERE a.problem IS NULL OR b.problem IS NULL""")
def g9_problem_gaps(spark, sf_dir):
    return ev.problem_gaps(fx_results_with_gaps(spark, sf_dir), "m17b", "copilot")


@register("g9_align_pairs", with_ctes(FX_RESULTS_SQL) + """
SELECT a.problem, a.passed AS passed_a, b.passed AS passed_b
FROM fx_results a JOIN fx_results b ON a.problem = b.problem
WHERE a.model = 'copilot' AND b.model = 'm135'""")
def g9_align_pairs(spark, sf_dir):
    return ev.align_pairs(fx_results(spark, sf_dir), "copilot", "m135")


@register("g10_contingency", with_ctes(FX_RESULTS_SQL) + """
SELECT CAST(count_if(a.passed AND b.passed) AS BIGINT) AS n11,
       CAST(count_if(a.passed AND NOT b.passed) AS BIGINT) AS n10,
       CAST(count_if(NOT a.passed AND b.passed) AS BIGINT) AS n01,
       CAST(count_if(NOT a.passed AND NOT b.passed) AS BIGINT) AS n00
FROM fx_results a JOIN fx_results b ON a.problem = b.problem
WHERE a.model = 'copilot' AND b.model = 'm135'""")
def g10_contingency(spark, sf_dir):
    return ev.contingency(ev.align_pairs(fx_results(spark, sf_dir), "copilot", "m135"))


def mcnemar_p_sql(n10: str, n01: str) -> str:
    """Exact McNemar p through lgamma (the Spark side uses a log recurrence)."""
    n, k = f"({n10} + {n01})", f"least({n10}, {n01})"
    return (f"least(1.0, 2.0 * list_sum(list_transform(range(0, {k} + 1), lambda i: "
            f"exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) - {n} * ln(2.0)))))")


def _pairs_sql(pairs: list[tuple[str, str]], source: str = "fx_results") -> str:
    values = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    return f"""pairs AS (SELECT * FROM (VALUES {values}) AS v(model_1, model_2)),
cells AS (
  SELECT p.model_1, p.model_2,
    CAST(count_if(a.passed AND b.passed) AS BIGINT) AS n11,
    CAST(count_if(a.passed AND NOT b.passed) AS BIGINT) AS n10,
    CAST(count_if(NOT a.passed AND b.passed) AS BIGINT) AS n01,
    CAST(count_if(NOT a.passed AND NOT b.passed) AS BIGINT) AS n00
  FROM pairs p JOIN {source} a ON a.model = p.model_1
               JOIN {source} b ON b.model = p.model_2 AND b.problem = a.problem
  GROUP BY p.model_1, p.model_2),
totals AS (SELECT model, CAST(count_if(passed) AS BIGINT) AS passed, CAST(count(*) AS BIGINT) AS total
           FROM {source} GROUP BY model),
stats AS (
  SELECT c.*, least(n10, n01) AS statistic, {mcnemar_p_sql('n10', 'n01')} AS p_value,
         t1.passed AS passed_1, t1.total AS total_1, t2.passed AS passed_2, t2.total AS total_2
  FROM cells c JOIN totals t1 ON t1.model = c.model_1 JOIN totals t2 ON t2.model = c.model_2)"""


def _odds_sql(p1, t1, p2, t2) -> str:
    return (f"CASE WHEN {t1} - {p1} = 0 OR {t2} - {p2} = 0 OR {p2} = 0 THEN NULL "
            f"ELSE ({p1} * 1.0 / ({t1} - {p1})) / ({p2} * 1.0 / ({t2} - {p2})) END")


ALL_PAIRS = [(a, b) for i, a in enumerate(MODEL_ORDER) for b in MODEL_ORDER[i + 1:]]
BASELINE_PAIRS = [(m, BASELINE) for m in OTHERS]

VS_BASELINE_SQL = with_ctes(FX_RESULTS_SQL, _pairs_sql(BASELINE_PAIRS)) + f"""
SELECT model_1 AS model, model_2 AS baseline, n11, n10, n01, n00, statistic, round(p_value, 9) AS p_value,
       passed_1 AS passed, total_1 AS total, passed_2 AS baseline_passed, total_2 AS baseline_total,
       round({_odds_sql('passed_2', 'total_2', 'passed_1', 'total_1')}, 9) AS odds_ratio
FROM stats"""


@register("g11_mcnemar", with_ctes(FX_RESULTS_SQL, _pairs_sql(BASELINE_PAIRS)) + """
SELECT model_1 AS model, n10, n01, statistic, round(p_value, 9) AS p_value FROM stats""")
def g11_mcnemar(spark, sf_dir):
    out = ev.compare_to_baseline(fx_results(spark, sf_dir), BASELINE, MODEL_ORDER)
    return round_doubles(out.select("model", "n10", "n01", "statistic", "p_value"))


@register("g12_odds_ratio", with_ctes(FX_RESULTS_SQL, _pairs_sql(BASELINE_PAIRS)) + f"""
SELECT model_1 AS model, round({_odds_sql('passed_2', 'total_2', 'passed_1', 'total_1')}, 9) AS odds_ratio
FROM stats""")
def g12_odds_ratio(spark, sf_dir):
    out = ev.compare_to_baseline(fx_results(spark, sf_dir), BASELINE, MODEL_ORDER)
    return round_doubles(out.select("model", "odds_ratio"))


@register("g13_compare_all_pairs", with_ctes(FX_RESULTS_SQL, _pairs_sql(ALL_PAIRS)) + f"""
SELECT model_1, model_2, n11, n10, n01, n00, statistic, round(p_value, 9) AS p_value,
       passed_1, total_1, passed_2, total_2,
       round({_odds_sql('passed_1', 'total_1', 'passed_2', 'total_2')}, 9) AS odds_ratio
FROM stats""")
def g13_compare_all_pairs(spark, sf_dir):
    return round_doubles(ev.compare_all_pairs(fx_results(spark, sf_dir), MODEL_ORDER))


@register("g14_compare_to_baseline", VS_BASELINE_SQL)
def g14_compare_to_baseline(spark, sf_dir):
    return round_doubles(ev.compare_to_baseline(fx_results(spark, sf_dir), BASELINE, MODEL_ORDER))


@register("g15_evaluation_summary", with_ctes(FX_RESULTS_SQL, _pairs_sql(BASELINE_PAIRS)) + f"""
SELECT t.model, CAST(count_if(r.passed) AS BIGINT) AS passed, CAST(count(*) AS BIGINT) AS total,
       round(100.0 * count_if(r.passed) / count(*), 2) AS percent,
       CAST(count_if(r.passed) AS BIGINT) AS correct, CAST(count_if(NOT r.passed) AS BIGINT) AS incorrect,
       any_value(s.statistic) AS statistic, round(any_value(s.p_value), 9) AS p_value,
       round(any_value({_odds_sql('s.passed_2', 's.total_2', 's.passed_1', 's.total_1')}), 9) AS odds_ratio
FROM (SELECT DISTINCT model FROM fx_results) t JOIN fx_results r ON r.model = t.model
LEFT JOIN stats s ON s.model_1 = t.model
GROUP BY t.model""")
def g15_evaluation_summary(spark, sf_dir):
    return round_doubles(ev.evaluation_summary(fx_results(spark, sf_dir), BASELINE, OTHERS))
