"""Evaluation: result extraction, pass rates, paired tests, effect sizes.

The results table is ``(model, problem, passed)`` (plus ``sample`` for
pass@k).  Model-pair statistics count bits: problems are numbered, a
model's outcomes on 32,768 of them are two bitmaps, and the cells of a
pair are popcounts of bitmaps ANDed.  Models meet in blocks, a block pair
a matrix of counts, so any number of models is one job; no results table
is joined with itself and there is no column per model.  A problem or model
that holds a large share of the rows is aggregated map-side before it moves.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.stats import mcnemar_exact, odds_ratio, pass_at_k
from quarry.functions.text import col_
from quarry.operators.ordering import with_global_index
from quarry.session import checkpoint_dir, ship_package

OK_STATUS = "OK"
# Problems in one bitmap (what bitmap_construct_agg numbers), and models in one block.
BITS = 32_768
BITMAP_WORDS = 512
MODEL_BLOCK = 64


class IncomparableResults(ValueError):
    """Result sets that cannot be paired; ``table`` lists what is wrong (see ``result_faults``)."""

    def __init__(self, message: str, table: DataFrame):
        super().__init__(message)
        self.table = table



# ------------------------------------------------------------- G1 - G4

def prediction_slice(program, prompt, tests) -> Column:
    """``program[len(prompt):-len(tests)]``; empty tests give ""."""
    program, prompt, tests = col_(program), col_(prompt), col_(tests)
    length = F.greatest(F.length(program) - F.length(tests) - F.length(prompt), F.lit(0))
    return F.when(F.length(tests) == 0, F.lit("")).otherwise(
        F.substring(program, F.length(prompt) + 1, length))


def passed_status(status) -> Column:
    """A result passed when its status is exactly "OK"."""
    return col_(status) == F.lit(OK_STATUS)


def result_rows(docs: DataFrame) -> DataFrame:
    """G1: nested result documents -> ``problem, prompt, prediction, passed``."""
    first = F.try_element_at(F.col("results"), F.lit(1))  # no result: null prediction
    extra = [c for c in ("model",) if c in docs.columns]
    return docs.select(
        *extra,
        F.col("name").alias("problem"),
        F.col("prompt"),
        prediction_slice(first["program"], F.col("prompt"), F.col("tests")).alias("prediction"),
        passed_status(first["status"]).alias("passed"),
    )


def problem_number(problem) -> Column:
    """The first digit run of a problem name as a number (null when absent)."""
    return F.regexp_extract(col_(problem), r"(\d+)", 1).try_cast("long")


def order_by_problem_number(df: DataFrame, rank: str = "rank",
                            tiebreak: list[str] | None = None) -> DataFrame:
    """Number rows by the first digit run of ``problem`` (ties by name,
    then by ``tiebreak`` columns, by default ``model`` where there is one;
    names without digits go last).

    Adds a global 0-based ``rank``; write with ``orderBy(rank)``.
    """
    keys = [problem_number("problem").asc_nulls_last(), F.col("problem").asc()]
    if tiebreak is None:
        tiebreak = [c for c in ("model",) if c in df.columns]
    keys += [F.col(c).asc() for c in tiebreak]
    return with_global_index(df, keys, name=rank)


# ------------------------------------------------------------- G5 - G8

def pass_at_k_by_model(samples: DataFrame, k: int) -> DataFrame:
    """Mean unbiased pass@k per model from (model, problem, passed) samples.

    Problems with fewer than ``k`` samples have no score; ``scored`` counts the others.
    """
    per_problem = samples.groupBy("model", "problem").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("passed")).alias("c"))
    scored = per_problem.withColumn("score", pass_at_k("n", "c", k))
    return scored.groupBy("model").agg(
        F.avg("score").alias(f"pass_at_{k}"), F.count(F.lit(1)).alias("problems"), F.count("score").alias("scored"))


def pass_rates(results: DataFrame) -> DataFrame:
    """Passed, total and percent (2 decimals) per model."""
    agg = results.groupBy("model").agg(
        F.count_if(F.col("passed")).alias("passed"), F.count(F.lit(1)).alias("total"))
    return agg.withColumn("percent", F.round(F.col("passed") * 100.0 / F.col("total"), 2))


def outcome_counts(results: DataFrame) -> DataFrame:
    """Correct and incorrect predictions per model (the stacked-bar table)."""
    agg = results.groupBy("model").agg(
        F.count_if(F.col("passed")).alias("correct"), F.count(F.lit(1)).alias("total"))
    return agg.select("model", "correct", (F.col("total") - F.col("correct")).alias("incorrect"))


def select_models(results: DataFrame, names: list[str],
                  known: list[str] | None = None) -> DataFrame:
    """Restrict to ``names``; names outside ``known`` (or absent) are an error."""
    if known is not None:
        unknown = sorted(set(names) - set(known))
        if unknown:
            raise ValueError(f"unknown models {unknown}; choose from {sorted(known)}")
    else:
        wanted = results.sparkSession.createDataFrame([(n,) for n in names], "model string")
        present = results.select("model").distinct()
        missing = [r["model"] for r in wanted.join(present, "model", "left_anti").collect()]
        if missing:
            raise ValueError(f"no results for models {sorted(missing)}")
    return results.filter(F.col("model").isin(list(names)))


# ------------------------------------------------------------- G9 - G12

def _side(results: DataFrame, model: str, suffix: str) -> DataFrame:
    return results.where(F.col("model") == model).select(
        "problem", F.col("passed").alias(f"passed_{suffix}"))


def problem_gaps(results: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """G9 (report): problems present for only one of the two models."""
    a, b = _side(results, model_a, "a"), _side(results, model_b, "b")
    joined = a.join(b, "problem", "full_outer")
    gaps = joined.where(F.col("passed_a").isNull() | F.col("passed_b").isNull())
    return gaps.select("problem",
                       F.col("passed_a").isNotNull().alias("in_a"),
                       F.col("passed_b").isNotNull().alias("in_b"))


def align_pairs(results: DataFrame, model_a: str, model_b: str,
                check: bool = True) -> DataFrame:
    """Outcomes of two models aligned on problem; unequal problem sets are an error."""
    if check and problem_gaps(results, model_a, model_b).limit(1).count() > 0:
        raise ValueError(f"the result sets of {model_a} and {model_b} "
                         "do not cover the same problems")
    return _side(results, model_a, "a").join(_side(results, model_b, "b"), "problem")


def contingency(pairs: DataFrame, a: str = "passed_a", b: str = "passed_b") -> DataFrame:
    """The 2x2 table n11, n10, n01, n00 of two aligned outcome columns."""
    A, B = F.col(a), F.col(b)
    return pairs.agg(
        F.count_if(A & B).alias("n11"), F.count_if(A & ~B).alias("n10"),
        F.count_if(~A & B).alias("n01"), F.count_if(~A & ~B).alias("n00"))


def with_mcnemar(df: DataFrame, n10: str = "n10", n01: str = "n01") -> DataFrame:
    """Exact McNemar statistic and two-sided p-value."""
    stat, p = mcnemar_exact(n10, n01)
    return df.withColumns({"statistic": stat, "p_value": p})


def with_odds_ratio(df: DataFrame, p1="passed_1", f1="failed_1", p2="passed_2",
                    f2="failed_2", out: str = "odds_ratio") -> DataFrame:
    """(p1/f1)/(p2/f2) on each row; null when undefined."""
    return df.withColumn(out, odds_ratio(p1, f1, p2, f2))


# ------------------------------------------------------------- G13 - G15

def result_faults(results: DataFrame, models: list[str]) -> DataFrame:
    """``model, fault, problem, times``: what keeps the models' results from being paired.

    ``absent`` models have no result at all; a ``gap`` is a problem that another
    of the models has; a ``duplicate`` is a problem with several results.
    """
    spark = results.sparkSession
    own = results.where(F.col("model").isin(models))
    counts = own.groupBy("problem", "model").agg(F.count("*").alias("times"))
    named = spark.createDataFrame([(m,) for m in models], "model string")
    absent = named.join(own.select("model").distinct(), "model", "left_anti")
    present = F.array(*[F.lit(m) for m in models])
    gaps = counts.groupBy("problem").agg(F.collect_set("model").alias("held")) \
        .select(F.explode(F.array_except(present, "held")).alias("model"), "problem")  # at most a row a model
    rows = [absent.select("model", F.lit("absent").alias("fault"), F.lit(None).cast(results.schema["problem"].dataType).alias("problem"),
                          F.lit(0).cast("long").alias("times")),
            gaps.join(absent, "model", "left_anti").select("model", F.lit("gap").alias("fault"), "problem", F.lit(0).cast("long").alias("times")),
            counts.where("times > 1").select("model", F.lit("duplicate").alias("fault"), "problem", "times")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def outcome_bitmaps(results: DataFrame, models: list[str]) -> DataFrame:
    """Checkpointed (m, chunk, have, pass, twice): per model (its place in ``models``) and chunk of problems
    the bitmaps of the problems it has and has passed, and how many it has more than once.

    Problems are numbered inside buckets of their hash, so no global sort is needed; a chunk is
    one bucket's run of BITS problems.  A problem with several results counts as passed if one did.
    """
    spark = results.sparkSession
    checkpoint_dir(spark)
    place = spark.createDataFrame([(m, i) for i, m in enumerate(models)], "model string, m int")
    own = results.join(F.broadcast(place), "model")  # one row a model named by the caller
    once = own.groupBy("problem", "m").agg(F.max(F.col("passed").cast("int")).alias("passed"), F.count("*").alias("times"))
    buckets = max(1, results.count() // (max(len(models), 1) * (BITS // 2)))
    bucketed = once.withColumn("bucket", F.pmod(F.xxhash64("problem"), F.lit(buckets)))
    number = F.dense_rank().over(Window.partitionBy("bucket").orderBy("problem")) - 1
    numbered = bucketed.withColumn("number", number)
    bit = F.pmod("number", F.lit(BITS)).cast("long")
    return numbered.groupBy("m", F.struct("bucket", F.floor(F.col("number") / BITS).alias("run")).alias("chunk")).agg(
        F.bitmap_construct_agg(bit).alias("have"), F.bitmap_construct_agg(F.when(F.col("passed") == 1, bit)).alias("pass"),
        F.count_if(F.col("times") > 1).alias("twice")).checkpoint()


@dataclass(frozen=True)
class Outcomes:
    """The outcomes of ``models`` as bitmaps (``outcome_bitmaps``), and for each model its passed, total and twice."""

    results: DataFrame
    models: list[str]
    bitmaps: DataFrame
    totals: dict[str, dict]

    def absent(self, models: list[str]) -> list[str]:
        return [m for m in models if not self.totals[m]["total"]]

    def check(self, models: list[str]) -> None:
        """Raise :class:`IncomparableResults` unless each of ``models`` has one result for the same problems."""
        places = [self.models.index(m) for m in models]
        number = self.bitmaps.where(F.col("m").isin(places)).groupBy("chunk").agg(F.bitmap_or_agg("have").alias("any")) \
            .agg(F.sum(F.bitmap_count("any"))).first()[0] or 0
        said = []
        for model in sorted(models):
            t = self.totals[model]
            if not t["total"]:
                said.append(f"{model}: absent")
                continue
            said += [f"{model}: {t['twice']} duplicates"] * (t["twice"] > 0)
            said += [f"{model}: {number - t['total']} gaps"] * (t["total"] < number)
        if said:
            raise IncomparableResults(f"the results cannot be compared ({', '.join(said)})", result_faults(self.results, models))


def outcomes(results: DataFrame, models: list[str]) -> Outcomes:
    """The results of ``models``, read once; what follows reads bitmaps."""
    models = list(dict.fromkeys(models))
    bitmaps = outcome_bitmaps(results, models)
    rows = {r["m"]: r.asDict() for r in bitmaps.groupBy("m").agg(
        F.sum(F.bitmap_count("pass")).alias("passed"), F.sum(F.bitmap_count("have")).alias("total"),
        F.sum("twice").alias("twice")).collect()}  # a row a model
    nothing = {"passed": 0, "total": 0, "twice": 0}
    return Outcomes(results, models, bitmaps, {m: rows.get(i, nothing) for i, m in enumerate(models)})


def _pair_counts(bitmaps: DataFrame, n_models: int, wanted: DataFrame) -> DataFrame:
    """(i, j, n11, n10, n01, n00) of the ``wanted`` block pairs (left, right) of models, every pair of models in them.

    The models of a block travel as one row a chunk.  A block pair is dealt by itself and a share of
    the chunks; a task holds the counts of one block pair at a time.
    """
    spark = bitmaps.sparkSession
    ship_package(spark)
    blocks = bitmaps.groupBy("chunk", F.floor(F.col("m") / MODEL_BLOCK).cast("int").alias("block")) \
        .agg(F.collect_list(F.struct("m", "have", "pass")).alias("of"))  # at most MODEL_BLOCK models of 8 KB
    pairs = blocks.join(F.broadcast(wanted), F.col("block") == F.col("left")).select("chunk", "left", "right", F.col("of").alias("l")) \
        .join(blocks.select("chunk", F.col("block").alias("right"), F.col("of").alias("r")), ["chunk", "right"])
    tasks = spark.sparkContext.defaultParallelism
    dealt = pairs.withColumn("share", F.pmod(F.xxhash64("chunk"), F.lit(tasks))) \
        .repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "left", "right", "share") \
        .sortWithinPartitions("left", "right").select("left", "right", "l", "r")

    def bits(side: pa.StructArray, first: int, name: str) -> np.ndarray:
        out = np.zeros((MODEL_BLOCK, BITMAP_WORDS), np.uint64)
        for m, bitmap in zip(side.field("m").to_pylist(), side.field(name)):
            out[m - first] = np.frombuffer(bitmap.as_buffer(), np.uint64)
        return out

    def rows(left: int, right: int, counts: np.ndarray) -> pa.RecordBatch:
        i, j = np.meshgrid(np.arange(MODEL_BLOCK) + left * MODEL_BLOCK, np.arange(MODEL_BLOCK) + right * MODEL_BLOCK, indexing="ij")
        real = (i < n_models) & (j < n_models)
        names = ["i", "j", "n11", "n10", "n01", "n00"]
        return pa.RecordBatch.from_arrays([pa.array(x[real].astype(np.int64)) for x in (i, j, *counts)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, None
        for batch in batches:
            for left, right, l, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if at != (left, right):
                    if at is not None:
                        yield rows(*at, counts)
                    at, counts = (left, right), np.zeros((4, MODEL_BLOCK, MODEL_BLOCK), np.int64)
                (lh, lp), (rh, rp) = ([bits(x.values, b * MODEL_BLOCK, n) for n in ("have", "pass")] for x, b in ((l, left), (r, right)))
                for k in range(MODEL_BLOCK):  # n11, and what the first, the second, either may have failed
                    for c, (a, b) in enumerate(((lp, rp), (lp, rh & ~rp), (lh & ~lp, rp), (lh & ~lp, rh & ~rp))):
                        if a[k].any():
                            counts[c, k] += np.bitwise_count(a[k] & b).sum(axis=1, dtype=np.int64)
        if at is not None:
            yield rows(*at, counts)

    parts = dealt.mapInArrow(run, "i long, j long, n11 long, n10 long, n01 long, n00 long")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n11", "n10", "n01", "n00")])


def _named_pairs(held: Outcomes, models: list[str], pairs: list[tuple[str, str]] | None) -> DataFrame:
    """(i, j, model_1, model_2, passed_1, total_1, passed_2, total_2) of ``pairs``, or of every pair in the models'
    order; i and j are the places of their bitmaps."""
    spark = held.bitmaps.sparkSession
    side = lambda k: spark.createDataFrame(
        [(p, held.models.index(m), m, held.totals[m]["passed"], held.totals[m]["total"]) for p, m in enumerate(models)],
        f"p{k} long, {'ij'[k - 1]} long, model_{k} string, passed_{k} long, total_{k} long")
    if pairs is None:
        last = F.lit(len(models) - 1).cast("long")
        places = spark.range(len(models) - 1).select(F.col("id").alias("p1"), F.explode(F.sequence(F.col("id") + 1, last)).alias("p2"))
    else:
        at = {m: p for p, m in enumerate(models)}
        places = spark.createDataFrame([(at[a], at[b]) for a, b in pairs], "p1 long, p2 long")
    return places.join(F.broadcast(side(1)), "p1").join(F.broadcast(side(2)), "p2").drop("p1", "p2")  # one row a model


def pair_statistics(results: DataFrame | Outcomes, models: list[str], pairs: list[tuple[str, str]] | None = None,
                    strict: bool = True) -> DataFrame:
    """Contingency, McNemar and odds ratio for each (model_1, model_2) of ``pairs``, or for every pair in order.

    With ``strict`` the models must have one result each for the same
    problems.  Without, pairs are counted over the problems both have, and
    each model's passed and total over all of its own.
    """
    if not (len(models) > 1 if pairs is None else pairs):
        raise ValueError("no model pairs to compare")
    held = results if isinstance(results, Outcomes) else outcomes(results, models)
    if strict:
        held.check(models)
    named = _named_pairs(held, models, pairs)
    blocks = named.select((F.col("i") / MODEL_BLOCK).cast("int").alias("left"), (F.col("j") / MODEL_BLOCK).cast("int").alias("right")).distinct()
    counted = named.join(_pair_counts(held.bitmaps, len(held.models), blocks), ["i", "j"], "left")
    zero = F.lit(0).cast("long")
    out = counted.select("model_1", "model_2", *[F.coalesce(c, zero).alias(c) for c in ("n11", "n10", "n01", "n00")],
                         "passed_1", "total_1", "passed_2", "total_2")
    out = with_mcnemar(out)
    out = out.withColumns({"failed_1": F.col("total_1") - F.col("passed_1"),
                           "failed_2": F.col("total_2") - F.col("passed_2")})
    return with_odds_ratio(out).drop("failed_1", "failed_2")


def compare_all_pairs(results: DataFrame | Outcomes, order: list[str], strict: bool = True) -> DataFrame:
    """Every unordered model pair (earlier model in ``order`` first)."""
    return pair_statistics(results, list(order), None, strict)


def compare_to_baseline(results: DataFrame | Outcomes, baseline: str, models: list[str], strict: bool = True) -> DataFrame:
    """Each model against one baseline.

    A model without results is reported (a warning) and left out; the
    baseline must be there.  The table is oriented (model, baseline); the
    odds ratio is the baseline's odds over the model's, as in the
    comparison it re-aims.
    """
    others = [m for m in models if m != baseline]
    held = results if isinstance(results, Outcomes) else outcomes(results, [baseline] + others)
    if strict and (absent := held.absent(others)):
        warnings.warn(f"no results for {', '.join(absent)}; not compared to {baseline}", stacklevel=2)
        others = [m for m in others if m not in absent]
    stats = pair_statistics(held, [baseline] + others, [(m, baseline) for m in others], strict)
    base_or = odds_ratio(F.col("passed_2"), F.col("total_2") - F.col("passed_2"),
                         F.col("passed_1"), F.col("total_1") - F.col("passed_1"))
    return stats.select(
        F.col("model_1").alias("model"), F.col("model_2").alias("baseline"),
        "n11", "n10", "n01", "n00", "statistic", "p_value",
        F.col("passed_1").alias("passed"), F.col("total_1").alias("total"),
        F.col("passed_2").alias("baseline_passed"), F.col("total_2").alias("baseline_total"),
        base_or.alias("odds_ratio"))


def evaluation_report(results: DataFrame, baseline: str, order: list[str]) -> dict[str, DataFrame]:
    """Pass rates, outcome counts, all pairs and the baseline comparison of the models that
    have results, and ``absent``, the models that have none."""
    held = outcomes(results, [baseline] + list(order))
    absent = held.absent(list(order))
    order = [m for m in order if m not in absent]
    results = results.where(F.col("model").isin(list(set(order) | {baseline})))
    return {
        "pass_rates": pass_rates(results),
        "outcomes": outcome_counts(results),
        "pairs": compare_all_pairs(held, order),
        "vs_baseline": compare_to_baseline(held, baseline, [baseline] + list(order)),
        "absent": results.sparkSession.createDataFrame([(m,) for m in absent], "model string"),
    }


def evaluation_summary(results: DataFrame, baseline: str, order: list[str]) -> DataFrame:
    """G15 as one table: per model rates and counts plus its baseline test."""
    rep = evaluation_report(results, baseline, order)
    vs = rep["vs_baseline"].select("model", "statistic", "p_value", "odds_ratio")
    return rep["pass_rates"].join(rep["outcomes"], "model").join(vs, "model", "left")
