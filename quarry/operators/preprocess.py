"""Cleaning and decontamination of function records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import function_name, has_ascii_letter, py_strip
from quarry.operators.joins import broadcast_if_small

TEXT_COLUMNS = ["doc_string", "function_header", "function_body"]


def require_docs(df: DataFrame) -> DataFrame:
    """Keep rows whose doc string contains an ASCII letter (null docs drop)."""
    return df.filter(has_ascii_letter("doc_string"))


def normalize_header(df: DataFrame) -> DataFrame:
    """Every " (" in the header becomes "("."""
    return df.withColumn("function_header",
                         F.replace(F.col("function_header"), F.lit(" ("), F.lit("(")))


def blank_undocumented_body(df: DataFrame) -> DataFrame:
    """Empty the body of functions with no doc, no comments, no constraints."""
    undocumented = ((F.col("doc_string") == "")
                    & (F.col("has_internal_comments") == F.lit(False))
                    & (F.col("has_constraints") == F.lit(False)))
    return df.withColumn("function_body",
                         F.when(undocumented, F.lit("")).otherwise(F.col("function_body")))


def prompt_function_names(prompts: DataFrame, prompt_col: str = "prompt") -> DataFrame:
    """C4: benchmark function name = name rule on the prompt's second-last line.

    Prompts with a single line give a null name, which matches nothing.
    """
    header_line = F.try_element_at(F.split(F.col(prompt_col), "\n", -1), F.lit(-2))
    return prompts.withColumn("function_name", function_name(header_line))


def header_function_name(df: DataFrame, out: str = "function_name") -> DataFrame:
    """The same name rule applied to the function header."""
    return df.withColumn(out, function_name(F.col("function_header")))


def decontaminate(df: DataFrame, names: DataFrame, name_col: str = "function_name") -> DataFrame:
    """Drop functions whose name equals a benchmark function name.

    One anti join on the name; the distinct name list is broadcast when
    its size is proven small, else the join shuffles (AQE splits skew).
    """
    keys = (names.select(F.col(name_col).alias("_bench_name"))
            .where(F.col("_bench_name").isNotNull()).distinct())
    tagged = df.withColumn("_fn_name", function_name(F.col("function_header")))
    kept = tagged.join(broadcast_if_small(keys), F.col("_fn_name") == F.col("_bench_name"),
                       "left_anti")
    return kept.drop("_fn_name")


def strip_text(df: DataFrame, cols=TEXT_COLUMNS) -> DataFrame:
    """Python ``str.strip`` on the text columns."""
    return df.withColumns({c: py_strip(c) for c in cols})


def preprocess(df: DataFrame, prompts: DataFrame, remove_no_docs: bool = False) -> DataFrame:
    """C1 (optional), C2, C3, C6, C7 in that order."""
    if remove_no_docs:
        df = require_docs(df)
    df = blank_undocumented_body(normalize_header(df))
    df = decontaminate(df, prompt_function_names(prompts))
    return strip_text(df)


def baseline_normalize(df: DataFrame) -> DataFrame:
    """Doc stripped and lower-cased; header and body stripped; nulls stay null."""
    return df.withColumns({
        "doc_string": F.lower(py_strip("doc_string")),
        "function_header": py_strip("function_header"),
        "function_body": py_strip("function_body"),
    })


def select_corpus(kind: str, raw: DataFrame, prompts: DataFrame | None = None,
                  remove_no_docs: bool = False) -> DataFrame:
    """The cleaned corpus ("cleaned") or the baseline corpus ("baseline")."""
    if kind == "baseline":
        return baseline_normalize(raw)
    if kind == "cleaned":
        if prompts is None:
            raise ValueError("the cleaned corpus needs the benchmark prompts")
        return preprocess(raw, prompts, remove_no_docs=remove_no_docs)
    raise ValueError(f"unknown corpus kind: {kind!r} (expected 'cleaned' or 'baseline')")
