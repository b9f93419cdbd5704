"""Test inputs derived from the driver tables, in Spark and in DuckDB SQL.

The reference ships no data, so code-shaped inputs are derived from the
driver's tables with integer and string arithmetic both engines evaluate
identically.  Every fixture is a projection of a whole table (or a
per-row transform of it), so its size grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.plans.registry import load

# ---------------------------------------------------------------- functions
# fx_functions: one function record per document.


def fx_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    d, text = F.col("doc_id"), F.col("text")
    first_line = F.element_at(F.split(text, "\n", -1), 1)
    doc = (F.when(d % 5 == 0, F.lit(""))
           .when(d % 5 == 1, F.lit("12 34"))
           .otherwise(F.concat(F.lit("  "), first_line, F.lit("\n"))))
    name = F.when(d % 4 == 0, F.concat(F.lit("bench_"), (d % 60).cast("string"))) \
        .otherwise(F.concat(F.lit("fn_"), d.cast("string")))
    header = F.concat(F.lit("function "), name,
                      F.when(d % 3 == 0, F.lit(" (x, y)")).otherwise(F.lit("(x, y)")))
    return docs.select(
        d.alias("id"),
        doc.alias("doc_string"),
        header.alias("function_header"),
        F.concat(F.lit("\t"), text, F.lit("\n")).alias("function_body"),
        (d % 7 == 0).alias("has_internal_comments"),
        (d % 11 == 0).alias("has_constraints"),
    )


FX_FUNCTIONS_SQL = """fx_functions AS (
  SELECT doc_id AS id,
    CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN '12 34'
         ELSE '  ' || string_split(text, chr(10))[1] || chr(10) END AS doc_string,
    'function ' || CASE WHEN doc_id % 4 = 0 THEN 'bench_' || CAST(doc_id % 60 AS VARCHAR)
                        ELSE 'fn_' || CAST(doc_id AS VARCHAR) END
      || CASE WHEN doc_id % 3 = 0 THEN ' (x, y)' ELSE '(x, y)' END AS function_header,
    chr(9) || text || chr(10) AS function_body,
    doc_id % 7 = 0 AS has_internal_comments,
    doc_id % 11 = 0 AS has_constraints
  FROM documents)"""


# ------------------------------------------------------------------ prompts
# fx_prompts: one benchmark prompt per benchmark item; the header is the
# second-last line.


def fx_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = load(spark, sf_dir, "benchmark")
    prompt = F.concat(F.lit('"""'), F.col("text"), F.lit('"""\nfunction bench_'),
                      F.col("item_id").cast("string"), F.lit("(x, y)\n"))
    return bench.select(F.col("item_id").alias("id"), prompt.alias("prompt"))


FX_PROMPTS_SQL = """fx_prompts AS (
  SELECT item_id AS id,
    '\"\"\"' || text || '\"\"\"' || chr(10) || 'function bench_' || CAST(item_id AS VARCHAR)
      || '(x, y)' || chr(10) AS prompt
  FROM benchmark)"""


# --------------------------------------------------------------------- code
# fx_code: each document's lines replaced by code-like lines chosen from the
# line's position and length; used by completion repair.

# The code lines a document line is replaced by, chosen by
# (doc_id*31 + pos*17 + length(line)) % len(lines).
CODE_LINES = ["if x", "for i in xs", "  while ok", "end", "  end", "y = 1", "format(z)"]
CODE_LINES_WITH_FUNCTION = ["if x", "function g(a)", "  while ok", "end", "  end", "y = 1",
                            "format(z)"]
CODE_LINES_FORMAT = ["if x", "function g(a)", "  while ok", "end", "  else", "y = a+b",
                     "if a; b; end", "  ", "format(z)"]


def _code_line(choice, lines) -> F.Column:
    expr = F.lit(lines[-1])
    for k in range(len(lines) - 2, -1, -1):
        expr = F.when(choice == k, F.lit(lines[k])).otherwise(expr)
    return expr


def code_column(lines: list[str] = CODE_LINES) -> F.Column:
    """The code text of a ``documents`` row (per-row transform: no explode, no shuffle)."""
    n = len(lines)
    return F.array_join(F.transform(
        F.split(F.col("text"), "\n", -1),
        lambda l, i: _code_line((F.col("doc_id") * 31 + i * 17 + F.length(l)) % n, lines)),
        "\n")


def fx_code(spark: SparkSession, sf_dir: str, lines: list[str] = CODE_LINES) -> DataFrame:
    """One code text per document."""
    return load(spark, sf_dir, "documents").select(F.col("doc_id"), code_column(lines).alias("code"))


def fx_code_sql(lines: list[str] = CODE_LINES, name: str = "fx_code") -> str:
    """CTEs ``{name}_lines(doc_id, pos, line)`` and ``{name}(doc_id, code)``."""
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(lines[:-1]))
    return f"""{name}_lines AS (
  SELECT doc_id, pos, CASE (doc_id * 31 + pos * 17 + length(line)) % {len(lines)} {cases}
                      ELSE '{lines[-1]}' END AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos
        FROM documents)),
{name} AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS code FROM {name}_lines GROUP BY doc_id)"""


# ------------------------------------------------------------------ results
# fx_results: per-problem outcomes of four models, from the labels table.

MODELS = [  # fixed values: (model, a, b, t); passed = (doc_id*a + quality*b + toxic*3) % 10 < t
    ("m135", 7, 3, 4),
    ("m360", 3, 5, 5),
    ("m17b", 9, 2, 6),
    ("copilot", 1, 4, 7),
]
MODEL_ORDER = ["copilot", "m135", "m360", "m17b"]
SAMPLES_PER_PROBLEM = 5


def _with_models(labels: DataFrame) -> DataFrame:
    """One row per (label, model): a generator over the fixed model list (one scan)."""
    params = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(a).alias("a"), F.lit(b).alias("b"),
                                F.lit(t).alias("t")) for m, a, b, t in MODELS])
    return labels.select("*", F.inline(params))


def fx_results(spark: SparkSession, sf_dir: str, keep_labels: bool = False) -> DataFrame:
    labels = load(spark, sf_dir, "labels")
    rows = _with_models(labels)
    passed = (F.col("doc_id") * F.col("a") + F.col("quality") * F.col("b")
              + F.col("toxic") * 3) % 10 < F.col("t")
    extra = ["quality", "toxic"] if keep_labels else []
    return rows.select("model", F.col("doc_id").alias("problem"), passed.alias("passed"), *extra)


def _models_values_sql() -> str:
    return ", ".join(f"('{m}', {a}, {b}, {t})" for m, a, b, t in MODELS)


FX_RESULTS_SQL = f"""fx_models AS (SELECT * FROM (VALUES {_models_values_sql()}) AS v(model, a, b, t)),
fx_results AS (
  SELECT m.model, l.doc_id AS problem, (l.doc_id * m.a + l.quality * m.b + l.toxic * 3) % 10 < m.t AS passed
  FROM labels l, fx_models m)"""


def fx_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to five samples per (model, problem) for pass@k (some problems have fewer than k)."""
    labels = load(spark, sf_dir, "labels")
    rows = _with_models(labels).withColumn(
        "sample", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % SAMPLES_PER_PROBLEM)))
    passed = (F.col("doc_id") * F.col("a") + F.col("sample") * F.col("b")) % 10 < F.col("t")
    return rows.select("model", F.col("doc_id").alias("problem"), "sample", passed.alias("passed"))


FX_SAMPLES_SQL = f"""fx_models AS (SELECT * FROM (VALUES {_models_values_sql()}) AS v(model, a, b, t)),
fx_samples AS (
  SELECT m.model, l.doc_id AS problem, s.sample, (l.doc_id * m.a + s.sample * m.b) % 10 < m.t AS passed
  FROM labels l, fx_models m, (SELECT range AS sample FROM range({SAMPLES_PER_PROBLEM})) s
  WHERE s.sample <= l.doc_id % {SAMPLES_PER_PROBLEM})"""


def fx_results_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_results where model m17b misses the problems whose label is toxic."""
    res = fx_results(spark, sf_dir, keep_labels=True)
    return res.where(~((F.col("model") == "m17b") & (F.col("toxic") == 1))) \
        .select("model", "problem", "passed")


FX_RESULTS_GAPS_SQL = FX_RESULTS_SQL + """,
fx_results_gaps AS (
  SELECT r.model, r.problem, r.passed FROM fx_results r JOIN labels l ON r.problem = l.doc_id
  WHERE NOT (r.model = 'm17b' AND l.toxic = 1))"""


# ------------------------------------------------------------------ sources
# fx_source_files: Julia files of consecutive documents of a source, whole texts inside.  Documents
# of GROUP_DOCS ids are dealt into files by their bytes, so that every file is below the limit of A4
# (1 MiB): a file ends behind the piece that reaches FILE_BYTES, and a piece of PIECE_CHARS
# characters has less than 480,000 bytes even if each is a line of its own.

GROUP_DOCS = 500
FILE_BYTES = 400_000
PIECE_CHARS = 60_000


def source_lines(d: F.Column, piece: F.Column, n_chars: F.Column, text: F.Column) -> list[F.Column]:
    """The lines a piece of a document adds to its file (null = absent): one function, with the whole
    text as a string literal (odd ids) or as comment lines (even ids)."""
    as_string = F.translate(text, "\n\"\\", " '/")
    as_comments = F.concat(F.lit("    # "), F.replace(F.translate(text, '"', "'"), F.lit("\n"), F.lit("\n    # ")))
    inner, mapped, returned = d % 6 == 0, d % 4 == 1, d % 4 == 2
    name = F.concat(d.cast("string"), F.when(piece > 0, F.concat(F.lit("_"), piece.cast("string"))).otherwise(F.lit("")))
    return [
        (F.when(d % 4 == 0, F.concat(F.lit("# about "), d.cast("string")))
         .when(d % 4 == 1, F.concat(F.lit('"doc '), d.cast("string"), F.lit('"')))
         .when(d % 4 == 2, F.concat(F.lit("@doc "), d.cast("string")))),
        F.concat(F.lit("function fn_"), name,
                 F.when(d % 2 == 0, F.lit(" (x, y)")).otherwise(F.lit("(x, y)"))),
        F.when(d % 3 == 0, F.lit("    # note")),
        F.when(d % 5 == 0, F.lit("    @constraint(m, x)")),
        F.when(d % 2 == 1, F.concat(F.lit('    s = "'), as_string, F.lit('"'))),
        F.when(d % 2 == 0, as_comments),
        F.lit("    if x"),
        F.concat(F.lit("        y = "), n_chars.cast("string")),
        F.lit("    end"),
        F.when(inner, F.concat(F.lit("    function inner_"), name, F.lit("(z)"))),
        F.when(inner, F.lit("    end")),
        F.when(mapped, F.lit("    g = map(function (z)")),
        F.when(mapped, F.lit("        z + 1")),
        F.when(mapped, F.lit("    end, xs)")),
        F.when(returned, F.lit("    return function (w)")),
        F.when(returned, F.lit("        w[end]")),
        F.when(returned, F.lit("    end")),
        F.lit("end"),
    ]


def fx_source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / PIECE_CHARS).cast("int") - 1, F.lit(0)))
    pieces = docs.select("doc_id", "source", "n_chars", "text", F.explode(starts).alias("piece"))
    text = F.substring(F.col("text"), F.col("piece") * PIECE_CHARS + 1, F.lit(PIECE_CHARS))
    lines = F.array_join(F.array(*source_lines(F.col("doc_id"), F.col("piece"), F.col("n_chars"), text)), "\n")
    group = (F.col("doc_id") / GROUP_DOCS).cast("long")
    weight = F.octet_length(text) + 7 * (F.regexp_count(text, F.lit("\n")) + 1)
    before = Window.partitionBy("source", "part").orderBy("doc_id", "piece").rowsBetween(Window.unboundedPreceding, -1)
    dealt = pieces.select("source", "doc_id", "piece", group.alias("part"), weight.cast("long").alias("weight"), lines.alias("lines")) \
        .withColumn("file", F.floor(F.coalesce(F.sum("weight").over(before), F.lit(0)) / FILE_BYTES))
    files = dealt.groupBy("source", "part", "file").agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "piece", "lines"))).alias("docs"))
    return files.select(
        F.col("source").alias("repo"),
        F.concat(F.lit("repo_"), F.col("source"), F.lit("/part_"), F.col("part").cast("string"), F.lit("_"),
                 F.col("file").cast("string"), F.lit(".jl")).alias("path"),
        F.array_join(F.col("docs.lines"), "\n").alias("text"))
