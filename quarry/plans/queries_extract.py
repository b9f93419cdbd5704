"""Registered queries: function extraction.

The source files are derived from ``documents`` (one directory per source,
whole texts inside as string literals or comment lines).  The
expected functions follow from the ids, so the oracle computes them
directly, without reading any code.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import extract as ex
from quarry.plans.fixtures import FILE_BYTES, GROUP_DOCS, PIECE_CHARS, fx_source_files
from quarry.functions.text import PY_WHITESPACE
from quarry.plans.registry import register, sql_chars, written_once

_WS_SQL = sql_chars(PY_WHITESPACE)


def _body_sql(keep_comments: bool, keep_constraints: bool) -> str:
    items = []
    if keep_comments:
        items.append("CASE WHEN doc_id % 3 = 0 THEN '    # note' END")
    if keep_constraints:
        items.append("CASE WHEN doc_id % 5 = 0 THEN '    @constraint(m, x)' END")
    items.append("CASE WHEN doc_id % 2 = 1 THEN '    s = \"' || translate(text, chr(10) || '\"' || chr(92), ' ''/') || '\"' END")
    if keep_comments:
        items.append("CASE WHEN doc_id % 2 = 0 THEN '    # ' || replace(translate(text, '\"', ''''), chr(10), chr(10) || '    # ') END")
    items += ["'    if x'", "'        y = ' || CAST(n_chars AS VARCHAR)", "'    end'"]
    items += [f"CASE WHEN doc_id % 6 = 0 THEN {x} END" for x in
              ("'    function inner_' || name || '(z)'", "'    end'")]
    items += [f"CASE WHEN doc_id % 4 = 1 THEN '{x}' END" for x in ("    g = map(function (z)", "        z + 1", "    end, xs)")]
    items += [f"CASE WHEN doc_id % 4 = 2 THEN '{x}' END" for x in ("    return function (w)", "        w[end]", "    end")]
    return ("array_to_string(list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL), chr(10))")


def expected_functions_sql(keep_comments: bool = True, keep_constraints: bool = True) -> str:
    inner = """SELECT source AS repo, path, CAST({line} AS INTEGER) AS line, CAST({line} + {more} AS INTEGER) AS end_line, 1 AS level,
       '' AS doc_string, {header} AS function_header, '{body}' AS function_body,
       false AS has_internal_comments, false AS has_constraints
FROM base WHERE {when}"""
    return f"""
WITH pieces AS (
  SELECT doc_id, source, n_chars, piece, substr(text, CAST(piece * {PIECE_CHARS} + 1 AS BIGINT), {PIECE_CHARS}) AS text, doc_id // {GROUP_DOCS} AS part,
         CAST(doc_id AS VARCHAR) || CASE WHEN piece > 0 THEN '_' || CAST(piece AS VARCHAR) ELSE '' END AS name
  FROM (SELECT *, unnest(range(CAST(greatest(ceil(length(text) / {PIECE_CHARS}), 1) AS BIGINT))) AS piece FROM documents)),
counted AS (
  SELECT *, length(text) - length(replace(text, chr(10), '')) + 1 AS text_lines,
         CASE WHEN doc_id % 4 = 3 THEN 0 ELSE 1 END AS doc_line FROM pieces),
sizes AS (
  SELECT *, (doc_id % 3 = 0)::INT + (doc_id % 5 = 0)::INT + CASE WHEN doc_id % 2 = 0 THEN text_lines ELSE 1 END + 3 AS plain,
         2 * (doc_id % 6 = 0)::INT AS inner_lines, 3 * (doc_id % 4 = 1)::INT AS mapped_lines, 3 * (doc_id % 4 = 2)::INT AS returned_lines,
         CAST(coalesce(sum(strlen(text) + 7 * text_lines) OVER (
           PARTITION BY source, part ORDER BY doc_id, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {FILE_BYTES} AS file
  FROM counted),
base AS (
  SELECT *, 'repo_' || source || '/part_' || CAST(part AS VARCHAR) || '_' || CAST(file AS VARCHAR) || '.jl' AS path,
         plain + inner_lines + mapped_lines + returned_lines AS n_body,
         coalesce(sum(doc_line + 2 + plain + inner_lines + mapped_lines + returned_lines) OVER (
           PARTITION BY source, part, file ORDER BY doc_id, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + doc_line + 1 AS hdr
  FROM sizes)
SELECT source AS repo, path, CAST(hdr AS INTEGER) AS line, CAST(hdr + n_body + 1 AS INTEGER) AS end_line, 0 AS level,
       CASE doc_id % 4 WHEN 0 THEN '# about ' || CAST(doc_id AS VARCHAR)
                       WHEN 1 THEN '"doc ' || CAST(doc_id AS VARCHAR) || '"'
                       WHEN 2 THEN '@doc ' || CAST(doc_id AS VARCHAR) ELSE '' END AS doc_string,
       'function fn_' || name || '(x, y)' AS function_header,
       {_body_sql(keep_comments, keep_constraints)} AS function_body,
       doc_id % 3 = 0 OR doc_id % 2 = 0 AS has_internal_comments, doc_id % 5 = 0 AS has_constraints
FROM base
UNION ALL {inner.format(line="hdr + plain + 1", more=1, header="'function inner_' || name || '(z)'", body="", when="inner_lines > 0")}
UNION ALL {inner.format(line="hdr + plain + inner_lines + 1", more=2, header="'function (z)'", body="        z + 1", when="mapped_lines > 0")}
UNION ALL {inner.format(line="hdr + plain + inner_lines + mapped_lines + 1", more=2, header="'function (w)'", body="        w[end]", when="returned_lines > 0")}"""


@register("b1_extract_functions", expected_functions_sql())
def b1_extract_functions(spark, sf_dir):
    return ex.extract_functions(fx_source_files(spark, sf_dir))


@register("b2_attach_docs", f"""
SELECT path, function_header, doc_string FROM ({expected_functions_sql()}) WHERE level = 0""")
def b2_attach_docs(spark, sf_dir):
    out = ex.extract_functions(fx_source_files(spark, sf_dir))
    return out.where(F.col("level") == 0).select("path", "function_header", "doc_string")


@register("b3_function_header", f"""
SELECT path, line, function_header FROM ({expected_functions_sql()})""")
def b3_function_header(spark, sf_dir):
    return ex.extract_functions(fx_source_files(spark, sf_dir)).select("path", "line", "function_header")


@register("b4_strip_line_comments", expected_functions_sql(keep_comments=False))
def b4_strip_line_comments(spark, sf_dir):
    return ex.extract_functions(fx_source_files(spark, sf_dir), keep_comments=False)


@register("b5_strip_constraint_macros", expected_functions_sql(keep_constraints=False))
def b5_strip_constraint_macros(spark, sf_dir):
    return ex.extract_functions(fx_source_files(spark, sf_dir), keep_constraints=False)


@register("b6_assemble_body", expected_functions_sql(False, False))
def b6_assemble_body(spark, sf_dir):
    return ex.extract_functions(fx_source_files(spark, sf_dir), keep_comments=False,
                                keep_constraints=False)


@register("b7_extract_corpus", f"""
SELECT doc_string, function_header, function_body, has_internal_comments, has_constraints, repo
FROM ({expected_functions_sql(False, False)})""")
def b7_extract_corpus(spark, sf_dir):
    out = ex.extract_corpus(fx_source_files(spark, sf_dir), keep_comments=False,
                            keep_constraints=False)
    return out.select(*ex.FUNCTION_RECORD, "repo")


def _tree_and_list(spark, sf_dir):
    return written_once(spark, sf_dir, "source-tree", lambda: _write_tree_and_list(spark, sf_dir))


def _write_tree_and_list(spark, sf_dir):
    """Write the source files as a tree and the repository list as page files."""
    from quarry.session import scratch_path
    from quarry.sources.writers import write_file_tree
    base = scratch_path(spark, "source-tree").replace("file:", "", 1)
    files = fx_source_files(spark, sf_dir)
    write_file_tree(files.select("path", F.col("text").cast("binary").alias("content")), base + "/tree")
    listed = (files.select(F.concat(F.lit("repo/"), F.col("repo")).alias("name")).distinct()
              .where(F.substring_index("name", "src", -1).cast("int") % 4 != 3))
    page_no = (F.substring_index("name", "src", -1).cast("long") / 100).cast("long")
    pages = listed.groupBy(page_no.alias("page")).agg(
        F.to_json(F.struct(F.collect_list(F.struct("name")).alias("items"))).alias("j"))
    write_file_tree(pages.select(F.concat(F.lit("repos_"), F.col("page").cast("string"), F.lit(".json")).alias("path"),
                                 F.encode("j", "UTF-8").alias("content")), base + "/list")
    return base + "/tree", base + "/list"


@register("b1_extract_split_files", f"""
SELECT 'repo_' || repo AS repo_dir, path, line, end_line, level, doc_string, function_header, function_body,
       has_internal_comments, has_constraints
FROM ({expected_functions_sql()})""")
def b1_extract_split_files(spark, sf_dir):
    """The files of the tree, each in chunks of 64 KiB that are extracted apart."""
    from quarry.operators.extract_split import extract_large_files
    from quarry.sources.listing import file_manifest
    tree = _tree_and_list(spark, sf_dir)[0]
    return extract_large_files(spark, tree, file_manifest(spark, tree), chunk_bytes=1 << 16)


def _tree_functions(spark, sf_dir):
    """The functions of the tree's listed repositories, without one deny-listed repository."""
    from quarry.operators.repos import EXCLUDED_REPOS
    tree, lst = _tree_and_list(spark, sf_dir)
    deny = spark.createDataFrame([(n,) for n in EXCLUDED_REPOS + ["repo/src5"]], "name string")
    return ex.extract_corpus_from_tree(spark, tree, lst, deny, keep_comments=False, keep_constraints=False)


@register("b7_extract_corpus_tree", f"""
SELECT 'repo_' || repo AS repo_dir, path, line, end_line, level, doc_string, function_header, function_body,
       has_internal_comments, has_constraints
FROM ({expected_functions_sql(False, False)})
WHERE CAST(split_part(repo, 'src', 2) AS INTEGER) % 4 <> 3 AND repo <> 'src5'""")
def b7_extract_corpus_tree(spark, sf_dir):
    """Repository list pages of at most 100 names; one deny-listed repository."""
    return _tree_functions(spark, sf_dir)


@register("b7_refresh_extraction", f"""
SELECT 'repo_' || repo AS repo_dir, path, line, end_line, level, doc_string, function_header, function_body,
       has_internal_comments, has_constraints
FROM ({expected_functions_sql()})
WHERE CAST(split_part(repo, 'src', 2) AS INTEGER) % 4 <> 3""")
def b7_refresh_extraction(spark, sf_dir):
    """A store brought up to the tree in two steps: half of the listed repositories, then all."""
    from quarry.operators import refresh as rf
    from quarry.session import scratch_path
    from quarry.sources.readers import repo_list
    tree, lst = _tree_and_list(spark, sf_dir)
    store = scratch_path(spark, "function-store")
    listed = repo_list(spark, lst)
    rf.refresh(spark, tree, store, listed.where(F.substring_index("name", "src", -1).cast("int") % 2 == 0))
    rf.refresh(spark, tree, store, listed)
    return rf.read_functions(spark, store)


@register("c8_preprocess_extracted_tree", f"""
WITH f AS (SELECT * FROM ({expected_functions_sql(False, False)})
           WHERE CAST(split_part(repo, 'src', 2) AS INTEGER) % 4 <> 3 AND repo <> 'src5'
           AND function_header NOT IN (SELECT 'function fn_' || item_id || '(x, y)' FROM benchmark))
SELECT path, line,
       trim(doc_string, {_WS_SQL}) AS doc_string, trim(replace(function_header, ' (', '('), {_WS_SQL}) AS function_header,
       trim(CASE WHEN doc_string = '' AND NOT has_internal_comments AND NOT has_constraints THEN ''
                 ELSE function_body END, {_WS_SQL}) AS function_body,
       has_internal_comments, has_constraints
FROM f""")
def c8_preprocess_extracted_tree(spark, sf_dir):
    """The corpus build in one plan: repo list -> files -> text -> functions -> cleaned
    records (C8 against the benchmark prompts) -> JSON Lines -> read back."""
    from quarry.operators.preprocess import preprocess
    from quarry.plans.fixtures import fx_prompts
    from quarry.session import scratch_path
    from quarry.sources.readers import FUNCTION_RECORD
    from quarry.sources.writers import write_function_records
    from pyspark.sql import types as T
    functions = _tree_functions(spark, sf_dir)
    # benchmark functions of the tree's names, so that some of its functions leak
    prompts = fx_prompts(spark, sf_dir).withColumn("prompt", F.replace("prompt", F.lit("function bench_"), F.lit("function fn_")))
    cleaned = preprocess(functions.select("path", "line", *ex.FUNCTION_RECORD), prompts)
    out = scratch_path(spark, "cleaned-records")
    write_function_records(cleaned, out)
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("line", T.IntegerType())]
                          + FUNCTION_RECORD.fields)
    return spark.read.schema(schema).json(out)
