"""Readers: repository lists, source-file trees, JSON Lines, JSON arrays, gzip JSON.

Every reader takes an explicit schema (no inference pass, no type guessing).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import col_
from quarry.sources.listing import file_manifest, reachable, read_contents

REPO_LIST = T.StructType([T.StructField("items", T.ArrayType(T.StructType([
    T.StructField("name", T.StringType())])))])

FUNCTION_RECORD = T.StructType([
    T.StructField("doc_string", T.StringType()),
    T.StructField("function_header", T.StringType()),
    T.StructField("function_body", T.StringType()),
    T.StructField("has_internal_comments", T.BooleanType()),
    T.StructField("has_constraints", T.BooleanType()),
])

RESULT_ROW = T.StructType([
    T.StructField("problem", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("passed", T.BooleanType()),
])

RESULT_DOC = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("tests", T.StringType()),
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("program", T.StringType()),
        T.StructField("status", T.StringType())]))),
])

# The size limit of corpus files (strictly smaller) and their suffix.
FILE_SIZE_LIMIT = 1024 * 1024
SOURCE_SUFFIX = ".jl"


def repo_list(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A1: one row per repository of a repository-list object ({"items": [{"name"}]}).

    ``path`` may be one file or a folder of page files; each file is one
    JSON object, so pages are parsed in parallel.
    """
    raw = spark.read.schema(REPO_LIST).option("multiLine", multi_line).json(path)
    return raw.select(F.explode("items").alias("item")).select(F.col("item.name").alias("name"))


def repo_dir_name(name) -> Column:
    """Directory a repository is cloned into: "owner/name" -> "owner_name"."""
    return F.replace(col_(name), F.lit("/"), F.lit("_"))


def _root_uri(root: str) -> str:
    root = root.rstrip("/")
    return root if ":" in root.split("/")[0] else "file:" + root


def corpus_files(spark: SparkSession, root: str, repos: DataFrame | None = None,
                 suffix: str = SOURCE_SUFFIX, limit: int | None = FILE_SIZE_LIMIT,
                 with_content: bool = True) -> DataFrame:
    """A4: source files below ``root`` by suffix, strictly smaller than ``limit`` (None: any size).

    Output: ``repo_dir``, ``path`` (relative to root), ``length`` and
    ``content`` (bytes).  Tasks list the folders (``sources/listing.py``); with
    ``repos`` (column ``name``) only those of listed repositories.  Large files
    are left out of the manifest, so they are never read.  Like every Spark file
    source, names starting with ``.`` or ``_`` are skipped.

    A root that tasks cannot open themselves is listed and read by Spark's
    binary-file source, and the repositories are a semi join.
    """
    folders = None if repos is None else repos.select(repo_dir_name("name"))
    if reachable(root):
        manifest = file_manifest(spark, root, folders, suffix, limit).drop("modified")
        return read_contents(manifest, root) if with_content else manifest
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*" + suffix).option("recursiveFileLookup", "true").load(root)
    if limit is not None:  # pushed into the listing
        files = files.where(F.col("length") < limit)
    rel = relative_path(F.col("path"), root)
    cols = [F.substring_index(rel, "/", 1).alias("repo_dir"), rel.alias("path"), F.col("length")]
    files = files.select(*cols, *([F.col("content")] if with_content else []))
    return files if folders is None else files.join(folders.toDF("repo_dir").distinct(), "repo_dir", "left_semi")


def decode_text(content) -> Column:
    """A5: UTF-8, else ISO-8859-1 for the whole file; universal newlines."""
    raw = col_(content)
    text = F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")) \
        .otherwise(F.decode(raw, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def read_source_texts(spark: SparkSession, root: str, repos: DataFrame | None = None,
                      suffix: str = SOURCE_SUFFIX, limit: int | None = FILE_SIZE_LIMIT) -> DataFrame:
    """A4 + A5: ``repo_dir, path, text`` of every corpus file."""
    files = corpus_files(spark, root, repos, suffix, limit)
    return files.select("repo_dir", "path", decode_text("content").alias("text"))


def read_function_records(spark: SparkSession, path: str, more: list[T.StructField] = ()) -> DataFrame:
    """JSON Lines of function records, explicit schema; ``more`` fields come first."""
    return spark.read.schema(T.StructType([*more, *FUNCTION_RECORD.fields])).json(path)


def read_results_array(spark: SparkSession, path: str) -> DataFrame:
    """Result rows stored as JSON arrays (one or many files)."""
    return spark.read.schema(RESULT_ROW).option("multiLine", True).json(path)


def read_result_docs(spark: SparkSession, root: str, with_file: bool = True) -> DataFrame:
    """Every ``*.results.json.gz`` below ``root``, one document per file.

    Gzip is detected from the extension; each file is parsed by one task.
    """
    docs = (spark.read.schema(RESULT_DOC)
            .option("multiLine", True)
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.results.json.gz")
            .json(root))
    if with_file:
        docs = docs.withColumn("file_name", F.col("_metadata.file_name"))
    return docs


def read_completion_docs(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Completion documents: every ``*.gz`` below ``root`` whose name lacks ``.results``."""
    docs = (spark.read.schema(schema)
            .option("multiLine", True)
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.gz")
            .json(root)
            .withColumn("file_name", F.col("_metadata.file_name"))
            .withColumn("rel_path", relative_path(F.col("_metadata.file_path"), root)))
    return docs.where(~F.col("file_name").contains(".results"))


def read_completion_texts(spark: SparkSession, root: str) -> DataFrame:
    """``rel_path, document``: the whole JSON text of every completion document (see above)."""
    docs = (spark.read.option("wholetext", True).option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.gz").text(root)
            .select(relative_path(F.col("_metadata.file_path"), root).alias("rel_path"),
                    F.col("_metadata.file_name").alias("name"), F.col("value").alias("document")))
    return docs.where(~F.col("name").contains(".results")).drop("name")


def relative_path(path, root: str) -> Column:
    """A file path relative to ``root`` (the path itself when outside it)."""
    prefix = _root_uri(root) + "/"
    # Spark writes local paths as file:/x; accept the file:///x spelling too
    prefixes = [prefix] + ([prefix.replace("file:/", "file:///", 1)]
                           if prefix.startswith("file:/") and not prefix.startswith("file://") else [])
    p = col_(path)
    out = p
    for pre in reversed(prefixes):
        out = F.when(p.startswith(pre), F.substring(p, len(pre) + 1, 1 << 30)).otherwise(out)
    return out


PROMPT = T.StructType([T.StructField("name", T.StringType()), T.StructField("prompt", T.StringType())])

# Fixed value: per-model result files are named "<model>_results_<language>.json".
RESULT_FILE_PATTERN = r"^(.*)_results_[A-Za-z0-9]+\.json$"


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark prompts (JSON Lines with a ``prompt`` field; ``name`` when present)."""
    return spark.read.schema(PROMPT).json(path)


def read_model_results(spark: SparkSession, path: str) -> DataFrame:
    """A8 for per-model files: ``<model>_results_<lang>.json`` JSON arrays -> rows with ``model``.

    Each file is one JSON array (parsed by one task); many files are read
    in parallel.
    """
    rows = (spark.read.schema(RESULT_ROW).option("multiLine", True)
            .option("recursiveFileLookup", "true").option("pathGlobFilter", "*_results_*.json")
            .json(path))
    return rows.withColumn("model", F.regexp_extract(F.col("_metadata.file_name"), RESULT_FILE_PATTERN, 1))


def list_checkpoints(spark: SparkSession, models_root: str) -> DataFrame:
    """D11 input: ``model, path`` of every ``checkpoint-N`` folder below ``models_root``.

    Uses the binary-file listing without reading file contents; the model
    is the folder directly below ``models_root``.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(models_root).select("path"))
    rel = relative_path(F.col("path"), models_root)
    ckpt = F.regexp_extract(rel, r"^(.*?checkpoint-\d+)/", 1)
    return (files.select(F.substring_index(rel, "/", 1).alias("model"), ckpt.alias("path"))
            .where(F.col("path") != "").distinct())
