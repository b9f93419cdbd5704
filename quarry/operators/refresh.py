"""Extraction kept up to date: only new and changed files are read.

A store folder has one manifest a version (path, length, modified, digest, batch) and the functions
of each batch.  ``batch`` is the version that extracted a file.  A refresh lists the tree, keeps
what has the same length and time, reads the rest, and extracts what has another digest.  A
version counts once its manifest is complete (Spark's committer marks it), so a refresh that
fails, or runs beside a reader, changes nothing that is read: rows of a file are replaced, and
rows of a deleted file go, in one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.extract import extract_functions
from quarry.session import scratch_path
from quarry.sources.listing import file_manifest, read_contents
from quarry.sources.readers import FILE_SIZE_LIMIT, SOURCE_SUFFIX, decode_text, repo_dir_name

MANIFEST = "repo_dir string, path string, length bigint, modified timestamp, digest string, batch bigint"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, store: str) -> list[int]:
    """The complete versions of a store, in order."""
    fs, where = _fs(spark, f"{store}/manifest")
    if not fs.exists(where):
        return []
    found = [f.getPath() for f in fs.listStatus(where)]
    return sorted(int(p.getName().split("=")[1]) for p in found
                  if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def manifest(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The files of a version (default: the last one)."""
    known = versions(spark, store)
    if not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifest/version={known[-1] if version is None else version}")


def refresh(spark: SparkSession, root: str, store: str, repos: DataFrame | None = None, suffix: str = SOURCE_SUFFIX,
            limit: int | None = FILE_SIZE_LIMIT, keep_comments: bool = True, keep_constraints: bool = True) -> dict[str, int]:
    """Bring the functions in ``store`` up to the tree below ``root``; how many files were kept, read, extracted and gone.

    ``repos`` (column ``name``) restricts the tree as in A4: files of repositories that are no longer
    listed go.  One refresh of a store at a time.
    """
    known = versions(spark, store)
    version = known[-1] + 1 if known else 0
    old = manifest(spark, store)
    listed = file_manifest(spark, root, None if repos is None else repos.select(repo_dir_name("name")), suffix, limit)
    before = old.select("path", F.col("length").alias("_length"), F.col("modified").alias("_modified"), "digest", "batch")
    paired = _written(listed.join(before, "path", "left"), "refresh-listed")
    same = F.coalesce((F.col("length") == F.col("_length")) & (F.col("modified") == F.col("_modified")), F.lit(False))
    kept = paired.filter(same).select(*old.columns)
    touched = paired.filter(~same).select("repo_dir", "path", "length", "modified", "digest", "batch")
    n_read = touched.count()
    current, n_extracted = kept, 0
    if n_read:
        read = read_contents(touched, root).withColumn("now", F.sha2("content", 256))
        changed = ~F.col("now").eqNullSafe(F.col("digest"))
        texts = _written(read.select("repo_dir", "path", "length", "modified", F.col("now").alias("digest"),
                                     F.when(changed, F.lit(version)).otherwise(F.col("batch")).cast("bigint").alias("batch"),
                                     F.when(changed, decode_text("content")).alias("text")), "refresh-read")
        new = texts.filter(F.col("batch") == version)
        n_extracted = new.count()
        if n_extracted:
            functions = extract_functions(new.select("repo_dir", "path", "text"), "text", keep_comments, keep_constraints)
            functions.write.mode("overwrite").parquet(f"{store}/functions/batch={version}")
        current = kept.unionByName(texts.select(*old.columns))
    gone = old.join(listed, "path", "left_anti").count()
    if not known or n_read or gone:
        current.write.mode("overwrite").parquet(f"{store}/manifest/version={version}")
    return {"kept": kept.count(), "read": n_read, "extracted": n_extracted, "gone": gone}


def read_functions(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The functions of a version's files (default: the last one), in the columns of ``extract_functions``."""
    files = manifest(spark, store, version).select("path", "batch")
    fs, where = _fs(spark, f"{store}/functions")
    if not fs.exists(where):
        empty = spark.createDataFrame([], "repo_dir string, path string, text string")
        return extract_functions(empty)
    return spark.read.parquet(f"{store}/functions").join(files, ["path", "batch"], "left_semi") \
        .select("repo_dir", "path", "line", "end_line", "level", "doc_string", "function_header", "function_body",
                "has_internal_comments", "has_constraints")


def _written(df: DataFrame, name: str) -> DataFrame:
    target = scratch_path(df.sparkSession, name)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)
