"""File manifests made by tasks, and files read in shares of like size (A4).

Spark's own file sources list every path on the driver.  Here folders are rows: a task lists the
folders it was dealt and what lies below them, up to FOLDERS_PER_TASK, and hands the rest on to the
next round, where they are dealt anew.  The manifest is written to the shared scratch folder; the
driver only learns how many folders are left and how many bytes there are.

Tasks reach the files through pyarrow's file systems (local, HDFS, S3, GCS, Azure).
``reachable`` tells whether a root is in one of these.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path, ship_package

FOLDERS_PER_TASK = 500
SHARE_BYTES = 64 << 20    # of files that one task reads, about
BATCH_BYTES = 8 << 20     # of content in one Arrow batch, about (a file is never cut)

MANIFEST = "repo_dir string, path string, length bigint, modified timestamp"
_LISTED = "folder string, path string, length bigint, modified timestamp, open boolean"


def open_root(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``root`` and its path there; ValueError where pyarrow has none."""
    root = root.rstrip("/") or "/"
    if ":" not in root.split("/")[0]:
        return pafs.LocalFileSystem(), os.path.abspath(root)
    if root.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + root[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(root)


def reachable(root: str) -> bool:
    """Whether tasks can open ``root``."""
    try:
        open_root(root)
    except (ValueError, NotImplementedError, pa.ArrowInvalid, OSError):
        return False
    return True


def _listed_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("folder", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", tz="UTC")), ("open", pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def _round(folders: DataFrame, root: str, suffix: str, limit: int | None) -> DataFrame:
    """The files in and below ``folders`` (relative to ``root``), and the folders left open."""
    budget = FOLDERS_PER_TASK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_root(root)
        left = budget
        for batch in batches:
            waiting = deque(batch.column(0).to_pylist())
            while waiting and left > 0:
                folder, rows = waiting.popleft(), []
                left -= 1
                for found in fs.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True)):
                    name = found.base_name
                    if name.startswith((".", "_")):
                        continue
                    path = f"{folder}/{name}" if folder else name
                    if found.type == pafs.FileType.Directory:
                        waiting.append(path)
                    elif found.type == pafs.FileType.File and name.endswith(suffix) and (limit is None or found.size < limit):
                        rows.append((folder, path, found.size, found.mtime, False))
                if rows:
                    yield _listed_batch(rows)
            if waiting:
                yield _listed_batch([(f, None, None, None, True) for f in waiting])

    return folders.mapInArrow(run, _LISTED)


def file_manifest(spark: SparkSession, root: str, folders: DataFrame | None = None, suffix: str = "",
                  limit: int | None = None) -> DataFrame:
    """Written ``repo_dir, path, length, modified`` of the files below ``root`` by suffix, strictly smaller than ``limit``.

    ``folders`` (one string column, relative to ``root``) restricts the listing; what is absent is
    skipped.  Names starting with ``.`` or ``_`` are skipped, as by Spark's file sources.
    """
    ship_package(spark)
    target = scratch_path(spark, "file-manifest")
    tasks = spark.sparkContext.defaultParallelism
    waiting = spark.createDataFrame([("",)], "folder string") if folders is None else folders.toDF("folder").distinct()
    number, n = 0, 1 if folders is None else waiting.count()
    while n:
        dealt = waiting.repartition(max(tasks, -(-n // FOLDERS_PER_TASK)), "folder")
        _round(dealt, root, suffix, limit).write.parquet(f"{target}/round={number}")
        waiting = spark.read.schema(_LISTED).parquet(f"{target}/round={number}").filter("open").select("folder")
        number, n = number + 1, waiting.count()
    if not number:
        return spark.createDataFrame([], MANIFEST)
    files = spark.read.schema(_LISTED).parquet(*[f"{target}/round={i}" for i in range(number)]).filter("not open")
    return files.select(F.substring_index("path", "/", 1).alias("repo_dir"), "path", "length", "modified")


def in_shares(manifest: DataFrame, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """``manifest`` dealt by path so that a task has about ``share_bytes`` to read."""
    total = manifest.agg(F.sum("length")).first()[0] or 0
    return manifest.repartition(max(1, -(-total // share_bytes)), "path")


def read_contents(manifest: DataFrame, root: str, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """``manifest`` with the bytes of every file as ``content``."""
    from pyspark.sql import types as T
    ship_package(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_root(root)
        for batch in batches:
            at, held, contents = 0, 0, []
            for i, path in enumerate(batch.column("path").to_pylist()):
                with fs.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    contents.append(stream.read())
                held += len(contents[-1])
                if held >= BATCH_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(at, len(contents))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], [*part.schema.names, "content"])
                    at, held, contents = i + 1, 0, []

    schema = T.StructType([*manifest.schema.fields, T.StructField("content", T.BinaryType())])
    return in_shares(manifest, share_bytes).mapInArrow(run, schema)
