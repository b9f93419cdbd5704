"""A sink that writes one file a row and publishes them on commit.

A task attempt writes below a folder of its own, ``_attempts/<run>/<attempt>``; names starting with
``_`` are no part of a tree.  When every task has succeeded, the commit moves the files of the
attempts that count to their places and removes the run's folder, also what failed or speculative
attempts left in it.  A job that fails publishes nothing and removes the folder, as far as tasks
that are being stopped do not write into it still.
"""

from __future__ import annotations

import gzip
import json
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quarry.session import ship_package
from quarry.sources.listing import open_root

MARKER = "_COMMITTED"
MOVES = 16  # files that are moved at once


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


class FileTreeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root, self.run, self.compress = options["root"], options["run"], options.get("compress")

    def _run_folder(self, base: str) -> str:
        return f"{base}/_attempts/{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        fs, base = open_root(self.root)
        folder, n = f"{self._run_folder(base)}/{uuid.uuid4().hex}", 0
        for batch in iterator:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                full = f"{folder}/{path}"
                fs.create_dir(full.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(full, compression=None) as stream:
                    stream.write(gzip.compress(content, mtime=0) if self.compress == "gzip" else content)
                n += 1
        return Attempt(folder, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        fs, base = open_root(self.root)

        def publish(source: pafs.FileInfo, folder: str) -> None:
            target = f"{base}/{source.path[len(folder) + 1:]}"
            fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
            fs.move(source.path, target)

        done = [m for m in messages if m is not None]
        with ThreadPoolExecutor(MOVES) as pool:
            for m in done:  # the names of one task's files at a time
                found = fs.get_file_info(pafs.FileSelector(m.folder, recursive=True, allow_not_found=True))
                list(pool.map(lambda f, folder=m.folder: publish(f, folder), [f for f in found if f.type == pafs.FileType.File]))
        self._clear(fs, base)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{MARKER}") as stream:
            stream.write(json.dumps({"run": self.run, "files": sum(m.files for m in done)}).encode())

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear(*open_root(self.root))

    def _clear(self, fs: pafs.FileSystem, base: str) -> None:
        for wait in (0.2, 0.5, 1.0, 0):
            try:
                if fs.get_file_info(self._run_folder(base)).type == pafs.FileType.Directory:
                    fs.delete_dir(self._run_folder(base))
                return
            except OSError:  # an attempt that is being stopped still writes
                time.sleep(wait)


class FileTreeSink(DataSource):
    """``df.write.format("quarry_file_tree")`` with the options root and run; columns path and content."""

    @classmethod
    def name(cls) -> str:
        return "quarry_file_tree"

    def writer(self, schema, overwrite: bool) -> FileTreeWriter:
        return FileTreeWriter(self.options)


def write_files(df: DataFrame, root: str, compress: str | None = None) -> int:
    """Write ``df`` (path, content) below ``root``; the number of files."""
    spark = df.sparkSession
    ship_package(spark)
    spark.dataSource.register(FileTreeSink)
    run = uuid.uuid4().hex
    options = {"root": root, "run": run} | ({"compress": compress} if compress else {})
    df.write.format(FileTreeSink.name()).mode("append").options(**options).save()
    fs, base = open_root(root)
    with fs.open_input_stream(f"{base}/{MARKER}") as stream:
        return json.loads(stream.read())["files"]
