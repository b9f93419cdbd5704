"""Writers: JSON Lines, ordered results, gzip JSON, CSV and file trees."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import code
from quarry.session import ship_package
from quarry.sources.file_sink import write_files
from quarry.sources.readers import read_completion_texts


def write_function_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines sink (one part file per task)."""
    df.write.mode(mode).json(path)


def write_results(df: DataFrame, path: str, order_col: str = "rank", as_array: bool = False,
                  mode: str = "overwrite") -> None:
    """A10: export result rows in ``order_col`` order as JSON Lines.

    A range-partitioned sort writes part files in order, and rows in order
    within each file.  ``as_array`` writes JSON arrays instead, one per
    part file, so no single task holds all rows.
    """
    ordered = df.orderBy(order_col)
    if not as_array:
        ordered.write.mode(mode).json(path)
        return
    ship_package(df.sparkSession)
    rows = ordered.select(F.to_json(F.struct(*[c for c in df.columns])).alias("j"))

    def to_arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # line by line as batches come; the last row so far waits to know whether a comma follows
        waiting = None
        for batch in batches:
            lines = batch["j"].tolist()
            if not lines:
                continue
            out = ["[" if waiting is None else waiting + ",", *[x + "," for x in lines[:-1]]]
            waiting = lines[-1]
            yield pd.DataFrame({"value": out})
        yield pd.DataFrame({"value": ["[]"] if waiting is None else [waiting, "]"]})

    rows.mapInPandas(to_arrays, "value string").write.mode(mode).text(path)


# Text survives a CSV round trip unchanged: no trimming, "" stays an empty
# string, and null is written as \N.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "nullValue": "\\N",
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A12 sink: header row, fields quoted with ``"`` and quotes doubled."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read back CSV written by ``write_csv`` (fields may hold newlines)."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).option("multiLine", True).csv(path)


def jsonl_to_csv(spark: SparkSession, src: str, dst: str, schema: T.StructType) -> None:
    """JSON Lines to CSV with a header and no index column."""
    write_csv(spark.read.schema(schema).json(src), dst)


def write_file_tree(df: DataFrame, root: str, path_col: str = "path",
                    content_col: str = "content", compress: str | None = None) -> int:
    """Write one file per row (bytes of ``content_col`` to ``root/path``).

    Files appear when all tasks have succeeded (``sources/file_sink.py``):
    failed or speculative attempts leave none.  Returns the file count.
    ``root`` must be a folder every executor can reach: a shared mount or
    a URI pyarrow can open (``s3://``, ``hdfs://``, ``gs://``).
    """
    return write_files(df.select(F.col(path_col).alias("path"), F.col(content_col).cast("binary").alias("content")), root, compress)


def rewrite_completions(spark: SparkSession, in_dir: str, out_dir: str) -> DataFrame:
    """Repair completion 0 of every completion document (E6 + E7).

    Reads every ``*.gz`` below ``in_dir`` whose name lacks ``.results`` and
    writes gzip JSON to the same relative path below ``out_dir`` (never in
    place).  A document is kept as the object it is: only the elements of
    ``completions`` are replaced, all other fields, nested values, nulls
    and their order stay.  The repair runs in the JVM; Python only takes
    the document apart and puts it together again, one small file a row.
    """
    ship_package(spark)
    docs = read_completion_texts(spark, in_dir)

    def take_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [json.loads(t).get("completions") for t in pdf["document"]]
            yield pdf.assign(completions=[c if isinstance(c, list) else None for c in found])

    def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, completions in zip(pdf["document"], pdf["completions"]):
                doc = json.loads(text)
                if completions is not None:
                    doc["completions"] = list(completions)
                out.append(json.dumps(doc, ensure_ascii=False).encode())
            yield pd.DataFrame({"path": pdf["rel_path"], "content": out})

    parsed = docs.mapInPandas(take_apart, "rel_path string, document string, completions array<string>")
    fixed = parsed.withColumn("completions", code.close_first_completion("completions"))
    write_file_tree(fixed.mapInPandas(put_together, "path string, content binary"), out_dir, compress="gzip")
    return fixed.drop("document")
