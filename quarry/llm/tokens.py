"""BPE encoding and decoding of whole texts (method in ``bpe.py``).

Map-only: texts stream through Arrow batches, every worker keeps a bounded memory of encoded
pre-tokens.  The vocabulary file reaches the workers with ``addFile``.

Defined results: null text encodes as empty text (no ids); null ids decode to empty text; texts of
any length are encoded whole; rows that repeat are encoded alike; extra columns pass through.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from quarry.llm import bpe

SLICE = 500  # documents encoded together inside a batch


def ship_vocabulary(spark: SparkSession, path: str) -> str:
    """Send the vocabulary file to the workers; returns the name to load it by."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _run(df: DataFrame, make, columns: list[tuple[str, object]]) -> DataFrame:
    """``df`` with ``columns`` (name, Spark type), which ``make`` gives as Arrow arrays of a slice."""
    names = [n for n, _ in columns]
    df = df.select(*[c for c in df.columns if c not in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part)], [*part.schema.names, *names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *[StructField(n, t) for n, t in columns]]))


def encode(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids",
           decoded_col: str | None = None) -> DataFrame:
    """``docs`` with ``ids_col``: the token ids, packed as little-endian unsigned 32-bit integers.

    With ``decoded_col`` also what the ids decode to (a round trip in one pass).
    """
    name = ship_vocabulary(docs.sparkSession, path)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        model = bpe.loaded(name)
        ids = model.encode([t or "" for t in part.column(text_col).to_pylist()])
        return [pa.array(ids, pa.binary()), *([pa.array(map(model.decode, ids), pa.string())] if decoded_col else [])]

    return _run(docs, make, [(ids_col, BinaryType()), *([(decoded_col, StringType())] if decoded_col else [])])


def decode(rows: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with ``text_col``: the text of the packed ids, special tokens included."""
    name = ship_vocabulary(rows.sparkSession, path)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        model = bpe.loaded(name)
        return [pa.array([model.decode(b or b"") for b in part.column(ids_col).to_pylist()], pa.string())]

    return _run(rows, make, [(text_col, StringType())])
