"""Elements of list columns replaced by what a table says of them (token ids, tokens)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import scratch_path, ship_package

LOOKUP_MAX_BYTES = 64 << 20   # of a table that every worker holds; larger ones are joined
BLOCK_ROWS = 500              # rows that meet their part of a larger table together
ROWS_AT_ONCE = 64             # rows of a batch that are looked up and answered together


def map_elements(df: DataFrame, column: str, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """``df`` with each element of the list ``column`` replaced by the ``value`` of its ``key`` in ``table``
    (unique keys), or by ``default``; null lists become empty.

    A table of up to LOOKUP_MAX_BYTES is held by the workers, and the lookup is map-only.  A larger
    one is joined: rows form blocks, a block asks once for each of its distinct elements, so that
    an element which is everywhere is one row a block, and the answers meet the block again.
    Either way a batch looks up its distinct elements, not each element.
    """
    ship_package(df.sparkSession)
    given = df.schema[column].dataType.elementType
    kind = table.schema[value].dataType
    lists = F.coalesce(F.col(column), F.array().cast(T.ArrayType(given)))
    rest = [c for c in df.columns if c != column]
    rows = df.select(*rest, lists.alias(column))
    schema = T.StructType([*df.select(*rest).schema.fields, T.StructField(column, T.ArrayType(kind))])
    pairs = table.select(F.col(key).cast(given).alias("key"), F.col(value).alias("value"))
    size = sum(F.octet_length(F.col(c).cast("string")) + F.lit(32) for c in ("key", "value"))
    if (pairs.agg(F.sum(size)).first()[0] or 0) <= LOOKUP_MAX_BYTES:
        out = _held(rows, column, pairs, default, schema)
    else:
        out = _joined(rows, column, pairs, default, schema)
    return out.select(*df.columns)


def _replaced(lists: pa.ListArray, get: Callable, default, kind: pa.DataType) -> pa.ListArray:
    coded = lists.flatten().dictionary_encode()
    values = pa.array([get(k, default) for k in coded.dictionary.to_pylist()], kind)
    offsets = lists.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), values.take(coded.indices).fill_null(default))


def _held(rows: DataFrame, column: str, pairs: DataFrame, default, schema: T.StructType) -> DataFrame:
    """Map-only.  A batch (bounded by Spark in bytes) is looked up and answered a few rows at a time."""
    table = pairs.toArrow()  # at most LOOKUP_MAX_BYTES
    kind = table.schema.field("value").type
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = dict(zip(sent.value.column(0).to_pylist(), sent.value.column(1).to_pylist())).get
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _replaced(part.columns[-1], get, default, kind)], part.schema.names)

    return rows.mapInArrow(run, schema)


def _joined(rows: DataFrame, column: str, pairs: DataFrame, default, schema: T.StructType) -> DataFrame:
    spark = rows.sparkSession
    place = F.monotonically_increasing_id()
    blocked = rows.select(F.floor(place / BLOCK_ROWS).alias("__block"), *rows.columns)
    target = scratch_path(spark, "lookup-rows")
    blocked.write.parquet(target)  # the blocks must not change between their two uses
    blocked = spark.read.schema(blocked.schema).parquet(target)
    asked = blocked.select(F.col("__block").alias("__of"), F.explode(F.array_distinct(column)).alias("key")).distinct()
    answers = asked.join(pairs, "key").select("__of", "key", "value")

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        get = dict(zip(found.column("key").to_pylist(), found.column("value").to_pylist())).get
        lists = own.column(own.num_columns - 1).combine_chunks()
        replaced = _replaced(lists, get, default, found.schema.field("value").type)
        return pa.table([*own.columns[1:-1], replaced], names=own.schema.names[1:])

    return blocked.groupBy("__block").cogroup(answers.groupBy("__of")).applyInArrow(run, schema)
