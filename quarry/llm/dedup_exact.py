"""Exact dedup of incoming batches against immutable snapshots.

A snapshot is a written, never changed table of text digests (SHA-256 of the
text with A-Z lower-cased), grouped by digest and divided into buckets by
digest prefix, with one static binary-fuse filter a bucket.  A batch is
grouped by digest on its own; its distinct digests pass the filters of their
buckets, and only positives join the snapshot's exact bucket, where the bytes
of one text of either side are compared.

* Text is read where it lies: digests, not texts, are shuffled.  The byte check
  reads the texts of matched representatives only (two a group).
* A group of copies of any size is pre-aggregated map-side to one row a task;
  the join of rows to their group is a plain equi-join that AQE splits when skewed.
* Buckets are digest prefixes, so they are even; their number follows the snapshot's row count.

Defined results: null text equals empty text; rows with equal ids and equal
texts are separate rows of which one stays; a null id is the smallest; empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import fuse
from quarry.llm.common import ascii_lower, materialise

BUCKET_KEYS = 200_000  # digests a bucket (and a filter) holds on average


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        found = [hashlib.sha256((t.as_py() or b"").lower()).digest() for t in texts]  # bytes.lower: A-Z only
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "digest"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, row): written, so that ``row`` names the same row wherever it is used."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, digest binary"
    return materialise(rows.mapInArrow(_digest_batches, schema)
                       .withColumn("row", F.monotonically_increasing_id()), "dedup-digests")


def _grouped(rows: DataFrame) -> DataFrame:
    """One row a digest: its size and its row with the largest id (then row number)."""
    return rows.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("last"), F.count("*").alias("n"))


def _bucket(digest: Column, buckets: int) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long") % buckets


@dataclass
class Snapshot:
    """An immutable set of grouped digests and the filters of its buckets."""

    groups: DataFrame   # digest, last(id, row), n, bucket
    filters: DataFrame  # bucket, filter
    buckets: int


def build_snapshot(rows: DataFrame) -> Snapshot:
    buckets = max(1, -(-rows.count() // BUCKET_KEYS))
    groups = materialise(_grouped(rows).withColumn("bucket", _bucket(F.col("digest"), buckets)), "dedup-snapshot")

    def build(t: pa.Table) -> pa.Table:
        blob = fuse.build(_keys(t.column("digest"))).tobytes()
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "filter": pa.array([blob], pa.binary())})

    filters = groups.select("bucket", "digest").groupBy("bucket").applyInArrow(build, "bucket long, filter binary")
    return Snapshot(groups, materialise(filters, "dedup-filters"), buckets)


def _keys(column) -> np.ndarray:
    """64-bit filter keys from the digests' second to ninth byte groups (the first 4 chose the bucket)."""
    joined = b"".join(d.as_py()[8:16] for d in column)
    return np.frombuffer(joined, dtype="<u8")


def screen(new: DataFrame, snapshot: Snapshot) -> DataFrame:
    """``new`` (digest, last, n) with ``maybe``: false where the filter rules the snapshot out."""
    schema = "digest binary, maybe boolean"

    def ask(new_rows: pa.Table, filter_rows: pa.Table) -> pa.Table:
        keys = _keys(new_rows.column("digest"))
        hit = np.zeros(len(keys), dtype=bool)
        if filter_rows.num_rows:
            hit = fuse.contains(fuse.Filter.frombytes(filter_rows.column("filter")[0].as_py()), keys)
        return pa.table({"digest": new_rows.column("digest"), "maybe": pa.array(hit)})

    keyed = new.select("digest", _bucket(F.col("digest"), snapshot.buckets).alias("bucket"))
    asked = keyed.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInArrow(ask, schema)
    return new.join(asked, "digest")


def _byte_checked(matched: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digests of ``matched`` (digest, new_id, old_id) whose two texts are equal byte by byte."""
    ids = matched.select("digest", F.explode(F.array("new_id", "old_id")).alias("_id")).distinct()
    texts = docs.select(F.col(id_col).alias("_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    # a repeated id can have several texts: the digest picks the one that was matched
    both = ids.join(texts, ids["_id"].eqNullSafe(texts["_id"])).filter(F.unhex(F.sha2(F.encode("_text", "UTF-8"), 256)) == F.col("digest"))
    same = both.groupBy("digest").agg((F.min("_text") == F.max("_text")).alias("same"))
    return same.filter(F.when(F.col("same"), F.lit(True)).otherwise(
        F.raise_error(F.lit("two texts of one SHA-256 digest differ")).cast("boolean"))).select("digest")


def dedup_batch(rows: DataFrame, snapshot: Snapshot, docs: DataFrame, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Groups over the batch ``rows`` and the snapshot: digest, last(id, row), n.

    ``docs`` holds the texts of both.  Snapshot groups that the batch does not touch are included.
    """
    new = materialise(screen(_grouped(rows), snapshot), "dedup-new")
    old = snapshot.groups.select("digest", F.col("last").alias("old_last"), F.col("n").alias("old_n"))
    matched = new.filter("maybe").join(old, "digest")
    equal = _byte_checked(matched.select("digest", F.col("last.id").alias("new_id"), F.col("old_last.id").alias("old_id")),
                          docs, id_col, text_col)
    pairs = materialise(matched.join(equal, "digest", "left_semi"), "dedup-matched")
    met = pairs.select("digest", F.greatest("last", "old_last").alias("last"), (F.col("n") + F.col("old_n")).alias("n"))
    only_new = new.join(pairs, "digest", "left_anti").select("digest", "last", "n")
    only_old = snapshot.groups.join(pairs, "digest", "left_anti").select("digest", "last", "n")
    return met.unionByName(only_new).unionByName(only_old)


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents: those up to the middle of the id range are the snapshot, later ones the batch.

    Returns ``id_col``, keep_id, group_size, kept and text_sha256, one row for every row of ``docs``.
    """
    rows = digests(docs, id_col, text_col)
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    middle = 0 if low is None else low + (high - low) // 2
    old = F.coalesce(F.col("id") <= middle, F.lit(True))
    snapshot = build_snapshot(rows.filter(old))
    groups = dedup_batch(rows.filter(~old), snapshot, docs, id_col, text_col)
    return rows.join(groups, "digest").select(
        F.col("id").alias(id_col), F.col("last.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("last.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without copies: of equal texts the row with the largest id stays."""
    stay = exact_dedup(docs, id_col=id_col, text_col=text_col).filter("kept").select(
        F.col(id_col).alias("__copy_id"), F.col("text_sha256").alias("__copy_digest"))
    own = F.sha2(F.encode(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), "UTF-8"), 256)
    # the digest tells texts of one id apart; rows equal in both are one
    joined = docs.join(stay, docs[id_col].eqNullSafe(stay["__copy_id"])).filter(own == F.col("__copy_digest"))
    return joined.dropDuplicates(["__copy_id", "__copy_digest"]).select(*docs.columns)
