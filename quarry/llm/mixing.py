"""Mixing sources to target weights.

Every document gets a hash-random key.  Within its source the documents are
range-sorted by that key, distributed prefix sums of the word counts give each
one its interval on the source's axis, and the interval is cut at the source's
exact budget.  A budget above the source's size takes whole epochs first.

* Sizes are counted once and written as a narrow table; text is not shuffled.
* The range sort splits a source that holds any share of all rows over many
  partitions; running sums are taken inside one (partition, source) slice and
  shifted by the slice's offset, so no source meets in one task.
* Only the per-source totals are ordered in one place (one row a source).

Defined results: null text has size 0; documents of size 0 take 0; a null
source is a source of its own, ranked last; rows that repeat are separate rows;
an empty table gives an empty result.  Columns other than the three named are ignored.
``text_hash`` (64 bits) tells rows of one id with different texts apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, WORD, materialise

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(no_source, source_key, source_size, target) per source: weighted shares of the whole size.

    A target stops at ``max_epochs`` times its source; what is above is shared among the rest by
    weight until nothing is.  That end state has one water level: target = min(cap, weight * level).
    Sources in order of cap / weight are capped up to the first whose ratio reaches the level that
    the others would then need.
    """
    totals = sized.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("no_source", "source_key"))
    choice = F.array(*[F.lit(float(w)) for w in weights])
    by_source = totals.withColumn("weight", F.element_at(choice, ((rank - 1) % len(weights) + 1).cast("int")))
    by_source = by_source.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")) \
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "no_source", "source_key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    total = F.sum("source_size").over(everything).cast("double")
    leveled = by_source.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                                   / F.sum("weight").over(after))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return leveled.withColumn("water", level).select(
        "no_source", "source_key", "source_size",
        F.least(F.col("cap"), F.col("weight") * F.coalesce(F.col("water"), F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Decide how many words the mix takes of every document.

    Returns ``id_col``, size, source_size, target, taken and text_hash; the takes of a source add up to its
    target rounded down.  The order is a function of the id and the seed alone, so reruns agree.
    """
    key = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 16)
    sized = materialise(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).isNull().cast("int").alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_key"),
        word_count(F.col(text_col)).alias("size"), key.alias("key"), F.xxhash64(text_col).alias("text_hash")), "mix-sizes")
    order = ["no_source", "source_key", "key", "id", "size"]
    # the partition number is written with the rows: both uses below must see the same one
    sliced = materialise(sized.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "mix-slices")
    slice_key = ["slice", "no_source", "source_key"]
    earlier = Window.partitionBy("no_source", "source_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(*slice_key).agg(F.sum("size").alias("slice_size")) \
        .withColumn("offset", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0))) \
        .join(source_targets(sized, weights, max_epochs), ["no_source", "source_key"]).drop("slice_size")
    upto = Window.partitionBy(*slice_key).orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sliced.withColumn("upto", F.sum("size").over(upto)).join(offsets, slice_key)
    start = F.col("offset") + F.col("upto") - F.col("size")
    budget = F.floor("target").cast("long")
    # a source of size 0 has target 0: divide by 1 then
    epoch = F.greatest(F.col("source_size"), F.lit(1))
    whole, rest = F.floor(budget / epoch).cast("long"), budget % epoch
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target",
                         (whole * F.col("size") + cut).cast("long").alias("taken"), "text_hash")


def repeat_taken(docs: DataFrame, decisions: DataFrame, *, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The mixed corpus: ``docs`` (no two rows of the same id and text) with each document as often
    as it was taken.

    Whole epochs repeat the row; a part of a document keeps its first words, joined by single
    blanks.  Documents of which nothing was taken do not appear.
    """
    took = decisions.filter("taken > 0").select(F.col(id_col).alias("__mix_id"), F.col("text_hash").alias("__mix_hash"),
                                                F.col("size").alias("__mix_size"), F.col("taken").alias("__mix_taken"))
    same = docs[id_col].eqNullSafe(took["__mix_id"]) & (F.xxhash64(docs[text_col]) == took["__mix_hash"])
    rows = docs.join(took, same).withColumn(
        "__mix_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("__mix_taken") / F.col("__mix_size")).cast("int"))))
    part = F.col("__mix_taken") - (F.col("__mix_copy") - 1) * F.col("__mix_size")
    words = F.array_remove(F.split(F.col(text_col), SPACE), "")
    cut = F.concat_ws(" ", F.slice(words, F.lit(1), part.cast("int")))
    text = F.when(part < F.col("__mix_size"), cut).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text).select(*docs.columns)
