"""Global row numbering without a single-partition window.

``with_global_index`` sorts with range partitioning (many tasks), tags each
row with its partition and in-partition position, then adds the row
counts of all earlier partitions.  The offset table has one row per
partition, so its broadcast is bounded by the partition count, not by
the data.  The tagged rows are checkpointed to the shared checkpoint
folder so a lost executor cannot renumber them between the two passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.walk import let
from quarry.session import checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | row-in-partition


def with_global_index(df: DataFrame, order_by: list[Column | str], name: str = "idx",
                      checkpoint: bool = True) -> DataFrame:
    """Add a 0-based ``name`` column that numbers rows in ``order_by`` order.

    ``order_by`` should end with a unique column: ties are then split by
    the range partitioner too, so one hot key cannot land in one task.
    """
    ordered = df.orderBy(*order_by).withColumn("_mid", F.monotonically_increasing_id())
    if checkpoint:
        checkpoint_dir(df.sparkSession)
        ordered = ordered.checkpoint(eager=True)
    tagged = ordered.select(
        "*",
        F.shiftright("_mid", _LOCAL_BITS).alias("_part"),
        F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)).alias("_local"))
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    out = tagged.join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_offset") + F.col("_local")) \
        .drop("_part", "_local", "_offset", "_mid")


_ROUNDS = 4
_MAX_WALKS = 64


def permuted(index: Column, n: Column, seed: int, epoch: Column) -> Column:
    """The place of row ``index`` (0 .. n-1) in a pseudo-random order of n rows, another for each seed and epoch.

    A Feistel network over pairs of 0 .. ceil(sqrt(n))-1 is a bijection of a square that is hardly
    larger than n; a value beyond n is sent through again until it is inside (cycle walking).
    No sort and no table: any row tells its place by itself.  Up to n = 961 no walk can be longer
    than the steps taken here; above, fewer than 7 in 100 values are outside, each time anew.
    """
    side = F.ceil(F.sqrt(n.cast("double"))).cast("long")

    def through(x: Column, at: Column) -> Column:
        left, right = F.floor(x / at["side"]).cast("long"), x % at["side"]
        for k in range(_ROUNDS):
            text = F.concat_ws(":", F.lit(str(seed)), at["epoch"].cast("string"), F.lit(str(k)), right.cast("string"))
            mixed = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
            left, right = right, (left + mixed) % at["side"]
        return left * at["side"] + right

    def walk(at: Column) -> Column:
        steps = F.sequence(F.lit(1), F.least(F.lit(_MAX_WALKS), 2 * at["side"] + 2).cast("int"))
        once = lambda x: let(x, lambda y: through(y, at))
        last = F.aggregate(steps, once(at["index"]), lambda x, _: F.when(x < at["n"], x).otherwise(once(x)))
        return let(last, lambda x: F.when(x < at["n"], x).otherwise(F.raise_error(F.lit("the walk left the rows")).cast("long")))

    return let(F.struct(index.cast("long").alias("index"), n.cast("long").alias("n"), side.alias("side"), epoch.alias("epoch")), walk)
