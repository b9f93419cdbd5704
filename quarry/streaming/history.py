"""conversation history maintained from a stream of submitted turns.

Turn events (files of ``conv_id, turn, role, text``) are read with a
Structured Streaming file source and appended, as they are, to the history
table.  Each micro-batch is written to its own ``batch_id=<n>`` partition
with dynamic partition overwrite: a replayed batch rewrites only itself, so
the table is exactly-once with respect to the stream's checkpoint.
Positions are given on reading, by the batch operator (F2), so they do not
depend on the order of arrival, and no conversation's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.conversations import DISPLAY_ROLES, history_rows

TURN_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])
TURN_COLUMNS = TURN_SCHEMA.fieldNames()


def _append_batch(table_path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id")
         .parquet(table_path))
    return write


def history_updates(events: DataFrame) -> DataFrame:
    """Streaming ``conv_id, turn, role, text`` of the messages the history is made of.

    Blank inputs are kept here: reading needs them to leave out their replies.
    """
    return events.where(F.col("role").isin(DISPLAY_ROLES)).select(*TURN_COLUMNS)


def stream_history(spark: SparkSession, source_dir: str, table_path: str, checkpoint: str,
                   files_per_batch: int = 1, fmt: str = "parquet",
                   available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``.

    ``available_now`` processes everything present, then stops (for batch
    schedulers); otherwise it runs continuously.  ``checkpoint`` and
    ``table_path`` must be in a folder every executor and the driver share.
    """
    events = (spark.readStream.schema(TURN_SCHEMA).format(fmt)
              .option("maxFilesPerTrigger", files_per_batch).load(source_dir))
    writer = (history_updates(events).writeStream.foreachBatch(_append_batch(table_path))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def read_history(spark: SparkSession, table_path: str) -> DataFrame:
    """The stored history in F2 long form, whatever order the turns arrived in."""
    return history_rows(spark.read.parquet(table_path).select(*TURN_COLUMNS))
