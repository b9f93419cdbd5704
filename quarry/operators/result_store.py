"""Evaluation results kept up to date (G5-G10): additive counts with retractions.

The store holds, for every batch, what it adds to the samples and passes of (file, model, problem).
A result file that comes again replaces what it said before, a withdrawn one takes it back: the
batch then holds the difference, which needs the counts of that file and no result file.  Rates,
pass@k and contingency cells follow from the sums.  A batch is one folder, replaced as a whole
when it is applied again, so a repeated run changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.stats import pass_at_k

KEY = ["file", "model", "problem"]


def _deltas(spark: SparkSession, store: str, problem_type: str, before: int | None = None) -> DataFrame:
    """The differences of all batches, or of those ``before`` one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    schema = f"file string, model string, problem {problem_type}, n bigint, c bigint, batch bigint"
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(store)
    return rows if before is None else rows.filter(F.col("batch") < before)


def apply_batch(results: DataFrame, store: str, batch: int, withdrawn: DataFrame | None = None) -> None:
    """Add the rows (file, model, problem, passed) of new or corrected files, and take back ``withdrawn`` files (file).

    Batches are applied in ascending order; the last one may be applied again.
    """
    spark = results.sparkSession
    kind = results.schema["problem"].dataType.simpleString()
    new = results.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if("passed").alias("c"))
    files = results.select("file").distinct()
    if withdrawn is not None:
        files = files.unionByName(withdrawn.select("file")).distinct()
    known = _deltas(spark, store, kind, batch).join(files, "file", "left_semi")
    back = known.select(*KEY, (-F.col("n")).alias("n"), (-F.col("c")).alias("c"))
    change = new.unionByName(back).groupBy(*KEY).agg(F.sum("n").alias("n"), F.sum("c").alias("c")).filter("n <> 0 or c <> 0")
    # read before the folder is replaced: what is read are other batches' folders
    change.write.mode("overwrite").parquet(f"{store.rstrip('/')}/batch={batch}")


def counts(spark: SparkSession, store: str, problem_type: str = "bigint") -> DataFrame:
    """``model, problem, n, c``: samples and passes of what is in force."""
    return _deltas(spark, store, problem_type).groupBy("model", "problem") \
        .agg(F.sum("n").alias("n"), F.sum("c").alias("c")).filter("n > 0")


def pass_at_k_of_counts(held: DataFrame, k: int) -> DataFrame:
    """G5 from counts."""
    return held.withColumn("score", pass_at_k("n", "c", k)).groupBy("model").agg(
        F.avg("score").alias(f"pass_at_{k}"), F.count("*").alias("problems"), F.count("score").alias("scored"))


def pass_rates_of_counts(held: DataFrame) -> DataFrame:
    """G6 from counts."""
    rates = held.groupBy("model").agg(F.sum("c").alias("passed"), F.sum("n").alias("total"))
    return rates.withColumn("percent", F.round(F.col("passed") * 100.0 / F.col("total"), 2))


def outcome_counts_of_counts(held: DataFrame) -> DataFrame:
    """G7 from counts."""
    return pass_rates_of_counts(held).select("model", F.col("passed").alias("correct"), (F.col("total") - F.col("passed")).alias("incorrect"))


def results_of_counts(held: DataFrame) -> DataFrame:
    """``model, problem, passed`` for the paired tests (G9-G14): a row a sample, so what comes twice is seen as such."""
    return held.select("model", "problem", F.explode(F.concat(
        F.array_repeat(F.lit(True), F.col("c").cast("int")), F.array_repeat(F.lit(False), (F.col("n") - F.col("c")).cast("int")))).alias("passed"))
