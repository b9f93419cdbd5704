"""Repository work lists and input checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.joins import broadcast_if_small
from quarry.sources.readers import repo_dir_name

# Repositories excluded from the corpus.
EXCLUDED_REPOS = [
    "Mehrnoom/Cryptocurrency-Pump-Dump",
    "analytech-solutions/C.jl",
    "terasakisatoshi/MyWorkflow.jl",
    "udohjeremiah/REPLference.jl",
    "JuliaIO/HDF5.jl",
    "vnegi10/CryptoDashApp.jl",
    "m3g/Packmol.jl",
    "JakobAsslaender/MRIgeneralizedBloch.jl",
    "greimel/distributional-macroeconomics",
    "jmboehm/RegressionTables.jl",
    "analytech-solutions/CBinding.jl",
    "ordovician/code-samples-julia-second-language",
    "JuliaSIMD/StrideArraysCore.jl",
]


def pending_repos(repos: DataFrame, present_dirs: DataFrame, dir_col: str = "repo_dir") -> DataFrame:
    """A2: repositories whose clone directory ("owner_name") is not present yet."""
    keyed = repos.withColumn("_dir", repo_dir_name("name"))
    present = present_dirs.select(F.col(dir_col).alias("_dir")).distinct()
    return keyed.join(present, "_dir", "left_anti").drop("_dir")


def denylist(spark: SparkSession, names: list[str] = EXCLUDED_REPOS) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "name string")


def exclude_repos(repos: DataFrame, deny: DataFrame | None = None) -> DataFrame:
    """A3: drop deny-listed repositories (the list is a table, so it can grow)."""
    deny = deny if deny is not None else denylist(repos.sparkSession)
    return repos.join(broadcast_if_small(deny.select("name")), "name", "left_anti")


def missing_inputs(expected: DataFrame, present: DataFrame, key: str = "model") -> DataFrame:
    """Expected keys with no input (``expected left_anti present``)."""
    return expected.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


class MissingInputs(FileNotFoundError):
    """Some expected inputs are absent; ``table`` holds all of their keys, ``count`` their number."""

    def __init__(self, key: str, count: int, examples: list, table: DataFrame):
        self.count, self.table = count, table
        shown = ", ".join(map(str, examples)) + (", ..." if count > len(examples) else "")
        super().__init__(f"{count} missing inputs for {key}: {shown}")


SHOWN_MISSING = 20  # keys that the message spells out; the error's table has all


def require_inputs(expected: DataFrame, present: DataFrame, key: str = "model") -> None:
    """Fail when any expected input is missing, with the count and the table of all missing keys."""
    missing = missing_inputs(expected, present, key)
    count = missing.count()
    if count:
        raise MissingInputs(key, count, [r[key] for r in missing.orderBy(key).limit(SHOWN_MISSING).collect()], missing)


def present_only(results: DataFrame, expected: DataFrame, key: str = "model") -> tuple[DataFrame, DataFrame]:
    """Keep results of expected keys; also return the skipped (missing) keys."""
    kept = results.join(expected.select(key).distinct(), key, "left_semi")
    return kept, missing_inputs(expected, results, key)
