"""Connected components of a written edge list, by alternating large and small stars.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  A node's neighbours
are never collected: its minimum is an aggregate (map-side combined) that joins the edges back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialise


def _with_minimum(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least, "u").select("u", "v", F.least("u", "least").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_minimum(down)
    return linked.select(F.col("v").alias("u"), F.col("least").alias("v")) \
        .unionByName(linked.select("u", F.col("least").alias("v")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v): every node of an edge but the least of its component, with that least node.

    ``edges`` has comparable columns u and v; loops and repeated edges do no harm.
    """
    edges = materialise(edges.filter("u <> v").distinct(), name)
    before = None
    while True:
        last, edges = edges, materialise(_small_star(_large_star(edges).distinct()).filter("u <> v").distinct(), name)
        discard(last)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges
        before = state
