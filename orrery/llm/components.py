"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import cut


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie the larger neighbours of each node to the least node beside it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie each node and its smaller neighbours to the least of them (a > b holds in every edge)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links between longs -> (node, component), the least node of each component.

    Nodes without links are not listed. Each round cuts lineage in the shared
    checkpoint folder; a round that leaves the edge set as it was is the last.
    Only a count and a checksum reach the driver.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = cut(pairs)
    seen = _signature(state)
    while seen[0]:
        state = cut(_small_star(_large_star(state)))
        now = _signature(state)
        if now == seen:
            break
        seen = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
