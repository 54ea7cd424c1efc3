"""Connected components of a distributed edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitscreen.llm.common import stored


def _minima(edges: DataFrame) -> DataFrame:
    """Stored, so that a join with it reads two shuffles and the optimizer can split a node with many edges."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("low")), "minima")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minima(both).select("u", F.least("u", "low").alias("low"))
    return (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = _minima(edges)
    moved = edges.join(low, "u").filter("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return low.select("u", F.col("low").alias("v")).unionByName(moved).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Large-star and small-star rounds: the edge table never grows, nothing but its
    size and a checksum reaches the driver, and each round is stored. Edges with a
    null end and loops link nothing; nodes without other edges are not returned.
    """
    edges = stored(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = state
        edges = stored(_small_star(_large_star(edges)), "edges")
