"""Connected components by alternating star steps; only edges and labels move, and only as Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise


def _step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "star")
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    large = materialise(large.distinct(), "large")
    low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "star")
    small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str, *, most: int = 60) -> DataFrame:
    """(node, component) for each node of an edge, component being the least node reachable. Null ends are ignored."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = materialise(e.distinct(), "edges")
    before = None
    for _ in range(most):
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v").cast("long"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
        e = materialise(_step(e), "edges")
    raise RuntimeError(f"components did not settle in {most} steps")
