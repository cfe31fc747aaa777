"""Connected components of an edge list by alternating large-star and small-star steps.

A large star hangs the greater neighbours of a node on its least neighbour, a small star the others; both keep
the components and shrink the distances, so the edges end as stars around the least node of each component.
Each step is one aggregation and one join on a node. Every round is written to the shared folder, so a lost
executor re-reads one round and the plan stays short. The driver sees two sums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toxscan.llm.common import written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``edges``: ``a``, ``b`` (comparable, no nulls). Returns ``node``, ``component`` (its least node) for every
    node of an edge between two different nodes."""
    e = written(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "components-edges")
    before = None
    for _ in range(rounds):
        e = written(_small_star(_large_star(e)), "components-round")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
