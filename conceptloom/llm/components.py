"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptloom.llm.common import written


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One step: every node's neighbours (the larger ones, or all smaller ones and itself) move to its smallest one."""
    if larger_only:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # written: a join with the aggregate itself keeps its partitions, and a hub's edges would stay in one task
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    joined = both.join(least, "a")
    if larger_only:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) of every node that an edge (``a``, ``b``: long) touches.

    Loops, repeated edges and both directions are fine; null ends are left out; no edges give no rows. Each round writes
    its edges to the shared folder, so that a lost executor costs one round at most. A hub's edges are combined before
    they are shuffled, and the joins that follow have written tables on both sides, whose hot keys adaptive execution splits.
    """
    now = written(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        now = written(_star(_star(now, True), False), "edges")
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == sign:
            break
        seen = sign
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
