"""Connected components by alternating large-star and small-star steps, all in minima over neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch


def _with_min(edges: DataFrame) -> DataFrame:
    """Every edge with the smallest node of its first one's neighbourhood. Neighbours come sorted, so a node with very many
    is passed through, not held."""
    smallest = F.first("b").over(Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    return edges.withColumn("m", F.least("a", smallest))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_min(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Of edges that lead to smaller nodes: each neighbour, and the node itself, to the smallest one."""
    least = _with_min(edges)
    ends = F.explode(F.when(F.col("b") != F.col("m"), F.array("a", "b")).otherwise(F.array("a")))
    return least.select(ends.alias("a"), F.col("m").alias("b"))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Of edges (a, b: long), per node: ``key`` and ``comp``, the smallest node reachable from it.

    Every step writes its edges, so a lost executor costs one step at most; the number of steps grows as the logarithm
    of the longest path. Only two numbers a step reach the driver. Loops and repeated edges don't matter.
    """
    now = scratch.save(edges.where("a <> b").select("a", "b").distinct(), "edges")
    before = None
    while True:
        new = scratch.save(_small_star(_large_star(now)).where("a <> b").distinct(), "star")
        # a star's edges all lead from a node to its smallest one: nothing more changes then
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        if state == before:
            break
        now, before = new, state
    return new.select(F.col("a").alias("key"), F.col("b").alias("comp")).unionByName(new.select(F.col("b").alias("key"), F.col("b").alias("comp")).distinct())
