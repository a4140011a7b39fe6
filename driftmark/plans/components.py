"""Connected components by alternating large and small stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.plans.cluster import cut


def _least(edges: DataFrame) -> DataFrame:
    """a -> the least of a and its neighbours b; partial sums keep hubs out of single tasks.

    It is cut so that the join with a hub's edges has two plain exchanges, which
    adaptive execution can split.
    """
    return cut(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _is_settled(edges: DataFrame) -> bool:
    """Whether every id has one parent at most and no parent has one: then b is a's component."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b); component is the least id reachable.

    The rounds grow with the logarithm of the longest path. Self-loops and repeated or
    null edges do no harm; ids in no edge but a self-loop are not returned.
    """
    edges = edges.where("a is not null and b is not null and a != b")
    now = cut(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    while not _is_settled(now):
        now = cut(_small_star(_large_star(now)).distinct())
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())
