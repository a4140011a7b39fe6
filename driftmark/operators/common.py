"""What all searches share: the size check before a broadcast, ranking, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a side that is sent to all executors: with 14 features and integers, some 10 MB.
BROADCAST_ROWS = 100_000
Q = [f"q{i}" for i in range(14)]
G = [f"g{i}" for i in range(14)]
V = [f"v{i}" for i in range(14)]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else as it is: joins then shuffle by key."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def nearest(candidates: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first k rows of each qid in a total order, with their rank from 1.

    Spark cuts each task's rows to k for a qid before it shuffles them.
    """
    window = Window.partitionBy("qid").orderBy(*order)
    return candidates.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def others(found: DataFrame, k: int, key: str = "ref_id") -> DataFrame:
    """Of the k + 1 nearest stored rows of each query the k that aren't the query itself, with their rank from 1."""
    return nearest(found.where(F.col("qid") != F.col(key)).withColumnRenamed("rank", "__dm_rank"), ["__dm_rank"], k).drop("__dm_rank")


def outcome(queries: DataFrame, neighbours: DataFrame, total: Column | None = None) -> DataFrame:
    """(qid, frauds, total) for every query; one without neighbours has (0, 0)."""
    counted = neighbours.groupBy("qid").agg(F.sum("fraud").alias("frauds"), F.count(F.lit(1)).alias("total"))
    rows = queries.select("qid").join(counted, "qid", "left")
    found = F.coalesce("total", F.lit(0)).cast("long")
    return rows.select("qid", F.coalesce("frauds", F.lit(0)).cast("long").alias("frauds"), (found if total is None else total.cast("long")).alias("total"))
