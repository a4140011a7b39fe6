"""Search over the 256 partitions of quantized vectors, with box pruning.

Positions inside a partition follow ref_id. Queries are the held side: references are read once,
and each is compared with the queries that ask for its partition.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmark.functions.quantize import lower_bound
from driftmark.operators.blocks import in_groups, of_integers
from driftmark.operators.boxes import everywhere
from driftmark.operators.common import BROADCAST_ROWS, Q, V, nearest
from driftmark.plans.cluster import cut
from driftmark.sources.readers import write_index
from driftmark.sources.schema import PARTITIONS

FAR = 2**63 - 1


def partition_stats(references: DataFrame) -> DataFrame:
    """(pk, total, frauds, mn0..mx13) for each of the 256 keys; the box of an empty one is zero."""
    boxes = [agg for i in range(14) for agg in (F.min(f"v{i}").alias(f"mn{i}"), F.max(f"v{i}").alias(f"mx{i}"))]
    found = references.groupBy("pk").agg(F.count(F.lit(1)).alias("total"), F.sum("fraud").alias("frauds"), *boxes)
    keys = references.sparkSession.range(PARTITIONS).select(F.col("id").cast("int").alias("pk"))
    return keys.join(found, "pk", "left").na.fill(0)


def positioned(references: DataFrame) -> DataFrame:
    """References with `pos`, their place in their partition by ref_id.

    A key that holds a third of the rows isn't sorted in one task: places are counted by
    ranges of ref_id.
    """
    return positions(references, "pk")


def positions(rows: DataFrame, key: str, order: str = "ref_id", span: int = 1 << 20) -> DataFrame:
    """rows with `pos`: the place from 0 among the rows of `key` in the order of a whole number.

    Numbers are dealt into ranges of `span`; counts of the ranges before give each range's start.
    """
    dealt = rows.withColumn("__dm_range", F.floor(F.col(order) / span))
    counts = dealt.groupBy(key, "__dm_range").agg(F.count(F.lit(1)).alias("__dm_n"))
    before = Window.partitionBy(key).orderBy("__dm_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "__dm_range", F.coalesce(F.sum("__dm_n").over(before), F.lit(0)).alias("__dm_start"))
    inside = Window.partitionBy(key, "__dm_range").orderBy(order)
    placed = dealt.withColumn("__dm_n", F.row_number().over(inside)).join(starts, [key, "__dm_range"])
    return placed.withColumn("pos", (F.col("__dm_start") + F.col("__dm_n") - 1).cast("long")).drop("__dm_range", "__dm_n", "__dm_start")


def _scan(probes: DataFrame, references: DataFrame, cap: int, k: int) -> DataFrame:
    """Candidates for the k nearest in the partitions that probes (qid, pk, scan_rank, q) name; of the first `cap` of each, of all for 0."""
    r = references if not cap else references.where(F.col("pos") < cap)
    return in_groups(probes, r, "pk", Q, V, np.float64, of_integers, k, "long")


ORDER = ["dist", "scan_rank", "pos"]


def _own(queries: DataFrame) -> DataFrame:
    return queries.withColumn("pk", F.col("qpk")).withColumn("scan_rank", F.lit(0))


def _allowed(queries: DataFrame, stats: DataFrame, cap: int, hard: bool) -> DataFrame:
    """Queries that are searched: with the hard limit, those whose own partition isn't larger than the cap."""
    if not (hard and cap):
        return queries
    sizes = F.broadcast(stats.select(F.col("pk").alias("qpk"), F.col("total").alias("__dm_total")))
    return queries.join(sizes, "qpk").where(F.col("__dm_total") <= cap).drop("__dm_total")


def knn_primary(queries: DataFrame, references: DataFrame, stats: DataFrame, k: int = 5, cap: int = 0, hard: bool = False) -> DataFrame:
    """The k nearest in the query's own partition."""
    return nearest(_scan(_own(_allowed(queries, stats, cap, hard)), references, cap, k), ORDER, k)


def knn_primary_and_all(queries: DataFrame, references: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(qid, ref_id, fraud, dist, rank): the k nearest in the query's own partition, as `knn_primary` without a cap gives them for unplaced references, and the k nearest of all.

    One search by boxes gives both: pieces of the references hold rows of one partition, and none that may hold one of either is left out.
    """
    found = everywhere(queries, references, Q, V, np.float64, of_integers, k, "long", BROADCAST_ROWS, ("qpk", "pk"))
    return tuple(nearest(some.drop("own"), ["dist", "ref_id"], k) for some in (found.where("own"), found))


def candidate_partitions(queries: DataFrame, kth: DataFrame, stats: DataFrame, most: int) -> DataFrame:
    """For each query up to `most` other partitions whose box is nearer than its k-th distance, by (bound, pk).

    kth: (qid, kth). 256 boxes go to every task. Empty partitions take part with their zero box.
    """
    boxes = F.broadcast(stats.select("pk", *[f"{s}{i}" for i in range(14) for s in ("mn", "mx")]))
    bounded = queries.join(kth, "qid").crossJoin(boxes).where(F.col("pk") != F.col("qpk")).select("qid", "qpk", "pk", "kth", lower_bound().alias("bound"), *Q)
    window = Window.partitionBy("qid").orderBy("bound", "pk")
    return bounded.where(F.col("bound") < F.col("kth")).withColumn("scan_rank", F.row_number().over(window)).where(F.col("scan_rank") <= most)


def kth_distance(queries: DataFrame, neighbours: DataFrame, k: int) -> DataFrame:
    """(qid, kth): the k-th distance found, or the largest number where fewer were."""
    last = neighbours.where(F.col("rank") == k).select("qid", F.col("dist").alias("kth"))
    return queries.select("qid").join(last, "qid", "left").select("qid", F.coalesce("kth", F.lit(FAR)).alias("kth"))


def knn_multi(queries: DataFrame, references: DataFrame, stats: DataFrame, k: int = 5, most: int = 2, cap: int = 0, hard: bool = False) -> DataFrame:
    """The k nearest in the query's own partition and up to `most` others.

    With most = 255 and no cap this is the exact search over quantized vectors: a partition
    is left out only if its box is no nearer than the k-th distance.
    """
    asked = _allowed(queries, stats, cap, hard)
    # at most k rows a query, read by the bounds and by the union
    first = cut(nearest(_scan(_own(asked), references, cap, k), ORDER, k))
    probes = candidate_partitions(asked, kth_distance(asked, first, k), stats, most)
    # the own partition's best k stand for it: no other row of it can be among the final k
    both = first.drop("rank").unionByName(_scan(probes, references, cap, k))
    return nearest(both, ORDER, k)


def nearest_one(queries: DataFrame, references: DataFrame, but_itself: bool = False) -> DataFrame:
    """(qid, ref_id, fraud, dist) of the nearest in the own partition; the query's own row, where wanted, left out."""
    pairs = _scan(_own(queries), references, 0, 1 + but_itself)
    pairs = pairs.where("qid <> ref_id") if but_itself else pairs
    best = pairs.groupBy("qid").agg(F.min(F.struct("dist", "pos", "ref_id", "fraud")).alias("best"))
    return best.select("qid", "best.ref_id", "best.fraud", "best.dist")


def partition_only(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """(qid, frauds, total) of the query's partition, without any distance; also for streams."""
    table = F.broadcast(stats.select(F.col("pk").alias("qpk"), "frauds", "total"))
    return queries.join(table, "qpk", "left").select("qid", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("frauds", "total")])


def build(references: DataFrame, path: str) -> None:
    """Write the partition index of references."""
    write_index(positioned(references).select("ref_id", "fraud", "pk", "pos", *V), partition_stats(references), path, "pk")
