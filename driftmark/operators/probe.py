"""Probing an index with one document: its neighbours, and the rate of frauds among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.functions import features, quantize
from driftmark.operators import exact, partitioned, score
from driftmark.operators.common import outcome
from driftmark.plans.fixtures import as_queries
from driftmark.streaming import scorer


def query_of(document: DataFrame) -> DataFrame:
    """The one document of a payload file as a query with qid 0."""
    flat = scorer.typed(document.withColumn("qid", F.lit(0).cast("long")), "qid")
    featured = flat.select(F.col("qid").alias("tx_id"), F.lit(0).alias("fraud"), *features.canonical())
    whole = featured.select("*", *[quantize.quantize(F.col(f"f{i}")).alias(f"v{i}") for i in range(14)])
    return as_queries(whole.withColumn("pk", quantize.partition_key()))


def _rated(query: DataFrame, found: DataFrame) -> DataFrame:
    """The neighbours, each with the rate of all; a query without any gives one row whose rate is NaN."""
    return score.probe_rate(outcome(query, found)).select("qid", "fraud_score").join(found, "qid", "left").drop("qid")


def against_index(document: DataFrame, references: DataFrame, stats: DataFrame, k: int = 5) -> DataFrame:
    """(fraud_score, rank, ref_id, fraud, dist): the k nearest by the partition index, all boxes considered."""
    query = query_of(document)
    found = partitioned.knn_multi(query, references, stats, k, partitioned.PARTITIONS - 1)
    return _rated(query, found.select("qid", "rank", "ref_id", "fraud", "dist"))


def against_references(document: DataFrame, references: DataFrame, k: int = 5) -> DataFrame:
    """(fraud_score, rank, fraud, dist): the k nearest of a list of references by 32-bit distances of features."""
    query = query_of(document)
    found = exact.knn_float(query, references, k, single=True)
    return _rated(query, found.select("qid", "rank", "fraud", "dist"))
