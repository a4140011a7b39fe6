"""Transactions derived from the events table, and their split into queries and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmark.functions import features, quantize

# The merchant categories that the derivation deals out.
MCCS = ["4511", "5311", "5411", "5812", "5912", "5944", "5999", "7801", "7802", "7995", "0000", "9999"]
DAY = 86_400_000_000


def transactions(events: DataFrame, spelt: bool = True) -> DataFrame:
    """Flat transaction columns of each event; all windows share one shuffle and one order by user.

    spelt: merchants by their ids, and the known ones as a list. Else both are numbers, and the known ones those of the ten events before
    (null where there are fewer), which is all that features need.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    base = events.select("*", k.alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    base = base.withColumn("merchant_id", F.concat(F.lit("MERC-"), (F.col("k") % 20).cast("string")) if spelt else F.col("k") % 20)
    user = Window.partitionBy("user_id").orderBy("micros", "event_id")
    before = user.rowsBetween(Window.unboundedPreceding, -1)
    cents = F.round(F.col("value") * 100).cast("long")
    known = F.collect_list("merchant_id").over(user.rowsBetween(-10, -1)) if spelt else F.array(*[F.lag("merchant_id", i).over(user) for i in range(1, 11)])
    told = base.select(
        "*",
        F.sum(cents).over(before).alias("cents_before"),
        F.count(F.lit(1)).over(before).alias("rows_before"),
        known.alias("known_merchants"),
        F.date_trunc("second", F.lag("ts").over(user)).cast("timestamp_ntz").alias("last_ts"),
    )
    # two running counts: a frame of a day would be counted anew for each row
    day = Window.partitionBy("user_id").orderBy("micros")
    upto, earlier = (F.count(F.lit(1)).over(day.rangeBetween(Window.unboundedPreceding, end)) for end in (0, -DAY - 1))
    return told.select(
        F.col("event_id").alias("tx_id"),
        (F.col("value") * 20).alias("amount"),
        (F.col("k") % 12 + 1).alias("installments"),
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("requested_at"),
        F.coalesce(F.try_divide(F.col("cents_before").cast("double"), "rows_before") / 5, F.lit(0.0)).alias("customer_avg"),
        (upto - F.when(F.col("micros").isNull(), 0).otherwise(earlier) - 1).cast("int").alias("tx_count_24h"),
        "known_merchants",
        "merchant_id",
        F.array(*map(F.lit, MCCS))[F.col("k") % 12].alias("mcc"),
        (F.col("k") * 37 % 100 * 60).cast("double").alias("merchant_avg"),
        F.col("event_type").isin("click", "view").alias("is_online"),
        (F.col("event_type") == "purchase").alias("card_present"),
        (F.col("event_id") * 7919 % 1200).cast("double").alias("km_from_home"),
        "last_ts",
        (F.col("event_id") * 104729 % 1100).cast("double").alias("last_km"),
        (F.col("event_type").isin("error", "signup") & (F.col("value") > 60)).cast("int").alias("fraud"),
    )


def vectors(tx: DataFrame) -> DataFrame:
    """tx_id, fraud, features f0..f13, quantized v0..v13 and partition key pk."""
    featured = tx.select("tx_id", "fraud", *features.canonical())
    quantized = featured.select("*", *[quantize.quantize(F.col(f"f{i}")).alias(f"v{i}") for i in range(14)])
    return quantized.withColumn("pk", quantize.partition_key())


_kept: dict[tuple, DataFrame] = {}


def forget() -> None:
    """Release what `vector_table` keeps."""
    for old in _kept.values():
        old.unpersist()
    _kept.clear()


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of a directory's events, kept by the session's executors (memory, then disk)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        forget()
        _kept[key] = vectors(transactions(spark.read.parquet(f"{sf_dir}/events.parquet"), spelt=False)).persist()
    return _kept[key]


#: Which transactions are asked for: those whose id is divisible by 50, all of them.
ASKED = "tx_id % 50 = 0"


def queries_of(table: DataFrame) -> DataFrame:
    return as_queries(table.where(ASKED))


def as_queries(rows: DataFrame) -> DataFrame:
    """qid, label and the query's f and q columns."""
    return rows.select(F.col("tx_id").alias("qid"), F.col("fraud").alias("label"), F.col("pk").alias("qpk"), *[F.col(f"f{i}").alias(f"g{i}") for i in range(14)], *[F.col(f"v{i}").alias(f"q{i}") for i in range(14)])


def references_of(table: DataFrame) -> DataFrame:
    """ref_id, fraud, f, v and pk of all transactions."""
    return table.withColumnRenamed("tx_id", "ref_id")
