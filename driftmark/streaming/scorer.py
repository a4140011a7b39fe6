"""Scoring documents from JSON, in batches and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftmark.functions import features, quantize
from driftmark.sources.schema import DOCUMENT, Limits


def parse(bodies: DataFrame, key: str = "qid", body: str = "body") -> DataFrame:
    """key, status and flat columns of JSON bodies, by the live rules.

    status: "ok"; "open" for a body that is empty, broken or without requested_at (the
    service then answers with score 0); "error" for a wrongly typed number. Missing numbers
    count as 0, missing booleans as false, a missing merchant as an unknown one.
    """
    # booleans are read as text: anything but true is false. Numbers must be numbers: a
    # body that only breaks their types can still be read with all of them as text.
    strict = DOCUMENT.replace("BOOLEAN", "STRING")
    loose = strict.replace(" DOUBLE", " STRING").replace(" INT,", " STRING,")
    read = lambda schema: F.from_json(F.col(body), f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = bodies.select(key, read(strict).alias("d"), read(loose)["_bad"].isNotNull().alias("__dm_broken"))
    number = lambda path: F.coalesce(F.col(path), F.lit(0))
    requested = features.parse_ts_live(F.col("d.transaction.requested_at"))
    wrong = F.col("d._bad").isNotNull() & ~F.col("__dm_broken")
    broken = F.col("d").isNull() | F.col("__dm_broken") | requested.isNull()
    truth = lambda path: F.coalesce(F.lower(path) == "true", F.lit(False))
    return rows.select(
        key,
        F.when(F.coalesce(wrong, F.lit(False)), "error").when(broken, "open").otherwise("ok").alias("status"),
        number("d.transaction.amount").alias("amount"),
        number("d.transaction.installments").alias("installments"),
        requested.alias("requested_at"),
        number("d.customer.avg_amount").alias("customer_avg"),
        number("d.customer.tx_count_24h").alias("tx_count_24h"),
        F.col("d.customer.known_merchants").alias("known_merchants"),
        F.col("d.merchant.id").alias("merchant_id"),
        F.col("d.merchant.mcc").alias("mcc"),
        number("d.merchant.avg_amount").alias("merchant_avg"),
        truth("d.terminal.is_online").alias("is_online"),
        truth("d.terminal.card_present").alias("card_present"),
        number("d.terminal.km_from_home").alias("km_from_home"),
        F.col("d.last_transaction").isNotNull().alias("has_last"),
        features.parse_ts_live(F.col("d.last_transaction.timestamp")).alias("last_ts"),
        number("d.last_transaction.km_from_current").alias("last_km"),
    )


def to_queries(parsed: DataFrame, key: str = "qid", limits: Limits = Limits(), risks: dict[str, float] | None = None) -> DataFrame:
    """key, status, features g, integers q and partition key qpk of parsed documents, by the fast variant."""
    featured = parsed.select(key, "status", *features.fast(limits, risks, F.col("has_last")))
    whole = featured.select("*", *[quantize.quantize(F.col(f"f{i}")).alias(f"v{i}") for i in range(14)]).withColumn("qpk", quantize.partition_key())
    return whole.withColumnsRenamed({f"{a}{i}": f"{b}{i}" for a, b in (("f", "g"), ("v", "q")) for i in range(14)})


def typed(documents: DataFrame, key: str) -> DataFrame:
    """key and flat columns of typed documents: timestamps, in any offset, are turned to UTC; what is missing is 0, false or unknown."""
    value = lambda path, other=0: F.coalesce(F.col(path), F.lit(other))
    return documents.select(
        key,
        value("transaction.amount").alias("amount"),
        value("transaction.installments").alias("installments"),
        features.parse_ts_dto(F.col("transaction.requested_at")).alias("requested_at"),
        value("customer.avg_amount").alias("customer_avg"),
        value("customer.tx_count_24h").alias("tx_count_24h"),
        F.col("customer.known_merchants").alias("known_merchants"),
        F.col("merchant.id").alias("merchant_id"),
        F.col("merchant.mcc").alias("mcc"),
        value("merchant.avg_amount").alias("merchant_avg"),
        value("terminal.is_online", False).alias("is_online"),
        value("terminal.card_present", False).alias("card_present"),
        value("terminal.km_from_home").alias("km_from_home"),
        features.parse_ts_dto(F.col("last_transaction.timestamp")).alias("last_ts"),
        F.col("last_transaction.km_from_current").alias("last_km"),
    )


def parse_typed(bodies: DataFrame, key: str = "qid", body: str = "body") -> DataFrame:
    """key and flat columns of JSON bodies read as typed documents."""
    return typed(bodies.select(key, F.from_json(F.col(body), DOCUMENT).alias("d")).select(key, "d.*"), key)


def documents_json(tx: DataFrame, key: str = "tx_id", offset_hours: int = 0) -> DataFrame:
    """qid and the JSON body of flat transactions, the reverse of `parse`; times are told in UTC or at an offset from it."""
    zone = f"{offset_hours:+03d}:00" if offset_hours else "Z"
    when = lambda c: F.concat(F.date_format(F.col(c) + F.make_dt_interval(hours=F.lit(offset_hours)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))
    last = F.when(F.col("last_ts").isNotNull(), F.struct(when("last_ts").alias("timestamp"), F.col("last_km").alias("km_from_current")))
    body = F.struct(
        F.concat(F.lit("tx-"), F.col(key)).alias("id"),
        F.struct("amount", "installments", when("requested_at").alias("requested_at")).alias("transaction"),
        F.struct(F.col("customer_avg").alias("avg_amount"), "tx_count_24h", "known_merchants").alias("customer"),
        F.struct(F.col("merchant_id").alias("id"), "mcc", F.col("merchant_avg").alias("avg_amount")).alias("merchant"),
        F.struct("is_online", "card_present", "km_from_home").alias("terminal"),
        last.alias("last_transaction"),
    )
    return tx.select(F.col(key).alias("qid"), F.to_json(body).alias("body"))


def stream(bodies: DataFrame, search: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Score a stream of (qid, body): each micro-batch goes through the batch path.

    Ranking is no time window, so it isn't allowed in a stream's own plan; `write` gets the
    batch's number and must be idempotent in it.
    """

    def batch(rows: DataFrame, number: int) -> None:
        write(search(to_queries(parse(rows))), number)

    return bodies.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
