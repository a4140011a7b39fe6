"""Shard assignment: jump consistent hashing.

A key's shard follows from the key and the shard count alone, with no ring table; going
from n to n + 1 shards moves about 1 / (n + 1) of the rows, all into the new shard
(Lamping and Veach, "A fast, minimal memory, consistent hash algorithm").

Defined results: null key -> hashed as the text "" (all null keys share a shard); null or
empty text -> size 8, text_crc32 0; repeated rows -> a slot each; empty table -> no rows;
columns besides those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.plans.cluster import running, ship

SHARDS = 24
HEADER_BYTES = 8


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard (0 to shards - 1) of each 64-bit key; at most `shards` vectorised steps."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(live):
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
            ahead = (shard[live] + 1) * (2.0**31 / ((state[live] >> np.uint64(33)).astype(float) + 1.0))
            stays = ahead >= shards
            live, ahead = live[~stays], ahead[~stays]
            shard[live] = ahead.astype(np.int64)
    return shard


def key_hash(key: Column) -> Column:
    """The first eight bytes of the MD5 of a key's text, as a signed number: any system can work it out."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 16), 16, -10).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    """Column of the shard of a stable key of any type."""

    @F.pandas_udf("int")
    def of(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy(np.int64), shards).astype(np.int32))

    return of(key_hash(key))


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard, slot inside the shard and shard after one more is added, for each row."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    # text is measured before the rows go on: no later step carries it
    lean = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + HEADER_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = lean.select(
        "*",
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), shards).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
        F.lit(1).alias("__dm_one"),
    )
    slotted = running(placed, ["shard"], ["doc_id", "text_crc32", "size"], "__dm_one", "slot", deal=key_hash(F.col("doc_id")))
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
