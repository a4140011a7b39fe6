"""Helpers that every distributed plan of the engine needs: shipping, lineage, ranks."""

from __future__ import annotations

import gc
import io
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that don't share the driver's disk.

    The sources (some hundred kB) are sent once for each SparkContext through
    Spark's own file server.
    """
    sc = spark.sparkContext
    if getattr(sc, "_driftmark_shipped", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent).as_posix())
    folder = tempfile.mkdtemp(prefix="driftmark-ship-")
    path = os.path.join(folder, "driftmark_src.zip")
    Path(path).write_bytes(packed.getvalue())
    sc.addPyFile(path)
    sc._driftmark_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and one machine runs all."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="driftmark-checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder; a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffles, and where it is set to the checkpoints, that nothing refers to any more.

    It notices them when the driver collects garbage, which a driver with little to do may not do until a plan has ended.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Keys that this many rows share, of which there are few, are joined without dealing rows by key.
HOT_ROWS = 50_000


def attach(rows: DataFrame, told: DataFrame, key: str, many: str) -> DataFrame:
    """rows with the columns of told, which has one row for each value of key; nulls where it has none.

    many: the column of told that says how many rows share the key. Rows of hot keys meet told's few rows about them in every task, rows
    without a key meet none, so that only the rest is dealt by key.
    """
    hot = told.where(F.col(many) >= HOT_ROWS)
    known, added = rows.where(F.col(key).isNotNull()), [c for c in told.columns if c != key]
    some = known.join(F.broadcast(hot), key)
    rest = known.join(F.broadcast(hot.select(key)), key, "left_anti").join(told.where(F.col(many) < HOT_ROWS), key, "left")
    kinds = dict(told.dtypes)
    none = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in added])
    order = [*rows.columns, *added]
    return some.select(*order).unionByName(rest.select(*order)).unionByName(none.select(*order))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a bucket that are put in order by one task, on average.
BUCKET_ROWS = 100_000
LEAST_BUCKETS = 256


def running(
    df: DataFrame, group: list[str], order: list[str], weight: str, name: str, buckets: int | None = None, deal: Column | None = None, turn: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Add `name`: the sum of `weight` over the rows before each row of its group, with no group in one task.

    Rows of a group are dealt into buckets by a hash (`deal`, by default that of the order columns); each bucket is
    summed alone, and the buckets' sums (buckets x groups rows, never the rows themselves)
    give where each starts. There are as many buckets as keep those of the largest group at BUCKET_ROWS rows,
    if no number is given. The order inside a group is by bucket (by `turn` of its number, where given), then by the order
    columns: a fixed shuffle that depends on values only, so a task that runs again gives
    the same numbers. Rows equal in all order columns get any of their places.
    """
    b, n, start = "__dm_bucket", "__dm_n", "__dm_start"
    if buckets is None:
        largest = df.groupBy(*group).count().agg(F.max("count").alias("n")).first()["n"] or 0
        buckets = max(LEAST_BUCKETS, -(-largest // BUCKET_ROWS))
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order) if deal is None else deal, F.lit(buckets)).cast("int"))
    sums = dealt.groupBy(*group, b).agg(F.sum(weight).alias(n))
    turns = [b] if turn is None else [turn(F.col(b)), F.col(b)]
    before = Window.partitionBy(*group).orderBy(*turns).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(*group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        dealt.withColumn(n, F.sum(weight).over(inside) - F.col(weight))
        .join(starts, [*group, b])
        .withColumn(name, (F.col(start) + F.col(n)).cast("long"))
        .drop(b, n, start)
    )


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, buckets: int | None = None) -> DataFrame:
    """Add `name`: a gapless rank from 0 inside each group, as `running` gives it for a weight of 1."""
    one = "__dm_one"
    return running(df.withColumn(one, F.lit(1)), group, order, one, name, buckets).drop(one)
