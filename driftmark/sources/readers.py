"""Readers and writers: references, documents, indexes, answers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftmark.functions import quantize
from driftmark.sources.schema import DIMS, DOCUMENT, REFERENCE


def is_fraud(label: Column) -> Column:
    """1 for the label "fraud" in any case; everything else, null too, is 0."""
    return F.coalesce(F.lower(label) == "fraud", F.lit(False)).cast("int")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, f0..f13, fraud) of a JSON array of {vector, label}, plain or gzipped.

    Names of fields are matched exactly, others are skipped. Vectors that are null or not of
    14 numbers are left out; ref_id follows the order in
    the file. A JSON array is one task to read: write it to Parquet once and read that.
    """
    rows = spark.read.schema(REFERENCE).option("multiLine", True).json(path)
    rows = rows.where(F.size("vector") == DIMS).withColumn("ref_id", F.monotonically_increasing_id())
    return rows.select("ref_id", *[F.col("vector")[i].cast("float").alias(f"f{i}") for i in range(DIMS)], is_fraud(F.col("label")).alias("fraud"))


#: Entries of one JSON array that is written: a file of them is read by one task.
FILE_ROWS = 50_000


def _write_arrays(rows: DataFrame, key: str, entry: Column, path: str, around: tuple[str, str]) -> None:
    """JSON files at path, each one array of at most about FILE_ROWS entries."""
    files = max(1, -(-rows.count() // FILE_ROWS))
    dealt = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(files)).alias("file")).agg(F.collect_list(F.struct(key, entry.alias("entry"))).alias("all"))
    body = F.array_join(F.transform(F.array_sort("all"), lambda x: x["entry"]), ",")
    dealt.select(F.concat(F.lit(around[0]), body, F.lit(around[1]))).write.option("maxRecordsPerFile", 1).text(path)


def write_references(rows: DataFrame, path: str) -> None:
    """(ref_id, vector, label) as files that `read_references` reads."""
    _write_arrays(rows, "ref_id", F.to_json(F.struct("vector", "label")), path, ("[", "]"))


def store_references(references: DataFrame, path: str) -> None:
    """(ref_id, v0..v13, fraud) of references as Parquet: what searches read."""
    quantized = [quantize.quantize(F.col(f"f{i}")).alias(f"v{i}") for i in range(DIMS)]
    references.select("ref_id", *quantized, "fraud").write.mode("overwrite").parquet(path)


def write_entries(bodies: DataFrame, path: str) -> None:
    """(qid, body, expected_approved) as load-test files that `read_entries` reads."""
    entry = F.concat(F.expr("substring(body, 1, length(body) - 1)"), F.lit(',"expected_approved":'), F.col("expected_approved").cast("string"), F.lit("}"))
    _write_arrays(bodies, "qid", entry, path, ('{"entries":[', "]}"))


def read_first_document(spark: SparkSession, path: str) -> DataFrame:
    """The document of a payload file; of an array the first."""
    return read_documents(spark, path).limit(1)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole of a small file, of a configuration for instance; None if there is none."""
    try:
        row = spark.read.option("wholetext", True).text(path).first()
    except AnalysisException:
        return None
    return row["value"] if row else None


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Transaction documents of a JSON file (an object, an array, or lines)."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Documents and their expected_approved of a load-test file {entries: [...]}."""
    kind = ", ".join(["id: STRING", *[f"{n}: {t}" for n, t in _fields()], "expected_approved: BOOLEAN"])
    return spark.read.schema(f"entries ARRAY<STRUCT<{kind}>>").option("multiLine", True).json(path).select(F.explode("entries").alias("e")).select("e.*")


def _fields() -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(DOCUMENT).fields if f.name != "id"]


def write_index(table: DataFrame, stats: DataFrame, path: str, key: str) -> None:
    """An index as Parquet: its rows by `key`, each key's rows in stored order, and a row of stats for each key.

    A key with many rows is written by many tasks: rows are dealt by key and by a part of
    their position.
    """
    part = F.floor(F.col("pos") / 1_000_000)
    table.repartition(F.col(key), part).sortWithinPartitions(key, "pos").write.mode("overwrite").partitionBy(key).parquet(f"{path}/rows")
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows and stats of an index that `write_index` wrote."""
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/stats")


def response(approved: Column, score: Column) -> Column:
    """The JSON answer of a decision."""
    return F.to_json(F.struct(approved.alias("approved"), score.alias("fraud_score")))
