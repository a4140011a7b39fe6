"""The corpus pipeline: stages over `documents`, each written as Parquet and read as the next one's input.

Quality and language are learnt from the tables of sf_dir and applied to all that the stage
before kept; near-duplicates, mixture and packing are worked out on their own input. Columns besides
those of documents are carried along by all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from driftmark.llm import language, mixing, neardup, packing, quality
from driftmark.llm.queries import fold, table, vocabulary
from driftmark.plans.cluster import remove, shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, by the whole text; null text counts as empty, repeated rows are judged alike, an empty table gives none."""
    trees = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return quality.accepted(docs, trees)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus is known to have; null, empty and letterless texts go, repeated rows are judged alike, an empty table gives none."""
    filters = language.fit(table(spark, sf_dir, "documents"), fold("doc_id", 4) != 2)
    return language.identified(docs, filters)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity of 0.8 or more.

    Null and empty texts are near nothing; of rows equal in id and text one stays, rows of a null id all do.
    """
    return neardup.deduplicated(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought closer together by repeating documents of small ones, none more than half again on average.

    No row is lost: null texts have no tokens and are read once, null is a source of its own, rows of a null id are read once.
    """
    return mixing.mixed(docs, vocabulary())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; null and empty texts are one closing id, each repeated row is packed."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality", keep_quality),
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trees, Bloom filters, MinHash and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each written to the shared folder before the next; what a stage has read is then deleted."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
            if i:
                remove(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
