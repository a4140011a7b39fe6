"""Mixing sources to target weights by a temperature.

A source's weight is its share of the tokens to the power of an exponent between 0 (all
alike) and 1 (as they are), normalised. The exponent is bisected: the least one that keeps
every source within the repetition limit, or, where a target entropy is given, the one that
meets it if that is larger. The budget is the least that uses every document at least once.
Tokens are those of a vocabulary file, counted over whole texts.

Each source is read in passes (epochs). A pass is a permutation of the source's blocks
and of the documents inside each, and every pass has a permutation of its own; the last
one ends where the source's budget does. Sources stay a table throughout: what reaches the driver is a
handful of sums, however many sources there are.

Defined results: null text has 0 tokens; null is a source of its own; a source without
tokens is used once, with weight 0; repeated rows are documents of their own in `mix`; texts of any length
count whole; an empty table gives no rows; columns besides those named are ignored or, in `mixed`, carried along.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.bpe import byte_bpe
from driftmark.llm.rows import with_text_columns
from driftmark.operators.common import small
from driftmark.plans.cluster import cut, running

REPETITION_LIMIT = 1.5
#: Halvings that are worked out from one pass over the sources, and the passes.
LEVELS, ROUNDS = 5, 11


def bisect(holds: Callable[[list[float]], list[bool]]) -> float:
    """The least exponent for which holds is true; it is true from there to 1. LEVELS halvings are asked for at once."""
    if holds([0.0])[0]:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        parts = 2**LEVELS
        points = [low + (high - low) * i / parts for i in range(1, parts)]
        told = dict(zip(points, holds(points), strict=True))
        a, b = 0, parts
        while b - a > 1:
            middle = (a + b) // 2
            a, b = (a, middle) if told[points[middle - 1]] else (middle, b)
        low, high = (points[a - 1] if a else low), (points[b - 1] if b < parts else high)
    return high


def solve(least_share: float, limit: float | None, target_entropy: float | None, entropies: Callable[[list[float]], list[float]]) -> float:
    """The exponent that keeps the repetition limit and then comes closest to the target entropy.

    least_share: tokens of the smallest source that has any, by those of the largest; a source
    of share x is read x ** (e - 1) times where the largest is read once. entropies: those of the
    normalised weights at given exponents.
    """
    if limit is not None and limit < 1:
        raise ValueError("a repetition limit under 1 would drop documents")
    found = 0.0 if target_entropy is None else bisect(lambda es: [h <= target_entropy for h in entropies(es)])
    if limit is not None:
        found = max(found, bisect(lambda es: [least_share ** (e - 1) <= limit for e in es]))
    return found


def _share() -> Column:
    return F.col("__dm_total") / F.col("__dm_top")


def _entropies(sources: DataFrame) -> Callable[[list[float]], list[float]]:
    """Entropies, in nats, of the weights of sources that have tokens: ln z - e * y / z of two sums over them for each exponent."""

    def at(exponents: list[float]) -> list[float]:
        x = _share()
        sums = [F.sum(v) for e in exponents for v in (F.pow(x, F.lit(e)), F.pow(x, F.lit(e)) * F.log(x))]
        row = sources.where("__dm_total > 0").agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        return [math.log(z) - e * y / z if z else 0.0 for e, z, y in zip(exponents, row[::2], row[1::2], strict=True)]

    return at


def counted(docs: DataFrame, vocabulary: str, name: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) with the tokens of each whole text."""
    return with_text_columns(docs, lambda texts: [[byte_bpe(vocabulary).count(t) for t in texts]], {name: "long"}, keep)


def mix(docs: DataFrame, vocabulary: str, limit: float | None = REPETITION_LIMIT, target_entropy: float | None = None, seed: int = 11, blocks: int | None = None) -> DataFrame:
    """A row for each time that a document is read.

    doc_id, source, n_tokens, epoch (from 0), position (tokens of the source read before),
    weight of the source and its repetition. blocks: those of a source, by default as many as keep them small.
    """
    group = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    lean = cut(counted(docs.select("doc_id", "source", "text"), vocabulary, keep=["doc_id", "source"]).withColumn("__dm_source", group))
    totals = lean.groupBy("__dm_source").agg(F.sum("n_tokens").alias("__dm_total"))
    ends = totals.agg(F.max("__dm_total").alias("top"), F.min(F.when(F.col("__dm_total") > 0, F.col("__dm_total"))).alias("low")).first()
    top, low = ends["top"] or 1, ends["low"] or 1
    sources = cut(totals.withColumn("__dm_top", F.lit(float(top))))
    e = solve(low / top, limit, target_entropy, _entropies(sources))
    z = sources.where("__dm_total > 0").agg(F.sum(F.pow(_share(), F.lit(e))).alias("z")).first()["z"] or 1.0
    some = F.col("__dm_total") > 0
    plan = sources.select(
        "__dm_source",
        "__dm_total",
        F.when(some, F.pow(_share(), F.lit(e)) / z).otherwise(0.0).alias("weight"),
        F.when(some, F.pow(_share(), F.lit(e - 1))).otherwise(1.0).alias("repetition"),
    ).withColumn("__dm_budget", F.round(F.col("__dm_total") * F.col("repetition")).cast("long"))
    passes = F.greatest(F.ceil(F.try_divide(F.col("__dm_budget"), F.col("__dm_total"))), F.lit(1)).cast("int")
    each = lean.join(small(plan), "__dm_source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.coalesce(passes, F.lit(1)) - 1)))
    each = each.withColumn("__dm_order", F.xxhash64("doc_id", "epoch", F.lit(seed)))
    placed = running(
        each,
        ["__dm_source", "epoch"],
        ["__dm_order", "doc_id", "n_tokens"],
        "n_tokens",
        "__dm_offset",
        blocks,
        deal=F.xxhash64("doc_id", F.lit(seed)),
        turn=lambda block: F.xxhash64("epoch", block, F.lit(seed)),
    )
    position = F.col("epoch") * F.col("__dm_total") + F.col("__dm_offset")
    read = placed.where((F.col("epoch") == 0) | (position < F.col("__dm_budget")))
    return read.select("doc_id", "source", "n_tokens", "epoch", position.alias("position"), "weight", "repetition")


def mixed(docs: DataFrame, vocabulary: str, limit: float | None = REPETITION_LIMIT, target_entropy: float | None = None) -> DataFrame:
    """The rows of docs, unchanged, each as often as the mixture reads it; rows of a null id once."""
    more = mix(docs.where("doc_id is not null"), vocabulary, limit, target_entropy).where("epoch > 0")
    repeats = more.groupBy(F.col("doc_id").alias("__dm_id")).agg(F.max("epoch").alias("__dm_more"))
    joined = docs.join(cut(repeats), F.col("doc_id") == F.col("__dm_id"), "left")
    return joined.withColumn("__dm_copy", F.explode(F.sequence(F.lit(0), F.coalesce("__dm_more", F.lit(0))))).drop("__dm_id", "__dm_more", "__dm_copy")
