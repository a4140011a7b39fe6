"""Quantized vectors: integers, partition keys, box bounds and squared distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftmark.sources.schema import DIMS, SCALE

QUANTIZED = [f"v{i}" for i in range(DIMS)]


def quantize(f: Column) -> Column:
    """A feature as an integer: -SCALE from -1 down, 0 for the rest up to 0, half to even between."""
    rounded = F.rint((f * F.lit(float(SCALE)).cast("float")).cast("double"))
    return F.when(F.isnan(f), 0).when(f <= -1, -SCALE).when(f <= 0, 0).when(f >= 1, SCALE).otherwise(rounded).cast("int")


def partition_key(prefix: str = "v") -> Column:
    """The 8-bit key of a quantized vector."""
    v = lambda i: F.col(f"{prefix}{i}")
    bit = lambda condition, weight: F.when(condition, weight).otherwise(0)
    bucket = F.when(v(12) <= 2047, 0).when(v(12) <= 4095, 1).when(v(12) <= 6143, 2).otherwise(3)
    return (bit(v(5) > 0, 1) + bit(v(9) > 0, 2) + bit(v(10) > 0, 4) + bit(v(11) > 0, 8) + bucket * 16 + bit(v(2) > 4096, 64) + bit(v(8) > 2048, 128)).cast("int")


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def lower_bound(q: str = "q", low: str = "mn", high: str = "mx") -> Column:
    """Squared distance from a vector to a box, 0 inside."""
    gaps = [F.greatest(F.col(f"{low}{i}") - F.col(f"{q}{i}"), F.col(f"{q}{i}") - F.col(f"{high}{i}"), F.lit(0)).cast("long") for i in range(DIMS)]
    return _sum([g * g for g in gaps])
