"""Locality-sensitive hashing by the signs of projections, with multi-probe."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.operators.blocks import in_groups, in_order
from driftmark.operators.common import G, nearest, small
from driftmark.operators.partitioned import positions
from driftmark.plans.cluster import cut, ship

PLANES, PROBES, CANDIDATES = 16, 8, 4000
#: Rows that a task gathers before it drops those that come too late in their bucket.
HELD_ROWS = 200_000


def planes(many: int = PLANES, seed: int = 42) -> list[list[int]]:
    """Normals of hyperplanes with whole components from -1000 to 1000; only the sign of a projection counts."""
    state, out = seed, []
    for _ in range(many):
        row = []
        for _ in range(14):
            state = (state * 1103515245 + 12345) % 2**31
            row.append(state // 65536 % 2001 - 1000)
        out.append(row)
    return out


def signature(prefix: str = "f", many: int = PLANES) -> Column:
    """Bit i says whether the vector lies on the positive side of plane i."""
    bits = []
    for i, plane in enumerate(planes(many)):
        dot = reduce(lambda a, b: a + b, [F.col(f"{prefix}{j}").cast("double") * F.lit(float(p)) for j, p in enumerate(plane)])
        bits.append(F.when(dot >= 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return reduce(lambda a, b: a + b, bits)


def buckets(references: DataFrame) -> DataFrame:
    """References with their signature `sig` and place `pos` in its bucket, by ref_id."""
    return positions(references.withColumn("sig", signature()), "sig")


def _early(rows: DataFrame, most: int) -> DataFrame:
    """rows without such as have `most` others of their `sig` before them by ref_id in what a task has read, so that the first `most` of each bucket stay.

    many: summed over the rows of a bucket, how many it has in all.
    """
    ship(rows.sparkSession)

    def reduced(table: pa.Table) -> pa.Table:
        sig, ids, many = (table.column(c).to_numpy() for c in ("sig", "ref_id", "many"))
        order = np.lexsort((ids, sig))
        every, start, n = np.unique(sig[order], return_index=True, return_counts=True)
        place = np.arange(len(order)) - np.repeat(start, n)
        counted = np.zeros(len(order), np.int64)
        if len(order):
            counted[start] = np.add.reduceat(many[order], start)
        kept = place < most
        return table.drop_columns(["many"]).take(pa.array(order[kept])).append_column("many", pa.array(counted[kept]))

    def early(batches):
        held = None
        for batch in batches:
            more = pa.Table.from_batches([batch]).append_column("many", pa.array(np.ones(batch.num_rows, np.int64)))
            held = more if held is None else pa.concat_tables([held, more])
            if held.num_rows > HELD_ROWS:
                held = reduced(held)
                if held.num_rows > HELD_ROWS // 2:
                    yield from held.to_batches(10_000)
                    held = None
        if held is not None:
            yield from reduced(held).to_batches(10_000)

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(early, f"{schema}, many long")


def asked(queries: DataFrame, probes: int = PROBES) -> DataFrame:
    """(qid, g, probe, sig): the query's own bucket for probe 0, and for probe j the one whose bit j - 1 is flipped."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(min(probes, PLANES)))).alias("probe")
    flip = F.when(F.col("probe") == 0, F.lit(0)).otherwise(F.expr("shiftleft(1L, greatest(probe - 1, 0))"))
    return queries.select("qid", *G, signature("g").alias("own"), steps).withColumn("sig", F.col("own").bitwiseXOR(flip.cast("long"))).drop("own")


def search(queries: DataFrame, references: DataFrame, k: int = 5, probes: int = PROBES, candidates: int = CANDIDATES) -> DataFrame:
    """The k nearest features in the query's bucket and, while fewer than k were found, in those one bit away.

    Probe j takes place if the probes before it found fewer than k; of what they find, in the order of probes and then of places in the
    bucket, the first `candidates` are ranked. Only buckets that some probe may ask for are numbered, and no row is held against queries
    that comes after the first `candidates` of its bucket: none is ranked for any query.
    """
    probed = cut(asked(queries, probes))
    wanted = small(probed.select("sig").distinct())
    lean = references.select("ref_id", "fraud", *[f"f{i}" for i in range(14)], signature().alias("sig"))
    held = cut(_early(lean.join(wanted, "sig", "left_semi").where("ref_id is not null"), candidates))
    stored = cut(positions(held.drop("many"), "sig").where(F.col("pos") < candidates))
    sizes = held.groupBy("sig").agg(F.sum("many").alias("size"))
    before = Window.partitionBy("qid").orderBy("probe").rowsBetween(Window.unboundedPreceding, -1)
    counted = probed.join(sizes, "sig", "left").withColumn("found", F.coalesce(F.sum("size").over(before), F.lit(0)))
    taken = counted.where((F.col("found") < k) & F.col("size").isNotNull())
    # rank among a query's candidates: those of the probes before, then the place in the bucket
    named = taken.select("qid", "sig", F.col("probe").alias("scan_rank"), *G, (candidates - F.col("found")).cast("long").alias("upto")).where("upto > 0")
    found = in_groups(named, stored, "sig", G, [f"f{i}" for i in range(14)], np.float64, in_order, k, "double")
    return nearest(found.withColumnRenamed("scan_rank", "probe"), ["dist", "probe", "pos"], k)
