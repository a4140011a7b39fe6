"""Embedding near-duplicates by a pivot-permutation index.

Equal vectors become one class. Each class is described by the ordered list of its PREFIX nearest
reference points (pivots) and stands in the inverted lists of the LISTED nearest. Two classes of
a list are candidates if they share LEAST_SHARED pivots of their whole prefixes and these stand near the front of both: a shared pivot
counts by the product of what its places are worth, from 1 for the first down to 1 / PREFIX,
and the counts must sum to LEAST_WEIGHT. Only candidates are verified, by their cosine in double precision. A
pair is looked at in the list of its least shared pivot alone. Lists are worked through in
pairs of blocks of at most BLOCK classes on average, so a common vector's list is spread
over many tasks, and what leaves a block is one row for each linked class, not each pair. Inside a block,
the weighted counts come from one product of narrow hashed tables, in which pivots that collide can only add, and
are then taken exactly where that product reaches LEAST_WEIGHT.

Pivots come from a bounded sample (`SAMPLE` vectors by a hash of the id, thinned so that no
two lie close) and fixed random directions; there are 6 * sqrt(classes) of them, so that the pairs looked at grow with the
power 1.5 of the table. They are sent to all tasks as single floats, at most PIVOT_BYTES of them: at 64 components that
is reached at some 30 billion classes, beyond which lists grow in proportion.
At cosine 0.9 exactly, pairs of random vectors of 64 components are found with a probability of 0.998 among up to a million classes and 0.99 among
20 million; the tests measure recall against brute force.

Defined results: a vector that is null, zero or holds null or non-finite components, or
whose id is null, links with nothing; vectors of other lengths link among themselves alone;
repeated rows count as vectors of their own; an empty table gives no rows; columns besides
those named are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.plans.cluster import attach, cut, ship
from driftmark.plans.components import components

SAMPLE = 4096
PIVOT_BYTES = 256_000_000
PREFIX, LISTED = 16, 10
LEAST_SHARED, LEAST_WEIGHT = 2, 0.75
BLOCK = 512
#: Columns of the tables that weighted counts are first taken from.
HASHED = 256
#: Part of a block's pairs from which one product verifies them in less time than pair by pair.
DENSE = 0.125


def choose_pivots(sample: np.ndarray, many: int, seed: int = 7) -> np.ndarray:
    """Unit reference points: sample vectors no two of which lie within a cosine of 0.7, then random directions."""
    width = sample.shape[1]
    taken = np.empty((0, width))
    for v in sample / np.linalg.norm(sample, axis=1, keepdims=True):
        if len(taken) >= many:
            break
        if not len(taken) or (taken @ v).max() < 0.7:
            taken = np.concatenate([taken, v[None]])
    more = np.random.default_rng(seed).normal(size=(many - len(taken), width))
    return np.concatenate([taken, more / np.linalg.norm(more, axis=1, keepdims=True)])


def prefixes(unit: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """For each row the indices of its nearest pivots, nearest first; equal distances by index."""
    near = unit.astype(np.float32) @ pivots.astype(np.float32, copy=False).T
    some = np.argpartition(-near, min(length, near.shape[1]) - 1, axis=1)[:, :length]
    some.sort(axis=1)
    order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1).astype(np.int32)


def worth(length: int) -> np.ndarray:
    """What each place of a prefix is worth."""
    return (length - np.arange(length)) / length


def retrieved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of a against rows of b: whether the weighted count of shared pivots may reach LEAST_WEIGHT; so for all that do, and for few others."""
    w = worth(a.shape[1]).astype(np.float32)
    tables = []
    for lists in (a, b):
        table = np.zeros((len(lists), HASHED), np.float32)
        np.add.at(table, (np.arange(len(lists))[:, None], lists.astype(np.int64) * 0x9E3779B1 >> 7 & HASHED - 1), w)
        tables.append(table)
    return tables[0] @ tables[1].T >= LEAST_WEIGHT - 1e-4


def shared(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of prefixes: pivots shared, their weighted count, and the least one that both are listed under."""
    same = x[:, :, None] == y[:, None, :]
    w = worth(x.shape[1])
    listed = np.where(same[:, :LISTED, :LISTED].any(2), x[:, :LISTED], np.iinfo(np.int32).max).min(1)
    return same.sum((1, 2)), same.reshape(len(x), -1) @ np.outer(w, w).ravel(), listed


def _linked(x: np.ndarray, y: np.ndarray, cosine: np.ndarray, least: float) -> np.ndarray:
    """Whether the cosine of each pair of rows is `least` or more, with values at the border taken again by exact sums."""
    out = cosine >= least
    for i in np.nonzero(np.abs(cosine - least) < 1e-12)[0]:
        out[i] = math.fsum(x[i] * y[i]) / math.sqrt(math.fsum(x[i] * x[i]) * math.fsum(y[i] * y[i])) >= least
    return out


def verified(first: np.ndarray, second: np.ndarray, candidates: np.ndarray, raw: np.ndarray, unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The candidate pairs (of rows first[i] and second[j]) whose cosine in double precision is `least` or more."""
    a, b = np.nonzero(candidates)
    if len(a) > DENSE * candidates.size:
        cosine = (unit[first] @ unit[second].T)[a, b]
    else:
        cosine = np.concatenate([np.einsum("ij,ij->i", unit[first[a[at : at + 8192]]], unit[second[b[at : at + 8192]]]) for at in range(0, len(a), 8192)] or [np.empty(0)])
    near = cosine >= least - 1e-12
    a, b, cosine = first[a[near]], second[b[near]], cosine[near]
    hit = _linked(raw[a], raw[b], cosine, least)
    return a[hit], b[hit]


def _units(rows: pd.Series, stored: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.stack([np.frombuffer(x, stored) for x in rows]).astype(float)
    # scaled first, so that the norm of tiny or huge components is right
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw, raw / np.linalg.norm(raw, axis=1, keepdims=True)


def link(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, n_links, component_id and kept for each row of vectors."""
    spark = vectors.sparkSession
    ship(spark)
    value = F.col(column).cast("array<double>")
    whole = F.coalesce(
        F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0), F.lit(False)
    )
    rows = vectors.select(F.col(key).alias("id"), F.when(whole & F.col(key).isNotNull(), value).alias("v"))
    classes = cut(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    widths = [r["w"] for r in classes.select(F.size("v").alias("w")).distinct().collect()]
    stored = "<f4" if dict(vectors.dtypes)[column] == "array<float>" else "<f8"
    found = [_index(classes.where(F.size("v") == w), stored, least) for w in sorted(widths)]
    if found:
        local = found[0]
        for more in found[1:]:
            local = local.unionByName(more)
        local = cut(local)
    else:
        local = cut(spark.createDataFrame([], "id long, links long, root long"))
    links = local.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(local.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    told = cut(
        classes.join(links.withColumnRenamed("id", "rep"), "rep", "left")
        .join(groups.withColumnRenamed("id", "rep"), "rep", "left")
        .select("v", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    return attach(rows, told, "v", "n").select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").cast("long").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"),
    )


def _index(classes: DataFrame, stored: str, least: float) -> DataFrame:
    """id, links, root of each class of one vector length in each block where it has a link."""
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("rep", "v").collect()
    seen = np.array([r["v"] for r in sorted(sample, key=lambda r: r["rep"])], float)
    seen = seen / np.abs(seen).max(axis=1, keepdims=True)
    many = max(32, min(int(6 * math.sqrt(n)), PIVOT_BYTES // (4 * seen.shape[1])))
    described = cut(_described(classes, choose_pivots(seen, many).astype(np.float32), stored))
    listed = described.select("rep", "n", "raw", "list", F.explode(F.slice("prefix", 1, LISTED)).alias("pivot"))
    # one row for each pivot: the blocks of its list
    sizes = listed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    lists = (
        listed.join(F.broadcast(sizes), "pivot")
        .select("pivot", "rep", "n", "raw", "list", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("pivot", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", F.col("rep").alias("id"), "n", "raw", "list")
    )

    def linked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pivot, low, high = key
        rows = rows.sort_values("id")
        raw, unit = _units(rows["raw"], stored)
        prefix = np.stack([np.frombuffer(x, "<i4") for x in rows["list"]])
        own, many, ids = rows["own"].to_numpy(), rows["n"].to_numpy(), rows["id"].to_numpy()
        first, second = np.nonzero(own == low)[0], np.nonzero(own == high)[0]
        candidates = retrieved(prefix[first], prefix[second])
        if low == high:
            candidates = np.triu(candidates, 1)
        a, b = verified(first, second, candidates, raw, unit, least)
        mine = np.zeros(len(a), bool)
        for at in range(0, len(a), 8192):  # exact counts, and the one list that a pair is taken in
            count, weight, listed = shared(prefix[a[at : at + 8192]], prefix[b[at : at + 8192]])
            mine[at : at + 8192] = (listed == pivot) & (count >= LEAST_SHARED) & (weight >= LEAST_WEIGHT)
        i, j = a[mine], b[mine]
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        np.add.at(links, i, many[j])
        np.add.at(links, j, many[i])
        while True:  # least index reachable inside the block
            before = root.copy()
            np.minimum.at(root, i, root[j])
            np.minimum.at(root, j, root[i])
            root = root[root]
            if (before == root).all():
                break
        some = links > 0
        return pd.DataFrame({"id": ids[some], "links": links[some], "root": ids[root[some]]})

    return lists.groupBy("pivot", "low", "high").applyInPandas(linked, "id long, links long, root long")


def _described(classes: DataFrame, pivots: np.ndarray, stored: str) -> DataFrame:
    """rep, n, raw components and prefix (as an array and as bytes) of each class."""
    sent = classes.sparkSession.sparkContext.broadcast(pivots)
    step = max(16, min(1024, 4_000_000 // len(pivots)))

    def described(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                given = np.array(part.column(2).to_pylist(), "<f8")
                raw = given / np.abs(given).max(axis=1, keepdims=True)
                near = prefixes(raw / np.linalg.norm(raw, axis=1, keepdims=True), sent.value, PREFIX)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([x.tobytes() for x in given.astype(stored)], pa.binary()), pa.array([x.astype("<i4").tobytes() for x in near], pa.binary()), pa.array(list(near), pa.list_(pa.int32()))],
                    ["rep", "n", "raw", "list", "prefix"],
                )

    return classes.select("rep", "n", "v").mapInArrow(described, "rep long, n long, raw binary, list binary, prefix array<int>")
