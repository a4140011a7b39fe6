"""Nearest rows by blocks: queries held by every task, references read once, the best k of each query kept as they pass.

A task keeps k rows for each query it holds and gives them up at its end, so what is shuffled is
queries x k x tasks, however many references a task reads. Queries, with the groups of references
that each asks for, are held at most `most` rows at a time; more are taken block after
block, each written to the shared folder, so that neither the driver nor a task ever holds more than one of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.operators.common import BROADCAST_ROWS, nearest
from driftmark.plans.cluster import shared_folder, ship

#: Distances computed at once: queries x references of a block.
BLOCK_CELLS = 4_000_000
KINDS = {"long": np.int64, "double": np.float64, "float": np.float32}


def in_order(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of q and v, each summed over the dimensions from left to right in their precision."""
    total = np.zeros((len(q), len(v)), q.dtype)
    for i in range(q.shape[1]):
        step = q[:, i : i + 1] - v[None, :, i]
        total += step * step
    return total


def around(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """About the same as one product, how far each row of that may be off, and the part by which sums in the precision of q may be."""
    x, y = q.astype(np.float64), v.astype(np.float64)
    a, b = (x * x).sum(1), (y * y).sum(1)
    steps = q.shape[1] + 4
    off = 8 * steps * np.finfo(np.float64).eps * (a + b.max()) + 4 * steps * np.finfo(q.dtype).tiny
    return a[:, None] + b - 2 * (x @ y.T), off, 2 * steps * float(np.finfo(q.dtype).eps)


def of_pairs(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """As `in_order`, of each row of q and the row of v at its place."""
    total = np.zeros(len(q), q.dtype)
    for i in range(q.shape[1]):
        step = q[:, i] - v[:, i]
        total += step * step
    return total


def of_integers(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The same of quantized vectors as one product; sums of 14 squares of such integers are exact in double precision."""
    return ((q * q).sum(1)[:, None] + (v * v).sum(1) - 2 * (q @ v.T)).astype(np.int64)


class Best:
    """The k best rows of each of n queries, by distance and two more keys; each with a reference's id and label."""

    def __init__(self, n: int, k: int, kind: str):
        self.far = np.iinfo(np.int64).max if kind == "long" else np.inf
        self.dist = np.full((n, k), self.far, KINDS[kind])
        self.keys = np.full((2, n, k), np.iinfo(np.int64).max)
        self.told = np.zeros((2, n, k), np.int64)

    def take(self, i: np.ndarray, dist: np.ndarray, keys: list[np.ndarray], told: list[np.ndarray]) -> None:
        """Rows for the queries i, any number for each."""
        k = self.dist.shape[1]
        order = np.lexsort((keys[1], keys[0], dist, i))
        i = i[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        near = place < k
        order, i, place = order[near], i[near], place[near]
        some, at = np.unique(i, return_inverse=True)
        new = Best(len(some), k, next(n for n, t in KINDS.items() if t == self.dist.dtype))
        new.dist[at, place] = dist[order]
        for mine, given in ((new.keys, keys), (new.told, told)):
            for j in (0, 1):
                mine[j, at, place] = given[j][order]
        both = np.concatenate([self.dist[some], new.dist], 1)
        keyed, telling = (np.concatenate([a[:, some], b], 2) for a, b in ((self.keys, new.keys), (self.told, new.told)))
        first = np.lexsort((keyed[1], keyed[0], both), axis=1)[:, :k]
        self.dist[some] = np.take_along_axis(both, first, 1)
        self.keys[:, some] = np.take_along_axis(keyed, first[None], 2)
        self.told[:, some] = np.take_along_axis(telling, first[None], 2)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(self.dist != self.far)


def _by_product(best: Best, own: np.ndarray, q: np.ndarray, v: np.ndarray, place: np.ndarray, key: np.ndarray, label: np.ndarray, rank: np.ndarray, upto: np.ndarray | None, kth: np.ndarray | None) -> bool:
    """`compare` for `in_order`: a product and its error leave few pairs, and only these are summed in order; False, and nothing done, for numbers without such an error."""
    k = best.dist.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        dist, off, part = around(q, v)
    if not np.isfinite(dist).all() or not np.isfinite(off).all():
        return False
    if upto is not None:
        dist[place[None, :] >= upto[:, None]] = np.inf
    most = np.partition(dist, k - 1, axis=1)[:, k - 1]
    most = np.minimum((most + off) * (1 + part), best.dist[own, -1])
    if kth is not None:
        most = np.minimum(most, kth)
    i, j = np.nonzero((dist <= (most * (1 + 2 * part) + off)[:, None]) & (dist < np.inf))
    exact = of_pairs(q[i], v[j])
    near = exact <= (best.dist[own, -1] if kth is None else np.minimum(best.dist[own, -1], kth))[i]
    i, j, exact = i[near], j[near], exact[near]
    if len(i):
        best.take(own[i], exact, [rank[i], place[j]], [key[j], label[j]])
    return True


def compare(best: Best, at: np.ndarray, q: np.ndarray, v: np.ndarray, place: np.ndarray, key: np.ndarray, label: np.ndarray, rank: np.ndarray, upto: np.ndarray | None, distance: Callable, kth: np.ndarray | None = None) -> None:
    """Hold the queries q, whose places in best are `at`, against all rows v, or those before `upto`; what is beyond kth doesn't count."""
    k = best.dist.shape[1]
    step = max(1, BLOCK_CELLS // len(v))
    for a in range(0, len(q), step):
        own = at[a : a + step]
        if distance is in_order and len(v) > 4 * k and _by_product(best, own, q[a : a + step], v, place, key, label, rank[a : a + step], upto if upto is None else upto[a : a + step], kth if kth is None else kth[a : a + step]):
            continue
        dist = distance(q[a : a + step], v)
        near = dist <= best.dist[own, -1:]
        if kth is not None:
            near &= dist <= kth[a : a + step, None]
        if upto is not None:
            near &= place[None, :] < upto[a : a + step, None]
        if len(v) > 4 * k:  # only the k-th least and what ties with it can count
            limit = np.partition(np.where(near, dist, best.far), k - 1, axis=1)[:, k - 1 : k]
            near &= dist <= limit
        i, j = np.nonzero(near)
        if len(i):
            best.take(own[i], dist[i, j], [rank[a : a + step][i], place[j]], [key[j], label[j]])


def in_blocks(rows: DataFrame, most: int, search: Callable[[pd.DataFrame], DataFrame]) -> DataFrame:
    """search for all rows, at most about `most` at a time; rows of a qid stay together."""
    held = rows.limit(most + 1).toPandas()
    if len(held) <= most:
        return search(held)
    blocks = -(-rows.count() // most)
    folder = f"{shared_folder(rows.sparkSession)}/search-{uuid.uuid4().hex}"
    for b in range(blocks):
        search(rows.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toPandas()).write.parquet(f"{folder}/block={b}")
    return rows.sparkSession.read.parquet(folder).drop("block")


def scan(held: pd.DataFrame, references: DataFrame, unpack: Callable, groups: list[tuple], distance: Callable, k: int, kind: str) -> DataFrame:
    """(qid, scan_rank, place, id, label, dist): for each query the k nearest that a task saw.

    held: the queries' qid. groups: (name, places among queries, vectors, scan_rank, up to which place) of those that ask for a
    group; unpack(batch): (name, place, id, label, vectors) of the references of each group in a batch.
    """
    ship(references.sparkSession)
    qids = held["qid"].to_numpy(np.int64)
    asking = {name: rest for name, *rest in groups}

    def reduced(batches):
        best = Best(len(qids), k, kind)
        for batch in batches:
            for name, place, key, label, v in unpack(batch):
                if name not in asking or not len(v):
                    continue
                at, q, rank, upto = asking[name]
                compare(best, at, q, v, place, key, label, rank, upto, distance)
        i, j = best.rows()
        # in parts, so that no batch is larger than Arrow likes
        for a in range(0, len(i), 50_000):
            x, y = i[a : a + 50_000], j[a : a + 50_000]
            columns = [qids[x], best.keys[0, x, y], best.keys[1, x, y], best.told[0, x, y], best.told[1, x, y], best.dist[x, y]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["qid", "scan_rank", "place", "id", "label", "dist"])

    return references.mapInArrow(reduced, f"qid long, scan_rank long, place long, id long, label long, dist {kind}")


def _vectors(batch: pa.RecordBatch, first: int, width: int, dtype: type) -> np.ndarray:
    return np.stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(width)], 1).astype(dtype)


def in_groups(probes: DataFrame, references: DataFrame, group: str, asked: list[str], stored: list[str], dtype: type, distance: Callable, k: int, kind: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """(qid, scan_rank, pos, ref_id, fraud, dist): candidates among which each query's k nearest by (dist, scan_rank, pos) are.

    probes: (qid, group, scan_rank, asked..., and where only the first of a group count, upto). references: (group, ref_id, fraud, stored..., and
    pos, for which ref_id stands in where there is none: places follow it).
    """
    place = F.col("pos") if "pos" in references.columns else F.col("ref_id")
    lean = references.select(group, place.cast("long").alias("place"), "ref_id", "fraud", *stored)

    def unpack(batch):
        names, place, ids, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        v = _vectors(batch, 4, len(stored), dtype)
        order = np.lexsort((place, names))
        names, place, ids, label, v = names[order], place[order], ids[order], label[order], v[order]
        every, start = np.unique(names, return_index=True)
        ends = [*start[1:], len(names)]
        return [(n, place[a:b], ids[a:b], label[a:b], v[a:b]) for n, a, b in zip(every.tolist(), start, ends, strict=True)]

    def search(held: pd.DataFrame) -> DataFrame:
        qids, at = np.unique(held["qid"].to_numpy(np.int64), return_inverse=True)
        groups = []
        for name, rows in held.reset_index(drop=True).groupby(group, sort=False):
            upto = rows["upto"].to_numpy(np.int64) if "upto" in rows else None
            groups.append((name, at[rows.index.to_numpy()], rows[asked].to_numpy(dtype), rows["scan_rank"].to_numpy(np.int64), upto))
        return scan(pd.DataFrame({"qid": qids}), lean, unpack, groups, distance, k, kind)

    columns = ["qid", group, "scan_rank", *asked, *(["upto"] if "upto" in probes.columns else [])]
    found = in_blocks(probes.select(*columns), most, search)
    return found.select("qid", F.col("scan_rank").cast("int").alias("scan_rank"), F.col("place").alias("pos"), F.col("id").alias("ref_id"), F.col("label").cast("int").alias("fraud"), "dist")
