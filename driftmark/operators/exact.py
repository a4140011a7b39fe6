"""Exact nearest neighbours of a stated set of queries among all references."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.operators.blocks import in_blocks, in_order, of_integers, scan
from driftmark.operators.boxes import everywhere
from driftmark.operators.common import BROADCAST_ROWS, G, Q, V, nearest


def knn(queries: DataFrame, references: DataFrame, k: int = 5, most_queries: int = BROADCAST_ROWS) -> DataFrame:
    """(qid, ref_id, fraud, dist, rank): the k nearest by squared distance of quantized vectors; ties by ref_id."""
    return everywhere(queries, references, Q, V, np.float64, of_integers, k, "long", most_queries)


def knn_float(queries: DataFrame, references: DataFrame, k: int = 5, single: bool = False, most_queries: int = BROADCAST_ROWS) -> DataFrame:
    """As `knn` on the unquantized features, in double precision or, for `single`, with 32-bit sums."""
    dtype, kind = (np.float32, "float") if single else (np.float64, "double")
    return everywhere(queries, references, G, [f"f{i}" for i in range(14)], dtype, in_order, k, kind, most_queries)


def _by_width(rows: list) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors) of the vectors of each length."""
    widths = np.array([len(x) for x in rows], np.int64)
    return [(int(w), at, np.array([rows[i] for i in at], float)) for w in np.unique(widths) for at in [np.nonzero(widths == w)[0]] if w]


def knn_arrays(queries: DataFrame, vectors: DataFrame, k: int = 5, most_queries: int = BROADCAST_ROWS) -> DataFrame:
    """(qid, vec_id, label, dist, rank) for vectors in an `embedding` array column; those of other lengths, or null, are no neighbours."""
    vector = F.col("embedding").cast("array<double>")
    lean = vectors.select("vec_id", "label", vector.alias("v")).where("v is not null")

    def unpack(batch):
        ids, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        return [(w, ids[at], ids[at], label[at], v) for w, at, v in _by_width(batch.column(2).to_pylist())]

    def search(held: pd.DataFrame) -> DataFrame:
        groups = [(w, at, x, np.zeros(len(at), np.int64), None) for w, at, x in _by_width(list(held["x"]))]
        return scan(held, lean, unpack, groups, in_order, k, "double")

    found = in_blocks(queries.select("qid", vector.alias("x")).where("x is not null"), most_queries, search)
    label = F.col("label").cast(dict(vectors.dtypes)["label"])
    return nearest(found.select("qid", F.col("id").alias("vec_id"), label.alias("label"), "dist"), ["dist", "vec_id"], k)
