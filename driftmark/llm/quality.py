"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown on the driver from a bounded sample of labelled rows (`most_rows`, by a
hash of doc_id), on statistics binned to at most 64 quantiles, and flattened into arrays of
nodes; scoring walks all trees of a batch at once with numpy. Inputs are statistics of the
whole text alone.

Defined results: null or empty text -> the score of the statistics of an empty text; no
usable label -> 0.5 everywhere; a doc_id labelled more than once counts by its least label,
null labels not at all; of a labelled doc_id's rows one is learnt from; repeated rows each get a row; an empty table none.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.rows import with_text_columns

BINS = 64
MARKS = "!?.,;:|#$%&*@=+-_/<>{}[]()'\""


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text that the trees look at."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    words = text.split()
    w = max(1, len(words))
    distinct = Counter(words)
    runs = set(zip(words, words[1:], words[2:], strict=False))
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    marked = sum(1 for x in words if not x[-1].isalnum())
    pure = sum(1 for x in words if x.isalpha())
    packed = zlib.compress(raw, 1)
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        upper / n,
        upper / max(1, upper + lower),
        digit / n,
        counts[128:].sum() / n,
        counts[32] / n,
        counts[10] / n,
        lengths.mean(),
        lengths.std(),
        lengths.max(),
        len(distinct) / w,
        max(distinct.values(), default=0) / w,
        len(runs) / max(1, len(words) - 2),
        len(set(lines)) / len(lines),
        len(raw) / len(lines),
        marked / w,
        pure / w,
        sum(1 for x in words if x.isupper() and len(x) > 1) / w,
        len(packed) / n,
        *(counts[ord(c)] / n for c in MARKS),
        counts[33:48].sum() / n,
        (counts > 0).sum() / min(n, 256),
    ]


class Trees:
    """Boosted trees flattened into arrays, one row for each tree; node 2i + 1 and 2i + 2 follow node i."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, depth: int):
        self.base, self.feature, self.cut, self.value, self.depth = base, feature, cut, value, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        out = np.full(len(x), self.base)
        if len(self.feature):
            tree = np.arange(len(self.feature))[None, :]
            node = np.zeros((len(x), len(self.feature)), np.int64)
            for _ in range(self.depth):
                right = np.take_along_axis(x, self.feature[tree, node], 1) > self.cut[tree, node]
                node = 2 * node + 1 + right
            out = out + self.value[tree, node].sum(1)
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))

    @classmethod
    def constant(cls) -> Trees:
        return cls(0.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)), 0)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, least: int = 5, ridge: float = 1.0) -> Trees:
        """Newton boosting of the logistic loss over histograms of gradients."""
        if not len(y):
            return cls.constant()
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(width)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(width)], 1)
        flat = binned + np.arange(width) * BINS
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        base = float(np.log(share / (1 - share)))
        nodes = 2 ** (depth + 1) - 1
        feature, cut_at, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
        margin = np.full(n, base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                first, many = 2**level - 1, 2**level
                key = ((node - first)[:, None] * (width * BINS) + flat).ravel()
                size = many * width * BINS
                hist = [np.bincount(key, np.repeat(v, width), size).reshape(many, width, BINS) for v in (g, h, np.ones(n))]
                left = [v.cumsum(2)[:, :, :-1] for v in hist]
                total = [v.sum(2, keepdims=True) for v in hist]
                right = [a - b for a, b in zip(total, left, strict=True)]
                gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
                gain[(left[2] < least) | (right[2] < least)] = -1
                best = gain.reshape(many, -1).argmax(1)
                for i in range(many):
                    j, b = divmod(int(best[i]), BINS - 1)
                    if gain[i, j, b] > 1e-6 and b < len(edges[j]):
                        feature[t, first + i], cut_at[t, first + i] = j, edges[j][b]
                node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut_at[t, node])
            first = 2**depth - 1
            sums = [np.bincount(node - first, v, 2**depth) for v in (g, h)]
            value[t, first:] = rate * sums[0] / (sums[1] + ridge)
            margin += value[t, node]
        return cls(base, feature, cut_at, value, depth)


def fit(docs: DataFrame, labels: DataFrame, training: Column, most_rows: int = 12_000) -> Trees:
    """Trees from the labelled rows that `training` (over doc_id) holds for, at most `most_rows` of them."""
    h = F.xxhash64(F.col("doc_id"), F.lit("quality"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & training)
    # the sample is bounded by most_rows, and so is what the join below broadcasts
    some = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("__dm_label")).orderBy(h, "doc_id").limit(most_rows)
    # a repeated doc_id counts once, by the text of least hash, so that most_rows bounds the rows, not only the ids
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "__dm_label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    wanted = with_text_columns(sample, lambda texts: list(zip(*map(_row, texts), strict=True)) or _none(), {f"s{i}": "double" for i in range(len(_row("")))}, ["__dm_label", "doc_id"])
    rows = sorted(tuple(r) for r in wanted.collect())
    if not rows:
        return Trees.constant()
    table = np.array([[r[0], *r[2:]] for r in rows], float)
    return Trees.fit(table[:, 1:], table[:, 0])


def _row(text: str | None) -> list[float]:
    return [float(v) for v in statistics(text)]


def _none() -> list[list[float]]:
    return [[] for _ in _row("")]


def score(docs: DataFrame, trees: Trees, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns `keep` of docs (all by default) with the score of each whole text."""

    def scored(texts: list[str | None]) -> list[np.ndarray]:
        out = [trees.score(np.array([statistics(t) for t in texts[a : a + 2048]], float)) for a in range(0, len(texts), 2048)]
        return [np.concatenate(out) if out else np.empty(0)]

    return with_text_columns(docs, scored, {name: "double"}, keep)


def accepted(docs: DataFrame, trees: Trees, least: float = 0.5) -> DataFrame:
    """The rows of docs, unchanged, with a score of at least `least`."""
    return score(docs, trees, name="__dm_score").where(F.col("__dm_score") >= least).drop("__dm_score")
