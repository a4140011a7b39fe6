"""MinHash near-duplicates with odd sketches.

A document's set is its distinct shingles of some words. Equal sets become one class. Of
each class, MinHash samples are banded into buckets and folded into an odd sketch, a bitmap
in which every sample flips one bit: the population count of the XOR of two sketches tells
how many samples differ, and so how similar the sets are. Candidates are pairs that share a
bucket; those whose sketches make the threshold implausible are dropped, the rest are
confirmed on the full sets, as whole numbers.

Buckets are never expanded into all pairs. First every class is held against the leader
(the class of most copies, then of least id) of each of its buckets, of which it keeps the
best by sketch; confirmed links give groups. Then only buckets that still hold several
groups are looked at, and there only classes outside the bucket's main group are held
against its members, on full sets and in blocks. So groups are those of the links between
all classes that share a bucket, while no step gives a row for each pair. Two sets of similarity 0.8 share one with probability
0.99995 (25 bands of 5).

Defined results: text without words, or null -> empty set, linked with nothing; fewer words
than a shingle -> the whole sequence is the one shingle; rows of a null id are linked with
nothing; repeated rows are copies; an empty table gives no rows; columns besides those named
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.plans.cluster import attach, cut, release, ship
from driftmark.plans.components import components

BANDS, ROWS = 25, 5
SKETCH_WORDS = 8
#: How far below the threshold a sketch's estimate may lie: 6 standard deviations at 0.8.
MARGIN = 0.25
MEMO = 200_000
#: Outsiders and members of a block, on average, and the shingles that it looks at at once.
OUTSIDERS, MEMBERS, COLUMNS = 64, 96, 16_384
#: Confirmed pairs that a task gives up at once.
KEPT = 10_000


@lru_cache(1)
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    draw = lambda: rng.integers(0, 2**64, BANDS * ROWS, np.uint64)
    return draw() | np.uint64(1), draw()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class _Words(dict):
    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_words = _Words()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text."""
    # bytes: lower() turns A-Z alone, split() parts at space and 0x09 to 0x0D alone
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = mixed(np.fromiter(map(_words.__getitem__, found), np.uint64, len(found)))
    size = min(words, len(h))
    many = len(h) - size + 1
    out = np.full(many, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + many])
    return np.unique(out)


def samples(found: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that isn't empty."""
    a, b = _hashes()
    out = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 2048):
            np.minimum(out, (found[at : at + 2048, None] * a + b).min(axis=0), out=out)
    return out


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Bitmap of SKETCH_WORDS 64-bit words in which each (position, sample) flips a bit."""
    with np.errstate(over="ignore"):
        bit = mixed(sample + np.arange(len(sample), dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - int(math.log2(64 * SKETCH_WORDS)))
    odd = np.bincount(bit.astype(np.int64), minlength=64 * SKETCH_WORDS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8")


def similarity(differing_bits: float) -> float:
    """Estimated similarity of two sets from the population count of their sketches' XOR."""
    bits = 64 * SKETCH_WORDS
    inside = 1 - 2 * differing_bits / bits
    return 1.0 + bits / 2 * math.log(inside) / (2 * BANDS * ROWS) if inside > 0 else 0.0


def most_differing(least: float) -> int:
    """The largest population count whose estimate reaches `least`."""
    return max(n for n in range(32 * SKETCH_WORDS) if similarity(n) >= least)


def _described(docs: DataFrame, words: int) -> DataFrame:
    """id, n_shingles, and for sets that aren't empty: key of the set, buckets, sketch."""

    def described(batches):
        for batch in batches:
            sizes, keys, buckets, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, words)
                sizes.append(len(found))
                if not len(found):
                    keys.append(None), buckets.append(None), sketches.append(None)
                    continue
                sample = samples(found)
                banded = np.zeros(BANDS, np.uint64)
                with np.errstate(over="ignore"):
                    for i in range(ROWS):
                        banded = mixed(banded * np.uint64(0x9E3779B97F4A7C15) + sample[i::ROWS] + np.uint64(i))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                buckets.append(banded.view(np.int64))
                sketches.append(odd_sketch(sample).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, longs), pa.array(sketches, longs)],
                ["id", "n_shingles", "key", "buckets", "sketch"],
            )

    lean = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return lean.mapInArrow(described, "id long, n_shingles long, key binary, buckets array<long>, sketch array<long>")


def _differing(a: str, b: str):
    """Population count of the XOR of two sketch columns."""
    total = F.lit(0)
    for i in range(SKETCH_WORDS):
        total = total + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return total


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets have 100 * intersection >= percent * union.

    The many a of a b are dealt into parts of about MEMBERS. Texts, which are smaller than sets, meet them by their ids, a join
    that adaptive execution can split, and are then dealt by part: that of an a once, that of a b once for each of its parts.
    """
    pairs = cut(pairs.select("a", "b"))
    many = cut(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts")))
    part = F.pmod(F.xxhash64("a"), F.col("parts"))
    sides = pairs.join(many, "b").select(F.col("a").alias("__dm_id"), "b", part.alias("part"), F.lit(True).alias("asks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    sides = sides.unionByName(many.select(F.col("b").alias("__dm_id"), "b", every.alias("part"), F.lit(False).alias("asks")))
    texts = docs.select(F.col("doc_id").cast("long").alias("__dm_id"), "text").where("__dm_id is not null")
    met = texts.join(sides, "__dm_id").select("b", "part", "asks", "__dm_id", "text")
    placed = met.repartition("b", "part").sortWithinPartitions("b", "part", "asks", "__dm_id")

    def sets(batches):
        """Each row's key and set; an id of several rows stands for the least of their sets."""
        last, least = None, b""
        for batch in batches:
            for *key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = shingles(text, words).tobytes()
                if key == last:
                    least = min(least, found)
                    continue
                if last is not None:
                    yield last, np.frombuffer(least, np.uint64)
                last, least = key, found
        if last is not None:
            yield last, np.frombuffer(least, np.uint64)

    def held(batches):
        at, y, kept = None, np.empty(0, np.uint64), []
        for (b, part, asks, a), x in sets(batches):
            if not asks:
                at, y = (b, part), x
                continue
            common = len(np.intersect1d(x, y, assume_unique=True)) if at == (b, part) else 0
            if common > 0 and 100 * common >= percent * (len(x) + len(y) - common):
                kept.append((a, b))
            if len(kept) == KEPT:
                yield _pairs(kept)
                kept = []
        yield _pairs(kept)

    return cut(placed.mapInArrow(held, "a long, b long"))


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])


def _members(classes: DataFrame) -> DataFrame:
    """(band, bucket, rep, leader): each class in each bucket that holds several, and the bucket's leader."""
    dealt = classes.select("rep", "copies", F.posexplode("buckets").alias("band", "bucket"))
    first = F.max(F.struct("copies", (-F.col("rep")).alias("least")))
    leads = cut(dealt.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), first.alias("lead")).where("n > 1").select("band", "bucket", (-F.col("lead.least")).alias("leader")))
    return cut(dealt.join(leads, ["band", "bucket"]).select("band", "bucket", "rep", "leader"))


def _best(members: DataFrame, classes: DataFrame, limit: int) -> DataFrame:
    """(a, b): each class and the leader of one of its buckets whose sketch differs least, if by `limit` bits at most."""
    sketch = lambda c, name: classes.select(F.col("rep").alias(c), F.col("sketch").alias(name))
    met = members.where("rep != leader").select("rep", "leader").distinct().join(sketch("rep", "x"), "rep").join(sketch("leader", "y"), "leader")
    near = met.select("rep", "leader", _differing("x", "y").alias("differing")).where(F.col("differing") <= limit)
    best = near.groupBy("rep").agg(F.min(F.struct("differing", "leader")).alias("best"))
    return best.select(F.col("rep").alias("a"), F.col("best.leader").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs; ids are whole numbers.

    Rows with the same id count as one document if their texts are equal; ids are otherwise
    expected to be distinct (`deduplicated` makes them so).
    """
    ship(docs.sparkSession)
    if (kind := dict(docs.dtypes)["doc_id"]) not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id must be a whole number, not {kind}")
    described, told = _grouped(docs, words, percent)
    release(docs.sparkSession)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return attach(described.select("id", "n_shingles", "key"), told, "key", "copies").select(
        F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )


def _grouped(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """What `_described` gives of each row, and for each class its key, component and number of copies."""
    limit = most_differing(percent / 100 - MARGIN)
    described = cut(_described(docs, words))
    named = described.where(F.col("key").isNotNull() & F.col("id").isNotNull())
    classes = cut(named.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("buckets").alias("buckets"), F.first("sketch").alias("sketch")))
    members = _members(classes)
    groups = components(confirm(_best(members, classes, limit), docs, words, percent))
    release(docs.sparkSession)
    more = _across(members, cut(groups), docs, words, percent)
    if more is not None:
        groups = components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    told = cut(classes.select("key", "rep", "copies").join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"), "copies"))
    return described, told


def _across(members: DataFrame, groups: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Links (a, b) across groups of classes that share a bucket; None if all buckets hold one group.

    A bucket's main group is its leader's. The outsiders of a main group (members of its
    buckets that are in another group) are held against all members of those buckets on
    their full sets, in blocks of about OUTSIDERS x MEMBERS, so that a block has few rows
    and gives one row at most for an outsider and a group.
    """
    known = lambda c, name: groups.select(F.col("id").alias(c), F.col("component").alias(name))
    grouped = members.join(known("rep", "own"), "rep", "left").withColumn("own", F.coalesce("own", "rep"))
    grouped = cut(grouped.join(known("leader", "main"), "leader", "left").select("band", "bucket", "rep", "own", F.coalesce("main", "leader").alias("main")))
    several = cut(grouped.where("own != main").select("band", "bucket").distinct())
    if several.isEmpty():
        return None
    held = cut(grouped.join(several, ["band", "bucket"]).select("main", "rep", "own").distinct())
    sizes = cut(held.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("ms"), F.ceil(F.count_if(F.col("own") != F.col("main")) / OUTSIDERS).alias("os")))
    sized = held.join(sizes, "main")
    place = lambda seed, many: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(many))
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1))
    rows = sized.select("main", "rep", "own", place("m", "ms").alias("m"), every("os").alias("o"), F.lit(False).alias("asks"))
    rows = rows.unionByName(sized.where("own != main").select("main", "rep", "own", place("o", "os").alias("o"), every("ms").alias("m"), F.lit(True).alias("asks")))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")

    def sets(batches):
        for batch in batches:
            found = [shingles(t, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "found"])

    # each set is worked out once, whatever blocks it is sent to
    wanted = held.select(F.col("rep").alias("id")).distinct()
    once = cut(texts.join(wanted, "id").mapInArrow(sets, "id long, found binary").groupBy("id").agg(F.min("found").alias("found")))
    met = rows.withColumnRenamed("rep", "id").join(once, "id").select("main", "o", "m", "id", "own", "asks", "found")

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["asks", "id"], kind="stable").drop_duplicates(["asks", "id"])
        asking, other = rows[rows["asks"]], rows[~rows["asks"]]
        x, y = ([np.frombuffer(f, np.uint64) for f in part["found"]] for part in (asking, other))
        common, a, b = common_counts(x, y), np.array([len(v) for v in x]), np.array([len(v) for v in y])
        hit = (common > 0) & (100 * common >= percent * (a[:, None] + b[None, :] - common))
        hit &= asking["own"].to_numpy()[:, None] != other["own"].to_numpy()[None, :]
        i, j = np.nonzero(hit)
        out = pd.DataFrame({"a": asking["id"].to_numpy()[i], "b": other["id"].to_numpy()[j], "own": other["own"].to_numpy()[j]})
        return out.drop_duplicates(["a", "own"])[["a", "b"]]

    return cut(met.groupBy("main", "o", "m").applyInPandas(linked, "a long, b long"))


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of x with each of y, by products of 0/1 matrices of bounded width."""
    out = np.zeros((len(x), len(y)), np.int64)
    if not x or not y:
        return out
    every = np.unique(np.concatenate(x))
    every = every[np.isin(every, np.unique(np.concatenate(y)), assume_unique=True)]
    for at in range(0, len(every), COLUMNS):
        part = every[at : at + COLUMNS]
        seen = []
        for sets in (x, y):
            table = np.zeros((len(sets), len(part)), np.float32)
            for row, found in zip(table, sets, strict=True):
                low, high = np.searchsorted(found, part[0]), np.searchsorted(found, part[-1], "right")
                place = np.searchsorted(part, found[low:high])
                row[place[part[place] == found[low:high]]] = 1
            seen.append(table)
        out += np.rint(seen[0] @ seen[1].T).astype(np.int64)
    return out


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, unchanged, of one document of each group: that of the least id; rows of a null id all stay.

    Documents are told apart by id and text, so that one id may have several texts, and ids may be of any type. Of rows
    equal in both one stays.
    """
    uid = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    named = docs.where("doc_id is not null").withColumn("__dm_uid", uid)
    found = near_duplicates(named.select(F.col("__dm_uid").alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias("__dm_uid"), "component_id").distinct()
    ids = named.select("doc_id", "__dm_uid").distinct().join(found, "__dm_uid")
    kept = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "__dm_uid")).alias("least")).select("least.__dm_uid")
    stays = named.join(kept, "__dm_uid", "left_semi").dropDuplicates(["__dm_uid"]).drop("__dm_uid")
    return stays.unionByName(docs.where("doc_id is null"))
