"""Language identification by bit-sliced Bloom filters of n-grams.

Tables of bit masks hold the filters of all languages, 64 in each: bit l % 64 of a slot of table
l // 64 belongs to language l, so one look-up of a gram's slots, and-ed together, gives every language that
contains it. A text's count for a language is the popcount of that bit over its grams, less
what the filter's fill makes false positives of.

The filters are learnt from the whole texts of a bounded sample: at most `per_language` documents of each language, by
a hash of doc_id. Their grams are counted, compared between languages and turned into masks on the executors;
what reaches the driver is the filters alone. Tables have SPACE slots or more for each gram of the language
that has most, as far as FILTER_BYTES allow; fuller filters are corrected for all the same. Predictions read whole
texts, and nothing but texts.

Defined results: null text, or text without a letter (marks and digits alone are none) -> `und` with score 0; letters but no
known gram -> the language that most rows have, score 0; equal counts -> the earlier name; no
labelled row at all -> `und` everywhere; of the rows of a repeated doc_id in a language one is learnt from; repeated rows each get a row; empty tables none.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.llm.rows import with_text_columns
from driftmark.plans.cluster import cut, ship

UNKNOWN = "und"
ORDERS = (3, 4)
HASHES = 3
#: Slots of a table for each gram of the language that has most, and log2 of the fewest.
SPACE, LEAST_BITS = 8, 12
#: Bytes of all tables together, which are sent to every task.
FILTER_BYTES = 256_000_000
#: Languages that a slot of a table has bits for.
WORD = 64
#: A language has a gram if its share there is at least this part of the gram's largest share.
LEAST_PART = 0.1
#: Code points whose grams are held at once.
CHUNK = 1 << 18


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter or a mark on one."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def grams(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hashes of all grams of the lower-cased words of texts, and whose they are.

    Anything but letters is one space; texts are flanked by spaces.
    """
    codes = [np.frombuffer(f" {(t or '').lower()} ".encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    line = np.concatenate(codes) if codes else np.empty(0, np.uint32)
    letter = letters()[line]
    begins = np.ones(len(line), bool)
    begins[1:] = owner[1:] != owner[:-1]
    kept = letter | begins
    kept[1:] |= letter[:-1]
    line, owner = np.where(letter, line, 32)[kept].astype(np.uint64), owner[kept]
    out = []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            size = max(0, len(line) - n + 1)
            h = np.full(size, n, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + line[i : i + size]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            same = owner[:size] == owner[n - 1 : n - 1 + size]
            out.append((h[same], owner[:size][same]))
    return out


def chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of at most CHUNK code points, or single longer texts."""
    part, chars = [], 0
    for t in texts:
        if part and chars + len(t or "") > CHUNK:
            yield part
            part, chars = [], 0
        part.append(t)
        chars += len(t or "")
    if part:
        yield part


def counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the distinct grams of texts and how often they occur."""
    out = [(np.empty(0, np.uint64), np.empty(0, np.int64)) for _ in ORDERS]
    for part in chunks(texts):
        for i, (h, _) in enumerate(grams(part)):
            new, n = np.unique(h, return_counts=True)
            every, at = np.unique(np.concatenate([out[i][0], new]), return_inverse=True)
            out[i] = every, np.bincount(at, np.concatenate([out[i][1], n]), len(every)).astype(np.int64)
    return out


def places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The slots of grams in tables of 2 ** bits."""
    mask = np.uint64((1 << bits) - 1)
    step = h >> np.uint64(40) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [(h + np.uint64(i) * step & mask).astype(np.int64) for i in range(HASHES)]


class Filters:
    """The filters of any number of languages; slots has a row for each table of WORD languages."""

    def __init__(self, languages: list[str], slots: np.ndarray, fallback: int):
        self.languages, self.slots, self.fallback = languages, slots, fallback
        self.bits = slots.shape[1].bit_length() - 1
        fill = np.array([((slots[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)).mean() for i in range(len(languages))])
        self.false = fill**HASHES

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """Corrected part of each text's grams that each language has; -1 for texts without a letter."""
        counts, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for h, owner in grams(texts):
            at = places(h, self.bits)
            total += np.bincount(owner, minlength=len(texts))
            for first, slots in zip(range(0, len(self.languages), WORD), self.slots, strict=True):
                mask = np.full(len(h), np.uint64(0xFFFFFFFFFFFFFFFF))
                for place in at:
                    mask &= slots[place]
                for i in range(first, min(first + WORD, len(self.languages))):
                    counts[:, i] += np.bincount(owner[(mask >> np.uint64(i - first) & np.uint64(1)).astype(bool)], minlength=len(texts))
        part = counts / np.maximum(total, 1)[:, None]
        part = np.clip((part - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)
        part[[not has_letter(t) for t in texts]] = -1
        return part

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text, its grams taken in chunks of bounded size."""
        names, scores = [], []
        for chunk in chunks(texts):
            part = self.shares(chunk) if self.languages else np.full((len(chunk), 1), -1.0)
            for row in part:
                if row[0] < 0:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                best = int(row.argmax()) if row.max() > 0 else self.fallback
                names.append(self.languages[best])
                scores.append(float(row[best]))
        return names, np.array(scores)


def sampled(docs: DataFrame, training: Column, per_language: int) -> tuple[DataFrame, dict[str, int]]:
    """(lang, text) of at most `per_language` documents of each language that `training` holds for, and each language's rows."""
    known = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    told = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("doc_id").alias("ids")).collect()
    rows = {r["lang"]: r["n"] for r in told}
    if not rows:
        return known.select("lang", "text"), rows
    # about twice the wanted part of each language by hash, then the least hashes of that small rest
    parts = F.create_map(*[x for r in told for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * per_language / max(1, r["ids"]))))])
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 30))
    some = known.where(h < parts[F.col("lang")] * (1 << 30)).select("lang", "doc_id", "text", h.alias("h"))
    # one row of each id before rows are ranked: many rows of one id share a hash
    single = some.groupBy("lang", "h", "doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return single.withColumn("n", first).where(F.col("n") <= per_language).select("lang", "text"), rows


def _counts(sample: DataFrame) -> DataFrame:
    """(lang, size, gram, n): how often each gram occurs in the texts of each language."""

    def told(batches):
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                for size, (h, n) in zip(ORDERS, counted(own), strict=True):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(h), pa.string()), pa.array([size] * len(h), pa.int32()), pa.array(h.view(np.int64)), pa.array(n)], ["lang", "size", "gram", "n"]
                    )

    return sample.mapInArrow(told, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def members(sample: DataFrame) -> DataFrame:
    """(lang, gram): the grams that a language's filter holds.

    A language has a gram if its share there is LEAST_PART of the gram's largest share or more, and it isn't a
    single find where another language has more.
    """
    counts = cut(_counts(sample))
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), ["lang", "size"]).withColumn("share", F.col("n") / F.col("total"))
    best = shares.groupBy("size", "gram").agg(F.max("share").alias("most"), F.max("n").alias("often"), F.collect_list(F.struct("lang", "n", "share")).alias("all"))
    each = best.select("gram", "most", "often", F.explode("all").alias("one")).select("gram", "most", "often", "one.*")
    return each.where((F.col("share") >= LEAST_PART * F.col("most")) & (F.col("n") >= F.least(F.lit(2), F.col("often")))).select("lang", "gram")


def fit(docs: DataFrame, training: Column, per_language: int = 1000) -> Filters:
    """Filters learnt from the rows that `training` holds for and whose lang is not null."""
    ship(docs.sparkSession)
    sample, rows = sampled(docs, training, per_language)
    if not rows:
        return Filters([], np.zeros((0, 1), np.uint64), 0)
    languages = sorted(rows)
    tables = -(-len(languages) // WORD)
    held = cut(members(sample))
    largest = held.groupBy("lang").count().agg(F.max("count").alias("n")).first()["n"] or 1
    most_bits = (FILTER_BYTES // (8 * tables)).bit_length() - 1
    bits = max(LEAST_BITS, min((SPACE * largest - 1).bit_length(), most_bits))
    index = {x: i for i, x in enumerate(languages)}

    def masked(batches):
        for batch in batches:
            at = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            for slot in places(batch.column(1).to_numpy().view(np.uint64), bits):
                key, back = np.unique((at // WORD << bits) + slot, return_inverse=True)
                mask = np.zeros(len(key), np.uint64)
                np.bitwise_or.at(mask, back, np.uint64(1) << (at % WORD).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(mask.view(np.int64))], ["slot", "mask"])

    # at most FILTER_BYTES of masks
    found = held.select("lang", "gram").mapInArrow(masked, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    slots = np.zeros(tables << bits, np.uint64)
    slots[found.column("slot").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    fallback = max(range(len(languages)), key=lambda i: (rows[languages[i]], -i))
    return Filters(languages, slots.reshape(tables, 1 << bits), fallback)


def predict(docs: DataFrame, filters: Filters, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs (all by default) with the language and score of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    return with_text_columns(docs, lambda texts: sent.value.predict(texts), dict(zip(names, ("string", "double"), strict=True)), keep)


def identified(docs: DataFrame, filters: Filters, least_score: float = 0.2) -> DataFrame:
    """The rows of docs, unchanged, whose text is in a learnt language with at least that score."""
    name, score = "__dm_lang", "__dm_score"
    told = predict(docs, filters, names=(name, score))
    return told.where((F.col(name) != UNKNOWN) & (F.col(score) >= least_score)).drop(name, score)
