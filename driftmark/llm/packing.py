"""Best-fit packing by minimum bin slack.

The plan is made on the counts of piece lengths, at most `capacity` numbers however many
documents there are: for each bin a bitset subset-sum finds the fullest combination of
available lengths that holds the longest one left, and that combination is taken as often as
the counts allow. Every combination uses up a length or cuts its count below its own
multiple, so there are at most sum(1 + capacity / length) of them, about 18,000 at 2048:
that bounds the table sent to the tasks. Pieces then find their place by their rank among
the pieces of their length.

Defined results: null or empty text -> one piece of the closing id alone; documents of any
length are cut whole; equal rows get places of their own; an empty table gives no rows;
columns besides those named are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.bpe import byte_bpe
from driftmark.plans.cluster import cut, ranked, ship

CAPACITY = 2048
#: The id that closes each document.
CLOSING_ID = 0
#: Bits of a key that hold a rank; the length stands above.
RANK_BITS = 44


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but perhaps the first."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(a, capacity) for a in range(first, n, capacity)]


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of available lengths that fill the most of room; long ones are preferred."""
    mask = (1 << room + 1) - 1
    reach, steps = 1, []
    for length in lengths:
        n = min(counts[length], room // length)
        k = 1
        while n > 0:
            k = min(k, n)
            steps.append((length, k, reach))
            reach |= reach << k * length & mask
            n -= k
            k *= 2
        if reach >> room:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + k
            at -= k * length
    return list(taken.items())


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (key of length and first rank, first sequence, pieces in each sequence, offset), and the sequences used."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece is empty or longer than a sequence")
    given = dict.fromkeys(left, 0)
    lengths = sorted(left, reverse=True)
    rows, sequences = [], 0
    while left:
        longest = lengths[0]
        left[longest] -= 1
        combination = dict(fullest([x for x in lengths if x <= capacity - longest], left, capacity - longest))
        left[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(left[n] // k for n, k in combination.items())
        offset = 0
        for n, k in sorted(combination.items(), reverse=True):
            rows.append((n << RANK_BITS | given[n], sequences, k, offset))
            offset += n * k
            given[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
        sequences += times
        if len(left) < len(lengths):
            lengths = [n for n in lengths if n in left]
    return np.array(sorted(rows), np.int64).reshape(-1, 4), sequences


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of what each row's ids are cut into."""
    ship(docs.sparkSession)

    def split(batches):
        bpe = byte_bpe(vocabulary)
        end = np.array([closing_id], "<u4")
        for batch in batches:
            rows, at = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate([bpe.ids(text), end])
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    rows.append((piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    at.append(i)
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(split, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """The pieces of all documents with the sequence and the offset at which each is placed."""
    found = cut(pieces(docs, vocabulary, capacity, closing_id))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table, _ = plan(counts, capacity)

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            row = table[np.searchsorted(table[:, 0], length << RANK_BITS | rank, "right") - 1]
            sequence, inside = np.divmod(rank - (row[:, 0] & (1 << RANK_BITS) - 1), row[:, 2])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 1] + sequence), pa.array(row[:, 3] + inside * length)],
                [*batch.schema.names[:5], "sequence_id", "offset"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    order = ["doc_id", "piece", "start", "ids_crc32"]
    numbered = ranked(found, ["length"], order, "__dm_rank").select("doc_id", "piece", "start", "length", "ids_crc32", "__dm_rank")
    return numbered.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
