"""Token counts of whole texts, by the whole-token shortcut of `bpe`.

Defined results: null or empty text -> 0 bytes, 0 tokens; texts of any length are counted
whole; repeated rows each get their count; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.bpe import byte_bpe
from driftmark.plans.cluster import ship


def _counter(path: str):
    """The count of one text under a vocabulary file of any of the two libraries."""
    if path.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(piece.encode(text or ""))
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    try:
        return byte_bpe(path).count
    except ValueError:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        return lambda text: len(library.encode(text or "", add_special_tokens=False).ids)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row."""
    ship(docs.sparkSession)

    def counted(batches):
        count = _counter(vocabulary)
        for batch in batches:
            n = [count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    lean = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return lean.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
