"""Adding columns that Python computes from a text, with all other columns carried along."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.plans.cluster import ship

KINDS = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def with_text_columns(docs: DataFrame, make: Callable, added: dict[str, str], keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns `keep` of docs (all by default) and those that make(list of texts) gives.

    added: name -> kind of each column that `make` returns, in order. Columns go through
    under positions, so that no name in docs clashes with a new one until the caller looks.
    """
    ship(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    carried = keep if text in keep else [*keep, text]
    at, n = carried.index(text), len(keep)
    names = [f"c{i}" for i in range(n + len(added))]
    kinds = [KINDS[k] for k in added.values()]

    def told(batches):
        for batch in batches:
            made = make(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names)

    fields = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.fields
    ddl = [f"{c} {f.dataType.simpleString()}" for c, f in zip(names, fields, strict=False)] + [f"{c} {k}" for c, k in zip(names[n:], added.values(), strict=True)]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)])
    return inner.mapInArrow(told, ", ".join(ddl)).toDF(*keep, *added)
