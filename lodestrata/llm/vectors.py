"""Tables of vectors as exact integers, and the products of their matrix that operators on vectors share.

A vector that is null or empty, or holds a null or a non-finite entry, takes no part. Neither does one whose
length isn't the commonest of the table (of two as common, the greater). Entries are ``floor(scale * c)``, with ``c``
as double, held within ``LIMIT`` either way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.text import map_arrow

#: Largest absolute value of an entry: float64 holds it exactly, and sums over its squares stay far from float64's range.
LIMIT = 1 << 40


def integers(df: DataFrame, id_column: str, vector_column: str, scale: int, keep: dict[str, Column] | None = None) -> tuple[DataFrame, int]:
    """(id, x array<long>, the columns of ``keep``) of the rows that take part, and their length (0: there are none)."""
    v = F.col(f"`{vector_column}`")
    finite = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    scaled = F.transform(v, lambda c: F.floor(F.greatest(F.least(F.lit(scale) * c.cast("double"), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))))
    sound = df.where(v.isNotNull() & (F.size(v) > 0) & finite)
    commonest = sound.groupBy(F.size(v).alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    width = commonest["width"] if commonest else 0
    extra = [column.alias(name) for name, column in (keep or {}).items()]
    return sound.where(F.size(v) == width).select(F.col(f"`{id_column}`").alias("id"), scaled.alias("x"), *extra), width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as a matrix of int64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, width)


def products(rows: DataFrame, width: int, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Xᵀ(XQ) over all rows ``x`` less ``mean``: each task sums its rows, Spark sums the tasks, width x columns numbers come back."""

    def part(batches):
        total = np.zeros(q.shape)
        for batch in batches:
            x = matrix(batch.column(0), width) - mean
            total += x.T @ (x @ q)
        at = np.indices(q.shape)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].ravel(), pa.int32()), pa.array(at[1].ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    sums = map_arrow(rows.select("x"), part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros(q.shape)
    for row in sums.collect():  # width x columns, whatever the table's size
        out[row["i"], row["j"]] = row["v"]
    return out
