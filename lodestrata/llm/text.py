"""Shared text conventions of the operators.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. Those separators are exactly
the ASCII white space of ``bytes.split()``, and ``bytes.lower()`` changes A-Z
only, so the operators that run in Python work on UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.session import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids have the remainder -1, so they fall in no held-out fold."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % modulus, F.lit(-1))


def checksum(data: Column) -> Column:
    """crc32 as a signed 32-bit integer."""
    return (F.crc32(data) - (1 << 31)).cast("int")


def map_arrow(
    df: DataFrame,
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | T.StructType,
) -> DataFrame:
    """``mapInArrow`` after the executors have got the package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """The values as bytes; null counts as empty."""
    return [value or b"" for value in column.to_pylist()]
