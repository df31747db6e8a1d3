"""Streaming: first occurrence by key within a watermark, and windowed counts. An extension; batch frames work as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """One event for each key within the watermark; state is dropped once the watermark has passed."""
    typed = events.withColumn(time, F.col(time).cast("timestamp"))
    if not events.isStreaming:
        return typed.dropDuplicates(keys)
    return typed.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, by: str, width: str = "1 hour", time: str = "ts", late: str = "1 hour") -> DataFrame:
    typed = events.withColumn(time, F.col(time).cast("timestamp"))
    typed = typed.withWatermark(time, late) if events.isStreaming else typed
    return typed.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select("w.start", "w.end", by, "n")
