"""The registered queries for the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans import audits, pixels, protocol, relations, reports

_ALL = relations.QUERIES | audits.QUERIES | reports.QUERIES | protocol.QUERIES | pixels.QUERIES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.split_leakage_audit(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
