"""Invariants of a table, all checked in two scans: one aggregate for rules on rows and totals, one grouped pass for all rules on keys.

Every rule gives one row (rule, violations, first): how often it is broken, and the smallest key that breaks it (null: it holds). The sums are plain
aggregates, which a lost executor can't count twice. A rule on keys sees each key once after partial aggregation, so a key with a third of all rows
is no burden. A condition that is null is broken. On an empty table all rules hold but totals other than 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT = "rule string, violations long, first string"


@dataclass
class Each:
    """Every row (for which ``among`` is true, if given) meets a condition."""

    name: str
    holds: Column
    among: Column | None = None


@dataclass
class Total:
    """The sum of ``value`` over all rows is ``expected``; the violation is how far it is off."""

    name: str
    value: Column
    expected: int


@dataclass
class Key:
    """A rule on all rows of a key (null keys have none). ``kind``:

    ``unique``: the key is there once. ``one_value``: its rows have one ``value`` at most. ``disjoint``: its rows are on one ``side`` only.
    ``matched``: it is on both sides, with equal values (null equals null).
    """

    name: str
    kind: str
    key: Column
    value: Column | None = None
    side: Column | None = None

    def broken(self) -> Column:
        value, side = F.col("low") != F.col("high"), F.col("one") != F.col("other")
        mixed = (F.col("valued") > 0) & (F.col("valued") < F.col("n"))
        return F.coalesce({"unique": F.col("n") > 1, "one_value": value, "disjoint": side, "matched": ~F.coalesce(side, F.lit(False)) | F.coalesce(value, F.lit(False)) | mixed}[self.kind], F.lit(False))


def report(rows: DataFrame, rules: list[Each | Total | Key], key: Column) -> DataFrame:
    """(rule, violations, first) of every rule. ``key``: how a row is named where it breaks a rule."""
    names = [r.name for r in rules]
    if len(set(names)) < len(names):
        raise ValueError("rules need different names")
    cells = []
    for k, rule in enumerate(rules):
        if isinstance(rule, Each):
            bad = ~F.coalesce(rule.holds, F.lit(False)) & (F.lit(True) if rule.among is None else F.coalesce(rule.among, F.lit(False)))
            cells += [F.count_if(bad).alias(f"n{k}"), F.min(F.when(bad, key.cast("string"))).alias(f"f{k}")]
        elif isinstance(rule, Total):
            off = F.coalesce(F.sum(rule.value.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")) - rule.expected
            cells += [F.abs(off).cast("long").alias(f"n{k}"), F.when(off != 0, F.concat(F.lit("off by "), off.cast("string"))).alias(f"f{k}")]
        else:
            cells += [F.lit(0).cast("long").alias(f"n{k}"), F.lit(None).cast("string").alias(f"f{k}")]
    each = [F.struct(F.lit(r.name).alias("rule"), F.col(f"n{k}").alias("violations"), F.col(f"f{k}").alias("first")) for k, r in enumerate(rules)]
    aggregated = rows.agg(*cells).select(F.explode(F.array(*each)).alias("r")).select("r.*")
    keyed = [r for r in rules if isinstance(r, Key)]
    if not keyed:
        return aggregated
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    seen = [F.when(r.key.isNotNull(), F.struct(F.lit(r.name).alias("rule"), r.key.cast("string").alias("key"), text(r.value).alias("value"), text(r.side).alias("side"))) for r in keyed]
    groups = rows.select(F.explode(F.array_compact(F.array(*seen))).alias("s")).groupBy("s.rule", "s.key").agg(
        F.count("*").alias("n"), F.count("s.value").alias("valued"), F.min("s.value").alias("low"), F.max("s.value").alias("high"), F.min("s.side").alias("one"), F.max("s.side").alias("other")
    )
    broken = F.lit(False)
    for r in keyed:
        broken = F.when(F.col("rule") == r.name, r.broken()).otherwise(broken)
    found = groups.where(broken).groupBy("rule").agg(F.count("*").alias("violations"), F.min("key").alias("first"))
    return aggregated.unionByName(found).groupBy("rule").agg(F.sum("violations").alias("violations"), F.min("first").alias("first"))


def enforce(rows: DataFrame, rules: list[Each | Total | Key], key: Column) -> None:
    """Raises ValueError with the rules that are broken and their first keys."""
    broken = report(rows, rules, key).where("violations > 0").orderBy("rule").collect()  # a row for each rule at most
    if broken:
        raise ValueError("violated: " + "; ".join(f"{r['rule']} {r['violations']} times, first {r['first']}" for r in broken))
