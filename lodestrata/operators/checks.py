"""Constraints as tables that must be empty, polygon policies, manifest comparison, gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalar import twice_area


class GateFailure(Exception):
    """A gate of a chain failed."""


def run_gates(gates: list[tuple[str, Callable[[], object]]]) -> dict[str, object]:
    """Run named checks in order; the first that raises ends the chain and is named."""
    out: dict[str, object] = {}
    for name, gate in gates:
        try:
            out[name] = gate()
        except Exception as error:
            raise GateFailure(f"{name}: {error}") from error
    return out


def violations(rules: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each rule's table; a rule holds if it has none."""
    return {name: df.count() for name, df in rules.items()}


def require(rules: dict[str, DataFrame]) -> None:
    broken = [name for name, df in rules.items() if df.limit(1).count()]
    if broken:
        raise ValueError("violated: " + ", ".join(broken))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def difference(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows on one side only, as multisets, with ``side``."""
    return expected.exceptAll(found).withColumn("side", F.lit("expected")).unionByName(found.exceptAll(expected).withColumn("side", F.lit("found")))


def identity(written: DataFrame, actual: DataFrame) -> DataFrame:
    """(doc_id, bytes, status) of two tables (doc_id, bytes, sha): identical, altered, missing (written only) or extra (actual only)."""
    left = written.select("doc_id", "bytes", F.col("sha").alias("old"), F.lit(True).alias("l"))
    right = actual.select("doc_id", F.col("bytes").alias("now"), F.col("sha").alias("new"), F.lit(True).alias("r"))
    status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").when(~F.col("old").eqNullSafe(F.col("new")), "altered").otherwise("identical")
    return left.join(right, "doc_id", "full_outer").select("doc_id", F.coalesce("bytes", "now").alias("bytes"), status.alias("status"))


def required_lookup(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join that fails on a row without a partner."""
    marked = right.withColumn("_found", F.lit(True))
    joined = left.join(marked, on, "left")
    name = joined.columns[0]
    missing = F.raise_error(F.concat_ws(" ", F.lit("no partner for"), *(F.col(k).cast("string") for k in on)))
    return joined.withColumn(name, F.when(F.col("_found").isNull(), missing.cast(joined.schema[name].dataType)).otherwise(F.col(name))).drop("_found")


def override(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviewed tiers over automatic ones. ``decisions``: a, b, prior, reviewed. A prior that differs fails."""
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    known = decisions.select(low, high, "prior", "reviewed")
    joined = edges.join(known, ["a", "b"], "left")
    wrong = F.raise_error(F.lit("the automatic tier is not the one that was reviewed"))
    value = F.when(F.col("prior").isNull(), F.col("tier")).when(F.col("prior") == F.col("tier"), F.col("reviewed")).otherwise(wrong.cast("string"))
    return joined.withColumn("tier", value).drop("prior", "reviewed")


def unused_decisions(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return decisions.select(low, high).join(edges.select("a", "b"), ["a", "b"], "left_anti")


def polygon_reason(xs: Column, ys: Column, width: Column, height: Column, policy: str) -> Column:
    """Why a polygon is not valid, null if it is. Three policies that differ at the edge:

    ``inspect``: malformed, zero area, negative, outside (at the size or beyond), the first that applies.
    ``audit``: malformed ends it; else zero_area and out_of_bounds (beyond the size) may both hold, joined by a bar; at the size: boundary.
    ``convert``: coordinates divided by the size must be finite and in [0, 1], three distinct points, an area.
    """
    n = F.size(xs)
    malformed = F.coalesce((n < 3) | (n != F.size(ys)), F.lit(True))
    low = F.least(F.array_min(xs), F.array_min(ys))
    zero = twice_area(xs, ys) == 0
    if policy == "inspect":
        out = (F.array_max(xs) >= width) | (F.array_max(ys) >= height)
        return F.when(malformed, "malformed").when(zero, "zero_area").when(low < 0, "negative").when(out, "outside")
    if policy == "audit":
        beyond = (low < 0) | (F.array_max(xs) > width) | (F.array_max(ys) > height)
        edge = (F.array_max(xs) == width) | (F.array_max(ys) == height)
        found = F.concat_ws("|", F.when(zero, "zero_area"), F.when(beyond, "out_of_bounds"), F.when(~beyond & edge, "boundary"))
        return F.when(malformed, "malformed").when(found != "", found)
    if policy == "convert":
        bad = F.exists(xs, lambda x: F.isnan(x) | ~(x / width).between(0, 1)) | F.exists(ys, lambda y: F.isnan(y) | ~(y / height).between(0, 1))
        distinct = F.size(F.array_distinct(F.arrays_zip(xs, ys)))
        tiny = twice_area(xs, ys) / (width * height) <= 1e-12
        return F.when(malformed, "malformed").when(bad, "outside").when(distinct < 3, "few_points").when(tiny, "zero_area")
    raise ValueError(policy)


def operating_threshold(split: str, fixed: float, asked: float | None = None, locked: tuple[str, ...] = ("test",)) -> float:
    """The confidence threshold of a split: the fixed one, or another that is asked for on a split that isn't locked."""
    if asked is None or asked == fixed:
        return fixed
    if split in locked:
        raise ValueError(f"the threshold of {split} is fixed at {fixed}")
    if not 0 < asked <= 1:
        raise ValueError("a threshold lies above 0 and at 1 at most")
    return asked


def threshold_label(threshold: float) -> str:
    """A label that fits file names: 0.65 gives 0p65."""
    return f"{threshold:.4g}".replace(".", "p")


def checked_split(split: str, unlocked: bool = False, known: tuple[str, ...] = ("train", "val", "test"), locked: tuple[str, ...] = ("test",)) -> str:
    """The split's name if it may be read: a locked one only where it has been unlocked."""
    if split not in known:
        raise ValueError(f"unknown split {split}")
    if split in locked and not unlocked:
        raise PermissionError(f"{split} is locked")
    return split


def label_line_faults(lines: DataFrame, classes: int, expected: DataFrame | None = None) -> DataFrame:
    """(file, line, fault) of label lines (file, line, cls, xs, ys): class, tokens, range or, against ``expected`` (file, n), count."""
    bad = F.when(F.coalesce(~F.col("cls").between(0, classes - 1), F.lit(True)), "class")
    bad = bad.when((F.size("xs") != F.size("ys")) | (F.size("xs") < 3), "tokens")
    bad = bad.when(F.exists(F.concat("xs", "ys"), lambda x: F.coalesce(~x.between(0, 1), F.lit(True))), "range")
    out = lines.select("file", "line", bad.alias("fault")).where("fault IS NOT NULL")
    if expected is not None:
        counts = lines.groupBy("file").agg(F.count("*").alias("have")).join(expected, "file", "full_outer")
        differ = counts.where(~F.col("have").eqNullSafe(F.col("n"))).select("file", F.lit(None).cast("int").alias("line"), F.lit("count").alias("fault"))
        out = out.unionByName(differ)
    return out


def filter_predictions(df: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows at or above a confidence, and the conservation report exported = kept + excluded."""
    kept = F.col("confidence") >= threshold
    report = df.agg(F.count("*").alias("exported"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("excluded"))
    return df.where(kept), report
