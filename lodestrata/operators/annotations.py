"""Annotated images: findings on their regions, and originals compared with derived copies by name and position.

An annotation table has ``name``, ``regions`` (array<struct<label: string, xs: array<double>, ys: array<double>>>, in order), ``width`` and ``height``.
All comparisons are expressions on the two arrays of a name, so a name is one row and nothing is paired but equal names. A null array of
regions counts as none, a null size makes geometry incomparable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.checks import polygon_reason

REGION = "struct<label: string, xs: array<double>, ys: array<double>>"
_NONE = f"array<{REGION}>"


def region_findings(rows: DataFrame) -> DataFrame:
    """(name, region, finding): missing_label, malformed, zero_area, out_of_bounds or boundary; a region may have several."""
    each = rows.select("name", "width", "height", F.posexplode("regions").alias("region", "r"))
    shape = polygon_reason(F.col("r.xs"), F.col("r.ys"), F.col("width"), F.col("height"), "audit")
    label = F.when(F.coalesce(F.trim("r.label"), F.lit("")) == "", F.array(F.lit("missing_label"))).otherwise(F.array().cast("array<string>"))
    found = F.concat(label, F.coalesce(F.split(shape, r"\|"), F.array().cast("array<string>")))
    return each.select("name", "region", F.explode(found).alias("finding"))


def annotation_report(rows: DataFrame, images: DataFrame) -> DataFrame:
    """(section, key, n, first): records, regions by class, findings, empty records, names given twice, and names on one side only.

    ``images``: name. ``first`` is the smallest name of the group. Every count is summed in the tasks first.
    """
    summed = lambda df, section, key: df.groupBy(F.lit(section).alias("section"), key.alias("key")).agg(F.count("*").alias("n"), F.min("name").alias("first"))
    regions = rows.select("name", F.explode("regions").alias("r"))
    label = F.coalesce(F.nullif(F.trim("r.label"), F.lit("")), F.lit("[missing]"))
    sizes = F.when(F.coalesce(F.size("regions"), F.lit(0)) == 0, "empty").otherwise("annotated")
    names = rows.groupBy("name").agg(F.count("*").alias("times"))
    sides = names.join(images.select("name").distinct().withColumn("image", F.lit(True)), "name", "full_outer")
    side = F.when(F.col("times").isNull(), "image_only").when(F.col("image").isNull(), "record_only").otherwise("both")
    found = region_findings(rows)
    out = [summed(rows, "record", sizes), summed(regions, "class", label), summed(found, "finding", F.col("finding")), summed(names.where("times > 1"), "repeated", F.lit("name")), summed(sides, "side", side)]
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first


def canonical(regions: Column, part: str = "all") -> Column:
    """A multiset of regions as a sorted array of texts: of whole regions, their ``geometry`` or their ``label``. Equal multisets are equal arrays."""
    fields = {"all": ("label", "xs", "ys"), "geometry": ("xs", "ys"), "label": ("label",)}[part]
    return F.array_sort(F.transform(regions, lambda r: F.to_json(F.struct(*(r[f].alias(f) for f in fields)), {"ignoreNullFields": "false"})))


def counted(values: Column) -> Column:
    """(value, n) of a sorted array: a multiset with its counts."""
    return F.transform(F.array_distinct(values), lambda v: F.struct(v.alias("value"), F.size(F.filter(values, lambda w: w == v)).alias("n")))


def _residuals(a: Column, b: Column, xf: Column, yf: Column) -> Column:
    """Absolute differences of one region's scaled coordinates and its copy's, in order; null if the points don't correspond."""
    alike = (F.size(a["xs"]) == F.size(b["xs"])) & (F.size(a["ys"]) == F.size(b["ys"])) & (F.size(a["xs"]) == F.size(a["ys"]))
    off = lambda axis, f: F.zip_with(a[axis], b[axis], lambda p, q: F.abs(p * f - q))
    return F.when(alike, F.concat(off("xs", xf), off("ys", yf)))


def compare(original: DataFrame, derived: DataFrame) -> DataFrame:
    """One row for each name: status (original_only, derived_only, different_count, incomparable, compared) and what agrees.

    same_labels: the sequences of labels. same_label_set, same_regions, same_geometry: as multisets, unscaled. residuals: (region, most) of
    each region that corresponds; max_residual, mean_residual and coordinates over all of them. Names are unique on each side.
    """
    side = lambda df, n: df.select("name", F.struct(F.coalesce("regions", F.array().cast(_NONE)).alias("regions"), F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h")).alias(n))
    both = side(original, "a").join(side(derived, "b"), "name", "full_outer")
    a, b = F.col("a.regions"), F.col("b.regions")
    xf, yf = F.col("b.w") / F.col("a.w"), F.col("b.h") / F.col("a.h")
    per = F.zip_with(a, b, lambda r, s: _residuals(r, s, xf, yf))
    equal = F.size(a) == F.size(b)
    sized = both.withColumn("per", F.when(equal & xf.isNotNull() & yf.isNotNull(), per))
    flat = F.flatten(F.filter("per", lambda v: v.isNotNull()))
    missing = F.col("per").isNull() | F.exists(F.coalesce("per", F.array().cast("array<array<double>>")), lambda v: v.isNull())
    status = F.when(F.col("b").isNull(), "original_only").when(F.col("a").isNull(), "derived_only").when(~equal, "different_count").when(missing, "incomparable").otherwise("compared")
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()
    same = lambda part: F.when(paired, canonical(a, part) == canonical(b, part))
    most = F.filter(F.transform("per", lambda v, k: F.struct(k.alias("region"), F.array_max(v).alias("most"))), lambda s: s["most"].isNotNull())
    labels = F.when(paired, F.transform(a, lambda r: r["label"]).eqNullSafe(F.transform(b, lambda r: r["label"])))
    return sized.withColumn("flat", flat).select(
        "name", status.alias("status"), labels.alias("same_labels"), same("label").alias("same_label_set"), same("all").alias("same_regions"), same("geometry").alias("same_geometry"), most.alias("residuals"),
        F.array_max("flat").alias("max_residual"), (F.aggregate("flat", F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size("flat"), F.lit(0))).alias("mean_residual"), F.size("flat").alias("coordinates"),
    )


def alternatives(compared: DataFrame, original: DataFrame, derived: DataFrame, families: DataFrame, limit: float) -> DataFrame:
    """(name, other, same_geometry, max_residual): for copies off by more than ``limit``, how each other original of their family would fit.

    ``families``: name, family. Only the copies in question meet their families, not all pairs of a family.
    """
    odd = compared.where((F.col("max_residual") > limit) | (F.col("status") == "different_count")).select("name").join(families, "name")
    others = odd.join(families.withColumnRenamed("name", "other"), "family").where("name <> other").select("name", "other")
    key = F.concat_ws("\x00", "other", "name")
    left = others.join(original.withColumnRenamed("name", "other"), "other").select(key.alias("name"), "regions", "width", "height")
    right = others.join(derived, "name").select(key.alias("name"), "regions", "width", "height")
    parts = F.split("name", "\x00")
    return compare(left, right).select(F.get(parts, F.lit(1)).alias("name"), F.get(parts, F.lit(0)).alias("other"), "status", "same_geometry", "max_residual")
