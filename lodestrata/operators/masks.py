"""Polygon masks as runs of pixels: every polygon is scanned once, overlaps are joins of runs. All of it stays in the JVM.

A pixel belongs to a polygon if its centre lies inside by the even-odd rule: on the line of centres of a row the pixels between the
first and the second crossing, the third and the fourth, and so on. A mask is the union of its polygons, as runs ``[start, stop)`` that don't
touch. Polygons with fewer than three points, or with a null or non-finite coordinate, have no pixels; what lies outside the image is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _within(value: Column, size: Column) -> Column:
    """The first pixel whose centre isn't below ``value``, held within the image."""
    return F.ceil(F.greatest(F.lit(0.0), F.least(value - 0.5, size.cast("double")))).cast("int")


def runs(rows: DataFrame, key: str, polygons: str, width: Column, height: Column) -> DataFrame:
    """(key, row, start, stop) of the mask of each key. ``polygons``: array of polygons, each an array of [x, y]; a key's rows are united."""
    each = rows.select(key, F.explode(polygons).alias("p"), width.alias("w"), height.alias("h"))
    sound = F.forall("p", lambda q: (F.size(q) == 2) & F.forall(q, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    each = each.where((F.size("p") >= 3) & F.coalesce(sound, F.lit(False)))
    ys = F.transform("p", lambda q: q[1])
    low, high = _within(F.array_min(ys), F.col("h")), _within(F.array_max(ys), F.col("h"))
    lines = each.withColumns({"low": low, "high": high}).where("low < high").select(key, "p", "w", F.explode(F.expr("sequence(low, high - 1)")).alias("row"))
    at, n = F.col("row") + 0.5, F.size("p")
    point = lambda i, k: F.get(F.get("p", i), F.lit(k))
    crossed = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (point(i, 1) > at) != (point((i + 1) % n, 1) > at))

    def x_at(i: Column) -> Column:
        j = (i + 1) % n
        return (point(j, 0) - point(i, 0)) * (at - point(i, 1)) / (point(j, 1) - point(i, 1)) + point(i, 0)

    cut = lines.select(key, "row", "w", F.array_sort(F.transform(crossed, x_at)).alias("x")).where(F.size("x") > 0)
    pixel = lambda k: _within(F.get("x", k), F.col("w"))
    spans = F.transform(F.sequence(F.lit(0), F.size("x") - 2, F.lit(2)), lambda k: F.struct(pixel(k).alias("start"), pixel(k + 1).alias("stop")))
    held = cut.select(key, "row", F.filter(spans, lambda s: s["start"] < s["stop"]).alias("s")).groupBy(key, "row").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("s"))

    def unite(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        return F.when(F.size(done) == 0, F.array(s)).when(last["stop"] >= s["start"], joined).otherwise(F.concat(done, F.array(s)))

    none = F.array().cast("array<struct<start:int,stop:int>>")
    united = F.when(F.size("s") < 2, F.col("s")).otherwise(F.aggregate("s", none, unite))
    return held.select(key, "row", F.explode(united).alias("r")).select(key, "row", "r.start", "r.stop")


def areas(masks: DataFrame, key: str) -> DataFrame:
    return masks.groupBy(key).agg(F.sum(F.col("stop") - F.col("start")).alias("area"))


def overlaps(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` (with keys ``a`` and ``b``) and ``common``, ``together`` (pixels) and ``mask_iou`` (0 if both masks are empty).

    Runs of a pair meet by row. Each pair is one row of ``pairs``; a null key gives no mask.
    """
    ends = pairs.select(a, b).distinct()
    mine = left.select(F.col(a), "row", F.col("start").alias("s1"), F.col("stop").alias("e1"))
    other = right.select(F.col(b), "row", F.col("start").alias("s2"), F.col("stop").alias("e2"))
    shared = F.least("e1", "e2") - F.greatest("s1", "s2")
    met = ends.join(mine, a).join(other, [b, "row"]).groupBy(a, b).agg(F.sum(F.greatest(shared, F.lit(0))).alias("common"))
    sized = pairs.join(met, [a, b], "left").join(areas(left, a).withColumnRenamed("area", "area_a"), a, "left").join(areas(right, b).withColumnRenamed("area", "area_b"), b, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    found = sized.withColumn("common", zero("common")).withColumn("together", zero("area_a") + zero("area_b") - F.col("common")).drop("area_a", "area_b")
    return found.withColumn("mask_iou", F.when(F.col("together") > 0, F.col("common") / F.col("together")).otherwise(0.0))
