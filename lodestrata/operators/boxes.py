"""Overlapping boxes of an image by a grid of cells, instead of all pairs.

Boxes that overlap by a share of ``threshold`` or more have sides within that factor of each other. A box lies in cells as large as its
longer side (four at most), and in those of the next few sizes up; a pair meets at the larger one's size, in the cell where its intersection begins, and
nowhere else. Cells are join keys, so an image with a third of all boxes is spread over its cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalar import box_iou


def _placed(rows: DataFrame, image: str, box: str, name: str, sizes: int) -> DataFrame:
    """A row for each cell of each box: image, level, cx, cy, and the row as ``name``."""
    at = lambda k: F.get(box, F.lit(k)).cast("double")
    wide, high = at(2) - at(0), at(3) - at(1)
    finite = F.forall(F.transform(box, lambda v: v.cast("double")), lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    sound = rows.where((F.size(box) == 4) & F.coalesce(finite, F.lit(False))).where((wide > 0) & (high > 0))
    own = F.ceil(F.log2(F.greatest(wide, high))).cast("int")
    levels = sound.select(F.col(image).alias("image"), F.struct("*").alias(name), F.array(at(0), at(1), at(2), at(3)).alias("b"), own.alias(f"{name}_level"), F.explode(F.sequence(own, own + sizes)).alias("level"))
    cell = lambda k: F.floor(F.get("b", F.lit(k)) / F.pow(F.lit(2.0), "level"))
    xs = levels.withColumn("cx", F.explode(F.sequence(cell(0), cell(2))))
    return xs.withColumn("cy", F.explode(F.sequence(cell(1), cell(3)))).withColumnRenamed("b", f"{name}_box")


def overlapping(left: DataFrame, right: DataFrame, image: str, left_box: str, right_box: str, threshold: float, where: Column | str | None = None) -> DataFrame:
    """(l, r, overlap): the rows of both sides, as structs, of all pairs in an image whose intersection over union is ``threshold`` (above 0) or more.

    ``where`` may look at ``l`` and ``r``. Boxes [left, top, right, bottom] without an area, or with a null or non-finite side, overlap nothing.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold lies above 0 and at 1 at most")
    sizes = math.ceil(math.log2(1 / threshold) + 1e-9)
    a, b = _placed(left, image, left_box, "l", sizes), _placed(right, image, right_box, "r", sizes)
    met = a.join(b, ["image", "level", "cx", "cy"]).where(F.col("level") == F.greatest("l_level", "r_level"))
    begins = lambda k: F.floor(F.greatest(F.get("l_box", F.lit(k)), F.get("r_box", F.lit(k))) / F.pow(F.lit(2.0), "level"))
    once = met.where((begins(0) == F.col("cx")) & (begins(1) == F.col("cy"))).withColumn("overlap", box_iou(F.col("l_box"), F.col("r_box")))
    out = once.where(F.col("overlap") >= threshold).select("l", "r", "overlap")
    return out if where is None else out.where(where)
