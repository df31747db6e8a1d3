"""Pairs of overlapping boxes by cells against all pairs, and a crowded image."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.scalar import box_iou
from lodestrata.operators import assignment
from lodestrata.operators.boxes import overlapping


@pytest.mark.parametrize("threshold", [0.05, 0.5, 1.0])
def test_cells_find_all_pairs_once(spark, threshold):
    draw = random.Random(1)
    rows = []
    for k in range(300):
        x, y, w, h = draw.uniform(-40, 40), draw.uniform(-40, 40), 2 ** draw.uniform(-3, 6), 2 ** draw.uniform(-3, 6)
        rows.append((k % 3, k, [x, y, x + w, y + h]))
    rows += [(1, 300, [0.0, 0.0, 8.0, 8.0]), (1, 301, [0.0, 0.0, 8.0, 8.0]), (1, 302, [8.0, 0.0, 16.0, 8.0]), (1, 303, [0.0, 0.0, 4.0, 16.0]), (2, 304, [1.0, 1.0, 1.0, 5.0]), (2, 305, None), (2, 306, [5.0, 5.0, 1.0, 1.0]), (2, 307, [0.0, 0.0, float("inf"), 1.0]), (None, 308, [0.0, 0.0, 8.0, 8.0])]
    frame = spark.createDataFrame(rows, "image long, id long, box array<double>").repartition(3)
    found = [(r["l"]["id"], r["r"]["id"]) for r in overlapping(frame, frame, "image", "box", "box", threshold).collect()]
    other = frame.select("image", F.col("id").alias("id2"), F.col("box").alias("box2")).where("id2 NOT IN (304, 305, 306, 307)")
    every = frame.where("id NOT IN (304, 305, 306, 307)").join(other, "image").where(box_iou(F.col("box"), F.col("box2")) >= threshold)
    assert len(found) == len(set(found)) and set(found) == {(r["id"], r["id2"]) for r in every.collect()}


def test_thresholds_lie_above_zero(spark):
    with pytest.raises(ValueError, match="above 0"):
        overlapping(spark.range(1), spark.range(1), "id", "id", "id", 0.0)


def test_one_image_with_a_hundred_thousand_boxes(spark):
    side = 317
    grid = spark.range(100_000).select(F.lit(1).alias("image_id"), "id", (F.col("id") % 3).cast("int").alias("cls"), (F.col("id") % side).alias("x").cast("double"), F.floor(F.col("id") / side).cast("double").alias("y"))
    box = lambda d: F.array(F.col("x") + d, F.col("y"), F.col("x") + d + 0.9, F.col("y") + 0.9)
    truth = grid.select("image_id", "id", "cls", box(0.0).alias("box"))
    predicted = grid.select("image_id", "id", "cls", F.lit(0.5).alias("confidence"), box(0.1).alias("box"))
    found = assignment.match_boxes(truth, predicted, 0.5)
    assert found.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("gt_id") == F.col("pred_id")).alias("same")).collect()[0][:] == ("matched", 100_000, 100_000)
