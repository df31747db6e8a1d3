"""Runs of pixels against filled rasters."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import images
from lodestrata.operators import masks

WIDTH, HEIGHT = 23, 17
SCHEMA = "id long, p array<array<array<double>>>"


def polygons(seed, count):
    draw = random.Random(seed)
    whole = lambda: float(draw.randrange(-4, 28)) if draw.random() < 0.5 else draw.uniform(-6, 30)  # noqa: E731  centres and corners are met
    return [(k, [[[whole(), whole() if draw.random() < 0.7 else draw.randrange(0, 17) + 0.5] for _ in range(draw.randint(3, 9))] for _ in range(draw.randint(1, 4))]) for k in range(count)]


def pixels(shape):
    return images.raster([[tuple(q) for q in p] for p in shape], WIDTH, HEIGHT)


@pytest.fixture(scope="module")
def drawn(spark):
    rows = polygons(0, 60)
    odd = [(90, []), (91, None), (92, [[[1.0, 1.0], [5.0, 1.0]]]), (93, [[[1.0, 1.0], [float("nan"), 1.0], [4.0, 9.0]]]), (94, [[[1.0, 1.0], None, [4.0, 9.0]], [[0.0, 0.0], [3.0, 0.0], [3.0, 3.0], [0.0, 3.0]]]), (95, [[[100.0, 100.0], [120.0, 100.0], [110.0, 130.0]]])]
    frame = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    return rows, masks.runs(frame, "id", "p", F.lit(WIDTH), F.lit(HEIGHT)).cache()


def test_runs_are_the_pixels_and_do_not_touch(drawn):
    rows, found = drawn
    seen = {}
    for r in found.collect():
        row = seen.setdefault(r["id"], [[0] * WIDTH for _ in range(HEIGHT)])[r["row"]]
        assert 0 <= r["start"] < r["stop"] <= WIDTH and not any(row[max(0, r["start"] - 1) : r["stop"] + 1])
        row[r["start"] : r["stop"]] = [1] * (r["stop"] - r["start"])
    for k, shape in rows:
        assert seen.get(k, [[0] * WIDTH] * HEIGHT) == pixels(shape).astype(int).tolist()
    assert {k for k in seen if k >= 90} == {94} and sum(map(sum, seen[94])) == 9


def test_overlaps_equal_rasters(spark, drawn):
    rows, found = drawn
    shapes = dict(rows)
    draw = random.Random(1)
    wanted = [(draw.randrange(60), draw.randrange(60)) for _ in range(80)] + [(3, 3), (5, 95), (95, 90), (None, 4)]
    frame = spark.createDataFrame(wanted, "a long, b long").distinct()
    left, right = found.withColumnRenamed("id", "a"), found.withColumnRenamed("id", "b")
    out = {(r["a"], r["b"]): (r["common"], r["together"], r["mask_iou"]) for r in masks.overlaps(frame, left, right, "a", "b").collect()}
    assert len(out) == len(set(wanted))
    for (a, b), (common, together, value) in out.items():
        x, y = (pixels(shapes.get(k, [])) for k in (a, b))
        assert (common, together) == (int((x & y).sum()), int((x | y).sum()))
        assert value == (common / together if together else 0.0)


def test_no_polygons(spark):
    assert masks.runs(spark.createDataFrame([], SCHEMA), "id", "p", F.lit(4), F.lit(4)).collect() == []
