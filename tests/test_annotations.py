"""Annotated images: findings, multisets, residuals and alternatives on hand-made records."""

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import annotations

SCHEMA = f"name string, regions array<{annotations.REGION}>, width double, height double"
SQUARE = ("ripe", [0.0, 8.0, 8.0], [0.0, 0.0, 8.0])
EDGE = ("raw", [2.0, 10.0, 10.0], [1.0, 1.0, 4.0])


@pytest.fixture(scope="module")
def original(spark):
    rows = [("a", [SQUARE, EDGE]), ("b", []), ("c", [(None, [1.0, 2.0, 3.0], [1.0, 1.0, 1.0])]), ("d", [(" ", [1.0], [1.0])]), ("e", [("x", [-1.0, 3.0, 3.0], [0.0, 0.0, 2.0])]), ("f", None), ("g", [SQUARE])]
    return spark.createDataFrame([(n, r, 10.0, 10.0) for n, r in rows], SCHEMA)


def test_report(spark, original):
    images = spark.createDataFrame([(n,) for n in ("a", "b", "c", "d", "e", "f", "z")], "name string")
    found = {(r["section"], r["key"]): (r["n"], r["first"]) for r in annotations.annotation_report(original.unionByName(original.where("name = 'a'")), images).collect()}
    assert found == {
        ("record", "annotated"): (6, "a"), ("record", "empty"): (2, "b"), ("class", "ripe"): (3, "a"), ("class", "raw"): (2, "a"), ("class", "x"): (1, "e"), ("class", "[missing]"): (2, "c"),
        ("finding", "boundary"): (2, "a"), ("finding", "zero_area"): (1, "c"), ("finding", "malformed"): (1, "d"), ("finding", "missing_label"): (2, "c"), ("finding", "out_of_bounds"): (1, "e"),
        ("repeated", "name"): (1, "a"), ("side", "both"): (6, "a"), ("side", "record_only"): (1, "g"), ("side", "image_only"): (1, "z"),
    }


def test_comparison_of_copies(spark, original):
    half = lambda r, off=0.0: (r[0], [x / 2 + off for x in r[1]], [y / 2 for y in r[2]])
    rows = [("a", [half(SQUARE), half(EDGE, 3.0)], 5.0), ("b", [SQUARE], 5.0), ("c", [("ripe", [1.0, 2.0], [1.0, 1.0, 1.0])], 5.0), ("d", [(" ", [1.0], [1.0])], None), ("e", [("y", [-1.0, 3.0, 3.0], [0.0, 0.0, 2.0])], 10.0), ("f", None, 5.0), ("z", [SQUARE], 5.0)]
    derived = spark.createDataFrame([(n, r, w, w) for n, r, w in rows], SCHEMA)
    found = {r["name"]: r for r in annotations.compare(original, derived).collect()}
    assert {n: r["status"] for n, r in found.items()} == {"a": "compared", "b": "different_count", "c": "incomparable", "d": "incomparable", "e": "compared", "f": "compared", "g": "original_only", "z": "derived_only"}
    a = found["a"]
    assert a["same_labels"] and not a["same_geometry"] and a["max_residual"] == 3.0 and a["coordinates"] == 12 and a["mean_residual"] == 9 / 12
    assert [tuple(r) for r in a["residuals"]] == [(0, 0.0), (1, 3.0)]
    e = found["e"]
    assert not e["same_labels"] and e["same_geometry"] and not e["same_regions"] and not e["same_label_set"] and e["max_residual"] == 0.0
    assert found["f"]["mean_residual"] is None and found["f"]["same_regions"] and found["g"]["same_labels"] is None and found["d"]["same_regions"]


def test_multisets_count_repeats(spark):
    rows = spark.createDataFrame([("a", [SQUARE, EDGE, SQUARE], [EDGE, SQUARE, SQUARE]), ("b", [SQUARE, EDGE, EDGE], [SQUARE, SQUARE, EDGE]), ("c", [SQUARE], [("raw", *SQUARE[1:])])], f"k string, x array<{annotations.REGION}>, y array<{annotations.REGION}>")
    equal = [annotations.canonical(F.col("x"), part) == annotations.canonical(F.col("y"), part) for part in ("all", "geometry", "label")]
    assert [tuple(r) for r in rows.orderBy("k").select(*equal).collect()] == [(True, True, True), (False, False, False), (False, True, False)]
    counts = rows.where("k = 'a'").select(annotations.counted(annotations.canonical(F.col("x"), "label")).alias("c")).first()["c"]
    assert [(r["value"], r["n"]) for r in counts] == [('{"label":"raw"}', 1), ('{"label":"ripe"}', 2)]


def test_alternatives_of_the_family(spark):
    moved = ("ripe", [20.0, 28.0, 28.0], [0.0, 0.0, 8.0])
    original = spark.createDataFrame([("a", [SQUARE], 40.0, 40.0), ("b", [moved], 40.0, 40.0), ("c", [EDGE], 40.0, 40.0), ("n", [moved], 40.0, 40.0)], SCHEMA)
    derived = spark.createDataFrame([("a", [moved], 40.0, 40.0), ("b", [moved], 40.0, 40.0), ("c", [EDGE], 40.0, 40.0)], SCHEMA)
    families = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "f"), ("n", None)], "name string, family string")
    compared = annotations.compare(original, derived)
    found = {(r["name"], r["other"]): (r["same_geometry"], r["max_residual"]) for r in annotations.alternatives(compared, original, derived, families, 2.0).collect()}
    assert found == {("a", "b"): (True, 0.0), ("a", "c"): (False, 18.0)}
    none = original.where("false")
    assert annotations.compare(none, none).collect() == [] and annotations.annotation_report(none, none.select("name")).collect() == []
