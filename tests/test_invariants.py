"""Each kind of rule holds, breaks, and names its first key; all of them in two scans."""

import pytest
from pyspark.sql import functions as F

from lodestrata.operators.invariants import Each, Key, Total, enforce, report

SCHEMA = "id long, side string, grp string, split string, n int, sha string"
GOOD = [(1, "pool", "a", "train", 2, "x"), (2, "pool", "a", "train", 3, None), (3, "pool", "b", "val", 0, "z"), (9, "out", None, None, 1, "q")]


def rules(total=6):
    pool = F.col("side") == "pool"
    return [
        Each("known_split", F.col("split").isin("train", "val", "test"), pool), Each("no_split_outside", F.col("split").isNull(), ~pool), Each("counted", F.col("n") >= 0), Total("instances", F.col("n"), total),
        Total("pool", pool.cast("int"), 3), Key("id_once", "unique", F.col("id")), Key("one_split", "one_value", F.col("grp"), F.col("split")), Key("apart", "disjoint", F.col("id"), side=F.col("side")),
    ]


def broken(spark, rows, which):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r["rule"]: (r["violations"], r["first"]) for r in report(frame, which, F.col("id")).collect()}


def test_all_rules_hold(spark):
    found = broken(spark, GOOD, rules())
    assert found == {r.name: (0, None) for r in rules()}
    enforce(spark.createDataFrame(GOOD, SCHEMA), rules(), F.col("id"))


@pytest.mark.parametrize(
    ("row", "expected"),
    [
        ((4, "pool", "c", "dev", 0, "y"), {"known_split": (1, "4"), "pool": (1, "off by 1")}),
        ((4, "pool", "c", None, 0, "y"), {"known_split": (1, "4"), "pool": (1, "off by 1")}),
        ((4, "out", None, "val", 0, "y"), {"no_split_outside": (1, "4")}),
        ((4, "out", None, None, None, "y"), {"counted": (1, "4")}),
        ((4, "out", None, None, 5, "y"), {"instances": (5, "off by 5")}),
        ((3, "pool", "b", "val", 0, "z"), {"id_once": (1, "3"), "pool": (1, "off by 1")}),
        ((2, "out", None, None, 0, "z"), {"id_once": (1, "2"), "apart": (1, "2")}),
        ((4, "pool", "a", "test", 0, "z"), {"one_split": (1, "a"), "pool": (1, "off by 1")}),
    ],
)
def test_each_rule_fails(spark, row, expected):
    found = broken(spark, [*GOOD, row], rules())
    assert {k: v for k, v in found.items() if v[0]} == expected and len(found) == len(rules())


def test_matched_sides(spark):
    rule = [Key("same", "matched", F.col("id"), F.col("sha"), F.col("side"))]
    rows = [(1, "expected", None, None, 0, "x"), (1, "found", None, None, 0, "x"), (2, "expected", None, None, 0, None), (2, "found", None, None, 0, None)]
    assert broken(spark, rows, rule) == {"same": (0, None)}
    worse = [(3, "expected", None, None, 0, "x"), (4, "found", None, None, 0, "x"), (5, "expected", None, None, 0, "x"), (5, "found", None, None, 0, "y"), (6, "expected", None, None, 0, "x"), (6, "found", None, None, 0, None)]
    assert broken(spark, rows + worse, rule) == {"same": (4, "3")}


def test_enforce_names_what_is_broken(spark):
    frame = spark.createDataFrame([*GOOD, (3, "pool", "b", "test", 0, "z")], SCHEMA)
    with pytest.raises(ValueError, match="id_once 1 times, first 3; one_split 1 times, first b; pool 1 times"):
        enforce(frame, rules(), F.col("id"))
    with pytest.raises(ValueError, match="different names"):
        report(frame, [*rules(), rules()[0]], F.col("id"))


def test_two_scans_and_an_empty_table(spark, tmp_path):
    spark.createDataFrame(GOOD, SCHEMA).write.parquet(str(tmp_path / "t"))
    plan = report(spark.read.parquet(str(tmp_path / "t")), rules(), F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Python" not in plan
    assert {k: v for k, v in broken(spark, [], rules()).items() if v[0]} == {"instances": (6, "off by -6"), "pool": (3, "off by -3")}
