"""CSV by ranges equals a CSV written row by row, and nothing half-written is ever seen."""

import csv
import datetime
import io
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import sinks


def row_by_row(rows, columns):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    for row in rows:
        writer.writerow(["" if v is None else str(v).lower() if isinstance(v, bool) else v for v in row])
    return out.getvalue().encode()


def test_csv_by_ranges_equals_row_by_row(spark, tmp_path, monkeypatch):
    odd = ["plain", 'a "quoted" one', "comma, here", "two\nlines", "", None, " blank ", "é漢", "\r"]
    rows = [(k * 7919 % 1000, odd[k % 9], k % 3 == 0 if k % 5 else None, (k - 400) / 7e5 if k % 4 else None, Decimal(k) / 4, datetime.date(2020, 1, 1 + k % 28)) for k in range(1000)]
    df = spark.createDataFrame(rows, "k long, text string, flag boolean, share double, price decimal(9,2), day date").repartition(7)
    want = row_by_row(df.orderBy("k").collect(), df.columns)
    monkeypatch.setattr(type(df), "collect", None)
    monkeypatch.setattr(type(df), "toLocalIterator", None)
    path = tmp_path / "o.csv"
    sinks.write_csv(df, str(path), ["k"])
    assert path.read_bytes() == want
    sinks.write_csv(df, f"file://{tmp_path}/p.csv", ["k"])
    assert (tmp_path / "p.csv").read_bytes() == want and sorted(os.listdir(tmp_path)) == ["o.csv", "p.csv"]


def test_empty_tables_and_refusal(spark, tmp_path):
    path = str(tmp_path / "o.csv")
    sinks.write_csv(spark.range(0), path, ["id"])
    assert open(path, "rb").read() == b"id\n"
    with pytest.raises(FileExistsError):
        sinks.write_csv(spark.range(3), path, ["id"])
    assert open(path, "rb").read() == b"id\n"


def test_a_failure_leaves_nothing(spark, tmp_path):
    bad = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken row")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken row"):
        sinks.write_csv(bad, str(tmp_path / "o.csv"), ["id"])
    with pytest.raises(Exception, match="broken row"):
        sinks.write_dataset({"good": spark.range(3), "bad": bad}, str(tmp_path / "set"))
    assert os.listdir(tmp_path) == []


def test_a_dataset_appears_whole(spark, tmp_path):
    path = str(tmp_path / "set")
    sinks.write_dataset({"a": spark.range(5), "b": spark.range(3).withColumnRenamed("id", "k")}, path)
    assert spark.read.parquet(f"{path}/a").count() == 5 and spark.read.parquet(f"{path}/b").columns == ["k"] and os.listdir(tmp_path) == ["set"]
    with pytest.raises(FileExistsError):
        sinks.write_dataset({"a": spark.range(1)}, path)
    with pytest.raises(FileExistsError), sinks.published(spark, str(tmp_path / "late")) as stage:  # another writer was faster
        os.makedirs(f"{stage.removeprefix('file:')}/out")
        os.makedirs(tmp_path / "late")
    assert sorted(os.listdir(tmp_path)) == ["late", "set"]
