"""Sinks: ordered single-file CSV with LF ends, JSON reports, flat YAML, label text, staged publication."""

from __future__ import annotations

import csv
import datetime
import io
import json
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.session import ship


def _csv_lines(columns: list[str]):
    """Task: rows as CSV text, a line feed between rows, one text for each batch."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            out = io.StringIO()
            writer = csv.writer(out, lineterminator="\n")
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer.writerow(["" if v is None else str(v).lower() if isinstance(v, bool) else v for v in row])
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()[:-1]])], names=["value"])

    return run


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file with a header, LF ends and rows in a fixed order. ``path``: local, or of any file system that Spark knows.

    Tasks write sorted ranges of rows; their files are joined as bytes in the order of the ranges, no row comes to the driver. An
    existing file is refused; it appears whole, by one rename, or not at all.
    """
    ship(df.sparkSession)
    with published(df.sparkSession, path) as stage:
        ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
        ranges.mapInArrow(_csv_lines(df.columns), "value string").write.text(f"{stage}/parts")
        head = io.StringIO()
        csv.writer(head, lineterminator="\n").writerow(df.columns)
        _join(df.sparkSession, head.getvalue().encode(), f"{stage}/parts", f"{stage}/out")


def _file_system(spark: SparkSession, path: str):
    """(Hadoop's path, its file system) of a path; one without a scheme is local to the driver and to tasks in local mode."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path if ":" in path.split("/")[0] else "file://" + os.path.abspath(path))
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    system.setWriteChecksum(False)
    return found, system


def _join(spark: SparkSession, head: bytes, folder: str, target: str) -> None:
    """``head`` and the part files of a folder in the order of their names, as one file."""
    jvm, (to, system) = spark._jvm, _file_system(spark, target)
    source, _ = _file_system(spark, folder)
    names = sorted(f.getPath().getName() for f in system.listStatus(source) if f.getPath().getName().startswith("part-"))
    out = system.create(to, False)
    try:
        out.write(head)
        for name in names:
            part = system.open(jvm.org.apache.hadoop.fs.Path(source, name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
    finally:
        out.close()


class published:  # noqa: N801
    """A staging folder beside the target; what is written to ``out`` in it, a file or a directory, becomes the target by one rename.

    Works on any file system that Spark knows. An existing target is refused, before and after the work; after an error nothing is left.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __enter__(self) -> str:
        self.target, self.system = _file_system(self.spark, self.path)
        if self.system.exists(self.target):
            raise FileExistsError(self.path)
        self.stage = self.spark._jvm.org.apache.hadoop.fs.Path(self.target.getParent(), f".staged-{uuid.uuid4().hex}")
        self.system.mkdirs(self.stage)
        return self.stage.toString()

    def __exit__(self, kind, *_) -> None:
        try:
            if kind is None:
                if self.system.exists(self.target):
                    raise FileExistsError(self.path)
                if not self.system.rename(self.spark._jvm.org.apache.hadoop.fs.Path(self.stage, "out"), self.target):
                    raise OSError(f"not published: {self.path}")
        finally:
            self.system.delete(self.stage, True)


def write_dataset(tables: dict[str, DataFrame], path: str) -> None:
    """Several tables as one directory of Parquet folders, published together: readers see all of them or none."""
    spark = next(iter(tables.values())).sparkSession
    with published(spark, path) as stage:
        for name, df in tables.items():
            df.write.parquet(f"{stage}/out/{name}")


def write_json(report: dict, path: str) -> None:
    with staged(path) as temporary, open(temporary, "w", encoding="utf-8") as out:
        json.dump(report, out, indent=2, sort_keys=True, ensure_ascii=False)
        out.write("\n")


def plain(value: object) -> object:
    """A value of built-in types only: dates and paths as text, sets sorted, numbers of numpy as Python's. Others raise TypeError."""
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted(map(plain, value))
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (datetime.date, os.PathLike)):
        return value.isoformat() if isinstance(value, datetime.date) else os.fspath(value)
    if hasattr(value, "item"):
        return plain(value.item())
    raise TypeError(f"{type(value).__name__} has no plain form")


def write_cases(df: DataFrame, path: str, category: str) -> None:
    """JSON records in one folder for each category; an existing folder is refused."""
    df.write.partitionBy(category).mode("errorifexists").json(path)


def write_protocol(values: dict, path: str) -> None:
    """``key: <JSON value>`` lines in the given order; values that JSON can't hold raise TypeError."""
    with staged(path) as temporary, open(temporary, "w", encoding="utf-8") as out:
        out.writelines(f"{key}: {json.dumps(value, ensure_ascii=False)}\n" for key, value in values.items())


def label_text(df: DataFrame) -> DataFrame:
    """(file, value): the label lines of each file, ten decimals. ``df``: file, region_index, cls, xs, ys (normalised)."""
    points = F.flatten(F.zip_with("xs", "ys", lambda x, y: F.array(F.format_string("%.10f", x), F.format_string("%.10f", y))))
    line = F.concat_ws(" ", F.col("cls").cast("string"), F.array_join(points, " "))
    lines = F.array_sort(F.collect_list(F.struct("region_index", line.alias("line"))))
    return df.groupBy("file").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("value"))


class staged:  # noqa: N801
    """A temporary path beside the target, renamed to it at the end; an existing target is refused unless ``replace``."""

    def __init__(self, path: str, replace: bool = False):
        self.path, self.replace = path, replace

    def __enter__(self) -> str:
        if os.path.exists(self.path) and not self.replace:
            raise FileExistsError(self.path)
        self.folder = tempfile.mkdtemp(dir=os.path.dirname(os.path.abspath(self.path)))
        return os.path.join(self.folder, "out")

    def __exit__(self, kind, *_) -> None:
        try:
            if kind is None:
                os.replace(os.path.join(self.folder, "out"), self.path)
        finally:
            shutil.rmtree(self.folder, ignore_errors=True)
