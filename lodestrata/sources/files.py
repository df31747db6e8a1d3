"""Sources: archives, directory trees, annotation documents, tables, label lines, prediction runs, flat protocols."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.images import image_size
from lodestrata.functions.scalar import TIERS
from lodestrata.sources import archives

REGION = "struct<shape_attributes: struct<name: string, all_points_x: array<double>, all_points_y: array<double>>, region_attributes: map<string,string>>"


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """The listing of a ZIP or TAR archive; no member is read. Other files raise ValueError."""
    return archives.members(spark, path).select("path", "bytes", "compressed", "is_dir")


def single_root(members: DataFrame) -> str:
    """The one top directory of an archive, without resource-fork sidecars; ValueError if there isn't just one."""
    top = F.substring_index("path", "/", 1)
    roots = members.where(~F.col("path").startswith("__MACOSX/") & F.col("path").contains("/")).select(top.alias("root")).distinct().limit(2).collect()
    if len(roots) != 1:
        raise ValueError("exactly one root directory is required")
    return roots[0]["root"]


def image_members(members: DataFrame, folders: list[str]) -> DataFrame:
    """Members root/folder/name.suffix of the given folders with an image suffix."""
    parts = F.split("path", "/")
    return members.where((F.size(parts) == 3) & F.get(parts, F.lit(1)).isin(folders) & F.lower("path").rlike(r"\.(jpg|jpeg|png)$"))


def archive_image_sizes(spark: SparkSession, path: str, head: int = 1 << 16) -> DataFrame:
    """(path, width, height) from the first bytes of each image member; null where no header is found. Tasks read their members by offset."""
    rows = archives.members(spark, path, content=True, head=head).where(F.lower("path").rlike(r"\.(jpg|jpeg|png)$"))
    return rows.select("path", image_size("content").alias("size")).select("path", "size.width", "size.height")


def file_tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of every file below ``root``; content is read only if it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def open_source(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of a directory's files or an archive's members, sidecars left out; nothing is unpacked.

    Members that leave the root, and such as can't be read whole, raise an error when their rows are read.
    """
    if os.path.isdir(path):
        return file_tree(spark, path).select("path", "length", "content")
    rows = archives.members(spark, path, content=True).where(~F.col("is_dir") & ~F.col("path").rlike(r"(^|/)[._][^/]*$|^__MACOSX/"))
    bad = F.raise_error(F.concat_ws(" ", F.col("status"), F.lit("member:"), F.col("path"))).cast("string")
    return rows.select(F.when(F.col("status") == "ok", F.col("path")).otherwise(bad).alias("path"), F.col("bytes").alias("length"), "content")


def regions(raw: Column) -> Column:
    """A list of regions, or a map of them by number, as an array in that order."""
    listed = F.from_json(raw, f"array<{REGION}>")
    mapped = F.from_json(raw, f"map<string,{REGION}>")
    keys = F.array_sort(F.transform(F.map_keys(mapped), lambda k: F.struct(k.try_cast("int").alias("n"), k.alias("k"))))
    ordered = F.transform(keys, lambda x: mapped[x["k"]])
    return F.when(F.trim(raw).startswith("["), listed).otherwise(ordered)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(file, filename, region_index, label, shape, xs, ys) from annotation documents, bare or wrapped; one row for each region."""
    text = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    body = F.coalesce(F.get_json_object("value", "$._via_img_metadata"), F.col("value"))
    entries = F.from_json(body, "map<string, struct<filename: string, regions: string>>")
    images = text.select("file", F.explode(entries).alias("key", "e")).select("file", "e.filename", regions(F.col("e.regions")).alias("regions"))
    rows = images.select("file", "filename", F.posexplode_outer("regions").alias("region_index", "r"))
    label = F.trim(F.col("r.region_attributes")["name"])
    return rows.select("file", "filename", "region_index", F.when(label != "", label).alias("label"), F.col("r.shape_attributes.name").alias("shape"), F.col("r.shape_attributes.all_points_x").alias("xs"), F.col("r.shape_attributes.all_points_y").alias("ys"))


def keyed_annotations(spark: SparkSession, path: str, unique: bool = True) -> DataFrame:
    """(split, filename, regions) from documents named split/anything.json: the regions of an image as one array in order.

    With ``unique`` a file name that is there twice in a split fails when the rows are read.
    """
    rows = annotations(spark, path).withColumn("split", F.element_at(F.split("file", "/"), -2))
    region = F.struct("region_index", "label", "shape", "xs", "ys")
    one = rows.groupBy("split", "filename", "file").agg(F.array_sort(F.collect_list(F.when(F.col("region_index").isNotNull(), region))).alias("regions"), F.count_if(F.coalesce("region_index", F.lit(0)) == 0).alias("entries"))
    keyed = one.groupBy("split", "filename").agg(F.sum("entries").alias("entries"), F.first("regions").alias("regions"))
    twice = F.raise_error(F.concat(F.lit("file name is there twice: "), "split", F.lit("/"), "filename")).cast("string")
    name = F.when(F.col("entries") > 1, twice).otherwise(F.col("filename")) if unique else F.col("filename")
    return keyed.select("split", name.alias("filename"), "regions")


def adjudications(spark: SparkSession, path: str, tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """(a, b, prior, reviewed) from a JSON list of reviewed relations; equal ends, unknown tiers or a pair given twice raise ValueError."""
    rows = spark.read.json(path, schema="a string, b string, prior string, reviewed string", multiLine=True, mode="FAILFAST")
    pair = rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "prior", "reviewed")
    bad = pair.where(F.coalesce((F.col("a") == F.col("b")) | ~F.col("prior").isin(*tiers) | ~F.col("reviewed").isin(*tiers), F.lit(True)))
    if bad.limit(1).count() or pair.groupBy("a", "b").count().where("count > 1").limit(1).count():
        raise ValueError("adjudications need two ends, known tiers and one row for each pair")
    return pair


def with_polygons(rows: DataFrame, spark: SparkSession, folder: str, reference: str = "mask_reference") -> DataFrame:
    """Predictions with the polygon of their side file (a JSON array of [x, y]); a reference without a file fails, no reference is null."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"))
    side = files.select(F.col("name").alias("side_name"), F.from_json("value", "array<array<double>>").alias("polygon"))
    joined = rows.join(side, F.element_at(F.split(F.col(reference), "/"), -1) == F.col("side_name"), "left")
    missing = F.raise_error(F.concat(F.lit("no polygon file "), F.col(reference))).cast("array<array<double>>")
    polygon = F.when(F.col(reference).isNull(), F.lit(None)).when(F.col("polygon").isNull(), missing).otherwise(F.col("polygon"))
    return joined.withColumn("polygon", polygon).drop("side_name")


def csv_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV file with a header, an explicit schema and no guessing; a bad row fails."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def training_curve(spark: SparkSession, path: str) -> DataFrame:
    """A per-epoch CSV whose header names may be padded with blanks; all values are doubles."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.select(*(F.col(f"`{c}`").try_cast("double").alias(c.strip()) for c in raw.columns))


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, cls, xs, ys) from label files: a class and normalised coordinates on each line."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    parts = F.split(F.trim("text"), r"\s+")
    numbers = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.try_cast("double"))
    rows = lines.where(F.trim("text") != "").select("file", "line", F.get(parts, F.lit(0)).try_cast("int").alias("cls"), numbers.alias("v"))
    return rows.select("file", "line", "cls", F.filter("v", lambda x, i: i % 2 == 0).alias("xs"), F.filter("v", lambda x, i: i % 2 == 1).alias("ys"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction rows with their box parsed; confidence outside 0 to 1 or a box of other than four numbers fails."""
    schema = "image_id string, pred_instance_id string, pred_class int, confidence double, box string"
    rows = csv_table(spark, path, schema).withColumn("box", F.from_json("box", "array<double>"))
    bad = F.coalesce(~F.col("confidence").between(0, 1) | (F.size("box") != 4), F.lit(True))
    return rows.withColumn("confidence", F.when(bad, F.raise_error(F.lit("bad prediction row")).cast("double")).otherwise(F.col("confidence")))


def flat_protocol(path: str) -> dict:
    """``key: <JSON value>`` lines; comments and blank lines are skipped."""
    with open(path, encoding="utf-8") as source:
        lines = [x.rstrip("\n") for x in source if x.strip() and not x.lstrip().startswith("#")]
    return {key: json.loads(value) for key, value in (x.split(": ", 1) for x in lines)}


def resolve_source(explicit: str | None, variable: str, fallbacks: list[str], platform_default: str | None = None) -> str:
    """The first that exists of: an explicit path, an environment variable's, the platform's default, the fallbacks."""
    for path in [explicit] if explicit else [os.environ.get(variable), platform_default, *fallbacks]:
        if path and os.path.exists(path):
            return path
    raise FileNotFoundError("no source: give a path or set " + variable)
