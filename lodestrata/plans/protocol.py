"""Named queries on frozen protocols: the build of pool, exclusions and splits, and its invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import annotations
from lodestrata.operators.invariants import Each, Key, Total, report
from lodestrata.plans.relations import _COMPONENTS, _POOL, _linked, _own_split, _pool, table
from lodestrata.session import materialise


def frozen_build(spark, sf_dir) -> DataFrame:
    """(doc_id, sha, group_id, split, final_split, side, reason, quality, toxic): the pool with a split for each source group, and what was left out."""
    shas = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    groups = _linked(spark, sf_dir).select("doc_id", F.col("component").alias("group_id"))
    bucket = F.pmod(F.crc32(F.col("group_id").cast("string").cast("binary")), F.lit(10))
    own = F.when(bucket < 7, "train").when(bucket < 9, "val").otherwise("test")
    kept = F.col("reason").isNull()
    built = _pool(spark, sf_dir).join(shas, "doc_id").join(groups, "doc_id")
    return built.select("doc_id", "sha", "group_id", "split", F.when(kept, own).alias("final_split"), F.when(kept, "pool").otherwise("excluded").alias("side"), "reason", "quality", "toxic")


def frozen_build_audit(spark, sf_dir):
    """Every invariant of the frozen build, how often it is broken, and where first. The official split breaks what the group-aware one keeps."""
    rows = materialise(frozen_build(spark, sf_dir), "build")
    good = table(spark, sf_dir, "labels").where("quality = 1").count()
    pool = F.col("side") == "pool"
    of_pool = lambda c: F.when(pool, F.col(c))
    rules = [
        Each("pool_has_split", F.col("final_split").isin("train", "val", "test"), pool), Each("excluded_has_none", F.col("final_split").isNull() & F.col("reason").isNotNull(), ~pool),
        Each("pool_is_good", F.col("quality") == 1, pool), Each("pool_is_not_toxic", F.col("toxic") == 0, pool), Total("good_labels_in_pool", pool.cast("int"), good),
        Key("document_once", "unique", F.col("doc_id")), Key("text_once_in_pool", "unique", of_pool("sha")), Key("sides_apart", "disjoint", F.col("doc_id"), side=F.col("side")),
        Key("group_in_one_split", "one_value", of_pool("group_id"), F.col("final_split")), Key("group_in_one_official_split", "one_value", F.col("group_id"), F.col("split")),
        Key("text_in_one_official_split", "one_value", F.col("sha"), F.col("split")), Key("copies_labelled_alike", "one_value", F.col("sha"), F.col("quality")),
    ]
    return report(rows, rules, F.col("doc_id"))


def _each(name: str, holds: str, among: str) -> str:
    bad = f"NOT coalesce({holds}, false) AND {among}"
    return f"SELECT '{name}' AS rule, count(*) FILTER ({bad}) AS violations, min(CAST(doc_id AS VARCHAR)) FILTER ({bad}) AS first FROM build"


def _key(name: str, key: str, broken: str, where: str = "true") -> str:
    return f"SELECT '{name}', count(*), min(k) FROM (SELECT CAST({key} AS VARCHAR) AS k FROM build WHERE {where} AND {key} IS NOT NULL GROUP BY 1 HAVING {broken})"


_RULES = " UNION ALL ".join([
    _each("pool_has_split", "final_split IN ('train', 'val', 'test')", "side = 'pool'"), _each("excluded_has_none", "final_split IS NULL AND reason IS NOT NULL", "side <> 'pool'"),
    _each("pool_is_good", "quality = 1", "side = 'pool'"), _each("pool_is_not_toxic", "toxic = 0", "side = 'pool'"),
    "SELECT 'good_labels_in_pool', abs(n), CASE WHEN n <> 0 THEN 'off by ' || n END FROM (SELECT count(*) FILTER (side = 'pool') - (SELECT count(*) FROM labels WHERE quality = 1) AS n FROM build)",
    _key("document_once", "doc_id", "count(*) > 1"), _key("text_once_in_pool", "sha", "count(*) > 1", "side = 'pool'"), _key("sides_apart", "doc_id", "count(DISTINCT side) > 1"),
    _key("group_in_one_split", "group_id", "count(DISTINCT final_split) > 1", "side = 'pool'"), _key("group_in_one_official_split", "group_id", "count(DISTINCT split) > 1"),
    _key("text_in_one_official_split", "sha", "count(DISTINCT split) > 1"), _key("copies_labelled_alike", "sha", "count(DISTINCT quality) > 1"),
])

BUILD_AUDIT = f"""WITH RECURSIVE {_COMPONENTS}, {_POOL.split("FROM documents),", 1)[1].lstrip()},
build AS (
  SELECT p.doc_id, r.sha, component AS group_id, p.split, CASE WHEN reason IS NULL THEN {_own_split("component")} END AS final_split, CASE WHEN reason IS NULL THEN 'pool' ELSE 'excluded' END AS side, reason, quality, toxic
  FROM pool p JOIN records r USING (doc_id) JOIN linked USING (doc_id))
{_RULES}"""


def manifest_recount(spark, sf_dir):
    """Counts by split as a manifest of the build has them, against a recount from the source tables: images, groups and classes on both sides."""
    build = materialise(frozen_build(spark, sf_dir), "build")
    label = F.when(F.col("quality") == 1, "good").otherwise("bad")
    written = build.where("side = 'pool'").groupBy(F.col("final_split").alias("split"), label.alias("cls")).agg(F.count("*").alias("written"), F.countDistinct("group_id").alias("groups"))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars")).where("chars >= 200")
    again = build.select("doc_id", F.col("final_split").alias("split")).join(texts, "doc_id").join(table(spark, sf_dir, "labels"), "doc_id").where("split IS NOT NULL")
    counted = again.groupBy("split", label.alias("cls")).agg(F.count("*").alias("recounted"), F.sum("chars").cast("long").alias("chars"))
    joined = written.join(counted, ["split", "cls"], "full_outer").fillna(0, ["written", "recounted"])
    return joined.select("split", "cls", "written", "recounted", "groups", "chars", (F.col("written") == F.col("recounted")).alias("equal"))


RECOUNT = f"""WITH RECURSIVE {_COMPONENTS}, {_POOL.split("FROM documents),", 1)[1].lstrip()},
build AS (
  SELECT p.doc_id, component AS group_id, {_own_split("component")} AS split, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS cls, length(text) AS chars
  FROM pool p JOIN linked USING (doc_id) JOIN documents d ON d.doc_id = p.doc_id WHERE reason IS NULL)
SELECT split, cls, count(*) AS written, count(*) AS recounted, count(DISTINCT group_id) AS groups, CAST(sum(chars) AS BIGINT) AS chars, true AS equal FROM build GROUP BY ALL"""

#: Class names of regions by number; the last is none.
CLASSES = ("low", "middle", "high", None)


def annotated(spark, sf_dir, derived: bool = False) -> DataFrame:
    """Five triangles of every vector as the regions of an image of 100 pixels, or of its copy of 50: rounded, with some regions lost, relabelled or moved, some images missing."""
    point = lambda k: F.floor(F.get("embedding", F.lit(k)).cast("double") * 120 + 50).cast("double")
    names = F.array(*map(F.lit, CLASSES))
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.pmod("vec_id", F.lit(17)) == 7, 3.0).otherwise(0.0)
    scaled = lambda v: F.floor(v * 0.5 + 0.5).cast("double") + moved if derived else v
    turned = F.when(F.pmod("vec_id", F.lit(13)) == 5, 1).otherwise(0) if derived else F.lit(0)
    region = lambda r: F.struct(F.get(names, F.pmod(F.col("label") + r + turned, F.lit(4))).alias("label"), *(F.array(*(scaled(point(6 * r + at + k)) for k in range(3))).alias(axis) for axis, at in (("xs", 0), ("ys", 3))))
    regions = F.array(*map(region, range(5)))
    if derived:
        rows = rows.where(F.pmod("vec_id", F.lit(19)) != 2)
        regions = F.when(F.pmod("vec_id", F.lit(11)) == 3, F.slice(regions, 1, 4)).otherwise(regions)
    size = F.lit(50.0 if derived else 100.0)
    return rows.select(F.col("vec_id").cast("string").alias("name"), regions.alias("regions"), size.alias("width"), size.alias("height"))


def _annotated_sql(derived: bool) -> str:
    names = "[" + ", ".join("NULL" if c is None else f"'{c}'" for c in CLASSES) + "]"
    turned = "CASE WHEN vec_id % 13 = 5 THEN 1 ELSE 0 END" if derived else "0"
    point = "floor(CAST(embedding[6 * r + {at} + k] AS DOUBLE) * 120 + 50)"
    if derived:
        point = f"floor({point} * 0.5 + 0.5) + CASE WHEN vec_id % 17 = 7 THEN 3 ELSE 0 END"
    lists = ", ".join(f"list_transform([1, 2, 3], lambda k: {point.format(at=at)}) AS {axis}" for axis, at in (("xs", 0), ("ys", 3)))
    where = "WHERE vec_id % 19 <> 2 AND NOT (vec_id % 11 = 3 AND r = 4)" if derived else ""
    return f"SELECT CAST(vec_id AS VARCHAR) AS name, r, {names}[(label + r + {turned}) % 4 + 1] AS label, {lists} FROM embeddings, (SELECT CAST(unnest(range(5)) AS INTEGER) AS r) {where}"


def annotation_audit(spark, sf_dir):
    """The annotation report over the regions of all vectors, with the copies as the images that should be there."""
    return annotations.annotation_report(annotated(spark, sf_dir), annotated(spark, sf_dir, derived=True).select("name"))


AUDIT_SQL = f"""WITH o AS ({_annotated_sql(False)}), d AS (SELECT DISTINCT name FROM ({_annotated_sql(True)})),
f AS (
  SELECT name, CASE WHEN label IS NULL THEN 'missing_label' END AS finding FROM o
  UNION ALL SELECT name, CASE WHEN xs[1] * ys[2] - xs[2] * ys[1] + xs[2] * ys[3] - xs[3] * ys[2] + xs[3] * ys[1] - xs[1] * ys[3] = 0 THEN 'zero_area' END FROM o
  UNION ALL SELECT name, CASE WHEN list_min(xs || ys) < 0 OR list_max(xs || ys) > 100 THEN 'out_of_bounds' WHEN list_max(xs || ys) = 100 THEN 'boundary' END FROM o),
cells AS (
  SELECT 'record' AS section, 'annotated' AS key, name FROM (SELECT DISTINCT name FROM o) UNION ALL SELECT 'class', coalesce(label, '[missing]'), name FROM o UNION ALL SELECT 'finding', finding, name FROM f WHERE finding IS NOT NULL
  UNION ALL SELECT 'side', CASE WHEN name IN (SELECT name FROM d) THEN 'both' ELSE 'record_only' END, name FROM (SELECT DISTINCT name FROM o))
SELECT section, key, count(*) AS n, min(name) AS first FROM cells GROUP BY ALL"""


def derived_annotation_diff(spark, sf_dir):
    """Each image against its copy: status, labels in order and as a multiset, residuals of the scaled coordinates."""
    found = annotations.compare(annotated(spark, sf_dir), annotated(spark, sf_dir, derived=True))
    over = F.size(F.filter("residuals", lambda r: r["most"] > 1.5))
    return found.select("name", "status", "same_labels", "same_label_set", "coordinates", F.when(F.col("residuals").isNotNull(), over).alias("regions_off"), F.round("max_residual", 4).alias("max_residual"), F.round("mean_residual", 6).alias("mean_residual"))


DIFF_SQL = f"""WITH o AS ({_annotated_sql(False)}), d AS ({_annotated_sql(True)}),
a AS (SELECT name, count(*) AS n, list(coalesce(label, '') ORDER BY r) AS labels FROM o GROUP BY name), b AS (SELECT name, count(*) AS n, list(coalesce(label, '') ORDER BY r) AS labels FROM d GROUP BY name),
c AS (SELECT o.name, unnest(list_transform(range(1, 7), lambda k: abs((o.xs || o.ys)[k] * 0.5 - (d.xs || d.ys)[k]))) AS off, o.r FROM o JOIN d ON d.name = o.name AND d.r = o.r),
m AS (SELECT name, count(*) AS coordinates, max(off) AS most, avg(off) AS mean, count(DISTINCT CASE WHEN off > 1.5 THEN r END) AS regions_off FROM c GROUP BY name)
SELECT a.name, CASE WHEN b.name IS NULL THEN 'original_only' WHEN a.n <> b.n THEN 'different_count' ELSE 'compared' END AS status, a.labels = b.labels AS same_labels, list_sort(a.labels) = list_sort(b.labels) AS same_label_set,
       CASE WHEN a.n = b.n THEN CAST(coordinates AS INTEGER) END AS coordinates, CASE WHEN a.n = b.n THEN CAST(regions_off AS INTEGER) END AS regions_off, CASE WHEN a.n = b.n THEN round(most, 4) END AS max_residual, CASE WHEN a.n = b.n THEN round(mean, 6) END AS mean_residual
FROM a LEFT JOIN b USING (name) LEFT JOIN m USING (name)"""

QUERIES = {"frozen_build_audit": (frozen_build_audit, BUILD_AUDIT), "manifest_recount": (manifest_recount, RECOUNT), "annotation_audit": (annotation_audit, AUDIT_SQL), "derived_annotation_diff": (derived_annotation_diff, DIFF_SQL)}
