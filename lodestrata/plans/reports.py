"""Named queries: partitions by mode and threshold, family and case reviews, matching analysis, manifests and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import scalar
from lodestrata.operators import assignment, masks, pairs
from lodestrata.operators.checks import threshold_label
from lodestrata.operators.components import connected_components, thinned
from lodestrata.operators.order import ranked
from lodestrata.plans.audits import _BOXES, _JUDGED, _boxes, _judged
from lodestrata.plans.relations import _EDGES, _RECORDS, known, records, spanning_relations, table
from lodestrata.session import materialise

#: Settings of inclusion: name, mode, the correlation of named edges and the reach of visual ones (see ``pairs.included``).
MODES = tuple((mode, mode, 0.995, 12) for mode in ("conservative", "current", "worst"))
THRESHOLDS = (0.9, 0.95, 0.99, 0.995, 0.999)


def _sized(spark, sf_dir) -> DataFrame:
    return records(spark, sf_dir, F.length("text").cast("long").alias("chars"))


def partitions(spark, sf_dir, settings: list[tuple[str, str, float, int]]) -> DataFrame:
    """(setting, doc_id, split, component) for every setting in one run: a node is a document in a setting."""
    rows = known(spark, sf_dir)
    columns = [F.col(c) for c in ("kind", "corr", "same", "distance", "full_corr")]
    wanted = F.filter(F.array(*(F.when(pairs.included(mode, *columns, named_at=at, reach=reach), F.lit(k)) for k, (_, mode, at, reach) in enumerate(settings))), lambda k: k.isNotNull())
    edges = spanning_relations(spark, sf_dir, rows).select("a", "b", F.explode(wanted).alias("k"))
    node = lambda c: (F.col(c) * len(settings) + F.col("k")).alias(c)
    found = connected_components(thinned(edges.select(node("a"), node("b")), "a", "b"), "a", "b")
    names = F.element_at(F.array(*(F.lit(name) for name, *_ in settings)), F.col("k") + 1)
    numbered = F.explode(F.array(*(F.lit(k) for k in range(len(settings)))))
    every = rows.select("doc_id", "split", numbered.alias("k")).withColumn("node", F.col("doc_id") * len(settings) + F.col("k"))
    joined = every.join(found, "node", "left").withColumn("component", F.floor(F.coalesce("component", "node") / len(settings)))
    return joined.select(names.alias("setting"), "doc_id", "split", "component")


def _partition_sql(settings) -> str:
    values = ", ".join(f"('{name}', '{mode}', {at}::DOUBLE, {reach})" for name, mode, at, reach in settings)
    return f"""{_EDGES},
settings(setting, mode, named_at, reach) AS (VALUES {values}),
taken AS (
  SELECT setting, a, b FROM settings, edges WHERE kind = 'exact'
    OR kind = 'named' AND (mode = 'worst' OR corr >= named_at AND (mode = 'current' OR same))
    OR kind = 'visual' AND distance <= reach AND (mode = 'worst' OR mode = 'current' AND corr >= 0.995 AND full_corr >= 0.96)),
ends AS (SELECT setting, a, b FROM taken UNION ALL SELECT setting, b, a FROM taken),
walk(setting, doc_id, component) AS (
  SELECT setting, doc_id, doc_id FROM settings, records
  UNION SELECT w.setting, b, component FROM walk w JOIN ends e ON e.setting = w.setting AND e.a = w.doc_id WHERE component < b),
parts AS (SELECT setting, doc_id, min(component) AS component FROM walk GROUP BY ALL)"""


def _statistics(parts: DataFrame) -> DataFrame:
    sizes = parts.groupBy("setting", "component").agg(F.count("*").alias("n"), F.countDistinct("split").alias("splits"))
    return sizes.groupBy("setting").agg(F.count("*").alias("groups"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("splits") > 1).alias("cross_split"))


_STATISTICS = """SELECT setting, count(*) AS groups, max(n) AS largest, count(*) FILTER (n = 1) AS single, count(*) FILTER (splits > 1) AS cross_split
FROM (SELECT setting, component, count(*) AS n, count(DISTINCT split) AS splits FROM parts JOIN records USING (doc_id) GROUP BY ALL) GROUP BY setting"""


def source_components_modes(spark, sf_dir):
    """Groups under the conservative, current and worst inclusion of edges."""
    return _statistics(partitions(spark, sf_dir, list(MODES)))


MODES_SQL = f"WITH RECURSIVE {_partition_sql(MODES)} {_STATISTICS}"

_SWEEP = [(threshold_label(t), "current", t, 12) for t in THRESHOLDS]


def threshold_group_sweep(spark, sf_dir):
    """Group statistics for each correlation that named edges need, named by a label that fits file names."""
    return _statistics(partitions(spark, sf_dir, _SWEEP))


SWEEP_SQL = f"WITH RECURSIVE {_partition_sql(_SWEEP)} {_STATISTICS}"


def partition_comparison(spark, sf_dir):
    """For each pair of modes: groups equal on both sides, groups on one side only, documents whose ids agree, and merges.

    A group equals one of the other side if their common documents are all that either has; no member lists are built.
    """
    parts = materialise(partitions(spark, sf_dir, list(MODES)).select("setting", "doc_id", "component"), "partitions")
    sizes = parts.groupBy("setting", "component").agg(F.count("*").alias("n"))
    left = parts.join(sizes, ["setting", "component"]).select(F.col("setting").alias("a"), "doc_id", F.col("component").alias("ca"), F.col("n").alias("na"))
    right = parts.join(sizes, ["setting", "component"]).select(F.col("setting").alias("b"), "doc_id", F.col("component").alias("cb"), F.col("n").alias("nb"))
    both = left.join(right, "doc_id").where("a < b").groupBy("a", "b", "ca", "cb", "na", "nb").agg(F.count("*").alias("n"))
    same = (F.col("n") == F.col("na")) & (F.col("n") == F.col("nb"))
    found = both.groupBy("a", "b").agg(F.count_if(same).alias("equal"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("n")).otherwise(0)).alias("agreeing_ids"))
    groups = sizes.groupBy("setting").agg(F.count("*").alias("groups"))
    joined = found.join(groups.toDF("a", "ga"), "a").join(groups.toDF("b", "gb"), "b")
    return joined.select("a", "b", "equal", "agreeing_ids", (F.col("ga") - F.col("equal")).alias("only_a"), (F.col("gb") - F.col("equal")).alias("only_b"), (F.col("ga") - F.col("gb")).alias("merges"))


COMPARISON_SQL = f"""WITH RECURSIVE {_partition_sql(MODES)},
groups AS (SELECT setting, component, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members FROM parts GROUP BY ALL),
modes AS (SELECT x.setting AS a, y.setting AS b FROM settings x JOIN settings y ON x.setting < y.setting)
SELECT a, b, (SELECT count(*) FROM groups x JOIN groups y USING (members) WHERE x.setting = a AND y.setting = b) AS equal,
       (SELECT count(*) FROM parts x JOIN parts y USING (doc_id) WHERE x.setting = a AND y.setting = b AND x.component = y.component) AS agreeing_ids,
       (SELECT count(*) FROM groups x WHERE x.setting = a AND members NOT IN (SELECT members FROM groups y WHERE y.setting = b)) AS only_a,
       (SELECT count(*) FROM groups x WHERE x.setting = b AND members NOT IN (SELECT members FROM groups y WHERE y.setting = a)) AS only_b,
       (SELECT count(*) FROM groups WHERE setting = a) - (SELECT count(*) FROM groups WHERE setting = b) AS merges FROM modes"""


def family_review(spark, sf_dir):
    """One row for each family in several splits: members, splits, sources, lengths, the closest neighbours, the strongest tier."""
    rows = _sized(spark, sf_dir).where("family IS NOT NULL")
    order = Window.partitionBy("family").orderBy("chars", "doc_id")
    near = F.when(F.col("chars") > 0, F.lag("chars").over(order) / F.col("chars"))
    groups = rows.withColumn("near", near).groupBy("family").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("split")), "|").alias("splits"), F.array_join(F.array_sort(F.collect_set("lang")), "|").alias("langs"),
        F.min("chars").alias("least_chars"), F.max("chars").alias("most_chars"), F.round(F.min("near"), 6).alias("weakest"), F.round(F.max("near"), 6).alias("strongest"), F.countDistinct("sha").alias("texts"),
    )
    tier = F.when(F.col("texts") < F.col("n"), "Confirmed").when(F.col("strongest") >= 0.995, "Supported").otherwise("Candidate")
    return groups.where(F.col("splits").contains("|")).withColumn("tier", tier).withColumn("tier_rank", scalar.tier_rank(F.col("tier")))


_REVIEW = f"""WITH {_RECORDS}, sized AS (SELECT r.*, length(text) AS chars FROM records r JOIN documents USING (doc_id) WHERE family IS NOT NULL),
near AS (SELECT *, lag(chars) OVER (PARTITION BY family ORDER BY chars, doc_id) / CAST(chars AS DOUBLE) AS near FROM sized),
review AS (
  SELECT family, count(*) AS n, string_agg(DISTINCT split, '|' ORDER BY split) AS splits, string_agg(DISTINCT lang, '|' ORDER BY lang) AS langs, min(chars) AS least_chars, max(chars) AS most_chars,
         round(min(near), 6) AS weakest, round(max(near), 6) AS strongest, count(DISTINCT sha) AS texts FROM near GROUP BY family HAVING count(DISTINCT split) > 1),
graded AS (SELECT *, CASE WHEN texts < n THEN 'Confirmed' WHEN strongest >= 0.995 THEN 'Supported' ELSE 'Candidate' END AS tier FROM review)"""
REVIEW_SQL = f"{_REVIEW} SELECT *, CAST(CASE tier WHEN 'Confirmed' THEN 4 WHEN 'Supported' THEN 2 ELSE 1 END AS INTEGER) AS tier_rank FROM graded"


def weakest_families(spark, sf_dir):
    """Ten families with the weakest link, weakest first."""
    return family_review(spark, sf_dir).orderBy("weakest", "family").limit(10).select("family", "weakest", "n", "tier")


WEAKEST_SQL = f"{_REVIEW} SELECT family, weakest, n, tier FROM graded ORDER BY weakest, family LIMIT 10"


def candidate_guards(spark, sf_dir):
    """Guard clusters: groups of the current mode, joined by the residual candidate edges of families between different groups."""
    rows = _sized(spark, sf_dir)
    parts = materialise(partitions(spark, sf_dir, [MODES[1]]).select("doc_id", F.col("component").alias("group_id")), "groups")
    of = rows.select("doc_id", "family").join(parts, "doc_id")
    residual = pairs.star_edges(of.where("family IS NOT NULL").select("family", "group_id").distinct(), "family", "group_id")
    guards = connected_components(residual).withColumnsRenamed({"node": "group_id", "component": "guard_id"})
    joined = parts.join(guards, "group_id", "left").withColumn("guard_id", F.coalesce("guard_id", "group_id"))
    return joined.groupBy("guard_id").agg(F.count("*").alias("documents"), F.countDistinct("group_id").alias("groups"))


GUARDS_SQL = f"""WITH RECURSIVE {_partition_sql([MODES[1]])},
keys AS (SELECT doc_id, 'g' || component AS k FROM parts UNION ALL SELECT doc_id, 'f' || family FROM records WHERE family IS NOT NULL),
spread(doc_id, guard_id) AS (SELECT doc_id, doc_id FROM records UNION SELECT y.doc_id, w.guard_id FROM spread w JOIN keys x ON x.doc_id = w.doc_id JOIN keys y ON y.k = x.k WHERE w.guard_id <= y.doc_id),
guards AS (SELECT doc_id, min(guard_id) AS guard_id FROM spread GROUP BY doc_id)
SELECT guard_id, count(*) AS documents, count(DISTINCT component) AS groups FROM guards JOIN parts USING (doc_id) GROUP BY guard_id"""


def duplicate_label_review(spark, sf_dir):
    """Copies of one text: whether their label signatures agree as a set, and as multisets of the splits."""
    rows = records(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    signature = F.concat_ws(":", F.coalesce(F.col("quality").cast("string"), F.lit("-")), F.coalesce(F.col("toxic").cast("string"), F.lit("-")))
    groups = rows.groupBy("sha").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.array_join(F.array_sort(F.collect_set(signature)), "|").alias("signatures"), F.countDistinct("split").alias("splits"))
    return groups.where("n > 1").withColumn("equal", ~F.col("signatures").contains("|"))


DUPLICATE_LABELS_SQL = f"""WITH {_RECORDS}, s AS (SELECT *, coalesce(CAST(quality AS VARCHAR), '-') || ':' || coalesce(CAST(toxic AS VARCHAR), '-') AS sig FROM records LEFT JOIN labels USING (doc_id))
SELECT sha, count(*) AS n, count(quality) AS labelled, string_agg(DISTINCT sig, '|' ORDER BY sig) AS signatures, count(DISTINCT split) AS splits, count(DISTINCT sig) = 1 AS equal FROM s GROUP BY sha HAVING count(*) > 1"""


def pool_totals(spark, sf_dir):
    """Documents by split and language with subtotals and the grand total in one pass; every level has to conserve the count."""
    rows = _sized(spark, sf_dir).rollup("split", "lang").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.countDistinct("source").alias("sources"), F.grouping_id().cast("int").alias("level"))
    return rows.select(F.coalesce("split", F.lit("*")).alias("split"), F.when(F.col("level") > 0, "*").otherwise(F.coalesce("lang", F.lit("?"))).alias("lang"), "n", "chars", "sources", "level")


TOTALS_SQL = f"""WITH {_RECORDS}
SELECT coalesce(split, '*') AS split, CASE WHEN grouping(split, lang) > 0 THEN '*' ELSE coalesce(lang, '?') END AS lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT r.source) AS sources, CAST(grouping(split, lang) AS INTEGER) AS level
FROM (SELECT r.*, text FROM records r JOIN documents USING (doc_id)) r GROUP BY ROLLUP (split, lang)"""


def paired_turns(spark, sf_dir):
    """Each user turn with the turn after it: paired, answered by the user again, or missing."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("chars").alias("asked"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"), F.col("chars").alias("answered"))
    status = F.when(F.col("next_role").isNull(), "missing").when(F.col("next_role") == "user", "same_role").otherwise("paired")
    return asked.join(after, ["conv_id", "turn"], "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum("asked").alias("asked"), F.sum("answered").alias("answered"))


PAIRED_SQL = """WITH a AS (SELECT conv_id, turn, length(text) AS asked FROM conversations WHERE role = 'user')
SELECT CASE WHEN c.role IS NULL THEN 'missing' WHEN c.role = 'user' THEN 'same_role' ELSE 'paired' END AS status, count(*) AS n, CAST(sum(asked) AS BIGINT) AS asked, CAST(sum(length(c.text)) AS BIGINT) AS answered
FROM a LEFT JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn + 1 GROUP BY ALL"""


def class_accuracy(spark, sf_dir):
    """For each class: labels, hits, misses, false positives and accuracy (null without labels)."""
    rows = _judged(spark, sf_dir)
    truth = rows.groupBy(F.col("truth").alias("cls")).agg(F.count("*").alias("labels"), F.count_if(F.col("guess") == F.col("truth")).alias("hits"))
    guess = rows.groupBy(F.col("guess").alias("cls")).agg(F.count_if(F.col("guess") != F.col("truth")).alias("false_positives"))
    joined = truth.join(guess, "cls", "full_outer").fillna(0, ["labels", "hits", "false_positives"])
    return joined.select("cls", "labels", "hits", (F.col("labels") - F.col("hits")).alias("misses"), "false_positives", F.round(F.try_divide("hits", "labels"), 6).alias("accuracy"))


ACCURACY_SQL = f"""WITH {_JUDGED}, c AS (SELECT unnest(range(3)) AS cls),
t AS (SELECT CAST(cls AS INTEGER) AS cls, count(*) FILTER (truth = cls) AS labels, count(*) FILTER (truth = cls AND guess = cls) AS hits, count(*) FILTER (guess = cls AND truth <> cls) AS false_positives, count(*) FILTER (truth = cls OR guess = cls) AS seen FROM judged, c GROUP BY ALL)
SELECT cls, labels, hits, labels - hits AS misses, false_positives, CASE WHEN labels > 0 THEN round(hits / labels, 6) END AS accuracy FROM t WHERE seen > 0"""


def foreign_predictions(spark, sf_dir):
    """Labels for documents outside a frozen split, and of unknown documents: a frozen analysis needs none of either."""
    known = records(spark, sf_dir).select("doc_id", "split")
    joined = table(spark, sf_dir, "labels").join(known, "doc_id", "left")
    return joined.groupBy(F.coalesce("split", F.lit("unknown")).alias("split")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("split") != "test", F.lit(True))).alias("outside_test"))


FOREIGN_SQL = f"WITH {_RECORDS} SELECT coalesce(split, 'unknown') AS split, count(*) AS n, count(*) FILTER (split IS DISTINCT FROM 'test') AS outside_test FROM labels LEFT JOIN records USING (doc_id) GROUP BY ALL"


def matched_boxes(spark, sf_dir):
    """One-to-one matches at an overlap of 0.2, with misses and false positives, and the failure category of each."""
    boxes = _boxes(spark, sf_dir)
    truth = boxes.select("image_id", "id", "cls", "box")
    predicted = boxes.select("image_id", "id", F.pmod(F.col("cls") + F.pmod("id", F.lit(2)), F.lit(3)).alias("cls"), "confidence", F.col("other").alias("box"))
    found = assignment.failure_category(assignment.match_boxes(truth, predicted, threshold=0.2))
    return found.select("image_id", "kind", "gt_id", "pred_id", "gt_class", "pred_class", "category")


#: Greedy matching as recursion over an image's candidates in their order; the state is the ids taken so far.
MATCHED_SQL = f"""WITH RECURSIVE {_BOXES},
cls AS (SELECT vec_id AS id, label % 3 AS g, (label % 3 + vec_id % 2) % 3 AS p, abs(CAST(embedding[9] AS DOUBLE)) AS confidence FROM embeddings),
raw AS (
  SELECT x.image_id, x.id AS gt, y.id AS pred, greatest(0, least(x.r0, y.r1) - greatest(x.l0, y.l1)) * greatest(0, least(x.b0, y.b1) - greatest(x.t0, y.t1)) AS i,
         (x.r0 - x.l0) * (x.b0 - x.t0) + (y.r1 - y.l1) * (y.b1 - y.t1) AS s FROM boxes x JOIN boxes y USING (image_id)),
c AS (
  SELECT image_id, gt, pred, i / (s - i) AS iou, row_number() OVER (PARTITION BY image_id ORDER BY i / (s - i) DESC, confidence DESC, CAST(gt AS VARCHAR), CAST(pred AS VARCHAR)) AS k
  FROM raw JOIN cls ON cls.id = pred WHERE i / (s - i) >= 0.2),
walk(image_id, k, gts, preds, won) AS (
  SELECT DISTINCT image_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), false FROM boxes
  UNION ALL
  SELECT w.image_id, c.k, CASE WHEN list_contains(gts, gt) OR list_contains(preds, pred) THEN gts ELSE list_append(gts, gt) END,
         CASE WHEN list_contains(gts, gt) OR list_contains(preds, pred) THEN preds ELSE list_append(preds, pred) END, NOT (list_contains(gts, gt) OR list_contains(preds, pred))
  FROM walk w JOIN c ON c.image_id = w.image_id AND c.k = w.k + 1),
won AS (SELECT image_id, gt, pred, iou FROM walk JOIN c USING (image_id, k) WHERE won),
out AS (
  SELECT image_id, 'matched' AS kind, gt AS gt_id, pred AS pred_id, iou FROM won
  UNION ALL SELECT image_id, 'missed', id, NULL, NULL FROM boxes WHERE id NOT IN (SELECT gt FROM won)
  UNION ALL SELECT image_id, 'false_positive', NULL, id, NULL FROM boxes WHERE id NOT IN (SELECT pred FROM won))
SELECT image_id, kind, gt_id, pred_id, CAST(a.g AS INTEGER) AS gt_class, CAST(b.p AS INTEGER) AS pred_class,
       CASE kind WHEN 'missed' THEN 'F1 missed' WHEN 'false_positive' THEN 'F2 false positive' ELSE CASE abs(a.g - b.p) WHEN 2 THEN 'F4 severe' WHEN 1 THEN 'F3 adjacent' ELSE CASE WHEN iou < 0.5 THEN 'F5 poor localisation' ELSE '' END END END AS category
FROM out LEFT JOIN cls a ON a.id = gt_id LEFT JOIN cls b ON b.id = pred_id"""


#: Side of the image that the polygons of boxes are drawn on, and what a box's unit and origin become there.
CANVAS, UNIT, ORIGIN = 48, 40.0, 0.5


def _corner(box: str, k: int) -> Column:
    return (F.get(box, F.lit(k)) + ORIGIN) * UNIT


def _shapes(box: str, notched: bool) -> Column:
    """Truth: the box with a notch from its lower side. Prediction: its upper left triangle and its lower right quarter, which overlap."""
    left, top, right, bottom = (_corner(box, k) for k in range(4))
    x, y = (left + right) / 2, (top + bottom) / 2
    at = lambda *points: F.array(*(F.array(p, q) for p, q in points))
    if notched:
        return F.array(at((left, top), (right, top), (right, bottom), (x, y), (left, bottom)))
    return F.array(at((left, top), (right, top), (left, bottom)), at((x, y), (right, y), (right, bottom), (x, bottom)))


def mask_localisation(spark, sf_dir):
    """Matched boxes with the overlap of their masks: poor localisation is judged by pixels."""
    boxes = _boxes(spark, sf_dir)
    size = F.lit(CANVAS)
    truth = masks.runs(boxes.select(F.col("id").alias("gt_id"), _shapes("box", True).alias("p")), "gt_id", "p", size, size)
    drawn = masks.runs(boxes.select(F.col("id").alias("pred_id"), _shapes("other", False).alias("p")), "pred_id", "p", size, size)
    guess = F.pmod(F.col("cls") + F.pmod("id", F.lit(2)), F.lit(3)).alias("cls")
    found = assignment.match_boxes(boxes.select("image_id", "id", "cls", "box"), boxes.select("image_id", "id", guess, "confidence", F.col("other").alias("box")), threshold=0.2)
    judged = assignment.failure_category(masks.overlaps(found.where("kind = 'matched'"), truth, drawn, "gt_id", "pred_id"))
    return judged.select("image_id", "gt_id", "pred_id", F.col("common").cast("long").alias("common"), F.col("together").cast("long").alias("together"), "category")


def _inside(points: list[tuple[str, str]]) -> str:
    """SQL: the pixel (px, py) has its centre in a polygon by the even-odd rule."""
    edges = zip(points, points[1:] + points[:1], strict=True)
    return "(" + " + ".join(f"CASE WHEN ({b} > py + 0.5::DOUBLE) <> ({d} > py + 0.5::DOUBLE) AND px + 0.5::DOUBLE < ({c} - {a}) * (py + 0.5::DOUBLE - {b}) / ({d} - {b}) + {a} THEN 1 ELSE 0 END" for (a, b), (c, d) in edges) + ") % 2 = 1"


MASKS_SQL = f"""WITH RECURSIVE {_BOXES}, m AS (SELECT * FROM ({MATCHED_SQL}) WHERE kind = 'matched'),
c AS (
  SELECT id, {", ".join(f"({side}{k} + {ORIGIN}::DOUBLE) * {UNIT}::DOUBLE AS {side}{k}" for k in "01" for side in "ltrb")} FROM boxes),
s AS (SELECT *, (l0 + r0) / 2 AS x0, (t0 + b0) / 2 AS y0, (l1 + r1) / 2 AS x1, (t1 + b1) / 2 AS y1 FROM c),
grid AS (SELECT px, py FROM (SELECT unnest(range({CANVAS})) AS px), (SELECT unnest(range({CANVAS})) AS py)),
pixels AS (
  SELECT id, px, py, {_inside([("l0", "t0"), ("r0", "t0"), ("r0", "b0"), ("x0", "y0"), ("l0", "b0")])} AS truth,
         {_inside([("l1", "t1"), ("r1", "t1"), ("l1", "b1")])} OR {_inside([("x1", "y1"), ("r1", "y1"), ("r1", "b1"), ("x1", "b1")])} AS drawn FROM s, grid),
counted AS (
  SELECT m.*, (SELECT count(*) FROM pixels a JOIN pixels b USING (px, py) WHERE a.id = gt_id AND b.id = pred_id AND a.truth AND b.drawn) AS common,
         (SELECT count(*) FROM pixels a JOIN pixels b USING (px, py) WHERE a.id = gt_id AND b.id = pred_id AND (a.truth OR b.drawn)) AS together FROM m)
SELECT image_id, gt_id, pred_id, common, together,
       CASE abs(gt_class - pred_class) WHEN 2 THEN 'F4 severe' WHEN 1 THEN 'F3 adjacent' ELSE CASE WHEN together = 0 OR common / together < 0.5 THEN 'F5 poor localisation' ELSE '' END END AS category FROM counted"""


def evidence_text(spark, sf_dir):
    """Evidence as text, numbers read back from it, a label that fits file names, a data URI of the digest and a run stamp."""
    rows = _sized(spark, sf_dir)
    share = F.round(F.col("chars") / 1000.0, 3)
    text = F.concat(F.lit("chars="), F.col("chars").cast("string"), F.lit("; share="), F.format_string("%.3f", share))
    back = lambda t, key, kind: F.regexp_extract(t, key + r"=([0-9.]+)", 1).cast(kind)
    named = rows.select("doc_id", "sha", text.alias("evidence"))
    return named.select(
        "doc_id", "evidence", back(F.col("evidence"), "chars", "long").alias("chars"), F.replace(F.regexp_extract("evidence", r"share=([0-9.]+)", 1), F.lit("."), F.lit("p")).alias("label"),
        F.concat(F.lit("data:application/octet-stream;base64,"), F.base64(F.unhex(F.substring("sha", 1, 16)))).alias("uri"),
        F.date_format(F.timestamp_seconds(F.col("doc_id") * 86_400), "yyyyMMdd'T'HHmmss'Z'").alias("stamp"),
    )


EVIDENCE_SQL = f"""WITH {_RECORDS}, t AS (SELECT doc_id, sha, length(text) AS chars, printf('%.3f', round(length(text) / 1000.0::DOUBLE, 3)) AS share FROM records JOIN documents USING (doc_id))
SELECT doc_id, 'chars=' || chars || '; share=' || share AS evidence, chars, replace(share, '.', 'p') AS label, 'data:application/octet-stream;base64,' || base64(unhex(substr(sha, 1, 16))) AS uri,
       strftime(make_timestamp(doc_id * 86400000000), '%Y%m%dT%H%M%SZ') AS stamp FROM t"""


def subset_manifest(spark, sf_dir):
    """Ten documents of each split by hash order, with bytes and digests: what a verified subset is checked against."""
    rows = records(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes")), "doc_id")
    order = Window.partitionBy("split").orderBy(scalar.hash_order(F.col("split"), F.col("doc_id").cast("string")), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("split", "doc_id", "bytes", "sha")


SUBSET_SQL = f"WITH {_RECORDS} SELECT split, doc_id, CAST(strlen(text) AS BIGINT) AS bytes, sha FROM records JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY split ORDER BY sha256(split || ':' || doc_id), doc_id) <= 10"


def preview_rows(spark, sf_dir):
    """The first 100 documents without a label, in order: a preview of orphans."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").orderBy("doc_id").limit(100)


PREVIEW_SQL = "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id) ORDER BY doc_id LIMIT 100"


def curve_diagnostics(spark, sf_dir):
    """First, last and best day of each event series, and the change between the ends; spread of the daily counts."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.groupBy("event_type").agg(
        F.min_by("n", "day").alias("first_n"), F.max_by("n", "day").alias("last_n"), F.date_format(F.min_by("day", F.struct(-F.col("n"), "day")), "yyyy-MM-dd").alias("best_day"),
        (F.max_by("n", "day") - F.min_by("n", "day")).alias("change"), F.median("n").alias("median"), (F.max("n") - F.min("n")).alias("range"),
    )


DIAGNOSTICS_SQL = """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, arg_min(n, day) AS first_n, arg_max(n, day) AS last_n, strftime(arg_min(day, {'n': -n, 'd': day}), '%Y-%m-%d') AS best_day, arg_max(n, day) - arg_min(n, day) AS change, median(n) AS median, max(n) - min(n) AS range FROM d GROUP BY event_type"""


def region_projection(spark, sf_dir):
    """Regions of an image without the one that is left out (number 3 of image 1), their label lines, and whether each line is valid."""
    e = lambda k: F.round(F.least(F.greatest(F.get("embedding", F.lit(k)).cast("double") + 0.5, F.lit(-0.1)), F.lit(1.1)), 4)
    region = lambda r: F.struct(F.lit(r).alias("region"), F.pmod(F.col("label") + r, F.lit(4)).alias("cls"), F.array(*(e(6 * r + k) for k in range(6))).alias("v"))
    images = table(spark, sf_dir, "embeddings").select("vec_id", F.array(*map(region, range(5))).alias("regions"))
    kept = images.select("vec_id", F.explode(F.filter("regions", lambda x: ~((F.col("vec_id") == 1) & (x["region"] == 3)))).alias("r"))
    inside: Column = F.forall("r.v", lambda x: x.between(0, 1))
    line = F.concat_ws(" ", F.col("r.cls").cast("string"), F.array_join(F.transform("r.v", lambda x: F.format_string("%.10f", x)), " "))
    return kept.select("vec_id", F.col("r.region").alias("region"), line.alias("line"), F.when(F.col("r.cls") > 2, "class").when(~inside, "range").otherwise("valid").alias("status"))


REGION_SQL = """WITH r AS (SELECT vec_id, region, CAST((label + region) % 4 AS INTEGER) AS cls, list_transform(range(6), lambda k: round(least(greatest(CAST(embedding[6 * region + k + 1] AS DOUBLE) + 0.5, -0.1), 1.1), 4)) AS v
  FROM embeddings, (SELECT CAST(unnest(range(5)) AS INTEGER) AS region) WHERE NOT (vec_id = 1 AND region = 3))
SELECT vec_id, region, cls || ' ' || array_to_string(list_transform(v, lambda x: printf('%.10f', x)), ' ') AS line,
       CASE WHEN cls > 2 THEN 'class' WHEN list_min(v) < 0 OR list_max(v) > 1 THEN 'range' ELSE 'valid' END AS status FROM r"""


def review_cases(spark, sf_dir):
    """Cases for a reviewer: weakest families, copies whose labels differ, clusters that candidate edges join; numbered in order."""
    weak = weakest_families(spark, sf_dir).select(F.lit("weak_family").alias("kind"), F.col("family").alias("subject"), F.format_string("%.6f", "weakest").alias("evidence"))
    conflict = duplicate_label_review(spark, sf_dir).where("NOT equal").select(F.lit("label_conflict").alias("kind"), F.col("sha").alias("subject"), F.col("signatures").alias("evidence"))
    guard = candidate_guards(spark, sf_dir).where("groups > 1").select(F.lit("guarded").alias("kind"), F.col("guard_id").cast("string").alias("subject"), F.concat(F.lit("groups="), F.col("groups").cast("string")).alias("evidence"))
    cases = weak.unionByName(conflict).unionByName(guard).withColumn("by", F.concat_ws("/", "kind", "subject"))
    return ranked(cases, "by").drop("by")


CASES_SQL = f"""WITH RECURSIVE weak AS ({WEAKEST_SQL}), conflict AS ({DUPLICATE_LABELS_SQL}), guard AS ({GUARDS_SQL}),
cases AS (
  SELECT 'weak_family' AS kind, family AS subject, printf('%.6f', weakest) AS evidence FROM weak
  UNION ALL SELECT 'label_conflict', sha, signatures FROM conflict WHERE NOT equal
  UNION ALL SELECT 'guarded', CAST(guard_id AS VARCHAR), 'groups=' || groups FROM guard WHERE groups > 1)
SELECT kind, subject, evidence, row_number() OVER (ORDER BY kind || '/' || subject) AS rank FROM cases"""


def config_sources(spark, sf_dir):
    """Settings with their source: asked for, taken over from the data, or the default; and whether they differ from the default."""
    documents = table(spark, sf_dir, "documents")
    seen = documents.agg(F.max(F.length("text")).cast("string").alias("longest"), F.countDistinct("lang").cast("string").alias("languages"), F.count("*").alias("n")).first()
    rows = [("longest", "4096", None, seen["longest"]), ("languages", "4", None, seen["languages"]), ("batch", "8", "16", None), ("epochs", "100", None, None)]
    asked = spark.createDataFrame(rows, "setting string, fallback string, requested string, derived string")
    source = F.when(F.col("requested").isNotNull(), "requested").when(F.col("derived").isNotNull(), "derived").otherwise("default")
    value = F.coalesce("requested", "derived", "fallback")
    return asked.select("setting", value.alias("value"), source.alias("source"), (value != F.col("fallback")).alias("differs"))


CONFIG_SQL = """WITH s AS (SELECT CAST(max(length(text)) AS VARCHAR) AS longest, CAST(count(DISTINCT lang) AS VARCHAR) AS languages FROM documents),
r(setting, fallback, requested, derived) AS (SELECT 'longest', '4096', NULL, longest FROM s UNION ALL SELECT 'languages', '4', NULL, languages FROM s UNION ALL SELECT 'batch', '8', '16', NULL UNION ALL SELECT 'epochs', '100', NULL, NULL)
SELECT setting, coalesce(requested, derived, fallback) AS value, CASE WHEN requested IS NOT NULL THEN 'requested' WHEN derived IS NOT NULL THEN 'derived' ELSE 'default' END AS source, coalesce(requested, derived, fallback) <> fallback AS differs FROM r"""

QUERIES = {
    "source_components_modes": (source_components_modes, MODES_SQL),
    "threshold_group_sweep": (threshold_group_sweep, SWEEP_SQL),
    "partition_comparison": (partition_comparison, COMPARISON_SQL),
    "family_review": (family_review, REVIEW_SQL),
    "weakest_families": (weakest_families, WEAKEST_SQL),
    "candidate_guards": (candidate_guards, GUARDS_SQL),
    "duplicate_label_review": (duplicate_label_review, DUPLICATE_LABELS_SQL),
    "pool_totals": (pool_totals, TOTALS_SQL),
    "paired_turns": (paired_turns, PAIRED_SQL),
    "class_accuracy": (class_accuracy, ACCURACY_SQL),
    "foreign_predictions": (foreign_predictions, FOREIGN_SQL),
    "greedy_box_matching": (matched_boxes, MATCHED_SQL),
    "mask_localisation": (mask_localisation, MASKS_SQL),
    "evidence_text": (evidence_text, EVIDENCE_SQL),
    "subset_manifest": (subset_manifest, SUBSET_SQL),
    "preview_rows": (preview_rows, PREVIEW_SQL),
    "curve_diagnostics": (curve_diagnostics, DIAGNOSTICS_SQL),
    "region_projection": (region_projection, REGION_SQL),
    "review_cases": (review_cases, CASES_SQL),
    "config_sources": (config_sources, CONFIG_SQL),
}
