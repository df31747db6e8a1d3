"""Named queries: aggregates, samples, set comparisons, geometry, matching and provenance over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import scalar
from lodestrata.operators import assignment, checks
from lodestrata.operators.boxes import overlapping
from lodestrata.plans.relations import _RECORDS, records, table
from lodestrata.session import materialise
from lodestrata.sources import archives

LABELS = (0, 1)


def class_counts(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    label = F.coalesce(F.col("quality").cast("string"), F.lit("Unlabeled / Unknown"))
    return joined.groupBy("lang", label.alias("label")).agg(F.count("*").alias("n"))


CLASS_COUNTS = "SELECT lang, coalesce(CAST(quality AS VARCHAR), 'Unlabeled / Unknown') AS label, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL"


def orphans_both_ways(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    missing = documents.join(labels, "doc_id", "left_anti").select("doc_id", F.lit("no_label").alias("side"))
    return missing.union(labels.join(documents, "doc_id", "left_anti").select("doc_id", F.lit("no_document").alias("side")))


ORPHANS = """SELECT doc_id, 'no_label' AS side FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'no_document' FROM labels ANTI JOIN documents USING (doc_id)"""


#: Runs of white space, in Java's and in RE2's syntax.
BLANKS = r"[\x20\x09-\x0D]+"


def _tidied(spark, sf_dir):
    """Documents with runs of white space made one blank: what a cleaned copy of the table holds."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.regexp_replace("text", BLANKS, " ").alias("text"))


_TIDIED = f"tidied AS (SELECT doc_id, lang, regexp_replace(text, '{BLANKS}', ' ', 'g') AS text FROM documents)"


def manifest_diff(spark, sf_dir):
    """Rows on one side only of the documents' manifest and of one written for their cleaned copies, as multisets. The written one is reread."""
    entry = lambda rows: rows.select("doc_id", F.length("text").cast("long").alias("chars"), F.size(F.split("text", "\n")).cast("long").alias("lines"))
    return checks.difference(materialise(entry(_tidied(spark, sf_dir)), "manifest"), entry(table(spark, sf_dir, "documents")))


MANIFEST_DIFF = f"""WITH {_TIDIED}, 
w AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, len(string_split(text, chr(10))) AS lines FROM tidied), f AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, len(string_split(text, chr(10))) AS lines FROM documents)
(SELECT *, 'expected' AS side FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM f)) UNION ALL (SELECT *, 'found' FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM w))"""


def identity_verify(spark, sf_dir):
    """Digests written for the cleaned copies of labelled documents, against the documents of 500 characters or more: identical, altered, missing and extra ones."""
    entry = lambda rows: rows.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha"))
    written = materialise(entry(table(spark, sf_dir, "labels").select("doc_id").join(_tidied(spark, sf_dir), "doc_id")), "identities")
    actual = entry(table(spark, sf_dir, "documents").where(F.length("text") >= 500))
    return checks.identity(written, actual).groupBy("status").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


IDENTITY = f"""WITH {_TIDIED}, d AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha FROM documents WHERE length(text) >= 500),
w AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha FROM labels JOIN tidied USING (doc_id))
SELECT CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN w.doc_id IS NULL THEN 'extra' WHEN w.sha IS DISTINCT FROM d.sha THEN 'altered' ELSE 'identical' END AS status,
       count(*) AS n, CAST(sum(coalesce(w.bytes, d.bytes)) AS BIGINT) AS bytes FROM w FULL JOIN d ON w.doc_id = d.doc_id GROUP BY ALL"""


def hash_ordered_sample(spark, sf_dir):
    rows = records(spark, sf_dir)
    order = Window.partitionBy("split").orderBy(scalar.hash_order(F.col("split"), F.col("doc_id").cast("string")), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("split", "doc_id", "rank")


SAMPLE = f"WITH {_RECORDS} SELECT split, doc_id, CAST(row_number() OVER (PARTITION BY split ORDER BY sha256(split || ':' || doc_id), doc_id) AS INTEGER) AS rank FROM records QUALIFY rank <= 10"


def _judged(spark, sf_dir):
    """Labels against a rule's prediction, three ordered classes: 0 low, 1 plain, 2 toxic."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("chars"), F.col("text").rlike(r"[#$%&*|]").alias("odd"))
    joined = table(spark, sf_dir, "labels").join(documents, "doc_id")
    truth = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).otherwise(0)
    guess = F.when(F.col("odd"), 0).when(F.col("chars") > 5000, 2).otherwise(1)
    return joined.select("doc_id", "lang", "chars", truth.alias("truth"), guess.alias("guess"))


_JUDGED = """judged AS (
  SELECT doc_id, lang, length(text) AS chars, CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS truth,
         CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 0 WHEN length(text) > 5000 THEN 2 ELSE 1 END AS guess
  FROM labels JOIN documents USING (doc_id))"""


def confusion_and_ordinal_error(spark, sf_dir):
    apart = F.abs(F.col("truth") - F.col("guess"))
    cells = [F.count_if(F.col("guess") == k).alias(f"guess_{k}") for k in range(3)]
    share = lambda n: F.round(F.count_if(apart == n) / F.count("*"), 6)
    return _judged(spark, sf_dir).groupBy("truth").agg(*cells, share(1).alias("adjacent_rate"), share(2).alias("severe_rate"), F.round(F.avg(apart), 6).alias("mean_distance"))


CONFUSION = f"""WITH {_JUDGED}
SELECT truth, count(*) FILTER (guess = 0) AS guess_0, count(*) FILTER (guess = 1) AS guess_1, count(*) FILTER (guess = 2) AS guess_2,
       round(count(*) FILTER (abs(truth - guess) = 1) / count(*), 6) AS adjacent_rate, round(count(*) FILTER (abs(truth - guess) = 2) / count(*), 6) AS severe_rate,
       round(avg(abs(truth - guess)), 6) AS mean_distance FROM judged GROUP BY truth"""


def _outcomes(spark, sf_dir):
    """Every labelled document and every one of 200 characters or more as an outcome: without a label a false positive, too short for a prediction missed, else matched with an overlap."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("chars"))
    joined = documents.join(_judged(spark, sf_dir).select("doc_id", "truth", "guess"), "doc_id", "left").where("truth IS NOT NULL OR chars >= 200")
    kind = F.when(F.col("truth").isNull(), "false_positive").when(F.col("chars") < 200, "missed").otherwise("matched")
    overlap = F.least(F.col("chars"), F.lit(2000)) / 2000.0
    return assignment.failure_category(joined.select("doc_id", "lang", "chars", kind.alias("kind"), F.col("truth").alias("gt_class"), F.col("guess").alias("pred_class"), overlap.alias("box_iou")))


_OUTCOMES = f"""{_JUDGED}, outcomes AS (
  SELECT doc_id, d.lang, length(text) AS chars, CASE WHEN truth IS NULL THEN 'F2 false positive' WHEN length(text) < 200 THEN 'F1 missed' WHEN abs(truth - guess) = 2 THEN 'F4 severe'
         WHEN abs(truth - guess) = 1 THEN 'F3 adjacent' WHEN least(length(text), 2000) / 2000.0::DOUBLE < 0.5 THEN 'F5 poor localisation' ELSE '' END AS category
  FROM documents d LEFT JOIN judged j USING (doc_id) WHERE truth IS NOT NULL OR length(text) >= 200)"""


def failure_taxonomy(spark, sf_dir):
    return _outcomes(spark, sf_dir).groupBy("lang", "category").agg(F.count("*").alias("n"))


TAXONOMY = f"WITH {_OUTCOMES} SELECT lang, category, count(*) AS n FROM outcomes GROUP BY ALL"


def top_cases_per_category(spark, sf_dir):
    rows = _outcomes(spark, sf_dir).where("category <> ''")
    order = Window.partitionBy("category").orderBy(F.desc("chars"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("category", "rank", "doc_id")


TOP_CASES = f"WITH {_OUTCOMES} SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY chars DESC, doc_id) AS INTEGER) AS rank, doc_id FROM outcomes WHERE category <> '' QUALIFY rank <= 10"


def _boxes(spark, sf_dir):
    """Two boxes for each vector, truth and prediction, grouped ten vectors to an image."""
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    box = lambda k: F.array(e(k), e(k + 1), e(k) + F.abs(e(k + 2)) + 0.1, e(k + 1) + F.abs(e(k + 3)) + 0.1)
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 10).cast("long").alias("image_id"), F.col("vec_id").alias("id"), F.pmod("label", F.lit(3)).alias("cls"), box(0).alias("box"), box(4).alias("other"), F.abs(e(8)).alias("confidence"))


_BOXES = """b AS (
  SELECT vec_id // 10 AS image_id, vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
boxes AS (
  SELECT image_id, id, e[1] AS l0, e[2] AS t0, e[1] + abs(e[3]) + 0.1::DOUBLE AS r0, e[2] + abs(e[4]) + 0.1::DOUBLE AS b0,
         e[5] AS l1, e[6] AS t1, e[5] + abs(e[7]) + 0.1::DOUBLE AS r1, e[6] + abs(e[8]) + 0.1::DOUBLE AS b1 FROM b)"""


def box_iou_candidates(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    found = overlapping(boxes.select("image_id", F.col("id").alias("gt_id"), "box"), boxes.select("image_id", F.col("id").alias("pred_id"), "other"), "image_id", "box", "other", 0.2)
    return found.select("l.image_id", "l.gt_id", "r.pred_id", F.round("overlap", 6).alias("iou"))


BOX_IOU = f"""WITH {_BOXES}, p AS (
  SELECT x.image_id, x.id AS gt_id, y.id AS pred_id, greatest(0, least(x.r0, y.r1) - greatest(x.l0, y.l1)) * greatest(0, least(x.b0, y.b1) - greatest(x.t0, y.t1)) AS i,
         (x.r0 - x.l0) * (x.b0 - x.t0) + (y.r1 - y.l1) * (y.b1 - y.t1) AS s FROM boxes x JOIN boxes y USING (image_id))
SELECT image_id, gt_id, pred_id, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) >= 0.2"""


def iou_policy_probe(spark, sf_dir):
    """What becomes of boxes without a valid class (every seventh) in class-aware matching: left out, ignored where nothing else matches, or kept as targets."""
    boxes = _boxes(spark, sf_dir)
    unknown = F.pmod("id", F.lit(7)) == 3
    guess = F.pmod(F.col("cls") + F.pmod("id", F.lit(2)), F.lit(3))
    predicted = boxes.select("image_id", "id", guess.alias("cls"), F.col("other").alias("box"), F.col("id").alias("ordinal"))
    out = []
    for policy, rows in (("left_out", boxes.where(~unknown).withColumn("ignore", F.lit(False))), ("ignored", boxes.withColumn("ignore", unknown)), ("kept", boxes.withColumn("ignore", F.lit(False)))):
        truth = materialise(rows.select("image_id", "id", "cls", "box", "ignore"), "truth")
        found = assignment.match_by_class(truth, predicted, 0.2)
        targets = truth.where("NOT ignore").agg(F.count("*").alias("targets"))
        counts = found.agg(F.count_if(F.col("outcome") == "hit").alias("tp"), F.count_if(F.col("outcome") == "false_positive").alias("fp"), F.count_if(F.col("outcome") == "ignored").alias("ignored"))
        out.append(counts.crossJoin(targets).select(F.lit(policy).alias("policy"), "tp", "fp", (F.col("targets") - F.col("tp")).alias("fn"), "ignored"))  # one row each
    return out[0].unionByName(out[1]).unionByName(out[2])


#: Matching as recursion over an image's predictions in their order; the state is the targets taken so far.
POLICY = f"""WITH RECURSIVE {_BOXES},
cls AS (SELECT vec_id AS id, label % 3 AS g, (label % 3 + vec_id % 2) % 3 AS p, vec_id % 7 = 3 AS unknown FROM embeddings),
raw AS (
  SELECT x.image_id, x.id AS gt, y.id AS pred, greatest(0, least(x.r0, y.r1) - greatest(x.l0, y.l1)) * greatest(0, least(x.b0, y.b1) - greatest(x.t0, y.t1)) AS i,
         (x.r0 - x.l0) * (x.b0 - x.t0) + (y.r1 - y.l1) * (y.b1 - y.t1) AS s FROM boxes x JOIN boxes y USING (image_id)),
near AS (SELECT image_id, gt, pred, i / (s - i) AS iou, a.unknown, a.g = b.p AS same FROM raw JOIN cls a ON a.id = gt JOIN cls b ON b.id = pred WHERE i / (s - i) >= 0.2),
policies AS (SELECT unnest(['left_out', 'ignored', 'kept']) AS policy),
numbered AS (SELECT image_id, id, row_number() OVER (PARTITION BY image_id ORDER BY id) AS k FROM boxes),
options AS (
  SELECT policy, y.image_id, y.id AS pred, y.k,
         coalesce(list(gt ORDER BY iou DESC, gt DESC) FILTER (same AND (policy = 'kept' OR NOT unknown)), []) AS free, coalesce(bool_or(policy = 'ignored' AND unknown), false) AS apart
  FROM policies, numbered y LEFT JOIN near n ON n.pred = y.id GROUP BY policy, y.image_id, y.id, y.k),
walk(policy, image_id, k, used, outcome) AS (
  SELECT DISTINCT policy, image_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), '' FROM options
  UNION ALL
  SELECT w.policy, w.image_id, o.k, CASE WHEN len(list_filter(free, lambda g: NOT list_contains(used, g))) > 0 THEN list_append(used, list_filter(free, lambda g: NOT list_contains(used, g))[1]) ELSE used END,
         CASE WHEN len(list_filter(free, lambda g: NOT list_contains(used, g))) > 0 THEN 'hit' WHEN apart THEN 'ignored' ELSE 'false_positive' END
  FROM walk w JOIN options o ON o.policy = w.policy AND o.image_id = w.image_id AND o.k = w.k + 1)
SELECT policy, count(*) FILTER (outcome = 'hit') AS tp, count(*) FILTER (outcome = 'false_positive') AS fp,
       (SELECT count(*) FROM cls c WHERE w.policy = 'kept' OR NOT c.unknown) - count(*) FILTER (outcome = 'hit') AS fn, count(*) FILTER (outcome = 'ignored') AS ignored FROM walk w GROUP BY policy"""


def polygon_area_validity(spark, sf_dir):
    """Quadrilaterals of vector components: the first reason that applies, and the area."""
    e = lambda k: F.get("embedding", F.lit(k)).cast("double") * 100 + 50
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(*map(e, range(4))).alias("xs"), F.array(*map(e, range(4, 8))).alias("ys"))
    area = scalar.twice_area(F.col("xs"), F.col("ys")) / 2
    named = {p: F.coalesce(checks.polygon_reason(F.col("xs"), F.col("ys"), F.lit(80.0), F.lit(80.0), p), F.lit("valid")).alias(p) for p in ("inspect", "audit", "convert")}
    return rows.select("vec_id", F.round(area, 4).alias("area"), *named.values())


POLYGONS = """WITH p AS (SELECT vec_id, list_transform(embedding[1:8], lambda v: CAST(v AS DOUBLE) * 100 + 50) AS v FROM embeddings),
a AS (SELECT vec_id, v, abs(v[1]*v[6]-v[2]*v[5] + v[2]*v[7]-v[3]*v[6] + v[3]*v[8]-v[4]*v[7] + v[4]*v[5]-v[1]*v[8]) / 2 AS area FROM p)
SELECT vec_id, round(area, 4) AS area,
       CASE WHEN area = 0 THEN 'zero_area' WHEN list_min(v) < 0 THEN 'negative' WHEN list_max(v) >= 80 THEN 'outside' ELSE 'valid' END AS inspect,
       CASE WHEN area = 0 THEN 'zero_area' WHEN list_min(v) < 0 OR list_max(v) > 80 THEN 'out_of_bounds' WHEN list_max(v) = 80 THEN 'boundary' ELSE 'valid' END AS audit,
       CASE WHEN list_min(v) < 0 OR list_max(v) > 80 THEN 'outside' WHEN 2 * area / 6400 <= 1e-12 THEN 'zero_area' ELSE 'valid' END AS "convert" FROM a"""


def coordinate_residuals(spark, sf_dir):
    e = F.col("embedding")
    values = F.zip_with(e, F.slice(e, 2, 63), lambda a, b: F.abs(a.cast("double") * 0.5 - b.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(values, 1, 63).alias("r"))
    return rows.select("vec_id", F.round(F.array_max("r"), 6).alias("largest"), F.round(scalar.total(F.col("r")) / 63, 6).alias("mean"), F.size(F.filter("r", lambda x: x > 0.3)).alias("over"))


RESIDUALS = """WITH r AS (SELECT vec_id, list_transform(range(1, 64), lambda k: abs(CAST(embedding[k] AS DOUBLE) * 0.5 - CAST(embedding[k + 1] AS DOUBLE))) AS r FROM embeddings)
SELECT vec_id, round(list_max(r), 6) AS largest, round(list_sum(r) / 63, 6) AS mean, CAST(len(list_filter(r, lambda x: x > 0.3)) AS INTEGER) AS over FROM r"""


def json_attribute_counts(spark, sf_dir):
    props = F.from_json("props", "map<string,string>")
    pairs = table(spark, sf_dir, "events").select("event_type", F.explode(props).alias("field", "value"))
    return pairs.groupBy("event_type", "field", F.concat_ws("=", "field", "value").alias("pair")).agg(F.count("*").alias("n"))


JSON_COUNTS = "SELECT event_type, 'k' AS field, 'k=' || json_extract_string(props, '$.k') AS pair, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL"


def robust_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.min("value").alias("least"), F.median("value").alias("median"), F.round(F.avg("value"), 6).alias("mean"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.max("value").alias("most")
    )


ROBUST = "SELECT event_type, min(value) AS least, median(value) AS median, round(avg(value), 6) AS mean, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY event_type"


def daily_curve_last(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.groupBy("event_type").agg(F.count("*").alias("days"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("last_day"), F.max_by("n", "day").alias("last_n"))


CURVE = "SELECT event_type, count(*) AS days, strftime(max(day), '%Y-%m-%d') AS last_day, arg_max(n, day) AS last_n FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type"


def share_percent(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 3))


SHARE = "SELECT lang, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 3) AS percent FROM documents GROUP BY lang"


def name_hint_report(spark, sf_dir):
    path = F.regexp_replace("url", r"[?#].*$", "")
    rows = table(spark, sf_dir, "pages").select(
        "page_id", scalar.suffix(path).alias("suffix"), path.rlike("(?i)(aug|bright|noise)").alias("augmentation_hint"), path.rlike(r"[0-9]{3}").alias("number_hint"), scalar.unsafe_path(path).alias("unsafe")
    )
    counts = rows.groupBy("suffix").agg(F.count("*").alias("n"), F.count_if("augmentation_hint").alias("augmentation"), F.count_if("number_hint").alias("numbers"), F.count_if("unsafe").alias("unsafe"))
    # Five examples of each suffix: Spark keeps each task's first five of a window's rank limit, so no suffix is gathered whole.
    five = Window.partitionBy("suffix").orderBy("page_id")
    examples = rows.withColumn("k", F.row_number().over(five)).where("k <= 5").groupBy("suffix").agg(F.array_join(F.array_sort(F.collect_list("page_id")), "|").alias("examples"))
    return counts.join(examples, "suffix")


NAME_HINTS = r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages),
s AS (SELECT *, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '.(\.[^.]*)$', 1)) AS suffix FROM p)
SELECT suffix, count(*) AS n, count(*) FILTER (regexp_matches(path, '(?i)(aug|bright|noise)')) AS augmentation, count(*) FILTER (regexp_matches(path, '[0-9]{3}')) AS numbers,
       count(*) FILTER (starts_with(path, '/') OR list_contains(string_split(path, '/'), '..')) AS unsafe, array_to_string(list_sort(list(page_id))[1:5], '|') AS examples FROM s GROUP BY suffix"""


def archive_structure(spark, sf_dir):
    """The structure report over the paths of all pages, as if they were an archive's members."""
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[A-Za-z]+://", "")
    rows = table(spark, sf_dir, "pages").select(path.alias("path")).where("path IS NOT NULL")
    return archives.structure_report(rows.withColumn("is_dir", F.col("path").endswith("/")))


_HINT_COUNTS = " ".join(f"UNION ALL SELECT 'hint', '{name}' FROM c WHERE regexp_matches(path, '{pattern}')" for name, pattern in archives.HINTS.items())
STRUCTURE = rf"""WITH p AS (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z]+://', '') AS path FROM pages WHERE url IS NOT NULL),
m AS (SELECT path, ends_with(path, '/') AS is_dir, regexp_extract(path, '([^/]*)$', 1) AS base FROM p),
f AS (SELECT *, coalesce(nullif(lower(regexp_extract(base, '.(\.[^.]*)$', 1)), ''), '[none]') AS suffix FROM m WHERE NOT is_dir),
c AS (SELECT * FROM f WHERE NOT starts_with(path, '__MACOSX/') AND NOT starts_with(base, '._')),
i AS (SELECT * FROM c WHERE suffix IN {archives.IMAGE_SUFFIXES}),
cells(section, key) AS (
  SELECT 'member', CASE WHEN is_dir THEN 'directory' ELSE 'file' END FROM m UNION ALL SELECT 'extension', suffix FROM f UNION ALL SELECT 'image', suffix FROM i UNION ALL SELECT 'top', string_split(path, '/')[1] FROM f
  {_HINT_COUNTS} UNION ALL SELECT 'unsafe', 'path' FROM m WHERE starts_with(path, '/') OR list_contains(string_split(path, '/'), '..'))
SELECT section, key, count(*) AS n FROM cells GROUP BY ALL
UNION ALL (SELECT 'folder', CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '[root]' END AS key, count(*) AS n FROM f GROUP BY ALL ORDER BY n DESC, key LIMIT 30)
UNION ALL SELECT 'repeated', 'image_names', count(*) FROM (SELECT lower(base) FROM i GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0"""


def top_directories(spark, sf_dir):
    folder = F.regexp_extract("url", r"^(.*)/[^/]*$", 1)
    return table(spark, sf_dir, "pages").groupBy(folder.alias("folder")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder").limit(30)


TOP_DIRECTORIES = "SELECT regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n FROM pages GROUP BY ALL ORDER BY n DESC, folder LIMIT 30"


def benchmark_contamination(spark, sf_dir):
    """Documents that hold a benchmark text unchanged. The benchmark is small and its size is checked before it is broadcast."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    if items.agg(F.coalesce(F.sum(F.length("item")), F.lit(0))).first()[0] > 50_000_000:
        raise ValueError("benchmark too large for this audit; use the decontamination operator")
    return table(spark, sf_dir, "documents").join(F.broadcast(items), F.expr("contains(text, item)")).select("doc_id", "item_id")


CONTAMINATION = "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"


def provenance_check(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("keys"), F.count_if(F.col("text").isNull()).alias("null_texts")).select(
        F.explode(F.array(*(F.struct(F.lit(n).alias("field"), e.cast("string").alias("expected"), a.cast("string").alias("actual")) for n, e, a in (("unique_keys", F.col("rows"), F.col("keys")), ("null_texts", F.lit(0), F.col("null_texts")), ("has_rows", F.lit(True), F.col("rows") > 0))))).alias("c")
    )
    return rows.select("c.field", "c.expected", "c.actual", (~F.col("c.expected").eqNullSafe(F.col("c.actual"))).alias("differs"))


PROVENANCE = """WITH c AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS k, count(*) FILTER (text IS NULL) AS z FROM documents),
r AS (SELECT 'unique_keys' AS field, CAST(n AS VARCHAR) AS expected, CAST(k AS VARCHAR) AS actual FROM c UNION ALL SELECT 'null_texts', '0', CAST(z AS VARCHAR) FROM c UNION ALL SELECT 'has_rows', 'true', CAST(n > 0 AS VARCHAR) FROM c)
SELECT *, expected IS DISTINCT FROM actual AS differs FROM r"""


def split_key_overlap(spark, sf_dir):
    """Keys shared by each pair of splits, by kind of key."""
    rows = records(spark, sf_dir)
    keys = rows.select("split", F.explode(F.array(F.struct(F.lit("sha").alias("kind"), F.col("sha").alias("key")), F.struct(F.lit("family").alias("kind"), F.col("family").alias("key")))).alias("k")).select("split", "k.kind", "k.key").distinct()
    pairs = keys.alias("x").join(keys.alias("y"), ["kind", "key"]).where("x.split < y.split")
    return pairs.groupBy("kind", F.concat_ws("/", "x.split", "y.split").alias("pair")).agg(F.count("*").alias("n"))


OVERLAP = f"""WITH {_RECORDS}, k AS (SELECT DISTINCT split, 'sha' AS kind, sha AS key FROM records UNION SELECT DISTINCT split, 'family', family FROM records)
SELECT kind, x.split || '/' || y.split AS pair, count(*) AS n FROM k x JOIN k y USING (kind, key) WHERE x.split < y.split GROUP BY ALL"""

QUERIES = {
    "class_counts": (class_counts, CLASS_COUNTS),
    "orphans_both_ways": (orphans_both_ways, ORPHANS),
    "manifest_diff": (manifest_diff, MANIFEST_DIFF),
    "identity_verify": (identity_verify, IDENTITY),
    "hash_ordered_sample": (hash_ordered_sample, SAMPLE),
    "confusion_and_ordinal_error": (confusion_and_ordinal_error, CONFUSION),
    "failure_taxonomy": (failure_taxonomy, TAXONOMY),
    "top_cases_per_category": (top_cases_per_category, TOP_CASES),
    "iou_policy_probe": (iou_policy_probe, POLICY),
    "box_iou_candidates": (box_iou_candidates, BOX_IOU),
    "polygon_area_validity": (polygon_area_validity, POLYGONS),
    "coordinate_residuals": (coordinate_residuals, RESIDUALS),
    "json_attribute_counts": (json_attribute_counts, JSON_COUNTS),
    "robust_summary": (robust_summary, ROBUST),
    "daily_curve_last": (daily_curve_last, CURVE),
    "share_percent": (share_percent, SHARE),
    "name_hint_report": (name_hint_report, NAME_HINTS),
    "archive_structure": (archive_structure, STRUCTURE),
    "top_directories": (top_directories, TOP_DIRECTORIES),
    "benchmark_contamination": (benchmark_contamination, CONTAMINATION),
    "provenance_check": (provenance_check, PROVENANCE),
    "split_key_overlap": (split_key_overlap, OVERLAP),
}
