"""Named queries on pixels: every vector of ``embeddings`` is an 8 x 8 image, half-sized copies and pairs of neighbours come from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import pixels
from lodestrata.plans.relations import table

WIDE, HALF = 8, 4


def _bytes(levels: Column) -> Column:
    return F.unhex(F.array_join(F.transform(levels, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def images(spark, sf_dir) -> DataFrame:
    """(vec_id, levels array<long>, content binary): entry c is the level floor(128 + 400 c), held within a byte; null vectors have none."""
    level = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), F.coalesce(F.floor(c.cast("double") * 400 + 128), F.lit(0))))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", level).alias("levels"))
    return rows.withColumn("content", _bytes(F.col("levels")))


def _halved(levels: str) -> Column:
    """Means of two by two pixels; one image in thirteen is brighter by 20, as if edited."""
    places = F.array(*(F.lit(2 * WIDE * y + 2 * x) for y in range(HALF) for x in range(HALF)))
    at = lambda k, off: F.get(levels, k + off)
    edited = F.when(F.pmod("vec_id", F.lit(13)) == 5, 20).otherwise(0)
    return F.transform(places, lambda k: F.least(F.lit(255), F.floor((at(k, 0) + at(k, 1) + at(k, WIDE) + at(k, WIDE + 1)) / 4) + edited))


def resize_review(spark, sf_dir):
    """Each image against its half-sized copy: mean absolute error after resampling, correlation of the signatures, verdict."""
    size = lambda n: (F.lit(n), F.lit(n))
    rows = images(spark, sf_dir).withColumn("copy", _bytes(_halved("levels")))
    found = rows.select("vec_id", pixels.resize_metrics((F.col("content"), *size(WIDE)), (F.col("copy"), *size(HALF)), channels=1, side=HALF).alias("m"))
    verdict = F.when(F.col("mae").isNull(), None).when(F.col("mae") > 12, "edited").when(F.col("corr") < 0.97, "unlike").otherwise("alike")
    return found.select("vec_id", F.round("m.mae", 4).alias("mae"), F.round("m.corr", 6).alias("corr")).withColumn("verdict", verdict)


def pixel_pairs(spark, sf_dir):
    """Figures of every image with the next one: correlations of pixels and edges, block similarity, histogram affinity."""
    left = images(spark, sf_dir).select(F.col("vec_id").alias("a"), F.col("content").alias("of_a"))
    right = left.select((F.col("a") - 1).alias("a"), F.col("of_a").alias("of_b"))
    size = (F.lit(WIDE), F.lit(WIDE))
    found = left.join(right, "a").select("a", pixels.pair_diagnostics((F.col("of_a"), *size), (F.col("of_b"), *size), side=WIDE, block=HALF).alias("m"))
    return found.select("a", *(F.round(f"m.{c}", 6).alias(c) for c in ("corr", "full_corr", "ssim", "affinity", "edge_corr")))


_PX = f"""px AS (SELECT vec_id, (k // {WIDE}) AS y, (k % {WIDE}) AS x, least(255, greatest(0, floor(CAST(embedding[k + 1] AS DOUBLE) * 400 + 128))) AS v
  FROM embeddings, (SELECT unnest(range({WIDE * WIDE})) AS k))"""


def _correlated(a: str, b: str, n: int) -> str:
    varied = lambda v: f"({n} * sum({v} * {v}) - sum({v}) * sum({v}))"
    equal = f"CAST(bool_and({a} = {b}) AS INTEGER)"
    return f"CASE WHEN {varied(a)} = 0 OR {varied(b)} = 0 THEN {equal} ELSE ({n} * sum({a} * {b}) - sum({a}) * sum({b})) / sqrt({varied(a)} * {varied(b)}) END"


_REVIEW = f"""WITH {_PX},
places AS (SELECT i, k, (i - 2 * k - 0.5) / 2 AS t FROM (SELECT unnest(range({WIDE})) AS i), (SELECT unnest(range({HALF})) AS k)),
shares AS (SELECT 'triangle' AS kernel, i, k, greatest(0, 1 - abs(t)) AS w FROM places
  UNION ALL SELECT 'lanczos', i, k, CASE WHEN abs(t) < 3 THEN sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) ELSE 0 END FROM places),
weights AS (SELECT kernel, i, k, floor(w / sum(w) OVER (PARTITION BY kernel, k) * {pixels.ONE} + 0.5) AS w FROM shares),
wide AS (SELECT kernel, vec_id, y, k AS x, greatest(0, least(255, floor((sum(v * w) + {pixels.ONE // 2}) / {pixels.ONE}))) AS v FROM px JOIN weights ON i = x GROUP BY ALL),
small AS (SELECT kernel, vec_id, k AS y, x, greatest(0, least(255, floor((sum(v * w) + {pixels.ONE // 2}) / {pixels.ONE}))) AS v FROM wide JOIN weights USING (kernel) WHERE i = y GROUP BY ALL),
copy AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, least(255, floor(sum(v) / 4) + CASE WHEN vec_id % 13 = 5 THEN 20 ELSE 0 END) AS v FROM px GROUP BY vec_id, y // 2, x // 2),
side_by_side AS (SELECT copy.vec_id, copy.v AS c, l.v AS l, t.v AS t FROM copy JOIN small l ON l.kernel = 'lanczos' AND l.vec_id = copy.vec_id AND l.y = copy.y AND l.x = copy.x
  JOIN small t ON t.kernel = 'triangle' AND t.vec_id = copy.vec_id AND t.y = copy.y AND t.x = copy.x),
found AS (SELECT vec_id, round(avg(abs(l - c)), 4) AS mae, round({_correlated("t", "c", HALF * HALF)}, 6) AS corr FROM side_by_side GROUP BY vec_id)
SELECT *, CASE WHEN mae > 12 THEN 'edited' WHEN corr < 0.97 THEN 'unlike' ELSE 'alike' END AS verdict FROM found"""

_PAIRS = f"""WITH {_PX},
around AS (SELECT c.vec_id, c.y, c.x, any_value(c.v) AS v, sum(o.v) AS total FROM px c JOIN px o ON o.vec_id = c.vec_id AND abs(o.y - c.y) <= 1 AND abs(o.x - c.x) <= 1 GROUP BY ALL),
edged AS (SELECT vec_id, y, x, v, CASE WHEN y IN (0, {WIDE - 1}) OR x IN (0, {WIDE - 1}) THEN v ELSE greatest(0, least(255, 9 * v - total)) END AS e FROM around),
pairs AS (SELECT a.vec_id AS a, a.y, a.x, a.v, a.e, b.v AS w, b.e AS f FROM edged a JOIN edged b ON b.vec_id = a.vec_id + 1 AND b.y = a.y AND b.x = a.x),
blocks AS (SELECT a, avg(v) AS mv, avg(w) AS mw, avg(v * w) - avg(v) * avg(w) AS cov, avg(v * v) - avg(v) * avg(v) AS vv, avg(w * w) - avg(w) * avg(w) AS vw FROM pairs GROUP BY a, y // {HALF}, x // {HALF}),
alike AS (SELECT a, avg((2 * mv * mw + 6.5025) * (2 * cov + 58.5225) / ((mv * mv + mw * mw + 6.5025) * (vv + vw + 58.5225))) AS ssim FROM blocks GROUP BY a),
bins AS (SELECT vec_id, v, count(*) AS n FROM px GROUP BY ALL),
shared AS (SELECT p.vec_id AS a, sum(sqrt(p.n * q.n)) / {WIDE * WIDE} AS affinity FROM bins p JOIN bins q ON q.vec_id = p.vec_id + 1 AND q.v = p.v GROUP BY ALL),
whole AS (SELECT a, {_correlated("v", "w", WIDE * WIDE)} AS corr, {_correlated("e", "f", WIDE * WIDE)} AS edge_corr FROM pairs GROUP BY a)
SELECT a, round(corr, 6) AS corr, round(corr, 6) AS full_corr, round(ssim, 6) AS ssim, round(coalesce(affinity, 0), 6) AS affinity, round(edge_corr, 6) AS edge_corr FROM whole JOIN alike USING (a) LEFT JOIN shared USING (a)"""

QUERIES = {"resize_review": (resize_review, _REVIEW), "pixel_pairs": (pixel_pairs, _PAIRS)}
