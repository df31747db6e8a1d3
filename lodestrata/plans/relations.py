"""Named queries: duplicates, families, evidence, components, pool and splits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import scalar
from lodestrata.operators import assignment, pairs, signatures
from lodestrata.operators.components import connected_components
from lodestrata.operators.forest import bridges, spanning_forest
from lodestrata.operators.hamming import near_pairs
from lodestrata.operators.order import ranked
from lodestrata.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """doc_id, sha, family (digest of all ASCII letters in lower case, null if there is none), split, source, lang."""
    letters = F.lower(F.regexp_replace("text", "[^A-Za-z]", ""))
    letters = F.when(letters != "", F.md5(letters))
    bucket = F.pmod(F.col("doc_id"), F.lit(10))
    split = F.when(bucket < 7, "train").when(bucket < 9, "val").otherwise("test")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), letters.alias("family"), split.alias("split"), "source", "lang", *more)


_RECORDS = """records AS (
  SELECT doc_id, sha256(text) AS sha, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN md5(lower(regexp_replace(text, '[^A-Za-z]', '', 'g'))) END AS family,
         CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END AS split, source, lang
  FROM documents)"""


def content_hash_duplicates(spark, sf_dir):
    rows = records(spark, sf_dir).select("sha", "doc_id")
    repeated = rows.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
    members = rows.join(repeated, "sha").groupBy("sha", "n", "first_id")  # the list is the report; only repeated hashes are gathered
    return members.agg(F.array_join(F.array_sort(F.collect_list("doc_id")), "|").alias("members"))


CONTENT_HASH_DUPLICATES = f"""WITH {_RECORDS}
SELECT sha, count(*) AS n, min(doc_id) AS first_id, string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY doc_id) AS members FROM records GROUP BY sha HAVING count(*) > 1"""


def cross_source_duplicate_groups(spark, sf_dir):
    groups = records(spark, sf_dir).groupBy("sha").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))
    return groups.where("n_sources > 1")


CROSS_SOURCE = f"""WITH {_RECORDS}
SELECT sha, count(*) AS n, count(DISTINCT source) AS n_sources, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM records GROUP BY sha HAVING count(DISTINCT source) > 1"""


def family_normalized_groups(spark, sf_dir):
    path = F.regexp_replace("url", r"[?#].*$", "")
    named = table(spark, sf_dir, "pages").select(scalar.bare_stem(path).alias("stem"), scalar.family(path).alias("family"), "page_id")
    return named.groupBy("stem", "family").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


FAMILY_NORMALIZED = r"""WITH names AS (
  SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM pages),
keyed AS (
  SELECT page_id, lower(regexp_replace(regexp_replace(stem, '(^|[_\-.])(aug|augment|brightness|bright|noise|gauss|resiz(e|ed)|640|480|369|277|404|303)($|[_\-.])', '_', 'gi'), '^[_.\-]+|[_.\-]+$', '', 'g')) AS stem,
         lower(regexp_replace(stem, '_(brightness|noise|gaussian|hsv|gamma)$', '', 'i')) AS family FROM names)
SELECT stem, family, count(*) AS n, min(page_id) AS first_page FROM keyed GROUP BY ALL"""


def blocked_family_pairs(spark, sf_dir):
    rows = records(spark, sf_dir)
    kind = F.when(F.col("split_a") != F.col("split_b"), "cross_split").otherwise("within_split")
    return pairs.blocked_pairs(rows, "family", "doc_id", "split").select("a", "b", kind.alias("kind"))


FAMILY_PAIRS = f"""WITH {_RECORDS}
SELECT x.doc_id AS a, y.doc_id AS b, CASE WHEN x.split <> y.split THEN 'cross_split' ELSE 'within_split' END AS kind
FROM records x JOIN records y ON x.family = y.family AND x.doc_id < y.doc_id"""


def exact_pairs_minus_family(spark, sf_dir):
    rows = records(spark, sf_dir)
    family = pairs.blocked_pairs(rows, "family", "doc_id", "split", across=True)
    exact = pairs.blocked_pairs(rows, "sha", "doc_id", "split")
    return pairs.minus_pairs(exact.select("a", "b"), family.select("a", "b"))


EXACT_MINUS_FAMILY = f"""WITH {_RECORDS}
SELECT x.doc_id AS a, y.doc_id AS b FROM records x JOIN records y ON x.sha = y.sha AND x.doc_id < y.doc_id
WHERE NOT (x.family = y.family AND x.split <> y.split)"""


def known(spark, sf_dir) -> DataFrame:
    """``records`` and the lengths, written once: texts are hashed in one pass however often the keys are joined."""
    chars = F.length("text").cast("double").alias("chars")
    return materialise(records(spark, sf_dir, chars), "records")


def profiles(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    """The profiles of documents and the split, family and digest that the shortlist looks at."""
    found = signatures.profiles(table(spark, sf_dir, "documents"), "doc_id", "text")
    rows = known(spark, sf_dir) if rows is None else rows
    return materialise(found.join(rows.select("doc_id", "split", "family", "sha"), "doc_id"), "profiles")


#: Which near pairs are news: other splits, other families, other texts.
NEWS = ("split", "family", "sha")


def shortlist(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b, distance, corr, full_corr): near pairs across splits and families with their correlations at both resolutions."""
    return near_pairs(rows, "doc_id", "h", 4, radius, NEWS, fine="fine")


def hamming_shortlist_banded(spark, sf_dir):
    return near_pairs(profiles(spark, sf_dir), "doc_id", "h", 4, 12, NEWS)


_PROFILES = r"""cell_counts AS (
  SELECT doc_id, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 257 AS cell, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents) GROUP BY ALL),
profiles AS (
  SELECT doc_id, list_transform(range(257), lambda k: coalesce(m[CAST(k AS INTEGER)], 0)) AS cells
  FROM (SELECT doc_id, map_from_entries(list((cell, n))) AS m FROM cell_counts GROUP BY doc_id HAVING sum(n) >= 50)),
hashes AS (SELECT doc_id, cells, array_to_string(list_transform(range(1, 257), lambda k: CASE WHEN cells[k] > cells[k + 1] THEN 1 ELSE 0 END), '') AS bits, split, family, sha FROM profiles JOIN records USING (doc_id)),
near AS (
  SELECT x.doc_id AS a, y.doc_id AS b, CAST(hamming(x.bits, y.bits) AS INTEGER) AS distance, x.cells AS ca, y.cells AS cb
  FROM hashes x JOIN hashes y ON x.doc_id < y.doc_id AND x.split <> y.split AND x.family IS DISTINCT FROM y.family AND x.sha <> y.sha WHERE hamming(x.bits, y.bits) <= 14),
shortlist AS (
  SELECT a, b, distance, (SELECT corr(list_sum(ca[4 * k - 3 : 4 * k]), list_sum(cb[4 * k - 3 : 4 * k])) FROM (SELECT unnest(range(1, 65)) AS k)) AS corr,
         (SELECT corr(ca[k], cb[k]) FROM (SELECT unnest(range(1, 257)) AS k)) AS full_corr FROM near)"""
HAMMING = f"WITH {_RECORDS}, {_PROFILES} SELECT a, b, distance FROM near WHERE distance <= 12"


def pearson_pairs(spark, sf_dir):
    found = shortlist(profiles(spark, sf_dir), 12)
    return found.select("a", "b", F.round("corr", 6).alias("corr"), F.round("full_corr", 6).alias("full_corr"))


PEARSON = f"WITH {_RECORDS}, {_PROFILES} SELECT a, b, round(corr, 6) AS corr, round(full_corr, 6) AS full_corr FROM shortlist WHERE distance <= 12"


def _named(rows: DataFrame) -> DataFrame:
    """Pairs of a family with the ratio of their lengths and whether their languages agree."""
    sizes = rows.select("doc_id", "chars", "lang")
    named = pairs.blocked_pairs(rows, "family", "doc_id", "split").select("a", "b").join(sizes.toDF("a", "ca", "la"), "a").join(sizes.toDF("b", "cb", "lb"), "b")
    closeness = F.when(F.greatest("ca", "cb") > 0, F.least("ca", "cb") / F.greatest("ca", "cb")).otherwise(1.0)
    return named.select("a", "b", F.lit("named").alias("kind"), closeness.alias("corr"), (F.col("la") == F.col("lb")).alias("same"), F.lit(None).cast("int").alias("distance"), F.lit(None).cast("double").alias("full_corr"))


def _exact(found: DataFrame) -> DataFrame:
    return found.select("a", "b", F.lit("exact").alias("kind"), F.lit(1.0).alias("corr"), F.lit(True).alias("same"), F.lit(0).alias("distance"), F.lit(1.0).alias("full_corr"))


def _visual(spark, sf_dir, rows: DataFrame) -> DataFrame:
    return shortlist(profiles(spark, sf_dir, rows), 14).select("a", "b", F.lit("visual").alias("kind"), "corr", F.lit(False).alias("same"), "distance", "full_corr")


def relation_edges(spark, sf_dir) -> DataFrame:
    """Exact, named (family) and visual (word profile) edges with their evidence; visual ones only between families and texts that differ."""
    rows = known(spark, sf_dir)
    exact = _exact(pairs.blocked_pairs(rows, "sha", "doc_id", "split"))
    return exact.unionByName(_named(rows)).unionByName(_visual(spark, sf_dir, rows))


_EDGES = f"""{_RECORDS}, {_PROFILES},
edges AS (
  SELECT x.doc_id AS a, y.doc_id AS b, 'exact' AS kind, 1.0::DOUBLE AS corr, true AS same, 0 AS distance, 1.0::DOUBLE AS full_corr
  FROM records x JOIN records y ON x.sha = y.sha AND x.doc_id < y.doc_id
  UNION ALL
  SELECT x.doc_id, y.doc_id, 'named', CASE WHEN greatest(length(p.text), length(q.text)) > 0 THEN CAST(least(length(p.text), length(q.text)) AS DOUBLE) / greatest(length(p.text), length(q.text)) ELSE 1.0 END,
         x.lang = y.lang, NULL, NULL
  FROM records x JOIN records y ON x.family = y.family AND x.doc_id < y.doc_id JOIN documents p ON p.doc_id = x.doc_id JOIN documents q ON q.doc_id = y.doc_id
  UNION ALL
  SELECT a, b, 'visual', corr, false, distance, full_corr FROM shortlist),
tiered AS (
  SELECT *, CASE WHEN kind = 'exact' THEN 'Confirmed'
    WHEN kind = 'named' THEN CASE WHEN corr >= 0.995 THEN CASE WHEN same THEN 'Strongly Supported' ELSE 'Supported' END ELSE 'Candidate' END
    WHEN distance > 12 THEN 'Outside current shortlist' WHEN corr >= 0.995 AND full_corr >= 0.96 THEN 'Supported' ELSE 'Candidate' END AS tier
  FROM edges)"""


def _tiered(spark, sf_dir):
    columns = [F.col(c) for c in ("kind", "corr", "same", "distance", "full_corr")]
    return relation_edges(spark, sf_dir).withColumn("tier", pairs.tier(*columns))


def edge_tiers(spark, sf_dir):
    return _tiered(spark, sf_dir).groupBy("kind", "tier").agg(F.count("*").alias("n"))


EDGE_TIERS = f"WITH {_EDGES} SELECT kind, tier, count(*) AS n FROM tiered GROUP BY ALL"


def tier_precedence_edges(spark, sf_dir):
    order = F.when(F.col("kind") == "exact", 0).when(F.col("kind") == "named", 1).otherwise(2)
    return pairs.first_writer(_tiered(spark, sf_dir), order).select("a", "b", "kind", "tier")


TIER_PRECEDENCE = f"""WITH {_EDGES}
SELECT a, b, kind, tier FROM tiered QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY CASE kind WHEN 'exact' THEN 0 WHEN 'named' THEN 1 ELSE 2 END) = 1"""


def _linked(spark, sf_dir) -> DataFrame:
    """(doc_id, component): documents linked by equal text or equal family; stars instead of all pairs."""
    rows = records(spark, sf_dir)
    edges = pairs.star_edges(rows, "sha", "doc_id").union(pairs.star_edges(rows, "family", "doc_id"))
    found = connected_components(edges).withColumnsRenamed({"node": "doc_id"})
    return rows.join(found, "doc_id", "left").select("doc_id", "split", F.coalesce("component", "doc_id").alias("component"))


_COMPONENTS = f"""{_RECORDS},
keys AS (SELECT doc_id, 's' || sha AS k FROM records WHERE sha IS NOT NULL UNION ALL SELECT doc_id, 'f' || family FROM records WHERE family IS NOT NULL),
walk(doc_id, component) AS (
  SELECT doc_id, doc_id FROM records
  UNION
  SELECT y.doc_id, w.component FROM walk w JOIN keys x ON x.doc_id = w.doc_id JOIN keys y ON y.k = x.k WHERE w.component <= y.doc_id),
linked AS (SELECT doc_id, min(component) AS component FROM walk GROUP BY doc_id)"""


def source_components(spark, sf_dir):
    linked = _linked(spark, sf_dir)
    names = ranked(linked.select("component").distinct(), "component")
    return linked.join(names, "component").select("doc_id", "component", F.format_string("sg-%04d", "rank").alias("group_id"))


SOURCE_COMPONENTS = f"WITH RECURSIVE {_COMPONENTS} SELECT doc_id, component, printf('sg-%04d', dense_rank() OVER (ORDER BY component)) AS group_id FROM linked"


def component_size_histogram(spark, sf_dir):
    sizes = _linked(spark, sf_dir).groupBy("component").agg(F.count("*").alias("size"), F.countDistinct("split").alias("splits"))
    return sizes.groupBy("size").agg(F.count("*").alias("components"), F.count_if(F.col("splits") > 1).alias("cross_split"))


SIZE_HISTOGRAM = f"""WITH RECURSIVE {_COMPONENTS}
SELECT size, count(*) AS components, count(*) FILTER (splits > 1) AS cross_split
FROM (SELECT component, count(*) AS size, count(DISTINCT split) AS splits FROM linked JOIN records USING (doc_id) GROUP BY component) GROUP BY size"""


def guard_clusters(spark, sf_dir):
    """Components over source groups joined by residual Candidate edges: exact groups first, then named edges contracted to them."""
    rows = records(spark, sf_dir)
    groups = rows.groupBy("sha").agg(F.min("doc_id").alias("g"))
    of = materialise(rows.join(groups, "sha").select("doc_id", "g", "family"), "groups")
    guards = connected_components(pairs.star_edges(of.select("family", "g").distinct(), "family", "g"))
    return of.join(guards.withColumnRenamed("node", "g"), "g", "left").select("doc_id", F.col("g").alias("group_id"), F.coalesce("component", "g").alias("guard_id"))


GUARD_CLUSTERS = f"""WITH RECURSIVE {_COMPONENTS}
SELECT doc_id, min(doc_id) OVER (PARTITION BY sha) AS group_id, component AS guard_id FROM linked JOIN records USING (doc_id)"""


def canonical_member(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars"))
    joined = _linked(spark, sf_dir).join(documents, "doc_id")
    return joined.groupBy("component").agg(F.min_by("doc_id", F.struct(-F.col("chars"), "doc_id")).alias("canonical"), F.count("*").alias("size"))


CANONICAL = f"""WITH RECURSIVE {_COMPONENTS}
SELECT component, arg_min(doc_id, {{'c': -length(text), 'd': doc_id}}) AS canonical, count(*) AS size FROM linked JOIN documents USING (doc_id) GROUP BY component"""


#: Tiers that merge two groups, and the place of a kind in the order of merging.
MERGING = ("Confirmed", "Strongly Supported", "Supported")
KINDS = ("exact", "named", "visual")


def _place(kind) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def spanning_relations(spark, sf_dir, rows: DataFrame) -> DataFrame:
    """Relation edges without those that copies add: exact ones as stars, named ones between the first copies of each text and language, visual ones.

    Of the pairs that are left out, each is tied by edges that come before it in the order (kind, a, b), and is no stronger than one of its ends' others.
    """
    exact = _exact(pairs.star_edges(rows, "sha", "doc_id").select(F.col("dst").alias("a"), F.col("src").alias("b")))
    first = rows.groupBy("sha", "lang").agg(F.min("doc_id").alias("doc_id"))
    named = _named(rows.join(first.select("doc_id"), "doc_id"))
    return exact.unionByName(named).unionByName(_visual(spark, sf_dir, rows))


def merging_edges(spark, sf_dir, rows: DataFrame) -> DataFrame:
    """(a, b, kind, tier, place, strength) of the spanning relations whose tier merges groups."""
    every = spanning_relations(spark, sf_dir, rows)
    tiered = every.withColumn("tier", pairs.tier(*(F.col(c) for c in ("kind", "corr", "same", "distance", "full_corr"))))
    kept = tiered.where(F.col("tier").isin(*MERGING))
    return materialise(kept.select("a", "b", "kind", "tier", _place(F.col("kind")).alias("place"), scalar.tier_rank(F.col("tier")).alias("strength")), "merging")


_MERGING = f"""{_EDGES},
merging AS (SELECT *, CASE kind WHEN 'exact' THEN 1 WHEN 'named' THEN 2 ELSE 3 END AS place, CASE tier WHEN 'Confirmed' THEN 4 WHEN 'Strongly Supported' THEN 3 ELSE 2 END AS strength FROM tiered WHERE tier IN ('Confirmed', 'Strongly Supported', 'Supported'))"""


def merged_edges(spark, sf_dir):
    """The edges that really joined two groups when all that merge are taken in order: exact, named, visual, then by ends."""
    forest, _ = spanning_forest(merging_edges(spark, sf_dir, known(spark, sf_dir)), "place")
    return forest.select("a", "b", "kind", "tier")


MERGED = f"""WITH RECURSIVE {_MERGING},
numbered AS (SELECT *, row_number() OVER (ORDER BY place, a, b) AS r FROM merging),
ends AS (SELECT r, a AS x, b AS y FROM numbered UNION ALL SELECT r, b, a FROM numbered),
reach(r, node) AS (SELECT r, a FROM numbered UNION SELECT w.r, e.y FROM reach w JOIN ends e ON e.x = w.node AND e.r < w.r)
SELECT a, b, kind, tier FROM numbered n WHERE NOT EXISTS (SELECT 1 FROM reach w WHERE w.r = n.r AND w.node = n.b)"""


def canonical_relation(spark, sf_dir):
    """How each document is tied to its group: the canonical member, or the strongest incident edge that merges (the first of equals in the order of merging).

    The canonical member is the longest text, then the smallest id. Groups are those of the merging edges.
    """
    rows = known(spark, sf_dir)
    edges = merging_edges(spark, sf_dir, rows)
    forest, _ = spanning_forest(edges, "place")
    found = connected_components(forest, "a", "b").withColumnRenamed("node", "doc_id")
    grouped = rows.select("doc_id", "chars").join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    canonical = grouped.groupBy("component").agg(F.min_by("doc_id", F.struct(-F.col("chars"), "doc_id")).alias("canonical"))
    # Every document's exact edge is with the smallest copy of its text; a text's named and visual edges hold for all its copies.
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("doc_id"), F.col("a").alias("other")))).alias("e"), "a", "b", "kind", "tier", "place", "strength")
    best = both.groupBy("e.doc_id").agg(F.min_by(F.struct("kind", "tier", F.col("e.other").alias("other")), F.struct(-F.col("strength"), "place", "a", "b")).alias("best"))
    joined = grouped.join(canonical, "component").join(best, "doc_id", "left")
    own = F.col("doc_id") == F.col("canonical")
    pick = lambda name, mine: F.when(own, mine).otherwise(F.col(f"best.{name}")).alias(name)
    return joined.select("doc_id", "canonical", pick("kind", F.lit("canonical")), pick("tier", F.lit("Confirmed")), pick("other", F.lit(None)))


CANONICAL_RELATION = f"""WITH RECURSIVE {_MERGING},
ends AS (SELECT a AS doc_id, b AS other, a, b, kind, tier, place, strength FROM merging UNION ALL SELECT b, a, a, b, kind, tier, place, strength FROM merging),
walk(doc_id, component) AS (SELECT doc_id, doc_id FROM records UNION SELECT e.other, w.component FROM walk w JOIN ends e USING (doc_id) WHERE w.component < e.other),
groups AS (SELECT doc_id, min(component) AS component FROM walk GROUP BY doc_id),
canon AS (SELECT component, arg_min(doc_id, {{'c': -length(text), 'd': doc_id}}) AS canonical FROM groups JOIN documents USING (doc_id) GROUP BY component),
best AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY strength DESC, place, a, b) = 1)
SELECT g.doc_id, canonical, CASE WHEN g.doc_id = canonical THEN 'canonical' ELSE kind END AS kind, CASE WHEN g.doc_id = canonical THEN 'Confirmed' ELSE tier END AS tier,
       CASE WHEN g.doc_id = canonical THEN NULL ELSE other END AS other
FROM groups g JOIN canon USING (component) LEFT JOIN best ON best.doc_id = g.doc_id"""


def bridge_edges(spark, sf_dir):
    """Edges between documents of one text or family whose removal splits their group, with the sizes that it would leave."""
    rows = records(spark, sf_dir)
    return bridges(pairs.double_star_edges(rows, "sha", "doc_id").union(pairs.double_star_edges(rows, "family", "doc_id")))


BRIDGES = f"""WITH RECURSIVE {_RECORDS},
edges AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM records x JOIN records y ON (x.sha = y.sha OR x.family = y.family) AND x.doc_id < y.doc_id),
ends AS (SELECT a, b, a AS x, b AS y FROM edges UNION ALL SELECT a, b, b, a FROM edges),
sides AS (SELECT a, b, a AS side FROM edges UNION ALL SELECT a, b, b FROM edges),
reach(ea, eb, side, node) AS (
  SELECT a, b, side, side FROM sides
  UNION
  SELECT r.ea, r.eb, r.side, e.y FROM reach r JOIN ends e ON e.x = r.node AND NOT (e.a = r.ea AND e.b = r.eb))
SELECT a, b, (SELECT count(*) FROM reach WHERE ea = a AND eb = b AND side = a) AS size_a, (SELECT count(*) FROM reach WHERE ea = a AND eb = b AND side = b) AS size_b
FROM edges WHERE NOT EXISTS (SELECT 1 FROM reach WHERE ea = a AND eb = b AND side = a AND node = b)"""


def threshold_sweep(spark, sf_dir):
    settings = F.explode(F.array(*(F.struct(F.lit(d).alias("reach"), F.lit(c).alias("named_at")) for d in (8, 10, 12, 14) for c in (0.99, 0.995, 0.999))))
    edges = relation_edges(spark, sf_dir).select("*", settings.alias("s"))
    kept = (F.col("kind") == "exact") | ((F.col("kind") == "named") & (F.col("corr") >= F.col("s.named_at"))) | ((F.col("kind") == "visual") & (F.col("distance") <= F.col("s.reach")))
    return edges.groupBy("s.reach", "s.named_at").agg(F.count_if(kept).alias("edges"), F.count_if(kept & (F.col("kind") == "visual")).alias("visual_edges"))


SWEEP = f"""WITH {_EDGES}
SELECT reach, CAST(named_at AS DOUBLE) AS named_at, count(*) FILTER (kind = 'exact' OR (kind = 'named' AND corr >= CAST(named_at AS DOUBLE)) OR (kind = 'visual' AND distance <= reach)) AS edges,
       count(*) FILTER (kind = 'visual' AND distance <= reach) AS visual_edges
FROM edges, (SELECT unnest([8, 10, 12, 14]) AS reach) r, (SELECT unnest([0.99, 0.995, 0.999]) AS named_at) c GROUP BY ALL"""


def annotation_conflicts(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    joined = records(spark, sf_dir).join(labels, "doc_id")
    signature = F.to_json(F.struct("quality", "toxic"))
    groups = joined.groupBy("source", "lang").agg(F.count("*").alias("n"), F.countDistinct(signature).alias("signatures"), F.countDistinct("quality").alias("qualities"))
    return groups.where("signatures > 1")


CONFLICTS = f"""WITH {_RECORDS}
SELECT source, lang, count(*) AS n, count(DISTINCT quality * 10 + toxic) AS signatures, count(DISTINCT quality) AS qualities
FROM records JOIN labels USING (doc_id) GROUP BY source, lang HAVING count(DISTINCT quality * 10 + toxic) > 1"""


def _pool(spark, sf_dir) -> DataFrame:
    """doc_id, reason: the first exclusion that applies, in the policy's order; null: included."""
    labels = table(spark, sf_dir, "labels")
    rows = records(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars")), "doc_id").join(labels, "doc_id", "left")
    per_copy = rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.countDistinct("quality").alias("qualities"))
    reason = (
        F.when(F.col("chars") < 200, "too_short")
        .when(F.col("quality").isNull(), "unlabelled")
        .when(F.col("qualities") > 1, "conflict_holdout")
        .when(F.col("quality") == 0, "low_quality")
        .when(F.col("doc_id") != F.col("first"), "exact_duplicate")
    )
    return rows.join(per_copy, "sha").select("doc_id", "split", "quality", "toxic", reason.alias("reason"))


_POOL = f"""{_RECORDS},
pool AS (
  SELECT r.doc_id, r.split, quality, toxic, CASE WHEN length(text) < 200 THEN 'too_short' WHEN quality IS NULL THEN 'unlabelled'
    WHEN qualities > 1 THEN 'conflict_holdout' WHEN quality = 0 THEN 'low_quality' WHEN r.doc_id <> first THEN 'exact_duplicate' END AS reason
  FROM records r JOIN documents d ON d.doc_id = r.doc_id LEFT JOIN labels l ON l.doc_id = r.doc_id
  JOIN (SELECT sha, min(records.doc_id) AS first, count(DISTINCT quality) AS qualities FROM records LEFT JOIN labels USING (doc_id) GROUP BY sha) USING (sha))"""


def pool_policy(spark, sf_dir):
    return _pool(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("included")).alias("reason")).agg(F.count("*").alias("n"))


POOL = f"WITH {_POOL} SELECT coalesce(reason, 'included') AS reason, count(*) AS n FROM pool GROUP BY ALL"


def group_class_profile(spark, sf_dir):
    joined = _linked(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    both = (F.col("quality") == 1) & (F.col("toxic") == 1)
    return joined.groupBy("component").agg(
        F.count("*").alias("images"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(both).alias("multi"), F.min("doc_id").alias("first_member")
    )


PROFILE = f"""WITH RECURSIVE {_COMPONENTS}
SELECT component, count(*) AS images, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad,
       count(*) FILTER (quality = 1 AND toxic = 1) AS multi, min(doc_id) AS first_member
FROM linked LEFT JOIN labels USING (doc_id) GROUP BY component"""

#: Fixed value: the published seed of the split (64 bits, whole).
SEED = 13436313853456744620
TARGETS = ((0.70, 0.15, 0.15), (0.70, 0.10, 0.20))


def _groups(spark, sf_dir) -> DataFrame:
    return group_class_profile(spark, sf_dir).select(F.col("component").alias("id"), "images", "multi", "good", "bad")


def group_split_greedy(spark, sf_dir):
    """The deterministic split: lexicographic objective, seed derived from a digest."""
    return assignment.split_trials(_groups(spark, sf_dir), ["good", "bad"], [(SEED, TARGETS[0])]).select("id", "split")


def split_monte_carlo(spark, sf_dir):
    """Largest deviation of the image shares over seeds and targets, weighted objective."""
    trials = [(seed, target) for target in TARGETS for seed in range(5)]
    groups = materialise(_groups(spark, sf_dir), "groups")
    found = assignment.split_trials(groups, ["good", "bad"], trials, lexicographic=False)
    shares = found.join(groups, "id").groupBy("trial", "seed", "split").agg(F.sum("images").alias("images"))
    whole = Window.partitionBy("trial")
    goal = F.element_at(F.array(*(F.struct(*(F.lit(x).alias(s) for x, s in zip(t, assignment.SPLITS, strict=True))) for _, t in trials)), F.col("trial") + 1)
    target = F.when(F.col("split") == "train", goal["train"]).when(F.col("split") == "val", goal["val"]).otherwise(goal["test"])
    off = shares.withColumn("off", 100 * F.abs(F.col("images") / F.sum("images").over(whole) - target))
    per_trial = off.groupBy("trial").agg(F.max("off").alias("off"))
    return per_trial.groupBy((F.col("trial") >= 5).alias("second_target")).agg(
        F.min("off").alias("least"), F.median("off").alias("median"), F.expr("percentile_disc(0.95) within group (order by off)").alias("p95"), F.max("off").alias("most"), F.count_if(F.col("off") <= 2).alias("within_2pp")
    )


def split_leakage_audit(spark, sf_dir):
    """Edges that cross the group-aware split (none) and the official one, by kind."""
    linked = materialise(_linked(spark, sf_dir), "linked")
    bucket = F.pmod(F.crc32(F.col("component").cast("string").cast("binary")), F.lit(10))
    own = F.when(bucket < 7, "train").when(bucket < 9, "val").otherwise("test")
    at = linked.select("doc_id", "split", own.alias("own"))
    keys = F.explode(F.array(F.struct(F.lit("exact").alias("kind"), F.col("sha").alias("key")), F.struct(F.lit("named").alias("kind"), F.col("family").alias("key"))))
    rows = records(spark, sf_dir).select("doc_id", keys.alias("k")).select("doc_id", "k.*").where("key IS NOT NULL").join(at, "doc_id")
    # Pairs are counted and never made: n members give n (n - 1) / 2, less those within each split.
    two = lambda n: n * (n - 1) / 2
    cells = rows.groupBy("kind", "key", "split", "own").agg(F.count("*").alias("n"))
    within = lambda by, name: cells.groupBy("kind", "key", by).agg(F.sum("n").alias("n")).groupBy("kind").agg(F.sum(two(F.col("n"))).alias(name))
    every = cells.groupBy("kind", "key").agg(F.sum("n").alias("n")).groupBy("kind").agg(F.sum(two(F.col("n"))).cast("long").alias("edges"))
    joined = every.where("edges > 0").join(within("split", "same"), "kind").join(within("own", "same_own"), "kind")
    return joined.select("kind", "edges", (F.col("edges") - F.col("same")).cast("long").alias("official_crossings"), (F.col("edges") - F.col("same_own")).cast("long").alias("group_aware_crossings"))


def _own_split(component: str) -> str:
    """SQL of the group's split: CRC-32 of the component's digits, bit by bit, modulo ten."""
    byte = f"list_transform(range(1, strlen(CAST({component} AS VARCHAR)) + 1), lambda p: ascii(substr(CAST({component} AS VARCHAR), p, 1)))"
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    eight = "list_reduce([CAST(xor(s, x) AS BIGINT)] || CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]), lambda c, z: " + step + ")"
    crc = f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || CAST({byte} AS BIGINT[]), lambda s, x: {eight}), 4294967295)"
    return f"CASE WHEN {crc} % 10 < 7 THEN 'train' WHEN {crc} % 10 < 9 THEN 'val' ELSE 'test' END"


LEAKAGE = f"""WITH RECURSIVE {_COMPONENTS}, own_split AS (SELECT doc_id, {_own_split("component")} AS own FROM linked),
placed AS (SELECT doc_id, split, own, sha, family FROM records JOIN own_split USING (doc_id)),
edges AS (
  SELECT 'exact' AS kind, x.split AS sa, y.split AS sb, x.own AS oa, y.own AS ob FROM placed x JOIN placed y ON x.sha = y.sha AND x.doc_id < y.doc_id
  UNION ALL SELECT 'named', x.split, y.split, x.own, y.own FROM placed x JOIN placed y ON x.family = y.family AND x.doc_id < y.doc_id)
SELECT kind, count(*) AS edges, count(*) FILTER (sa <> sb) AS official_crossings, count(*) FILTER (oa <> ob) AS group_aware_crossings FROM edges GROUP BY kind"""

QUERIES = {
    "content_hash_duplicates": (content_hash_duplicates, CONTENT_HASH_DUPLICATES),
    "cross_source_duplicate_groups": (cross_source_duplicate_groups, CROSS_SOURCE),
    "family_normalized_groups": (family_normalized_groups, FAMILY_NORMALIZED),
    "blocked_family_pairs": (blocked_family_pairs, FAMILY_PAIRS),
    "exact_pairs_minus_family": (exact_pairs_minus_family, EXACT_MINUS_FAMILY),
    "hamming_shortlist_banded": (hamming_shortlist_banded, HAMMING),
    "pearson_pairs": (pearson_pairs, PEARSON),
    "edge_tiers": (edge_tiers, EDGE_TIERS),
    "tier_precedence_edges": (tier_precedence_edges, TIER_PRECEDENCE),
    "source_components": (source_components, SOURCE_COMPONENTS),
    "component_size_histogram": (component_size_histogram, SIZE_HISTOGRAM),
    "guard_clusters": (guard_clusters, GUARD_CLUSTERS),
    "canonical_member": (canonical_member, CANONICAL),
    "merged_edges": (merged_edges, MERGED),
    "canonical_relation": (canonical_relation, CANONICAL_RELATION),
    "bridge_edges": (bridge_edges, BRIDGES),
    "threshold_sweep": (threshold_sweep, SWEEP),
    "annotation_conflicts": (annotation_conflicts, CONFLICTS),
    "pool_policy": (pool_policy, POOL),
    "group_class_profile": (group_class_profile, PROFILE),
    "group_split_greedy": (group_split_greedy, None),
    "split_monte_carlo": (split_monte_carlo, None),
    "split_leakage_audit": (split_leakage_audit, LEAKAGE),
}
