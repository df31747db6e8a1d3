"""Source divergence audit: how far the sources of a language are apart in their words, and by which words.

Terms are runs of ASCII letters and of all characters beyond ASCII; only A-Z are lower-cased. A language keeps the terms
that at least ``LEAST`` of its documents have. p = 1 + floor(10^9 (count + 5) / (N + 5 V)) of each kept term in each source.

The sums of |p - q| over all kept terms for each pair of sources split by term. Terms that a quarter or more of a language's
sources have are heavy: dense tiles of sources by terms in numpy. Rare terms are postings: where a source lacks a term its p is the
source's base, so a pair's sum is that of the bases, plus what each source's postings change against the other's base (sorted values and prefix sums),
plus a correction for each term that both have (pairs of one rare term's postings, fewer than a quarter of the sources). Both parts are exact integers and are
added up. Tasks hold two tiles of about ``TILE`` sources and a block of about ``TERMS`` terms, so that neither a common word nor a
source with a third of all rows makes a large group.

Null text, language and source count as ''. Repeated rows are documents each, whatever their ids. Long texts are read
piece by piece. A language without kept terms gives its pairs, with value 0; one with a single source has no pairs; an empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.text import map_arrow
from lodestrata.session import materialise

LEAST, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: A term is heavy if its sources times this number are all of the language's or more.
SHARE = 4
TILE, TERMS = 64, 2048
#: Distinct (language, source, term) that a task holds before it hands them on; texts over LONG bytes are not cut into a list of words.
HELD, LONG = 500_000, 1 << 22
#: Fixed value: bytes of a term (UTF-8), the complement of [\x00-\x40\x5B-\x60\x7B-\x7F].
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: A count and a number of documents in one integer: documents in the upper bits.
ONE = 1 << 42
COUNTS = "lang string, source string, term binary, n long, docs long"


def _counts(batches):
    """Sums for each (language, source, term) of a task: occurrences and documents."""
    held: dict[tuple, dict] = {}
    size = 0

    def flush():
        for (lang, source), terms in held.items():
            values = list(terms.values())
            whole = len(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * whole, pa.string()), pa.array([source] * whole, pa.string()), pa.array(list(terms), pa.binary()), pa.array([v % ONE for v in values], pa.int64()), pa.array([v // ONE for v in values], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            text = text.lower()
            found = Counter(TERM.findall(text) if len(text) < LONG else (m[0] for m in TERM.finditer(text)))
            terms = held.setdefault((lang, source), {})
            size -= len(terms)
            for term, n in found.items():
                terms[term] = terms.get(term, 0) + n + ONE
            size += len(terms)
            if size > HELD:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_lang, holders, leads) of kept terms: occurrences in the source and the language, sources that have it, and one row of each term marked."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    dealt = map_arrow(rows, _counts, COUNTS).repartition("lang", "term")  # summed by task already; one shuffle serves all that follows
    each = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    of_term = each.withColumns({"in_docs": F.sum("docs").over(term), "n_lang": F.sum("n").over(term), "holders": F.count("*").over(term), "first": F.min("source").over(term)})
    return of_term.where(F.col("in_docs") >= LEAST).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "n_lang", "holders", (F.col("source") == F.col("first")).alias("leads"))


def share(count: Column, whole: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (whole + 5 terms)) in decimals; 0 where there are no terms."""
    exact = lambda c: c.cast("decimal(19,0)")
    top = exact(F.lit(UNIT)) * exact(count + SMOOTH)
    below = exact(whole + SMOOTH * terms)
    return F.when(terms > 0, 1 + F.call_function("div", top, F.when(terms > 0, below).otherwise(1))).otherwise(0).cast("long")


def _tile_pair(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of all pairs of sources of two tiles over one block of terms; rows without a term hold the sources' bases."""
    _, _, one, two = key
    bases = rows[rows["term"].isna()].sort_values("source")
    names, base, tile = bases["source"].to_numpy(object), bases["p"].to_numpy(np.int64), bases["tile"].to_numpy()
    left, right = np.flatnonzero(tile == one), np.flatnonzero(tile == two)
    found = rows[rows["term"].notna()]
    at = pd.Index(names).get_indexer(found["source"])
    p, heavy = found["p"].to_numpy(np.int64), found["heavy"].to_numpy(bool)
    code, _ = pd.factorize(found["term"])
    gap = np.abs(base[:, None] - base[None])
    total = np.zeros_like(gap)
    if heavy.any():
        place = np.full(code.max() + 1, -1)
        held = np.unique(code[heavy])
        place[held] = np.arange(len(held))
        dense = np.repeat(base[:, None], len(held), axis=1)
        dense[at[heavy], place[code[heavy]]] = p[heavy]
        for i in left:
            total[i, right] += np.abs(dense[right] - dense[i]).sum(axis=1)
    at, p, code = at[~heavy], p[~heavy], code[~heavy]
    if len(p):
        order = np.lexsort((p, at))
        own, value = at[order], p[order]
        ends = np.searchsorted(own, np.arange(len(names) + 1))
        moved = np.zeros_like(gap)  # of row i's postings against the base of column j, less the distance of the bases
        for i in np.unique(own):
            v = value[ends[i] : ends[i + 1]]
            sums = np.concatenate([[0], np.cumsum(v)])
            below = np.searchsorted(v, base)
            moved[i] = base * below - sums[below] + sums[-1] - sums[below] - base * (len(v) - below) - len(v) * gap[i]
        total += moved + moved.T
        order = np.argsort(code, kind="stable")
        at, p, code = at[order], p[order], code[order]
        starts = np.searchsorted(code, code, side="right")
        reach = starts - np.arange(len(code)) - 1  # later postings of the same term
        i = np.repeat(np.arange(len(code)), reach)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(reach) - reach, reach)
        a, b = at[i], at[j]
        both = np.abs(p[i] - p[j]) - np.abs(p[i] - base[b]) - np.abs(p[j] - base[a]) + gap[a, b]
        np.add.at(total, (a, b), both)
        np.add.at(total, (b, a), both)
    i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
    if one == two:
        i, j = i[i < j], j[i < j]
    return pd.DataFrame({"lang": key[0], "a": names[i], "b": names[j], "part": total[i, j], "gap": gap[i, j]})


def pair_sums(postings: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, a, b, value), each unordered pair of sources once.

    ``postings``: lang, source, term, p, heavy; ``groups``: lang, source, base; ``langs``: lang, blocks, tiles, n_light.
    """
    tile = F.pmod(F.xxhash64("source"), F.col("tiles"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    pair = [F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two")]
    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    own = postings.join(langs, "lang").select("lang", "source", "term", "p", "heavy", block.alias("block"), tile.alias("tile"), other.alias("other"))
    bases = groups.join(langs, "lang").select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), F.lit(False).alias("heavy"), tile.alias("tile"), "blocks", other.alias("other"))
    bases = bases.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = own.unionByName(bases.drop("blocks")).select("lang", "block", *pair, "source", "tile", "term", "p", "heavy")
    parts = rows.groupBy("lang", "block", "one", "two").applyInPandas(_tile_pair, "lang string, a string, b string, part long, gap long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.first("gap").alias("gap"))
    return sums.join(langs.select("lang", "n_light"), "lang").select("lang", "a", "b", (F.col("part") + F.col("gap") * F.col("n_light")).alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of sources, and up to TOP terms that a source uses more than its language."""
    kept = materialise(term_counts(docs), "kept-terms")
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
    groups = materialise(every.join(of_source, ["lang", "source"], "left").fillna(0, ["whole"]), "sources")
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("whole").alias("whole_lang"))
    light = F.col("holders") * SHARE < F.col("sources")
    sized = kept.join(sources, "lang").where("leads").groupBy("lang").agg(F.count("*").alias("terms"), F.count_if(light).alias("n_light"))
    langs = sources.join(sized, "lang", "left").fillna(0, ["terms", "n_light"])
    langs = materialise(langs.withColumns({"blocks": F.greatest(F.lit(1).cast("long"), F.ceil(F.col("terms") / TERMS)), "tiles": F.ceil(F.col("sources") / TILE)}), "languages")
    based = groups.join(langs.select("lang", "terms"), "lang").withColumn("base", share(F.lit(0), F.col("whole"), F.col("terms")))
    p, q = share(F.col("n"), F.col("whole"), F.col("terms")), share(F.col("n_lang"), F.col("whole_lang"), F.col("terms"))
    graded = kept.join(groups, ["lang", "source"]).join(langs.select("lang", "sources", "whole_lang", "terms"), "lang").withColumns({"p": p, "q": q, "heavy": ~light})

    over = graded.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)

    sums = pair_sums(graded.select("lang", "source", "term", "p", "heavy"), based.select("lang", "source", "base"), langs.select("lang", "blocks", "tiles", "n_light"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    both = sums.select("lang", ends.alias("e"), "value").select("lang", "e.source", "e.item", "value").withColumn("rank", F.row_number().over(order))
    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return columns(both, "pair").unionByName(columns(terms, "term"))
