"""Relations between records: blocked pairs, hash pairs, banded Hamming pairs, tiers of evidence.

Pair tables are what these operators are for; where only components are wanted, ``star_edges``
links a block's members to its smallest one, so that a block costs its size and not its square.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import materialise


def star_edges(rows: DataFrame, block: str, node: str) -> DataFrame:
    """(src, dst): each node with the smallest of its block. Null blocks give none."""
    smallest = rows.where(F.col(block).isNotNull()).groupBy(block).agg(F.min(node).alias("dst"))
    return rows.join(smallest, block).where(F.col(node) != F.col("dst")).select(F.col(node).alias("src"), "dst")


def double_star_edges(rows: DataFrame, block: str, node: str) -> DataFrame:
    """(a, b): each node of a block with its smallest and its largest one. No edge of a block of three or more is a bridge in it, as in the block's pairs."""
    ends = rows.where(F.col(block).isNotNull()).groupBy(block).agg(F.min(node).alias("low"), F.max(node).alias("high"))
    joined = rows.join(ends, block).select(F.col(node).alias("n"), F.explode(F.array("low", "high")).alias("end"))
    return joined.where("n <> end").select(F.least("n", "end").alias("a"), F.greatest("n", "end").alias("b")).distinct()


def blocked_pairs(rows: DataFrame, block: str, node: str, split: str, across: bool | None = None) -> DataFrame:
    """(a, b, block) with a < b of one block; ``across``: different splits only (True), equal splits only (False), any (None)."""
    left = rows.select(F.col(block).alias("block"), F.col(node).alias("a"), F.col(split).alias("split_a"))
    right = rows.select(F.col(block).alias("block"), F.col(node).alias("b"), F.col(split).alias("split_b"))
    pairs = left.join(right, "block").where(F.col("a") < F.col("b"))
    if across is not None:
        pairs = pairs.where((F.col("split_a") != F.col("split_b")) == across)
    return pairs.select("a", "b", "block", "split_a", "split_b")


def minus_pairs(pairs: DataFrame, emitted: DataFrame) -> DataFrame:
    """Pairs that were not emitted before (either direction)."""
    done = emitted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(done, ["a", "b"], "left_anti")


def first_writer(edges: DataFrame, precedence: Column) -> DataFrame:
    """One edge for each unordered pair: the one with the smallest precedence."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    best = edges.groupBy(low.alias("a"), high.alias("b")).agg(F.min_by(F.struct("*"), precedence).alias("e"))
    return best.select("a", "b", *(f"e.{c}" for c in edges.columns if c not in ("a", "b")))


def band_masks(bits: int, errors: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``errors`` set: what one band is probed with."""
    return [sum(1 << k for k in at) for n in range(errors + 1) for at in combinations(range(bits), n)]


def hamming_pairs(
    rows: DataFrame, node: str, limbs: str, n_limbs: int, radius: int, bands: int | None = None, keep: tuple[str, ...] = (), where: Column | str | None = None,
    payload: tuple[str, ...] = (), also: dict[str, Column] | None = None,
) -> DataFrame:
    """(a, b, distance, those of ``also``) of all pairs at most ``radius`` bits apart, a < b.

    Multi-index hashing: of ``bands`` bands a pair in range differs on one by ``radius // bands`` bits at most, so each
    distinct row is joined with the band values that near (``band_masks``). The whole distance, ``where`` and that the band is the first one where
    the two meet are part of the join's condition, so each pair comes out of it once and is never widened or shuffled again.
    None takes ``radius + 1`` bands: every band is met as it is, and what is shuffled grows with the rows alone; probes for values one bit off would
    multiply it by a band's width. ``where`` may tell which pairs are wanted, by the
    columns ``keep`` of either side (as ``name_a``, ``name_b``, of the smaller and the larger node); ``also`` are values of a pair by the
    columns ``payload`` (as ``name_a``, ``name_b``, of either side in any order), which equal hashes and ``keep`` have to determine. Copies (equal hash
    and ``keep``) are one row, and attached afterwards. Nulls and an empty table give no pairs.
    """
    bits = 64 * n_limbs
    bands = max(radius + 1 if bands is None else bands, math.ceil(bits / 60))
    bounds = [bits * k // bands for k in range(bands + 1)]
    spans, errors = list(enumerate(zip(bounds, bounds[1:], strict=False))), radius // bands
    names = [f"l{k}" for k in range(n_limbs)]

    def value(lo: int, hi: int, side: str) -> Column:
        """Bits lo to hi of the limbs, the first limb's highest bit being bit 0."""
        limb = lambda at: F.col(f"{side}l{at // 64}")
        low = (hi - 1) % 64 + 1  # bits that the last limb gives
        last = F.shiftrightunsigned(limb(hi - 1), 64 - low)
        if lo // 64 != (hi - 1) // 64:
            last = F.shiftleft(limb(lo), low).bitwiseOR(last)
        return last.bitwiseAND(F.lit((1 << hi - lo) - 1))

    sound = rows.where(F.col(limbs).isNotNull()).select(F.col(node).alias("n"), *(F.get(limbs, F.lit(k)).alias(x) for k, x in enumerate(names)), *(F.col(c).alias(f"k_{c}") for c in keep), *(F.col(c).alias(f"p_{c}") for c in payload))
    kept = [*names, *(f"k_{c}" for c in keep)]
    carried = [f"p_{c}" for c in payload]
    distinct = materialise(sound.groupBy(*kept).agg(F.min("n").alias("e"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in carried)), "distinct-hashes")
    columns = ["e", "copies", *kept, *carried]
    side = lambda name: [F.col(c).alias(f"{name}{c}") for c in columns]
    own = F.array(*(F.struct(F.lit(k).alias("k"), value(lo, hi, "").alias("v")) for k, (lo, hi) in spans))

    def probes(k: int, lo: int, hi: int) -> Column:
        masks = F.array(*(F.lit(m).cast("long") for m in band_masks(hi - lo, errors)))
        return F.transform(masks, lambda m: F.struct(F.lit(k).alias("k"), value(lo, hi, "").bitwiseXOR(m).alias("v")))

    left = distinct.select(*side("x"), F.explode(own).alias("own")).select("*", "own.k", "own.v").drop("own")
    right = distinct.select(*side("y"), F.explode(F.concat(*(probes(k, lo, hi) for k, (lo, hi) in spans)) if errors else own).alias("own")).select("*", "own.k", "own.v").drop("own")
    apart = sum((F.bit_count(F.col(f"x{c}").bitwiseXOR(F.col(f"y{c}"))) for c in names), F.lit(0))
    meets = lambda lo, hi: F.bit_count(value(lo, hi, "x").bitwiseXOR(value(lo, hi, "y"))) <= errors
    first = F.lit(None).cast("int")
    for k, (lo, hi) in reversed(spans):
        first = F.when(meets(lo, hi), k).otherwise(first)

    def wanted(found: DataFrame, a: str, b: str) -> DataFrame:
        return found.withColumns({f"{c}_{name}": F.col(f"{end}k_{c}") for c in keep for name, end in (("a", a), ("b", b))})

    both = left.join(right, ["k", "v"]).where((F.col("xe") < F.col("ye")) & (apart <= radius)).where(F.col("k") == first)
    if where is not None:  # in the order of the smallest copies; the other order holds for some copies of a pair at most
        either = wanted(both, "x", "y").withColumn("__one", F.expr(where) if isinstance(where, str) else where).drop(*(f"{c}_{n}" for c in keep for n in "ab"))
        either = wanted(either, "y", "x").withColumn("__two", F.expr(where) if isinstance(where, str) else where).drop(*(f"{c}_{n}" for c in keep for n in "ab"))
        both = either.where(F.col("__one") | (((F.col("xcopies") > 1) | (F.col("ycopies") > 1)) & F.col("__two"))).drop("__one", "__two")
    measured = both.withColumns({f"{c}_{name}": F.col(f"{end}p_{c}") for c in payload for name, end in (("a", "x"), ("b", "y"))})
    more = also or {}
    tags = [f"{end}k_{c}" for c in keep for end in "xy"]
    near = measured.select("xe", "ye", "xcopies", "ycopies", *tags, apart.alias("distance"), *(c.alias(x) for x, c in more.items()))
    single = near.where("xcopies = 1 AND ycopies = 1").select(F.col("xe").alias("a"), F.col("ye").alias("b"), "distance", *more)

    # Pairs of which a side has copies, and the copies themselves: each copy takes its row's part.
    several = distinct.where("copies > 1")
    own_pairs = several.select(*side("x"), *side("y"))
    own_pairs = own_pairs.withColumns({f"{c}_{name}": F.col(f"{end}p_{c}") for c in payload for name, end in (("a", "x"), ("b", "y"))})
    own_pairs = own_pairs.select("xe", "ye", "xcopies", "ycopies", *tags, F.lit(0).alias("distance"), *(c.alias(x) for x, c in more.items()))
    copied = near.where("xcopies > 1 OR ycopies > 1").unionByName(own_pairs)
    named = several.select("e", *(F.col(c).alias(f"{c}_") for c in kept))
    members = sound.join(named, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in kept]).select("e", "n")
    for end in "xy":
        found = members.select(F.col("e").alias(f"{end}e"), F.col("n").alias(f"{end}n"))
        copied = copied.join(found, f"{end}e", "left").withColumn(f"{end}n", F.coalesce(f"{end}n", f"{end}e"))
    copied = copied.where("xe <> ye OR xn < yn")
    turned = F.col("xn") > F.col("yn")
    ends = {f"{c}_{name}": F.when(turned, F.col(f"{other}k_{c}")).otherwise(F.col(f"{end}k_{c}")) for c in keep for name, end, other in (("a", "x", "y"), ("b", "y", "x"))}
    copied = copied.withColumns(ends) if ends else copied
    copied = copied if where is None else copied.where(where)
    return single.unionByName(copied.select(F.least("xn", "yn").alias("a"), F.greatest("xn", "yn").alias("b"), "distance", *more))


def tier(kind: Column, corr: Column, same_regions: Column, distance: Column, full_corr: Column) -> Column:
    """Confirmed for exact edges; named ones by correlation and regions; visual ones by distance and two correlations."""
    named = F.when(corr >= 0.995, F.when(same_regions, "Strongly Supported").otherwise("Supported")).otherwise("Candidate")
    visual = (
        F.when(distance > 12, "Outside current shortlist")
        .when((corr >= 0.995) & (full_corr >= 0.96), "Supported")
        .otherwise("Candidate")
    )
    return F.when(kind == "exact", "Confirmed").when(kind == "named", named).otherwise(visual)


def included(mode: str, kind: Column, corr: Column, same_regions: Column, distance: Column, full_corr: Column, named_at: float = 0.995, reach: int = 12) -> Column:
    """Which edges merge groups: ``conservative``, ``current`` or ``worst``."""
    if mode not in ("conservative", "current", "worst"):
        raise ValueError(mode)
    strong = F.coalesce(corr >= named_at, F.lit(False))
    named = {"conservative": strong & same_regions, "current": strong, "worst": F.lit(True)}[mode]
    seen = F.coalesce(distance <= reach, F.lit(False))
    supported = seen & F.coalesce((corr >= 0.995) & (full_corr >= 0.96), F.lit(False))
    visual = {"conservative": F.lit(False), "current": supported, "worst": seen}[mode]
    return F.when(kind == "exact", True).when(kind == "named", named).otherwise(visual)
