"""A directional 256-bit hash of a text's word counts, and correlations at two resolutions.

Words fall into 257 cells by their MD5; the counts of the cells are the text's profile. Bit k says whether
cell k counts more than cell k + 1. Near copies share almost all bits, other texts of a language about half of those that are set. Short texts
(fewer than ``LEAST`` words) have no profile: nearly all their cells are empty and would agree by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalar import moments

CELLS, LEAST = 257, 50


def profiles(rows: DataFrame, node: str, text: str) -> DataFrame:
    """(node, fine array<long>, coarse array<long>, h array<long>, of_fine, of_coarse) of each text with enough words; null texts have none.

    ``fine``: 256 cells; ``coarse``: 64 sums of four; ``of_``: the moments of each.
    """
    word = F.explode(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    cell = F.conv(F.substring(F.md5("word"), 1, 4), 16, 10).cast("int") % CELLS
    counts = rows.select(node, word.alias("word")).groupBy(node, cell.alias("cell")).agg(F.count("*").alias("n"))
    held = counts.groupBy(node).agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m"), F.sum("n").alias("words")).where(F.col("words") >= LEAST)
    cells = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long")))
    filled = held.select(node, cells.alias("cells"))
    sized = filled.select(node, F.slice("cells", 1, CELLS - 1).alias("fine"), coarse(F.col("cells")).alias("coarse"), difference_limbs(F.col("cells")).alias("h"))
    return sized.withColumns({"of_fine": moments(F.col("fine")), "of_coarse": moments(F.col("coarse"))})


def difference_limbs(cells: Column) -> Column:
    """Bits ``cells[k] > cells[k + 1]`` as 64-bit integers, the first bit highest."""
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(CELLS - 2)), lambda k: F.when(F.get(cells, k) > F.get(cells, k + 1), "1").otherwise("0")), "")
    half = lambda at: F.conv(F.substring(text, at, 32), 2, 10).cast("long")
    return F.array(*(F.shiftleft(half(at), 32).bitwiseOR(half(at + 32)) for at in range(1, CELLS - 1, 64)))


def coarse(cells: Column) -> Column:
    """64 sums of four cells each."""
    at = lambda k, j: F.get(cells, k * 4 + j)
    return F.transform(F.sequence(F.lit(0), F.lit((CELLS - 1) // 4 - 1)), lambda k: at(k, 0) + at(k, 1) + at(k, 2) + at(k, 3))
