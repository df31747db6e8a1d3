"""The forest of merging edges, and bridges: rounds of joins over edge tables, no task for a component.

``spanning_forest`` is Boruvka's: in each round every group takes its first outgoing edge, groups are contracted along those
edges by pointer jumping, and of parallel edges the first stays. With all edges in one order that is what taking them one by one
and keeping those that join two groups gives. ``bridges`` walks the forest as one list of arcs for each tree (each node's arcs in a
circle, every arc followed by the one after its twin), and ranks the lists by pointer jumping: differences of places are sizes of subtrees,
differences of sums are sums over subtrees. Rounds grow with the logarithm of the number of nodes, whatever the shape. Every round is
written to the shared folder. Nodes are of any orderable type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.order import ranked
from lodestrata.session import discard, materialise


def _settle(up: DataFrame) -> DataFrame:
    """(u, top) with every ``top`` a root, from one step up for each node (roots point to themselves).

    A node that has met its root is joined no more, so a root with many nodes meets each of them once.
    """
    now = materialise(up.withColumn("open", F.col("u") != F.col("top")), "tops")
    while not now.where("open").isEmpty():
        further = now.select(F.col("u").alias("top"), F.col("top").alias("further"))
        moved = now.where("open").join(further, "top").select("u", F.col("further").alias("top"), (F.col("further") != F.col("top")).alias("open"))
        then = materialise(moved.unionByName(now.where("NOT open")), "tops")
        discard(now)
        now = then
    return now


def spanning_forest(edges: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """(the edges that join two groups when taken by ``order``, a, b, with their place as ``rank``; (node): one root of each tree).

    Edges without an end and loops join nothing. An empty table gives two empty ones.
    """
    spark = edges.sparkSession
    usable = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    numbered = materialise(ranked(usable, *order, "a", "b"), "edges")
    live = materialise(numbered.select("rank", F.col("a").alias("u"), F.col("b").alias("v")), "live")
    nodes = live.select(F.col("u").alias("node")).union(live.select("v")).distinct()
    nodes = materialise(nodes, "nodes")
    picks, moves = [], []
    while not live.isEmpty():
        ends = live.select("rank", "u", "v").union(live.select("rank", F.col("v").alias("u"), F.col("u").alias("v")))
        first = materialise(ends.groupBy("u").agg(F.min(F.struct("rank", "v")).alias("e")).select("u", "e.rank", "e.v"), "first")
        picks.append(first._lodestrata_path)
        back = first.select(F.col("u").alias("v"), F.col("rank").alias("back"))
        mutual = (F.col("rank") == F.col("back")) & (F.col("u") < F.col("v"))
        tops = _settle(first.join(back, "v").select("u", F.when(mutual, F.col("u")).otherwise(F.col("v")).alias("top")))
        moves.append(tops._lodestrata_path)
        joined = live.join(tops.select("u", F.col("top").alias("p")), "u").join(tops.select(F.col("u").alias("v"), F.col("top").alias("q")), "v").where("p <> q")
        then = materialise(joined.groupBy(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).agg(F.min("rank").alias("rank")), "live")
        discard(live)
        live = then
    if not picks:
        return numbered, nodes
    kept = spark.read.parquet(*picks).select("rank").distinct()
    gone = spark.read.parquet(*moves).where("u <> top").select(F.col("u").alias("node"))
    return materialise(numbered.join(kept, "rank"), "forest"), materialise(nodes.join(gone, "node", "left_anti"), "roots")


def tree_arcs(forest: DataFrame, roots: DataFrame) -> DataFrame:
    """(arc, u, v, twin, next, opens): both directions of every edge as one list for each tree; ``opens`` marks one arc of each node ``u``."""
    both = forest.select(F.col("a").alias("u"), F.col("b").alias("v")).union(forest.select("b", "a"))
    arcs = materialise(ranked(both, "u", "v", name="arc"), "arcs")
    spans = materialise(arcs.groupBy("u").agg(F.min("arc").alias("first"), F.max("arc").alias("last")), "spans")
    twins = arcs.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("arc").alias("twin"))
    of_end = spans.select(F.col("u").alias("v"), "first", "last")
    linked = arcs.join(twins, ["u", "v"]).join(of_end, "v").withColumn("next", F.when(F.col("twin") == F.col("last"), F.col("first")).otherwise(F.col("twin") + 1))
    starts = spans.join(roots.withColumnRenamed("node", "u"), "u").select(F.col("first").alias("next"), F.lit(True).alias("ends"))
    opening = spans.select(F.col("first").alias("arc"), F.lit(True).alias("opens"))
    cut = linked.join(starts, "next", "left").join(opening, "arc", "left")
    return cut.select("arc", "u", "v", "twin", F.when(F.col("ends").isNull(), F.col("next")).alias("next"), F.coalesce("opens", F.lit(False)).alias("opens"))


def rank_lists(arcs: DataFrame, sums: list[str]) -> DataFrame:
    """(arc, steps, end, ``sums``): from each arc to its list's end, itself included: how many, which arc ends it, and the XOR of each column.

    ``arcs``: arc, next (null at an end) and the columns. No two arcs of a round point to one, so no key is hot.
    """
    open_ = F.col("next").isNotNull()
    now = materialise(arcs.select("arc", "next", F.lit(1).cast("long").alias("steps"), F.when(~open_, F.col("arc")).alias("end"), *sums), "lists")
    while not now.where(open_).isEmpty():
        ahead = now.select(F.col("arc").alias("next"), F.col("next").alias("over"), F.col("steps").alias("more"), F.col("end").alias("last"), *(F.col(c).alias(f"{c}_") for c in sums))
        joined = now.where(open_).join(ahead, "next")
        moved = joined.select("arc", F.col("over").alias("next"), (F.col("steps") + F.col("more")).alias("steps"), F.col("last").alias("end"), *(F.col(c).bitwiseXOR(F.col(f"{c}_")).alias(c) for c in sums))
        then = materialise(moved.unionByName(now.where(~open_)), "lists")
        discard(now)
        now = then
    return now.drop("next")


def bridges(edges: DataFrame) -> DataFrame:
    """(a, b, size_a, size_b), a < b: edges whose removal splits their component, and the nodes on either side after it.

    Every edge outside the forest gets 128 random bits (a hash of its ends) at both ends. A forest edge is crossed by
    no other edge if the bits of the subtree below it cancel out. Parallel edges count once; an empty table gives no rows.
    """
    pairs = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    forest, roots = spanning_forest(pairs)
    others = pairs.join(forest.select("a", "b"), ["a", "b"], "left_anti").withColumns({"x": F.xxhash64("a", "b"), "y": F.xxhash64("b", "a", F.lit("bridge"))})
    bits = others.select(F.col("a").alias("u"), "x", "y").union(others.select("b", "x", "y")).groupBy("u").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    arcs = tree_arcs(forest, roots)
    own = lambda c: F.when(F.col("opens"), F.coalesce(c, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias(c)
    arcs = materialise(arcs.join(bits, "u", "left").select("arc", "u", "v", "twin", "next", own("x"), own("y")), "arcs")
    lists = rank_lists(arcs, ["x", "y"])
    lengths = lists.groupBy("end").agg(F.max("steps").alias("length"))
    after = lists.join(arcs.select("arc", F.col("x").alias("own_x"), F.col("y").alias("own_y")), "arc")
    after = materialise(after.select("arc", "steps", "end", F.col("x").bitwiseXOR(F.col("own_x")).alias("x"), F.col("y").bitwiseXOR(F.col("own_y")).alias("y")), "after")
    down = arcs.where("u < v").select("arc", "twin", F.col("u").alias("a"), F.col("v").alias("b")).join(after, "arc")
    both = down.join(after.select(F.col("arc").alias("twin"), F.col("steps").alias("back"), F.col("x").alias("tx"), F.col("y").alias("ty")), "twin").where("x = tx AND y = ty")
    below, whole = F.shiftright(F.abs(F.col("steps") - F.col("back")) + 1, 1), F.shiftright("length", 1) + 1
    sized = both.join(lengths, "end").select("a", "b", below.alias("below"), whole.alias("whole"), (F.col("steps") > F.col("back")).alias("b_below"))
    size = lambda inside: F.when(inside, F.col("below")).otherwise(F.col("whole") - F.col("below"))
    return sized.select("a", "b", size(~F.col("b_below")).alias("size_a"), size(F.col("b_below")).alias("size_b"))
