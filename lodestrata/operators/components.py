"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two shuffles over the edges and is written to the shared folder, so
the lineage stays short and a lost executor costs one round. The rounds grow with
the logarithm of the longest path, not with its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import discard, materialise, ship

#: Edges that a task thins together.
CHUNK = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of every node that isn't the smallest: fewer edges than nodes, the same components."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[tied], nodes[root[tied]]


def thinned(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges between longs with the same components, in each chunk of a task fewer than its nodes: nothing is shuffled. Nulls are left out."""
    ship(edges.sparkSession)

    def thin(batches):
        held, n = [], 0
        for batch in batches:
            held.append((batch[src].to_numpy(), batch[dst].to_numpy()))
            n += len(batch)
            if n >= CHUNK:
                held = [stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                n = 0  # what is kept of a chunk goes on with the next one, if it is the smaller part
                if len(held[0][0]) > CHUNK // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], [src, dst])
                    held = []
        if held:
            u, v = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], [src, dst])

    sound = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    return sound.select(F.col(src).cast("long"), F.col(dst).cast("long")).mapInArrow(thin, f"{src} long, {dst} long")


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """large: link every larger neighbour of u to u's smallest; small: link the smaller neighbours and u itself."""
    both = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(smallest, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(smallest.select("u", F.col("m").alias("v")))
    else:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def _marks(edges: DataFrame) -> tuple:
    """Number of edges and two sums of 128 bits of their hashes: equal edge sets have equal marks, and no shuffle is needed to compare them."""
    sums = (F.sum(h.cast("decimal(38,0)")) for h in (F.xxhash64("u", "v"), F.xxhash64("v", "u", F.lit(1))))
    return tuple(edges.agg(F.count("*"), *sums).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Nulls and self-loops are ignored; repeated edges and either direction are fine.
    An empty edge table gives an empty result.
    """
    high, low = F.greatest(src, dst), F.least(src, dst)
    pairs = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    now = materialise(pairs.select(high.alias("u"), low.alias("v")).distinct(), "edges")
    after = _marks(now)
    while True:
        then = materialise(_star(_star(now, small=False), small=True), "edges")
        discard(now)
        now, before = then, after
        after = _marks(now)
        if after == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
