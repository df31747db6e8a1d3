"""Exact top-k inner products: norm-sorted candidates, SVD-rotated partial sums, Cauchy-Schwarz bounds on the rest.

Candidates are written in order of falling length, so that a scan for a block of queries starts at the length
below which no query of the block can reach its threshold (a filter that Parquet's statistics answer). The vectors are
rotated by the singular vectors of the candidates, which puts most of their length first. Of every pair of a batch and a query, the partial
sum over the first coordinates plus the product of the remaining lengths bounds the score; what stays above the query's threshold gets
more coordinates, then the exact integer product. A query's threshold is its k-th score among the longest candidates, or among
those that the task has met, if greater. Queries go in blocks of ``BLOCK`` against all rows; a task keeps k scores for each query of the block.

Vectors that take part are those of ``vectors.integers``; a row without an id takes no part. Rows with the query's id are its own and no
candidates. Equal rows are candidates each; each row that asks gets its own result. Scores beyond 64 bits are held at the end of their range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.text import map_arrow
from lodestrata.llm.vectors import integers, matrix, products
from lodestrata.session import discard, materialise

#: Queries in a block, candidates that give the first thresholds, and pairs that a task holds at once.
BLOCK, SEED, CELLS = 8192, 2048, 1 << 21
#: Shares of the coordinates after which the bound is tried.
HEADS = (0.25, 0.6)
#: What rounding can add to a bound, relative to the product of the lengths.
SLACK = 1e-9
#: Below it all sums of products are exact in float64.
EXACT = float(1 << 53)
OUT = "row long, query_id long, vec_id long, score long"


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of all pairs of rows; by Cauchy-Schwarz no partial sum exceeds the product of the lengths."""
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)), np.int64)
    longest = lambda m: np.sqrt((m.astype(float) ** 2).sum(axis=1).max())
    if longest(q) * longest(c) < EXACT:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    whole = q.astype(object) @ c.astype(object).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Best:
    """The k best (score falling, id rising) of each query, kept as three rows of arrays."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = np.concatenate([self.query, query]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, ~score, query))  # ~score falls as the score rises, without overflow
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.id, self.score = query[keep], ids[keep], score[keep]
        full = place[keep] == self.k - 1
        self.floor[self.query[full]] = np.maximum(self.floor[self.query[full]], self.score[full])


def _thresholds(ids: np.ndarray, q: np.ndarray, seed_ids: np.ndarray, seed: np.ndarray, k: int) -> np.ndarray:
    """The k-th score of each query among the seed's candidates; the least number there is if the seed has fewer."""
    out = np.full(len(q), np.iinfo(np.int64).min)
    step = max(1, CELLS // max(1, len(seed)))
    for lo in range(0, len(q), step):
        scores = exact_scores(q[lo : lo + step], seed)
        scores[ids[lo : lo + step, None] == seed_ids[None]] = np.iinfo(np.int64).min
        if len(seed) >= k:
            out[lo : lo + step] = np.partition(scores, len(seed) - k, axis=1)[:, len(seed) - k]
    return out


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def _scan(rows: np.ndarray, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, rotation: np.ndarray, k: int):
    """The task: candidates in batches against one block of queries."""
    width = q.shape[1]
    heads = sorted({max(1, int(width * share)) for share in HEADS})

    def run(batches):
        best = Best(len(q), k, floor.copy())
        turned = q @ rotation
        long = _lengths(turned)
        tails = [_lengths(turned[:, h:]) for h in heads]
        step = max(1, CELLS // max(1, len(q)))
        for batch in batches:
            all_ids, all_x = np.asarray(batch.column(0)), matrix(batch.column(1), width)
            for lo in range(0, len(all_x), step):
                x, own = all_x[lo : lo + step], all_ids[lo : lo + step]
                c = x @ rotation
                reach = _lengths(c)
                alive = np.flatnonzero(long * (reach.max() * (1 + SLACK)) >= best.floor)
                near = np.arange(len(x))
                for h, tail in zip(heads, tails, strict=True):
                    if not len(alive) or not len(near):
                        break
                    bound = turned[alive, :h] @ c[near, :h].T + np.outer(tail[alive], _lengths(c[near, h:])) + SLACK * np.outer(long[alive], reach[near])
                    open_ = bound >= best.floor[alive, None]
                    alive, near = alive[open_.any(axis=1)], near[open_.any(axis=0)]
                if not len(alive) or not len(near):
                    continue
                score = exact_scores(q[alive], x[near])
                i, j = np.nonzero((score >= best.floor[alive, None]) & (ids[alive, None] != own[near][None]))
                if len(i):
                    best.add(alive[i], own[near[j]], score[i, j])
        yield pa.RecordBatch.from_arrays([pa.array(rows[best.query]), pa.array(ids[best.query]), pa.array(best.id), pa.array(best.score)], names=["row", "query_id", "vec_id", "score"])

    return run


def top_inner_products(df: DataFrame, asks: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each row for which ``asks`` is true."""
    spark = df.sparkSession
    found, width = integers(df, id_column, vector_column, scale, {"asks": F.coalesce(asks, F.lit(False))})
    found = found.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "x", "asks")
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    # Equal vectors have one length, so ids and places split them over tasks.
    placed = found.withColumns({"length": length, "at": F.monotonically_increasing_id()})
    candidates = materialise(placed.repartitionByRange(F.desc("length"), "id", "at").sortWithinPartitions(F.desc("length"), "id").drop("at"), "candidates")
    queries = materialise(candidates.where("asks").select("id", "x").withColumn("row", F.monotonically_increasing_id()), "queries")
    # A row's number has its task in the upper bits and its place in the task in the lower 33.
    sizes = queries.groupBy(F.shiftright("row", 33).alias("part")).agg(F.count("*").alias("n"), F.min("row").alias("first")).orderBy("part").collect()
    blocks = [(r["first"] + lo, min(r["first"] + lo + BLOCK, r["first"] + r["n"])) for r in sizes for lo in range(0, r["n"], BLOCK)]
    if not blocks:
        discard(candidates)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    gram = products(candidates, width, np.zeros(width), np.eye(width))
    rotation = np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]
    head = candidates.orderBy(F.desc("length"), "id").limit(SEED).select("id", "x").toArrow()
    seed_ids, seed = np.asarray(head["id"]), matrix(head["x"], width)
    paths = []
    for first, end in _merged(blocks):
        block = queries.where((F.col("row") >= first) & (F.col("row") < end)).toArrow()  # BLOCK rows at most
        ids, q, rows = np.asarray(block["id"]), matrix(block["x"], width), np.asarray(block["row"])
        floor = _thresholds(ids, q, seed_ids, seed, k)
        long = _lengths(q.astype(float))
        least = float(np.min(np.where(floor > 0, floor / np.maximum(long, 1e-300), 0.0))) * (1 - SLACK)
        within = candidates.where(F.col("length") >= least) if least > 0 else candidates
        part = map_arrow(within.select("id", "x"), _scan(rows, ids, q, floor, rotation, k), OUT)
        order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        ranked = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        paths.append(materialise(ranked, "top-products")._lodestrata_path)
    discard(candidates)
    discard(queries)
    return spark.read.schema(ranked.schema).parquet(*paths)


def _merged(blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of row numbers with at most BLOCK queries each: short blocks that follow each other become one."""
    out, held = [], 0
    for first, end in blocks:
        if out and held + end - first <= BLOCK:
            out[-1] = (out[-1][0], end)
            held += end - first
        else:
            out.append((first, end))
            held = end - first
    return out
