"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

A document's ids (and one closing id) are cut into full pieces of ``width`` and
one rest. Only counts by length go to the driver: at most ``width`` numbers. There,
lengths are placed from the longest to the shortest; each goes into the pattern
with most room left (the shortest pack), of which as many copies are taken as the
length has pieces. Where none has room, new sequences are opened, each filled with as
many pieces of the length as fit, and one more pattern has what is left over. Every
step uses up a length or a pattern, so there are at most ``2 * width`` patterns and
``2 * width**2`` slots, whatever the number of documents. A
piece then finds its slot by its rank among the pieces of its length. Ranks come
from numbered parts of each length, about ``ROWS`` pieces each (more, beyond ``PARTS`` parts in all), so that no task holds
a length and what is broadcast has a bound.

Defined results: a null or empty text is the closing id alone. Repeated rows are
packed once each. A null doc_id is kept. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.text import map_arrow
from lodestrata.llm.tokens import default_vocabulary, encoder
from lodestrata.session import materialise

WIDTH, END_ID = 2048, 1
#: Pieces of a part whose ranks one task gives, and the most parts that are broadcast.
ROWS, PARTS = 200_000, 100_000


def plan(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, list[int]]]:
    """(copies, lengths) of each pattern. ``histogram``: number of pieces by length."""
    by_room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = width
        while left:
            while room >= length and not by_room[room]:
                room -= 1
            if room < length:
                for copies, n in zip((1, left // (width // length)), (left % (width // length), width // length), strict=True):
                    if copies and n:
                        by_room[width - n * length].append((copies, [length] * n))
                break
            copies, lengths = by_room[room].pop()
            used = min(copies, left)
            if copies > used:
                by_room[room].append((copies - used, lengths))
            by_room[room - length].append((used, [*lengths, length]))
            left -= used
    return [pattern for room in sorted(by_room) for pattern in by_room[room]]


def slots(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Arrays in order of (length, first rank): length, first rank, first sequence, offset."""
    rows, first, used = [], 0, defaultdict(int)
    for copies, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], first, offset))
            used[length] += copies
            offset += length
        first += copies
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), columns, strict=True))


def cut_pieces(docs: DataFrame, *, vocabulary: str | None = None, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, start, length, ids_crc32, doc_tokens: one row for each piece."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    path, closing, step = vocabulary or default_vocabulary(), np.array([END_ID], "<u4").tobytes(), 4 * width

    def cut(batches):
        encode = encoder(path).encode
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for k, text in enumerate(batch["text"].to_pylist()):
                packed = (encode(text) if text else b"") + closing
                for i in range(0, len(packed), step):
                    piece = packed[i : i + step]
                    at.append(k)
                    start.append(i // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(packed) // 4)
            columns = [batch["id"].take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_arrow(rows, cut, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(
    docs: DataFrame,
    *,
    vocabulary: str | None = None,
    width: int = WIDTH,
    rows_per_part: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Columns id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece."""
    spark = docs.sparkSession
    pieces = cut_pieces(docs, vocabulary=vocabulary, width=width, id_col=id_col, text_col=text_col)
    pieces = materialise(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most width rows
    rows_per_part = max(rows_per_part, sum(histogram.values()) // PARTS)
    sizes = spark.createDataFrame([(k, -(-n // rows_per_part)) for k, n in histogram.items()], "length long, parts long")
    cut_up = pieces.join(F.broadcast(sizes), "length").withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.col("parts")).cast("int")).drop("parts")
    parts = cut_up.groupBy("length", "bucket").agg(F.count("*").alias("n"))  # at most width + PARTS rows
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialise(parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "parts")
    table = spark.sparkContext.broadcast(slots(plan(histogram, width)))

    order = Window.partitionBy("length", "bucket").orderBy("id", "start", "ids_crc32", "doc_tokens")
    ranked = cut_up.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(parts.drop("n")), ["length", "bucket"])
    names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = ranked.select(*names, (F.col("rank") + F.col("before")).alias("rank"))
    id_type = pieces.schema["id"].dataType.simpleString()
    shift = 1 << 48

    def place(batches):
        t = table.value
        keys = t["length"] * shift + t["rank"]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            sequence = t["sequence"][at] + rank - t["rank"][at]
            columns = [batch[n] for n in names] + [pa.array(sequence, pa.int64()), pa.array(t["offset"][at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    out = map_arrow(ranked, place, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
