"""Suffix-array dedup of byte strings: every byte of a ``LENGTH``-byte string that also starts in a
document with a smaller id is removed.

A suffix array of all text is never built. Anchors (see ``repeats``) bring together what can
be equal, and contexts that are equal are one string, that of their smallest document. What differs, the
representatives of classes that share an anchor, is sorted as suffixes: the strings of a
group of anchors are dealt to shards, each shard gets its suffix array and Burrows-Wheeler
transform, and the transforms are merged by iterative interleave refinement. The merge
yields common-prefix lengths; intervals with ``LENGTH`` or more symbols in common are the
repeated strings, and the smallest document of an interval keeps its copy.

A string that holds the anchor takes at least half of the context on one side of it, so contexts
with a string in common agree on the half to the left or on the half to the right: a context that shares
neither half with another document's takes no part. An anchor with more than ``LARGE`` classes is dealt to
groups by its halves, each of which settles the strings that hold that half; the method is the same.

Defined results: null text is empty. Texts shorter than ``LENGTH`` stay whole. Documents with
equal ids don't remove from each other; those with a null id neither remove nor lose
anything. Repeated rows are treated alike. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import bwt, repeats
from lodestrata.llm.text import map_arrow, texts_of
from lodestrata.session import discard, materialise, release_shuffles

LENGTH, SEED = 50, 16
SHARDS, GROUP, LARGE = 4, 4_000, 5_000
#: Symbols by which a round refines the interleave.
STEP = 5


def byte_hashes():
    table = repeats.mix(np.arange(1, 257, dtype=np.uint64))
    return lambda text: table[np.frombuffer(text, np.uint8)]


def scheme(length: int = LENGTH, seed: int = SEED) -> repeats.Scheme:
    return repeats.Scheme(length, min(seed, length), byte_hashes)


def contexts(rows: DataFrame, representatives: DataFrame, s: repeats.Scheme) -> DataFrame:
    """(anchor, cls, id, left, data, side, deal): the bytes of each representative's context; ``left`` of them precede the anchor.

    ``side``: 0 or 1 where only the strings with the half to the left or right are settled, else -1; ``deal`` hashes the group.
    """
    id_type = rows.schema["id"].dataType.simpleString()
    half = s.context // 2

    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for k, text, asked in repeats.wanted_of(batch):
                for anchor, cls, at, n in zip(*(asked[f].tolist() for f in ("anchor", "cls", "at", "n")), strict=True):
                    pos = at >> 32
                    left = min(pos, s.context)
                    data = text[pos - left : pos + s.length]
                    sides = [(-1, b"")] if n <= LARGE else [(0, data[left - half : left] if left >= half else None), (1, data[left + s.seed : left + s.seed + half])]
                    for side, part in sides:
                        if part is not None and (side < 1 or len(part) == half):
                            deal = xxhash.xxh64_intdigest(anchor.to_bytes(8, "little", signed=True) + part, side + 1) >> 1
                            for column, value in zip(out, (anchor, cls, k, left, data, side, deal), strict=True):
                                column.append(value)
            a, c, k, left, data, side, deal = out
            columns = [
                pa.array(a, pa.int64()), pa.array(c, pa.int64()), batch["id"].take(pa.array(k, pa.int64())), pa.array(left, pa.int32()),
                pa.array(data, pa.binary()), pa.array(side, pa.int8()), pa.array(deal, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "cls", "id", "left", "data", "side", "deal"])

    return map_arrow(repeats.with_requests(rows, representatives), cut, f"anchor long, cls long, id {id_type}, left int, data binary, side byte, deal long")


def undecided(data: list[bytes], left: np.ndarray, anchor: np.ndarray, code: np.ndarray, s: repeats.Scheme) -> np.ndarray:
    """Positions of the contexts that share a half with another document's context of the same anchor."""
    half = s.context // 2
    keep = np.zeros(len(data), bool)
    for cut in (lambda x, k: x[k - half : k] if k >= half else None, lambda x, k: x[k + s.seed : k + s.seed + half]):
        parts = [cut(x, k) for x, k in zip(data, left.tolist(), strict=True)]
        at = np.array([i for i, p in enumerate(parts) if p is not None and len(p) == half], np.int64)
        if len(at):
            h = np.array([xxhash.xxh64_intdigest(parts[i]) for i in at.tolist()], np.uint64)
            order = np.lexsort((code[at], h, anchor[at]))
            at, h = at[order], h[order]
            starts = np.flatnonzero(repeats._starts(anchor[at], h))
            size = np.diff(np.append(starts, len(at)))
            apart = np.minimum.reduceat(code[at], starts) < np.maximum.reduceat(code[at], starts)
            keep[at[np.repeat(apart, size)]] = True
    return np.flatnonzero(keep)


def repeated_starts(strings: list[bytes], ids: np.ndarray, length: int, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every ``length``-byte string that also starts in a string with a smaller id."""
    groups = [g for g in np.array_split(np.arange(len(strings)), shards) if len(g)]
    built = [bwt.shard([strings[k] for k in g]) for g in groups]
    row, interval, _ = bwt.merge([t for t, _, _ in built], length, STEP)
    if not len(row):
        return row, row
    owner = np.concatenate([g[o] for g, (_, o, _) in zip(groups, built, strict=True)])[row]
    offset = np.concatenate([o for _, _, o in built])[row]
    starts = np.flatnonzero(repeats._starts(interval))
    smallest = np.repeat(np.minimum.reduceat(ids[owner], starts), np.diff(np.append(starts, len(row))))
    found = ids[owner] > smallest
    return owner[found], offset[found]


def offsets_by_merge(rows: DataFrame, representatives: DataFrame, s: repeats.Scheme) -> DataFrame:
    """(anchor, cls, offsets), as ``repeats.offsets_by_hash`` gives them."""
    strings = materialise(contexts(rows, representatives, s), "contexts")
    release_shuffles(rows.sparkSession)
    groups = max(1, math.ceil(strings.count() / GROUP))
    dealt = strings.repartition(F.pmod("deal", F.lit(groups))).withColumn("group", F.pmod("deal", F.lit(groups))).sortWithinPartitions("group")
    half = s.context // 2

    def settle(table: pa.Table):
        ids, anchor, left = repeats.codes_of(table["id"].combine_chunks()), table["anchor"].to_numpy(), table["left"].to_numpy()
        data, side = table["data"].to_pylist(), table["side"].to_numpy()
        at = undecided(data, left, anchor, ids, s)
        owner, offset = repeated_starts([data[k] for k in at.tolist()], ids[at], s.length) if len(at) else (at, at)
        owner = at[owner]
        a = left[owner] - offset
        ok = (a >= 0) & (a <= s.context) & ((side[owner] < 0) | ((side[owner] == 0) & (a >= half)) | ((side[owner] == 1) & (a < s.context - half + 1)))
        owner, a = owner[ok], a[ok]
        order = np.lexsort((a, owner))
        owner, a = owner[order], a[order]
        heads = np.flatnonzero(repeats._starts(owner)) if len(owner) else owner
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(owner)), pa.int32()), pa.array(a, pa.int32()))
        who = pa.array(owner[heads])
        return pa.RecordBatch.from_arrays([table["anchor"].combine_chunks().take(who), table["cls"].combine_chunks().take(who), lists], ["anchor", "cls", "offsets"])

    def merge(batches):
        held, last = [], None
        for batch in batches:
            groups_ = batch["group"].to_numpy()
            cuts = [0, *(np.flatnonzero(groups_[1:] != groups_[:-1]) + 1).tolist(), len(batch)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if held and groups_[lo] != last:
                        yield settle(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(lo, hi - lo))
                    last = groups_[lo]
        if held:
            yield settle(pa.Table.from_batches(held))

    found = map_arrow(dealt.drop("deal"), merge, "anchor long, cls long, offsets array<int>")
    out = materialise(found.groupBy("anchor", "cls").agg(F.flatten(F.collect_list("offsets")).alias("offsets")), "offsets")
    discard(strings)
    return out


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Columns id, n_bytes, n_removed, n_spans, kept_sha256: one row for each document."""
    out = removed_strings(docs, id_col=id_col, text_col=text_col, length=length)
    return out.select(id_col, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def removed_strings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Columns id, n_bytes, n_removed, spans (start and end of each removed run), kept (the remaining bytes)."""
    s = scheme(length)
    rows = repeats.rows_of(docs, id_col, text_col)
    spans = repeats.covered_spans(rows, s, offsets_by_merge)
    joined = rows.join(spans, ["id", "var"], "left").select("id", "text", "spans")

    def cut(batches):
        for batch in batches:
            n, removed, runs, kept = [], [], [], []
            for text, spans in zip(texts_of(batch["text"]), repeats.spans_of(batch["spans"]), strict=True):
                gone = repeats.mask(len(text), spans) if spans is not None else np.zeros(0, bool)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                n.append(len(text))
                removed.append(int(gone.sum()))
                runs.append(edges.reshape(-1, 2).tolist())
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes() if spans is not None else text)
            columns = [batch["id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "spans", "kept"])

    id_type = rows.schema["id"].dataType.simpleString()
    out = map_arrow(joined, cut, f"id {id_type}, n_bytes long, n_removed long, spans array<array<long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
