"""Benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel edit distance.

Texts and items are normalised alike: lower case, runs of white space become one space.
An item of n characters may differ by k = n // CHARS_PER_ERROR edits from a place in a
document. It is cut into k + 1 pieces: k edits spare at least one of them, so every
match contains a piece unchanged. All pieces of all items are searched in one pass with
an Aho-Corasick automaton; each hit fixes where the item would lie, and there the edit
distance of the item to its best substring is computed in bit-parallel columns.

Items are read in blocks of at most ``ITEM_BLOCK`` items and ``BLOCK_CHARS`` characters, and each block is broadcast, so
driver and executors hold a block at most; every block is matched with all documents, and a Python worker
builds its automaton once.

Defined results: null or blank texts and items match nothing. Equal items are one item for each id.
Items too short for an error must stand between non-letters. Repeated rows are
reported once each. An empty table on either side gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestrata.llm.text import map_arrow

CHARS_PER_ERROR, ITEM_BLOCK, BLOCK_CHARS = 24, 20_000, 8_000_000


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): ``k + 1`` pieces whose lengths differ by one at most."""
    bounds = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def masks_of(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_substring(masks: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the substring of ``text`` nearest to the pattern, the first of equals; None beyond ``k``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = full, 0, m, None
    get = masks.get
    for end, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | ~(xh | vp) & full
        hn = vp & xh
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & full
        hn = hn << 1 & full
        vp = hn | ~(xv | hp) & full
        vn = hp & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, end)
    return best


class Matcher:
    """Finds the items of one block in normalised texts."""

    def __init__(self, items: list[tuple], chars_per_error: int):
        self.items, places = [], {}
        for item_id, text in items:
            k = len(text) // chars_per_error
            n = len(self.items)
            self.items.append((item_id, text, k))
            for offset, piece in pieces(text, k):
                places.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()
        self.masks: dict[int, dict[str, int]] = {}

    def find(self, text: str) -> list[tuple]:
        """(item id, distance, start, end) for each item found: its best place, the first of equals."""
        best: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        if not text or not self.items:
            return []
        for last, (size, at) in self.automaton.iter(text):
            for n, offset in at:
                _, item, k = self.items[n]
                start = last + 1 - size - offset
                if (n, start) in tried or best.get(n, (1,))[0] == 0:
                    continue
                tried.add((n, start))
                end = start + len(item)
                if k == 0:
                    if not (text[start - 1 : start].isalpha() or text[end : end + 1].isalpha()):
                        best[n] = (0, end)
                    continue
                if start >= 0 and text.startswith(item, start):
                    best[n] = (0, end)
                    continue
                lo = max(0, start - k)
                if n not in self.masks:
                    self.masks[n] = masks_of(item)
                found = best_substring(self.masks[n], len(item), text[lo : end + k], k)
                if found and found[0] < best.get(n, (k + 1,))[0]:
                    best[n] = (found[0], lo + found[1])
        out = []
        for n, (distance, end) in sorted(best.items()):
            item_id, item, _ = self.items[n]
            out.append((item_id, distance, max(0, end - len(item)), end))
        return out


def blocks_of(items: Iterable[tuple], item_block: int) -> Iterator[list[tuple]]:
    """(id, text) pairs in lists of bounded number and size."""
    block, size = [], 0
    for item in items:
        block.append(item)
        size += len(item[1])
        if len(block) >= item_block or size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


_built: dict[str, Matcher] = {}


def _matcher(token: str, block: list[tuple], chars_per_error: int) -> Matcher:
    """The matcher of a block: the tasks of a Python worker share it, the last one is kept."""
    if token not in _built:
        _built.clear()
        _built[token] = Matcher(block, chars_per_error)
    return _built[token]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    chars_per_error: int = CHARS_PER_ERROR,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """Columns id, item_id, distance, near_start, near_end (in the normalised text): one row for each document and item found in it.

    ``near_start`` is the end less the item's length.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, item_id {benchmark.schema[item_id_col].dataType.simpleString()}, distance int, near_start long, near_end long"
    items = benchmark.select(F.col(item_id_col).alias("item"), F.col(item_text_col).alias("text")).distinct().orderBy("item", "text")
    source = ((r["item"], normalise(r["text"])) for r in items.toLocalIterator())
    source = (x for x in source if x[1])
    item_type = to_arrow_type(benchmark.schema[item_id_col].dataType)
    found = [_match(rows, block, chars_per_error, schema, item_type) for block in blocks_of(source, item_block)]
    out = reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col})


def _match(rows: DataFrame, block: list[tuple], chars_per_error: int, schema: str, item_type: pa.DataType) -> DataFrame:
    shared, token = rows.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def match(batches):
        matcher = _matcher(token, shared.value, chars_per_error)
        for batch in batches:
            at, found = [], []
            for k, text in enumerate(batch["text"].to_pylist()):
                hits = matcher.find(normalise(text))
                at.extend([k] * len(hits))
                found.extend(hits)
            item, distance, start, end = zip(*found, strict=True) if found else ((),) * 4
            columns = [batch["id"].take(pa.array(at, pa.int64())), pa.array(item, item_type), pa.array(distance, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "item_id", "distance", "near_start", "near_end"])

    return map_arrow(rows, match, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_text_col: str = "text", chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_text_col).alias("t")).distinct()
    source = (normalise(r["t"]) for r in items.toLocalIterator())
    source = ((n, x) for n, x in enumerate(source) if x)
    for block in blocks_of(source, ITEM_BLOCK):
        shared, token = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def clean(batches, shared=shared, token=token):
            matcher = _matcher(token, shared.value, chars_per_error)
            for batch in batches:
                ok = [not matcher.find(normalise(text)) for text in batch["text"].to_pylist()]
                yield batch.filter(pa.array(ok, pa.bool_()))

        rows = map_arrow(rows, clean, rows.schema)
    return rows.select("row.*")
