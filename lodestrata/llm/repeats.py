"""Seeds of repeated passages: winnowed anchors, shared by documents, with their contexts.

A text is a sequence of units (words or bytes), each with a 64-bit hash. A passage is
``length`` consecutive units. An anchor is a ``seed``-gram that is the smallest hash
among the seed-grams of some passage (ties: all), so equal passages have an anchor
at the same offset. The context of an anchor is everything a passage around it can
cover: ``length - seed`` units on both sides, cut at the text's ends.

Extension in two steps, neither of which makes pairs of documents:

* anchors with equal contexts form a class. In a class every passage is shared, so all
  its documents but the smallest are covered over the whole context;
* a class's smallest document can only be covered by other classes of its anchor.
  One occurrence of each such class (its representative) is compared passage by
  passage; what is found holds for the class. A passage takes at least half of the context on one
  side of its anchor, so a class takes no part if neither half is another document's: a byte
  for each half, sent with the occurrence, tells that of most classes before any text is looked up.

Occurrences are shuffled once, by group of anchors: a task sends a group one row of arrays for each chunk
of its documents, so that Spark moves few long rows; classes are read off group by group. A
class that occurs often in one task is summed up there: its smallest and largest document go to
the anchor's task, its occurrences to any task, and they meet the class's verdict in a join
that Spark can split. So what a hot anchor sends to one task grows with tasks, not with rows.
Equality is that of 44 bits of an anchor's hash and the 64 of a context's or passage's. (Halves of equal bytes
are only compared further.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.text import checksum, map_arrow, texts_of
from lodestrata.session import discard, materialise, release_shuffles

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Occurrences that are combined at once before the shuffle, and from how many documents on a class is summed up.
CHUNK, HEAVY = 1 << 20, 16
#: Documents after which a chunk may end; rows of arrays that are listed at once after the shuffle, occurrences that are judged together.
READ, LISTED, JUDGED = 1 << 8, 1 << 10, 1 << 18
#: Groups of anchors (by their lowest bits); a row of occurrences holds one group's of one chunk.
GROUPS = 1 << 12
ANCHOR = (1 << 44) - 1
#: Kinds of rows: an occurrence, a summed class's end, an occurrence of a summed class.
PLAIN, SUMMARY, DEFERRED = 0, 1, 2
#: Arrays of equal length, but for ``more``, which has ``others`` entries for each occurrence; a position is low + high * 2**16,
#: an anchor tail + anchor * 2**12 (unsigned; the tail is one value in a group, so it takes no room when compressed).
OCCURRENCES = (
    "group int, anchor array<int>, tail array<smallint>, cls array<bigint>, id array<{id}>, var array<int>, low array<smallint>, high array<int>, run array<int>, halves array<smallint>, "
    "others array<int>, kind array<tinyint>, more array<bigint>"
)
VERDICT = "anchor long, cls long, id {id}, var int, at long, more array<bigint>, first {id}, n int, kind byte, rep boolean"


@dataclass(frozen=True)
class Scheme:
    """``hashes`` is made on the executors and maps a text to the uint64 hashes of its units."""

    length: int
    seed: int
    hashes: Callable[[], Callable[[bytes], np.ndarray]]

    @property
    def context(self) -> int:
        return self.length - self.seed


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes of any run of units in constant time."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, h: np.ndarray):
        if len(self.powers) <= len(h):
            n = max(1 << 16, 2 * len(h))
            Rolling.powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE))), dtype=np.uint64)
            Rolling.inverses = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _INVERSE))), dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * self.powers[: len(h)], dtype=np.uint64)))

    def runs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverses[start]

    def every(self, length: int) -> np.ndarray:
        """Hashes of all runs of that length."""
        return mix((self.sums[length:] - self.sums[:-length]) * self.inverses[: len(self.sums) - length])


def sliding(values: np.ndarray, width: int, choose) -> np.ndarray:
    """``choose`` (np.minimum or np.maximum) over every ``width`` consecutive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = choose(values[: len(values) - step], values[step:])
        done += step
    return values


def anchors(h: np.ndarray, s: Scheme) -> tuple[np.ndarray, ...]:
    """(anchor, class, position, run): equal neighbours are one row with their number."""
    return marked(h, s)[:4]


def marked(h: np.ndarray, s: Scheme) -> tuple[np.ndarray, ...]:
    """(anchor, class, position, run, halves): ``anchors`` with a byte for the half of the context to the left and, above it, to the right.

    Equal halves have equal bytes; 0 where the text has no whole half.
    """
    n = len(h)
    if n < s.length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int32),) * 2 + (np.zeros(0, np.int16),)
    rolling = Rolling(h)
    grams = rolling.every(s.seed)
    width = s.length - s.seed + 1
    lowest = sliding(grams, width, np.minimum)
    padded = np.concatenate((np.zeros(width - 1, np.uint64), lowest, np.zeros(width - 1, np.uint64)))
    pos = np.flatnonzero(sliding(padded, width, np.maximum) == grams)
    lo, hi = np.maximum(pos - s.context, 0), np.minimum(pos + s.length, n)
    shape = ((pos - lo) << 32 | (hi - pos)).astype(np.uint64)
    cls = mix(rolling.runs(lo, hi) + mix(shape + np.uint64(1)))
    anchor = grams[pos]
    first = np.ones(len(pos), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (cls[1:] != cls[:-1]) | (pos[1:] != pos[:-1] + 1)
    at = np.flatnonzero(first)
    run = np.diff(np.append(at, len(pos)))
    pos, half = pos[at], s.context // 2
    begin, end = pos - half, pos + s.seed + half
    mark = lambda lo, hi, whole: np.where(whole, mix(rolling.runs(lo, hi)) % np.uint64(255) + np.uint64(1), np.uint64(0))
    halves = mark(np.maximum(begin, 0), pos, begin >= 0) | mark(pos + s.seed, np.minimum(end, n), end <= n) << np.uint64(8)
    return anchor[at].view(np.int64), cls[at].view(np.int64), pos.astype(np.int32), run.astype(np.int32), halves.astype(np.uint16).view(np.int16)


def telling(docs: DataFrame, id_col: str, text: Column) -> Column:
    """What tells rows with equal ids apart: the text's checksum, or nothing where no id is there twice."""
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1")
    return checksum(text) if repeated.limit(1).count() else F.lit(0)


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, var (see ``telling``), text (binary)."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).alias("id"), telling(docs, id_col, text).alias("var"), text.alias("text"))


def codes_of(ids: pa.Array) -> np.ndarray:
    """Integers in the order of the ids."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _ordered(key: np.ndarray, *ties: np.ndarray) -> np.ndarray:
    """The order by a 64-bit hash and then by ``ties``. One sort of integers whose low bits hold the row; what they hide is put in order after it."""
    low = (1 << len(key).bit_length()) - 1
    packed = np.sort(key & ~low | np.arange(len(key)))
    order = packed & low
    new = _starts(packed & ~low)
    again = np.flatnonzero(~(new & np.append(new[1:], True)))
    rows = order[again]
    order[again] = rows[np.lexsort((*(x[rows] for x in reversed(ties)), key[rows]))]
    return order


def _combined(ids: pa.Array, var: pa.Array, doc: np.ndarray, anchor: np.ndarray, cls: np.ndarray, at: np.ndarray, halves: np.ndarray) -> pa.RecordBatch:
    """The occurrences of a chunk of documents (``doc``: index into ids), with the classes that occur often summed up."""
    order = _ordered(cls, codes_of(ids)[doc], at)
    doc, anchor, cls, at, halves = doc[order], anchor[order] & ANCHOR, cls[order], at[order], halves[order]
    own = _starts(cls, anchor, doc)
    one = np.flatnonzero(own)  # a row for each class and document
    others, begin = np.diff(np.append(one, len(cls))) - 1, one + 1
    doc, anchor, cls, halves = doc[one], anchor[one], cls[one], halves[one]
    starts = np.flatnonzero(_starts(cls, anchor))
    size = np.diff(np.append(starts, len(cls)))
    heavy = size >= HEAVY
    ends = np.concatenate((starts[heavy], (starts + size - 1)[heavy]))  # the smallest and the largest document
    pick = np.concatenate((np.arange(len(cls)), ends))
    kind = np.concatenate((np.where(np.repeat(heavy, size), DEFERRED, PLAIN), np.full(len(ends), SUMMARY))).astype(np.int8)
    others = np.concatenate((others, np.zeros(len(ends), np.int64)))
    # Occurrences of summed classes go to groups of their own, by document.
    group = np.where(kind == DEFERRED, GROUPS + doc[pick] % GROUPS, anchor[pick] & (GROUPS - 1))
    order = _ordered(group << 48 | doc[pick] << 24, doc[pick])  # ids that rise within a group are shorter when compressed
    pick, kind, group, others = pick[order], kind[order], group[order], others[order]
    cuts = np.flatnonzero(_starts(group))
    lists = lambda values, bounds: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
    bounds = np.append(cuts, len(group))
    before = np.concatenate(([0], np.cumsum(others)))
    more = at[np.repeat(begin[pick] - before[:-1], others) + np.arange(before[-1])]
    who, at = pa.array(doc[pick]), at[one][pick]
    pos = at >> 32
    numbers = (pos & 0xFFFF).astype(np.uint16).view(np.int16), (pos >> 16).astype(np.int32), (at & 0xFFFFFFFF).astype(np.int32), halves[pick], others.astype(np.int32), kind
    anchor = anchor[pick]
    hashes = (anchor >> 12).astype(np.uint32).view(np.int32), (anchor & 0xFFF).astype(np.int16), cls[pick]
    each = [*map(pa.array, hashes), ids.take(who), var.take(who), *map(pa.array, numbers)]
    columns = [pa.array(group[cuts].astype(np.int32)), *(lists(x, bounds) for x in each), lists(pa.array(more), before[bounds])]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OCCURRENCES.split(", ")])


def _listed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(group, anchor, cls, id, var, at, more, halves, kind): a row for each occurrence of ``_combined``'s rows."""
    flat = {c: batch[c].flatten() for c in batch.schema.names if c != "group"}
    low, high, run, others, anchor, tail = (flat[c].to_numpy() for c in ("low", "high", "run", "others", "anchor", "tail"))
    anchor = anchor.view(np.uint32).astype(np.int64) << 12 | tail
    at = (low.view(np.uint16).astype(np.int64) | high.astype(np.int64) << 16) << 32 | run
    group = np.repeat(batch["group"].to_numpy(), np.diff(batch["anchor"].offsets.to_numpy()))
    ends = np.concatenate(([0], np.cumsum(others))).astype(np.int32)
    more = pa.ListArray.from_arrays(pa.array(ends), flat["more"], mask=pa.array(others == 0))
    columns = [pa.array(group), pa.array(anchor), flat["cls"], flat["id"], flat["var"], pa.array(at), more, flat["halves"], flat["kind"]]
    return pa.RecordBatch.from_arrays(columns, ["group", "anchor", "cls", "id", "var", "at", "more", "halves", "kind"])


def occurrences(rows: DataFrame, s: Scheme) -> DataFrame:
    """Rows of ``OCCURRENCES``. Where they are listed, ``at`` is position << 32 | run and ``more`` has the document's others of the class."""
    id_type = rows.schema["id"].dataType.simpleString()

    def find(batches):
        hashes = s.hashes()
        ids, var, parts, sizes, held = [], [], [], [], 0

        def flush():
            anchor, cls, pos, run, halves = (np.concatenate(x) for x in zip(*parts, strict=True))
            at = pos.astype(np.int64) << 32 | run
            return _combined(pa.concat_arrays(ids), pa.concat_arrays(var), np.repeat(np.arange(len(sizes)), sizes), anchor, cls, at, halves)

        for batch in (b.slice(k, READ) for b in batches for k in range(0, len(b), READ)):
            ids.append(batch["id"])
            var.append(batch["var"])
            for text in texts_of(batch["text"]):
                parts.append(marked(hashes(text), s))
                sizes.append(len(parts[-1][0]))
                held += sizes[-1]
            if held >= CHUNK:
                yield flush()
                ids, var, parts, sizes, held = [], [], [], [], 0
        if parts:
            yield flush()

    return map_arrow(rows.where(F.col("id").isNotNull()), find, OCCURRENCES.format(id=id_type))


def _undecided(anchor: np.ndarray, code: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """Which classes have a half whose byte is that of another document's class of the anchor."""
    out = np.zeros(len(anchor), bool)
    for mark in (halves & 0xFF, halves >> 8):
        at = np.flatnonzero(mark)
        key = anchor[at] << 8 | mark[at]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        if len(at):
            starts = np.flatnonzero(_starts(key))
            apart = np.minimum.reduceat(code[at], starts) < np.maximum.reduceat(code[at], starts)
            out[at[np.repeat(apart, np.diff(np.append(starts, len(at))))]] = True
    return out


def _verdicts(rows: pa.Table) -> pa.RecordBatch:
    """Whole groups of anchors to what is known of their classes. Rows that can lose nothing go."""
    anchor, ids = rows["anchor"].to_numpy(), rows["id"].combine_chunks()
    code = codes_of(ids)
    order = _ordered(anchor)
    starts = np.flatnonzero(_starts(anchor[order]))
    shared = np.minimum.reduceat(code[order], starts) < np.maximum.reduceat(code[order], starts)
    pick = order[np.repeat(shared, np.diff(np.append(starts, len(anchor))))]
    cls, at, var, kind = (rows[c].to_numpy() for c in ("cls", "at", "var", "kind"))
    pick = pick[np.lexsort((at[pick], var[pick], code[pick], cls[pick], anchor[pick]))]
    anchor, cls, code, kind = anchor[pick], cls[pick], code[pick], kind[pick]
    new = _starts(anchor, cls)
    rep = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    first = rep[of]  # the class's smallest document
    group = np.cumsum(_starts(anchor)) - 1 if len(anchor) else anchor
    several = _undecided(group[rep], code[rep], rows["halves"].to_numpy()[pick[rep]].view(np.uint16))[of]
    n = np.where(several, np.bincount(group[rep[several[rep]]], minlength=len(anchor))[group], 0)
    keep = np.flatnonzero((code > code[first]) | several | (kind == SUMMARY))
    named = several[keep] | (kind[keep] == SUMMARY)
    take = pa.array(pick[keep])
    columns = [
        pa.array(anchor[keep], mask=~named),
        pa.array(cls[keep], mask=~named),
        ids.take(take),
        rows["var"].combine_chunks().take(take),
        pa.array(at[pick[keep]]),
        rows["more"].combine_chunks().take(take),
        ids.take(pa.array(pick[first[keep]])),
        pa.array(n[keep].astype(np.int32)),
        pa.array(kind[keep]),
        pa.array(new[keep] & several[keep]),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in VERDICT.split(", ")])


def verdicts(found: DataFrame) -> DataFrame:
    """Of anchors that documents share: (anchor, cls, id, var, at, more, first, n, kind, rep).

    ``first``: smallest document of the class. ``n``: classes of the anchor that may cover each other, if this is one of them, else 0.
    ``rep``: the class's representative. Anchor and class are null where nothing asks for them.
    """
    id_type = found.schema["id"].dataType.elementType.simpleString()

    def judge(batches):
        names = ["anchor", "cls", "id", "var", "at", "more", "kind"]
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in (_listed(b.slice(k, LISTED)) for b in batches for k in range(0, len(b), LISTED)):
            kinds = batch["kind"].to_numpy()
            later = batch.filter(pa.array(kinds == DEFERRED))
            if len(later):
                blank = [pa.nulls(len(later), later["id"].type), pa.nulls(len(later), pa.int32()), later["kind"], pa.array(np.zeros(len(later), bool))]
                yield pa.RecordBatch.from_arrays([*(later[c] for c in names[:-1]), *blank], [c.split()[0] for c in VERDICT.split(", ")])
            held.append(batch.filter(pa.array(kinds != DEFERRED)))
            n += len(held[-1])
            if n >= JUDGED:
                whole = pa.Table.from_batches(held).combine_chunks()
                values = whole["group"].to_numpy()
                cut = int(np.searchsorted(values, values[-1]))  # the last group may go on
                if cut:
                    yield _verdicts(whole.slice(0, cut))
                held, n = whole.slice(cut).to_batches(), len(whole) - cut
                n = 0 if cut else -len(whole)  # a large group: look again after as many rows
        if held and sum(map(len, held)):
            yield _verdicts(pa.Table.from_batches(held).combine_chunks())

    dealt = found.repartition("group").sortWithinPartitions("group")
    return map_arrow(dealt, judge, VERDICT.format(id=id_type))


def passages(rows: DataFrame, requests: DataFrame, s: Scheme) -> DataFrame:
    """(anchor, cls, id, a, passage): the passages that start ``a`` units before each representative.

    Only those passages whose first smallest seed-gram is the representative's anchor: every passage
    belongs to one of its anchors, the same in all texts, so none is listed twice.
    """
    id_type = rows.schema["id"].dataType.simpleString()
    def expand(batches):
        hashes = s.hashes()
        for batch in batches:
            out, ids = [], []
            for k, text, at in wanted_of(batch):
                rolling = Rolling(hashes(text))
                whole = rolling.every(s.length).view(np.int64)
                pos = at["at"] >> 32
                before, after = reach(rolling.every(s.seed), pos, s.context)
                a = np.arange(s.context + 1)
                start = pos[:, None] - a[None, :]
                ok = (start >= 0) & (start < len(whole)) & (a <= before[:, None]) & (s.context - a <= after[:, None])
                who, which = np.nonzero(ok)
                out.append((at["anchor"][who], at["cls"][who], which.astype(np.int32), whole[start[ok]]))
                ids.append(np.full(len(who), k))
            if not out:
                continue
            at = pa.array(np.concatenate(ids))
            anchor, cls, a, passage = (pa.array(np.concatenate(x)) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([anchor, cls, batch["id"].take(at), a, passage], ["anchor", "cls", "id", "a", "passage"])

    return map_arrow(with_requests(rows, requests), expand, f"anchor long, cls long, id {id_type}, a int, passage long")


def with_requests(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, var, text, asked): the rows that representatives come from, with their anchors."""
    asked = F.collect_list(F.struct("anchor", "cls", "at", "n")).alias("asked")
    # By id alone: where ``var`` is the same for all, the join deals by id, and what is dealt already isn't dealt again.
    return rows.join(requests.repartition("id").groupBy("id", "var").agg(asked), ["id", "var"])


def wanted_of(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, dict[str, np.ndarray]]]:
    """(row, text, arrays of the asked anchors); of repeated rows that follow each other, one."""
    asked = batch["asked"]
    fields = {f: asked.values.field(f).to_numpy(zero_copy_only=False) for f in ("anchor", "cls", "at", "n")}
    ends, before = asked.offsets.to_numpy(), None
    for k, (row, var, text) in enumerate(zip(batch["id"].to_pylist(), batch["var"].to_pylist(), texts_of(batch["text"]), strict=True)):
        if (row, var) != before:
            yield k, text, {f: v[ends[k] : ends[k + 1]] for f, v in fields.items()}
        before = row, var


def reach(grams: np.ndarray, pos: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """How many seed-grams before each position are larger, and how many after it are not smaller, up to ``most``."""
    step = np.arange(1, most + 1)
    ends = np.concatenate((grams, np.zeros(1, np.uint64)))  # beyond an end: smaller than any
    own = grams[pos][:, None]
    back, on = pos[:, None] - step, np.minimum(pos[:, None] + step, len(grams))
    stop_before = (back < 0) | (ends[np.maximum(back, 0)] <= own)
    stop_after = (on == len(grams)) | (ends[on] < own)
    first = lambda stop: np.where(stop.any(axis=1), stop.argmax(axis=1), most)
    return first(stop_before), first(stop_after)


def offsets_by_hash(rows: DataFrame, representatives: DataFrame, s: Scheme) -> DataFrame:
    """(anchor, cls, offsets): offsets of the passages that a smaller document has, found by passage hashes."""
    found = materialise(passages(rows, representatives, s), "passages")
    release_shuffles(rows.sparkSession)
    key = ["anchor", "a", "passage"]
    smallest = found.groupBy(key).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    covered = found.join(smallest, key).where(F.col("id") > F.col("first"))
    out = materialise(covered.groupBy("anchor", "cls").agg(F.collect_set("a").alias("offsets")), "offsets")
    discard(found)
    return out


def covered_spans(rows: DataFrame, s: Scheme, offsets: Callable[[DataFrame, DataFrame, Scheme], DataFrame] = offsets_by_hash) -> DataFrame:
    """(id, var, spans): for each document with removals, its covered ranges as start << 32 | end (ends may pass the text's)."""
    spark = rows.sparkSession
    hits = materialise(verdicts(occurrences(rows, s)), "hits")
    release_shuffles(spark)
    partly = offsets(rows, hits.where("rep").select("anchor", "cls", "id", "var", "at", "n"), s)
    release_shuffles(spark)
    # A summed class's occurrences are anywhere; this join may meet hot keys and is one that Spark can split.
    summed = hits.where(F.col("kind") == SUMMARY).select("anchor", "cls", "first", "n").dropDuplicates(["anchor", "cls"])
    later = hits.where(F.col("kind") == DEFERRED).select("anchor", "cls", "id", "var", "at", "more").join(summed, ["anchor", "cls"])
    plain = hits.where(F.col("kind") == PLAIN).select("anchor", "cls", "id", "var", "at", "more", "first", "n")
    every = plain.unionByName(later)
    places = F.concat(F.array("at"), F.coalesce("more", F.array().cast("array<bigint>")))
    pos = lambda x: F.shiftright(x, 32)
    end = lambda x: pos(x) + x.bitwiseAND(0xFFFFFFFF) - 1 + s.length
    pack = lambda lo, hi: F.shiftleft(lo, 32).bitwiseOR(hi)
    whole = F.transform(places, lambda x: pack(F.greatest(pos(x) - s.context, F.lit(0)), end(x)))
    whole = every.where(F.col("id") > F.col("first")).select("id", "var", whole.alias("r"))
    # Only a class's smallest document is looked up, so no key is hot here.
    part = every.where((F.col("id") == F.col("first")) & (F.col("n") > 0)).join(partly, ["anchor", "cls"])
    part = part.select("id", "var", F.flatten(F.transform("offsets", lambda a: F.transform(places, lambda x: pack(pos(x) - a, end(x) - a)))).alias("r"))
    spans = materialise(whole.unionByName(part).groupBy("id", "var").agg(F.flatten(F.collect_list("r")).alias("spans")), "spans")
    release_shuffles(spark)
    discard(hits)
    discard(partly)
    return spans


def mask(n: int, spans: np.ndarray) -> np.ndarray:
    """True for each unit to remove."""
    lo, hi = spans >> 32, np.minimum(spans & 0xFFFFFFFF, n)
    return np.cumsum(np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1))[:n] > 0


def spans_of(column: pa.ListArray) -> list[np.ndarray | None]:
    """The ranges of each row as an array, None where there are none."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] if b > a else None for a, b in zip(ends, ends[1:], strict=False)]
