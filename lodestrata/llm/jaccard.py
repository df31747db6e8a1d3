"""Near-duplicates by the Jaccard similarity of five-word shingles, exact: prefix filter, then verification.

Words as in ``text``; the set of a text holds 64-bit hashes of its 5-word shingles (fewer
words: the whole sequence; none: the empty set). Two documents are linked if their sets are equal
or have at least ``NUMERATOR / DENOMINATOR`` of their union in common; components of links are groups.

All sets are put in one order. Of a set of s, the first s - ceil(0.8 s) + 1 hashes are its
prefix; two sets in range share a hash of their prefixes, so nothing is lost. The order
puts hashes that a sample finds often last, so lists of sets by hash stay short; any order is exact.

A candidate pair's sets are fetched only if their prefixes share enough hashes (beyond the prefixes at most the rest of one set is
common) and their sketches allow it: bit k is the parity of the set's hashes
that fall on k, so the bits that differ are at most the hashes that are in one set alone.

Prefix hashes are shuffled once, by hash, and sorted; a hash that only one set has goes there. A hash that many sets of one task
have is known to be shared: its rows go to any task, so a hot hash doesn't go to one.

The stage's first step is SimHash: the fingerprint of a set has a bit where more than half its hashes have it, and fingerprints
that the grids of ``simhash`` find within its radius give pairs that are verified like all others.
A large group of near copies shares its whole prefixes. So each set is first compared with a few
centres too: the set of a list with the largest share of its prefix in lists, as an original has it and not its copies, those centres first that most of
the set's lists have. That joins such a group; then a list is compared in full
across components only, members outside its largest component with all others.

Defined results: as in ``simhash``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.simhash import first_of_each, links
from lodestrata.llm.text import checksum, map_arrow, texts_of
from lodestrata.operators.components import connected_components
from lodestrata.llm.repeats import _starts
from lodestrata.session import discard, materialise, release_shuffles

SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5
#: The order's sample: one text of so many, a hash in so many of them counts as frequent, so many frequent ones at most.
SAMPLE, FREQUENT, MOST = 8, 16, 200_000
#: Centres that a set is compared with at first, and the most keys that are broadcast to leave sets out early.
CENTRES, KEYS = 12, 1_000_000
#: Prefix hashes that are combined at once before the shuffle, and from how many sets on a hash is spread.
CHUNK, HEAVY = 1 << 20, 16
#: Prefix hashes of a set that travel as a list with each of its rows.
LISTED = 64
#: Bits of a sketch at least; a larger set has the next power of two.
BITS = 1024
_CHUNK = 1 << 21
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Shingles:
    """Sorted distinct hashes of a text's shingles; hashes of words are kept, up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if len(words) < SHINGLE:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)] if words else [], np.uint64).view(np.int64)
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, 2)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(h) - SHINGLE + 1
        out = sum(h[i : i + n] * _ODD[i] for i in range(SHINGLE))
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
        return np.unique(out.view(np.int64))


def prefix_of(values: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set's first hashes in the common order: by hash, then the frequent ones (sorted, with ranks) by rank."""
    s = len(values)
    if not s:
        return values
    place = np.zeros(s, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        place = np.where(frequent[at] == values, rank[at] + 1, 0)
    return values[np.argsort(place, kind="stable")][: s + NUMERATOR * s // -DENOMINATOR + 1]


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, rank of each by rising count) of a sample's frequent hashes."""

    def count(batches):
        shingles, held, n = Shingles(), [], 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values[counts > 1]), pa.array(counts[counts > 1].astype(np.int64))], ["h", "n"])

        for batch in batches:
            for text in texts_of(batch["text"]):
                if xxhash.xxh64_intdigest(text) % SAMPLE == 0:
                    held.append(shingles(text))
                    n += len(held[-1])
                    if n > _CHUNK:
                        yield flush()
                        held, n = [], 0
        if held:
            yield flush()

    found = map_arrow(texts, count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(f"n >= {FREQUENT}").orderBy(F.desc("n"), "h").limit(MOST).toPandas()
    found = found.sort_values(["n", "h"]).reset_index(drop=True)
    order = np.argsort(found["h"].to_numpy(np.int64))
    return found["h"].to_numpy(np.int64)[order], order.astype(np.int64)


def _key(values: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes())).view(np.int64))


def _sketch(values: np.ndarray) -> np.ndarray:
    bits = max(BITS, 1 << (len(values) - 1).bit_length())
    return np.packbits((np.bincount(values & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _fingerprint(values: np.ndarray) -> int:
    """SimHash of a set of hashes; that of the empty set is zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), _CHUNK >> 6):
        ones += np.unpackbits(values[at : at + (_CHUNK >> 6)].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values)).view(">i8")[0])


def _folded(column: str, other: str) -> Column:
    """The sketch in half its bits where the other has half as many (sizes in range differ by one step at most)."""
    half = (F.size(column) / 2).cast("int")
    folded = F.zip_with(F.slice(column, 1, half), F.slice(column, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(column) > F.size(other), folded).otherwise(F.col(column))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).alias("id"), checksum(data).alias("var"), data.alias("text"))


def signed(rows: DataFrame) -> DataFrame:
    """Columns id, var (checksum of the text), key (of the set), size, and, where a task first meets the key, fp, sketch and prefix."""
    shared = rows.sparkSession.sparkContext.broadcast(_frequent(rows.select("text")))
    longs = pa.list_(pa.int64())

    def sign(batches):
        shingles, order, met = Shingles(), shared.value, set()
        for batch in batches:
            keys, sizes, fps, sketches, prefixes = [], [], [], [], []
            for text in texts_of(batch["text"]):
                values = shingles(text)
                key = _key(values)
                new = key not in met
                met.add(key)
                keys.append(key)
                sizes.append(len(values))
                fps.append(_fingerprint(values) if new else None)
                sketches.append(_sketch(values) if new else None)
                prefixes.append(prefix_of(values, *order) if new else None)
            columns = [batch["id"], batch["var"], pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(sketches, longs), pa.array(prefixes, longs)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "var", "key", "size", "fp", "sketch", "prefix"])

    return map_arrow(rows, sign, f"id {rows.schema['id'].dataType.simpleString()}, var int, key long, size long, fp long, sketch array<long>, prefix array<long>")


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, values) of the wanted keys (key, var of one of its texts)."""
    some = [r["var"] for r in wanted.select("var").distinct().limit(KEYS + 1).toLocalIterator()]
    early = rows.sparkSession.sparkContext.broadcast(frozenset(some) if len(some) <= KEYS else None)

    def give(batches):
        shingles, given, wanted_vars = Shingles(), set(), early.value
        for batch in batches:
            out = []
            for var, text in zip(batch["var"].to_pylist(), batch["text"], strict=True):
                if wanted_vars is None or var in wanted_vars:
                    values = shingles(text.as_py())
                    key = _key(values)
                    if key not in given:
                        given.add(key)
                        out.append((key, values))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([v for _, v in out], pa.list_(pa.int64()))], ["key", "values"])

    found = map_arrow(rows.select("var", "text"), give, "key long, values array<long>")
    return found.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (src, dst) in range."""
    a, b = (nodes.select(F.col("key").alias(k), F.col("size").alias(f"{k}_n"), F.col("sketch").alias(f"{k}_s")) for k in ("src", "dst"))
    total = F.col("src_n") + F.col("dst_n")
    least = F.ceil(total * NUMERATOR / (NUMERATOR + DENOMINATOR) - 1e-6)
    differ = F.aggregate(F.zip_with(_folded("src_s", "dst_s"), _folded("dst_s", "src_s"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    alike = F.when(NUMERATOR * F.greatest("src_n", "dst_n") <= DENOMINATOR * F.least("src_n", "dst_n"), differ <= total - 2 * least)
    left = materialise(pairs.join(a, "src").join(b, "dst").where(alike).select("src", "dst"), "pairs")
    keys = left.select(F.col("src").alias("key")).union(left.select("dst")).distinct()
    wanted = materialise(nodes.select("key", "var").join(keys, "key"), "wanted")
    sets = materialise(_sets(rows, wanted), "sets")
    release_shuffles(rows.sparkSession)
    a, b = sets.select(F.col("key").alias("src"), F.col("values").alias("x")), sets.select(F.col("key").alias("dst"), F.col("values").alias("y"))
    common = F.size(F.array_intersect("x", "y")) * (NUMERATOR + DENOMINATOR)
    out = materialise(left.join(a, "src").join(b, "dst").where(common >= NUMERATOR * (F.size("x") + F.size("y"))).select("src", "dst"), "links")
    for table in (sets, left, wanted):
        discard(table)
    return out


def shared_hashes(found: DataFrame) -> DataFrame:
    """(h, key): the prefix hashes that several sets have; a row may be there twice if several tasks listed the set.

    ``found``: key, prefix (null where the task has listed the set before).
    """

    def spread(batches):
        keys, prefixes, held = [], [], 0

        def flush():
            sizes = np.array([len(x) for x in prefixes])
            h, key = np.concatenate(prefixes), np.repeat(np.array(keys, np.int64), sizes)
            order = np.argsort(h, kind="stable")
            h, key = h[order], key[order]
            starts = np.flatnonzero(_starts(h)) if len(h) else h
            size = np.diff(np.append(starts, len(h)))
            many = size >= HEAVY
            # Of a hash that is spread one row goes where its other rows do, so that they are seen to be shared.
            to = np.concatenate((np.where(np.repeat(many, size), key ^ h, h), h[starts[many]]))
            kind = np.concatenate((np.repeat(many, size), np.zeros(int(many.sum()), bool)))
            also = np.concatenate((np.zeros(len(h), bool), np.ones(int(many.sum()), bool)))
            pick = np.concatenate((np.arange(len(h)), starts[many]))
            arrays = [pa.array(to), pa.array(h[pick]), pa.array(key[pick]), pa.array(kind), pa.array(also)]
            return pa.RecordBatch.from_arrays(arrays, ["to", "h", "key", "spread", "also"])

        for batch in batches:
            for key, prefix in zip(batch["key"].to_pylist(), batch["prefix"], strict=True):
                if prefix.is_valid:
                    keys.append(key)
                    prefixes.append(prefix.values.to_numpy())
                    held += len(prefixes[-1])
            if held >= CHUNK:
                yield flush()
                keys, prefixes, held = [], [], 0
        if held:
            yield flush()

    def keep(batches):
        held: list[pa.RecordBatch] = []
        n = 0

        def several(rows: pa.Table):
            h, key = rows["h"].to_numpy(), rows["key"].to_numpy()
            new = _starts(h)
            heads = np.flatnonzero(new)
            many = np.minimum.reduceat(key, heads) < np.maximum.reduceat(key, heads)
            many |= np.logical_or.reduceat(rows["also"].combine_chunks().to_numpy(zero_copy_only=False), heads)
            ok = np.repeat(many, np.diff(np.append(heads, len(h)))) & _starts(h, key) & ~rows["also"].combine_chunks().to_numpy(zero_copy_only=False)
            return pa.RecordBatch.from_arrays([pa.array(h[ok]), pa.array(key[ok])], ["h", "key"])

        for batch in batches:
            known = batch["spread"]
            yield pa.RecordBatch.from_arrays([batch["h"].filter(known), batch["key"].filter(known)], ["h", "key"])
            held.append(batch.filter(pc.invert(known)).select(["h", "key", "also"]))
            n += len(held[-1])
            if n >= CHUNK:
                whole = pa.Table.from_batches(held).combine_chunks()
                values = whole["h"].to_numpy()
                cut = int(np.searchsorted(values, values[-1]))  # the last hash may go on
                if cut:
                    yield several(whole.slice(0, cut))
                held, n = whole.slice(cut).to_batches(), 0 if cut else -len(whole)
        if sum(map(len, held)):
            yield several(pa.Table.from_batches(held).combine_chunks())

    posts = map_arrow(found.select("key", "prefix"), spread, "to long, h long, key long, spread boolean, also boolean")
    dealt = posts.repartition("to").drop("to").sortWithinPartitions("h", "key", "also")
    return map_arrow(dealt, keep, "h long, key long")


def _pairs(a: str, b: str) -> list:
    return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(src, dst): candidates by fingerprint; sets of one fingerprint with their smallest key, and the smallest keys of fingerprints in range."""
    firsts = materialise(nodes.groupBy("fp").agg(F.min("key").alias("k")), "points")
    same = nodes.select("fp", "key").join(firsts, "fp").where("key != k").select(*_pairs("key", "k"))
    a, b = firsts.select(F.col("fp").alias("src"), F.col("k").alias("a")), firsts.select(F.col("fp").alias("dst"), F.col("k").alias("b"))
    out = materialise(same.union(links(firsts).join(a, "src").join(b, "dst").select(*_pairs("a", "b"))), "fingerprint-pairs")
    discard(firsts)
    return out


def centre_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): each set with up to ``CENTRES`` centres of its lists."""
    prefix = F.col("size") + F.floor(-F.col("size") * NUMERATOR / DENOMINATOR) + 1
    share = members.groupBy("key").agg(F.countDistinct("h").alias("n")).join(nodes.select("key", prefix.alias("p")), "key").select("key", (F.col("n") / F.col("p")).alias("share"))
    shared = members.join(share, "key")
    middle = shared.groupBy("h").agg(F.max(F.struct("share", F.xxhash64("key").alias("x"), F.col("key").alias("k"))).alias("m")).select("h", F.col("m.k").alias("centre"))
    near = members.join(middle, "h").where("key != centre").groupBy("key", "centre").agg(F.count("*").alias("n"))
    few = near.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "centre"))), 1, CENTRES).alias("c"))
    return few.select("key", F.explode("c.centre").alias("c")).select(*_pairs("key", "c"))


def pairs_across(mixed: DataFrame) -> DataFrame:
    """(src, dst): pairs of different components that share enough prefix hashes. ``mixed``: h, key, size, g, main (largest component of h).

    A pair of sets with at most ``LISTED`` hashes here is judged where it first meets, by the sets' lists of hashes; others are counted up hash by hash.
    """
    lists = mixed.groupBy("key").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("h")).alias("hs")).select("key", F.when(F.col("n") <= LISTED, F.col("hs")).alias("hs"))
    every = materialise(mixed.join(lists, "key"), "listed")
    few = every.where("g != main").select("h", F.col("key").alias("a"), F.col("g").alias("ag"), F.col("size").alias("an"), F.col("hs").alias("ah"))
    both = few.join(every, "h").where((F.col("ag") != F.col("g")) & (NUMERATOR * F.greatest("an", "size") <= DENOMINATOR * F.least("an", "size")))
    # Each pair once for a hash; of its common hashes at most the rest of the set whose prefix ends first lie beyond the prefixes.
    both = both.where((F.col("g") == F.col("main")) | (F.col("a") < F.col("key")))
    rest = lambda n: F.ceil(F.col(n) * NUMERATOR / DENOMINATOR - 1e-6) - 1
    needed = F.ceil((F.col("an") + F.col("size")) * NUMERATOR / (NUMERATOR + DENOMINATOR) - 1e-6) - F.greatest(rest("an"), rest("size"))
    common, listed = F.array_intersect("ah", "hs"), F.col("ah").isNotNull() & F.col("hs").isNotNull()
    at_first = F.when(listed, (F.size(common) >= needed) & (F.array_min(common) == F.col("h"))).otherwise(True)
    met = both.where(at_first).select(*_pairs("a", "key"), F.when(listed, F.size(common)).otherwise(1).alias("n"), needed.alias("needed"))
    out = materialise(met.groupBy("src", "dst").agg((F.sum("n") >= F.first("needed")).alias("enough")).where("enough").select("src", "dst"), "candidates")
    discard(every)
    return out


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, var, component (its smallest key): one row for each document."""
    rows = _texts(docs, id_col, text_col)
    found = materialise(signed(rows), "signed")
    nodes = materialise(found.where("sketch IS NOT NULL").select("key", "var", "size", "fp", "sketch").dropDuplicates(["key"]), "nodes")
    release_shuffles(docs.sparkSession)
    members = materialise(shared_hashes(found), "members")
    release_shuffles(docs.sparkSession)
    alike = simhash_pairs(nodes)
    release_shuffles(docs.sparkSession)
    first = _verified(alike.union(centre_pairs(members, nodes)).distinct(), nodes, rows)
    discard(alike)

    release_shuffles(docs.sparkSession)
    groups = materialise(connected_components(first), "groups")
    placed = nodes.select("key", "size").join(groups.select(F.col("node").alias("key"), "component"), "key", "left").select("key", "size", F.coalesce("component", "key").alias("g"))
    named = materialise(members.join(placed, "key"), "named")
    shares = named.groupBy("h", "g").agg(F.count("*").alias("n"))
    largest = shares.groupBy("h").agg(F.max(F.struct("n", "g")).alias("m"), F.count("*").alias("k")).where("k > 1").select("h", F.col("m.g").alias("main"))
    mixed = materialise(named.join(largest, "h"), "mixed")
    pairs = pairs_across(mixed)
    release_shuffles(docs.sparkSession)
    second = _verified(pairs, nodes, rows)

    for table in (members, named, mixed, pairs):
        discard(table)
    release_shuffles(docs.sparkSession)
    ends = connected_components(first.union(second)).select(F.col("node").alias("key"), "component")
    out = materialise(found.select("id", "var", "key").join(ends, "key", "left").select("id", "var", F.coalesce("component", "key").alias("component")), "found")
    for table in (found, nodes, first, groups, second):
        discard(table)
    release_shuffles(docs.sparkSession)
    return out


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: the smallest id (null last), of equal ids one text, of equal rows one."""
    return first_of_each(docs, components(docs, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col)
