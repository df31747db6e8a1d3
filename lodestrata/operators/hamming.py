"""Near pairs of bit strings whose tags all differ, compared in blocks of numpy.

Of ``radius + 1`` bands a pair in range agrees on one. Each distinct row goes once to the cell of each of its bands, with what a pair is
measured by, so pairs leave the task where they meet and are never shuffled. In a cell rows are sorted by their number of set bits: a pair in range differs
in it by the radius at most. A cell of more than ``BLOCK`` rows is dealt to pairs of blocks, so no task gets it whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.signatures import CELLS
from lodestrata.session import materialise, ship

#: Rows of a cell that are compared in one go, rows held by a task before it compares, pairs looked at together, pairs measured together.
BLOCK, HELD, PAIRS, MEASURED = 1 << 14, 1 << 15, 1 << 20, 1 << 12
_WIDEST = 56  # bits of a band: a cell is one long, the band's number above its value


def spans_of(bits: int, radius: int) -> list[tuple[int, int]]:
    """The bands, as first bit and the one after the last."""
    n = max(radius + 1, math.ceil(bits / _WIDEST))
    bounds = [bits * k // n for k in range(n + 1)]
    return list(zip(bounds, bounds[1:], strict=False))


def _value(lo: int, hi: int) -> Column:
    """Bits lo to hi of the limbs, the first limb's highest bit being bit 0."""
    low = (hi - 1) % 64 + 1  # bits that the last limb gives
    last = F.shiftrightunsigned(F.col(f"l{(hi - 1) // 64}"), 64 - low)
    if lo // 64 != (hi - 1) // 64:
        last = F.shiftleft(F.col(f"l{lo // 64}"), low).bitwiseOR(last)
    return last.bitwiseAND(F.lit((1 << hi - lo) - 1))


def _masks(spans: list[tuple[int, int]], n_limbs: int) -> np.ndarray:
    """(band, limb): the bits of a band."""
    out = np.zeros((len(spans), n_limbs), np.uint64)
    for k, (lo, hi) in enumerate(spans):
        for p in range(lo, hi):
            out[k, p // 64] |= np.uint64(1 << 63 - p % 64)
    return out


def close_pairs(limbs: list[np.ndarray], part: np.ndarray, radius: int, pick: np.ndarray | None = None):
    """Batches (left, right, distance) of the pairs within a part at most ``radius`` bits apart, each pair once.

    ``pick``: only pairs with such a row on a side.
    """
    weight = sum(np.bitwise_count(x).astype(np.int64) for x in limbs)
    order = np.lexsort((weight, part))
    limbs, key = [x[order] for x in limbs], part[order] * (64 * len(limbs) + radius + 1) + weight[order]
    last = np.searchsorted(key, key + radius, "right")
    rows, own = np.arange(len(key)), None
    if pick is None:
        first = rows + 1
    else:  # a picked row looks both ways, and of two picked ones the earlier one finds the other
        own = pick[order]
        rows = np.flatnonzero(own)
        # A part's first row: weights can't reach below it.
        heads = np.searchsorted(part[order], part[order][rows])
        first, last = np.maximum(np.searchsorted(key, key[rows] - radius), heads), last[rows]
    count = np.maximum(last - first, 0)

    def near(left, right):
        apart = np.zeros(len(right), np.uint16)
        for x in limbs:
            apart = apart + np.bitwise_count((x[left] if np.ndim(left) == 0 else x[left]) ^ x[right])
            ok = np.flatnonzero(apart <= radius)
            if len(ok) < len(right):
                right, apart = right[ok], apart[ok]
                left = left if np.ndim(left) == 0 else left[ok]
        left = np.broadcast_to(left, right.shape)
        if own is not None:
            ok = np.flatnonzero((left != right) & ~(own[right] & (right < left)))
            left, right, apart = left[ok], right[ok], apart[ok]
        return order[left], order[right], apart.astype(np.int32)

    wide = count > 512
    held, n = [], 0
    for i in np.flatnonzero(wide).tolist():
        held.append(near(rows[i], np.arange(first[i], last[i])))
        n += len(held[-1][0])
        if n >= PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
    few = np.flatnonzero(~wide & (count > 0))
    ends = np.cumsum(count[few])
    at = 0
    while at < len(few):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        some = few[at:stop]
        c = count[some]
        left = np.repeat(rows[some], c)
        right = np.arange(int(c.sum())) + np.repeat(first[some] - (np.cumsum(c) - c), c)
        yield near(left, right)
        at = stop


def correlations(fine: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlations of rows of counts, at 64 sums of four and as they are: those of ``scalar.pearson_of``, in the same integers."""
    used, at = np.unique(np.concatenate((left, right)), return_inverse=True)
    counts = fine[used].astype(np.int64)
    out = []
    for values in (counts.reshape(len(used), -1, 4).sum(axis=2), counts):
        n, total = values.shape[1], values.sum(axis=1)
        spread = ((values * values).sum(axis=1) * n - total * total).astype(np.float64)
        found = np.empty(len(left))
        for k in range(0, len(left), MEASURED):
            a, b = at[k : min(k + MEASURED, len(left))], at[len(left) + k : len(left) + min(k + MEASURED, len(left))]
            dot = np.einsum("ij,ij->i", values[a], values[b])
            root = np.sqrt(spread[a] * spread[b])
            flat = root == 0
            part = (dot * n - total[a] * total[b]) / np.where(flat, 1.0, root)
            if flat.any():
                part[flat] = (values[a[flat]] == values[b[flat]]).all(axis=1)
            found[k : k + MEASURED] = part
        out.append(found)
    return out[0], out[1]


def _fine(table: pa.Table) -> np.ndarray:
    """The counts of each row: narrow where all fit a byte, else from the wide column."""
    wide = table["wide"].combine_chunks()
    some = np.flatnonzero(wide.is_valid().to_numpy(zero_copy_only=False))
    out = np.zeros((len(table), CELLS - 1), np.int32 if len(some) else np.int8)
    narrow = table["narrow"].combine_chunks()
    out[narrow.is_valid().to_numpy(zero_copy_only=False)] = narrow.flatten().to_numpy().reshape(-1, CELLS - 1)
    if len(some):
        out[some] = wide.flatten().to_numpy().reshape(-1, CELLS - 1)
    return out


def near_pairs(rows: DataFrame, node: str, limbs: str, n_limbs: int, radius: int, differ: tuple[str, ...], fine: str | None = None) -> DataFrame:
    """(a, b, distance) of all pairs a < b at most ``radius`` bits apart that differ in every column of ``differ`` (two nulls are equal).

    With ``fine``, a column of ``CELLS - 1`` counts that hash and ``differ`` determine: also ``corr`` and ``full_corr``. Copies (equal
    hash and ``differ``) are compared once and attached afterwards; they are no pairs among themselves. Nulls and an empty table give no pairs.
    """
    if not differ:
        raise ValueError("pairs have to differ in something")
    spark = rows.sparkSession
    ship(spark)
    spans = spans_of(64 * n_limbs, radius)
    masks, names, tags = _masks(spans, n_limbs), [f"l{k}" for k in range(n_limbs)], [f"k_{c}" for c in differ]
    carried = {}
    if fine is not None:
        small = F.array_max(fine) <= 127
        carried = {"narrow": F.when(small, F.col(fine).cast("array<tinyint>")), "wide": F.when(~small, F.col(fine).cast("array<int>"))}
    limb = [F.get(limbs, F.lit(k)).alias(x) for k, x in enumerate(names)]
    sound = rows.where(F.col(limbs).isNotNull()).select(F.col(node).alias("n"), *limb, *(F.col(c).alias(t) for c, t in zip(differ, tags, strict=True)), *(c.alias(x) for x, c in carried.items()))
    distinct = sound.groupBy(*names, *tags).agg(F.min("n").alias("e"), F.count("*").alias("copies"), *(F.first(x).alias(x) for x in carried))
    distinct = materialise(distinct, "distinct-hashes")
    cells = F.explode(F.array(*(_value(lo, hi).bitwiseOR(F.lit(k << _WIDEST)) for k, (lo, hi) in enumerate(spans)))).alias("cell")
    large = distinct.select(*names).select(cells).groupBy("cell").count().where(F.col("count") > BLOCK)
    blocks = F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int")
    sized = distinct.select("*", cells).join(F.broadcast(large), "cell", "left").withColumn("blocks", blocks)  # at most rows * bands / BLOCK cells
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("e"), F.col("blocks")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    work = dealt.select("cell", "block", F.explode(both).alias("p"), "e", "copies", *names, *tags, *carried)
    work = work.select("cell", "p.i", "p.j", "block", "e", F.col("copies").cast("long"), *names, *tags, *carried).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    kind, measured = rows.schema[node].dataType.simpleString(), fine is not None
    schema = f"xe {kind}, ye {kind}, distance int" + (", corr double, full_corr double" if measured else "")
    bands = len(spans)

    def compare(several: bool):
        def settle(table: pa.Table):
            copies = table["copies"].to_numpy()
            if not several:
                table = table.filter(pa.array(copies == 1))
            elif not (copies > 1).any():
                return
            if len(table) < 2:
                return
            table = table.combine_chunks()
            pick = table["copies"].to_numpy() > 1 if several else None
            cell, i, j, block = (table[c].to_numpy() for c in ("cell", "i", "j", "block"))
            new = np.ones(len(cell), bool)
            new[1:] = (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            words = [table[x].to_numpy().view(np.uint64) for x in names]
            codes = [table[t].combine_chunks().dictionary_encode("encode").indices.to_numpy() for t in tags]
            counts = None
            for left, right, apart in close_pairs(words, np.cumsum(new), radius, pick):
                ok = (i[left] == j[left]) | (block[left] != block[right])
                for c in codes:
                    ok &= c[left] != c[right]
                left, right, apart = left[ok], right[ok], apart[ok]
                other = [w[left] ^ w[right] for w in words]
                ok, band = np.ones(len(left), bool), cell[left] >> _WIDEST
                for k in range(bands - 1):  # a pair belongs to the first band where it meets
                    same = band > k
                    for x, m in zip(other, masks[k], strict=True):
                        if m:
                            same &= x & m == 0
                    ok &= ~same
                left, right, apart = left[ok], right[ok], apart[ok]
                if len(left):
                    ends = [table["e"].combine_chunks().take(pa.array(x)) for x in (left, right)]
                    more = []
                    if measured:
                        counts = _fine(table) if counts is None else counts
                        more = [pa.array(x) for x in correlations(counts, left, right)]
                    whole = pa.RecordBatch.from_arrays([*ends, pa.array(apart), *more], [c.split()[0] for c in schema.split(", ")])
                    yield from (whole.slice(at, 1 << 16) for at in range(0, len(whole), 1 << 16))

        def run(batches):
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += len(batch)
                if n >= HELD:
                    whole = pa.Table.from_batches(held)
                    cell, i, j = (whole[c].to_numpy() for c in ("cell", "i", "j"))
                    cut = int(np.flatnonzero((cell == cell[-1]) & (i == i[-1]) & (j == j[-1]))[0])  # the last part may go on
                    if cut:
                        yield from settle(whole.slice(0, cut))
                    held = whole.slice(cut).to_batches()
                    n = (len(whole) - cut) if cut else 0  # a large part: look again after as many rows
            if held:
                yield from settle(pa.Table.from_batches(held))

        return work.mapInArrow(run, schema)

    more = ["corr", "full_corr"] if measured else []
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "distance", *more)
    copied = compare(several=True)
    repeated = distinct.where("copies > 1").select("e", *(F.col(c).alias(f"{c}_") for c in (*names, *tags)))
    members = sound.join(repeated, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*names, *tags)]).select("e", "n")
    for end in "xy":
        found = members.select(F.col("e").alias(f"{end}e"), F.col("n").alias(f"{end}n"))
        copied = copied.join(found, f"{end}e", "left").withColumn(f"{end}n", F.coalesce(f"{end}n", f"{end}e"))
    return compare(several=False).select(*ordered("xe", "ye")).unionByName(copied.select(*ordered("xn", "yn")))
