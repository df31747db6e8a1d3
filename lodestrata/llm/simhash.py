"""SimHash near-duplicates: segment popcounts as an embedding, a grid range-join, exact verification.

Fingerprint: A-Z lower-cased, words, 3-word shingles with repeats (fewer words: the
whole sequence), XXH64 with seed 42; a bit is set if more than half the hashes set
it. No word at all: fingerprint zero, linked like any other.

Links: fingerprints with at most ``radius`` differing bits. A fingerprint is mapped to
the bit counts of its 32 two-bit segments, a point in Z^32. The Manhattan distance of
two points is at most the fingerprints' Hamming distance, so it is a lower bound and a
range query of that radius loses nothing. The axes form eight groups; a distance of 3
touches at most three groups, so two points in range agree on five others: the 56
fives of groups are the grids, and their counts are the cell. Points of one cell whose Manhattan distance is
in range are compared exactly. Two unrelated fingerprints meet in a cell with a probability of about
56 * (3/8)**20, 2e-7. A cell of up to ``SMALL_CELL`` points is compared in one row, a larger one in blocks of bounded
size; a block gives a spanning forest of its links instead of all pairs, which keeps the components the same.

Only distinct fingerprints take part; copies are attached afterwards. Hot cells are
cut into blocks and block pairs are separate tasks, so no task holds a cell.

Defined results: null text counts as empty. A null doc_id never names a component
unless all of its documents have none. Repeated rows are all returned. An empty table
gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.text import checksum, map_arrow, texts_of
from lodestrata.operators.components import connected_components
from lodestrata.session import materialise, ship

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Fingerprints in a block; a task compares two blocks of one cell.
BLOCK = 1024
#: Cells up to this size are compared in one array, all links given.
SMALL_CELL = 32
#: Shingles whose bits are counted at once.
_CHUNK = 1 << 16
#: The 32 axes count the bits of two-bit segments; eight groups of four axes, by their first bits.
GROUPS, GROUP_BITS = tuple(range(0, 64, 8)), 8
_LOW = 0x5555555555555555


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), (ends[len(words) - n :] - 1).tolist()
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        packed = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK], strict=True)])
        total += np.unpackbits(np.frombuffer(packed, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, var (checksum of the text), fp (signed 64-bit)."""
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), checksum(data).alias("var"), data.alias("text"))

    def hashed(batches):
        for batch in batches:
            values = np.array([fingerprint(t) for t in texts_of(batch["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["var"], pa.array(values)], ["id", "var", "fp"])

    return map_arrow(rows, hashed, f"id {rows.schema['id'].dataType.simpleString()}, var int, fp long")


def embedding(fp: Column) -> Column:
    """The counts of the 32 segments in unary, two bits each, so that the Manhattan distance of two is the number of differing bits."""
    up = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(up).bitwiseAND(_LOW).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(_LOW), 1))


def links(points: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Spanning links (src, dst) between distinct fingerprints at most ``radius`` bits apart. ``points`` has fp.

    Exact for radius 0 to 3. Applied to distinct values only.
    """
    if not 0 <= radius <= 3:
        raise ValueError("eight groups of axes are exact up to a radius of 3")
    # A grid's cell: the embedding without the bits of three groups; the grid's number is in the bits of one of them.
    masks = [sum(0xFF << first for first in kept) for kept in combinations(GROUPS, len(GROUPS) - 3)]
    grids = F.array(*(F.struct(F.lit(g).cast("byte").alias("grid"), F.lit(m - (m >> 63 << 64)).alias("mask")) for g, m in enumerate(masks)))
    spread = points.select("fp", embedding(F.col("fp")).alias("e"), F.explode(grids).alias("g"))
    spread = spread.select("g.grid", F.col("e").bitwiseAND(F.col("g.mask")).alias("cell"), "fp")
    sizes = spread.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    # Spark takes the 56 rows of a point for one and would broadcast all shared cells through the driver.
    members = spread.join(sizes.hint("merge"), ["grid", "cell"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # Block pair (i, j), i <= j: a member of block b goes to (b, b..) and (..b, b).
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")),
    )

    def compare(key, pdf):
        import pandas as pd

        values = np.sort(pdf["fp"].to_numpy())
        return pd.DataFrame(spanning_links(values, radius), columns=["src", "dst"])

    ship(points.sparkSession)
    small = F.col("n") <= SMALL_CELL
    lists = members.where(small).groupBy("grid", "cell").agg(F.collect_list(F.struct("fp", embedding(F.col("fp")).alias("e"))).alias("points"))
    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    close = lambda x: F.filter("points", lambda y: (y["fp"] > x["fp"]) & (apart(x["e"], y["e"]) <= radius) & (apart(x["fp"], y["fp"]) <= radius))
    near = F.flatten(F.transform("points", lambda x: F.transform(close(x), lambda y: F.struct(x["fp"].alias("src"), y["fp"].alias("dst")))))
    few = lists.select(F.explode(near).alias("l")).select("l.src", "l.dst")
    work = members.where(~small).select("grid", "cell", "fp", F.explode(pairs).alias("p")).select("grid", "cell", "p.i", "p.j", "fp")
    found = work.groupBy("grid", "cell", "i", "j").applyInPandas(compare, "src long, dst long")
    return few.union(found).distinct()


def spanning_links(values: np.ndarray, radius: int) -> np.ndarray:
    """A spanning forest of the links among sorted distinct values, as pairs: breadth-first, so no pair table is held."""
    unsigned = values.view(np.uint64)
    low = np.uint64(_LOW)
    counts = (unsigned | unsigned >> np.uint64(1)) & low | (unsigned & unsigned >> np.uint64(1) & low) << np.uint64(1)
    open_ = np.ones(len(values), bool)
    out = []
    for root in range(len(values)):
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(open_)
            rest = rest[np.bitwise_count(counts[rest] ^ counts[at]) <= radius]  # the lower bound
            near = rest[np.bitwise_count(unsigned[rest] ^ unsigned[at]) <= radius]
            open_[near] = False
            queue.extend(near.tolist())
            out.extend((values[at], values[k]) for k in near)
    return np.array(out, np.int64).reshape(-1, 2)


def _members(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """Columns id, var, fp, component (its smallest fingerprint), component_id (its smallest id)."""
    found = materialise(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    points = materialise(found.groupBy("fp").agg(F.min("id").alias("first")), "points")
    nodes = connected_components(links(points, radius))
    named = points.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    table = materialise(named.select("fp", "component").join(smallest, "component"), "members")
    return found.join(table, "fp")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Columns id, fingerprint (16 hex digits), component_id (smallest id of the component): one row for each document."""
    found = _members(docs, id_col, text_col, radius)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each component: the smallest id (null last), of equal ids one text, of equal rows one."""
    return first_of_each(docs, _members(docs, id_col, text_col, radius), id_col=id_col, text_col=text_col)


def first_of_each(docs: DataFrame, found: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """The first row of ``docs`` for each component of ``found`` (id, var, component)."""
    order = F.struct(F.col("id").isNull().alias("null"), "id", "var")
    first = found.groupBy("component").agg(F.min(order).alias("f")).select(F.col("f.id").alias("first_id"), F.col("f.var").alias("first_var"))
    var = checksum(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), var.alias("var"))  # no name of the table's can clash
    kept = rows.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("var") == F.col("first_var")), "left_semi")
    return kept.dropDuplicates(["id", "var"]).select("row.*")
