"""Forests, bridges and Hamming pairs against plain versions: union-find, removal of each edge, all pairs."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import forest, pairs, signatures
from lodestrata.operators.order import ranked


def taken_in_order(edges):
    """What union-find keeps of (a, b, place) by (place, a, b)."""
    above = {}

    def find(x):
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    kept = set()
    for place, a, b in sorted((p, a, b) for a, b, p in edges):
        if a != b and find(a) != find(b):
            above[find(a)] = find(b)
            kept.add((a, b, place))
    return kept, {find(x) for x in above}


def test_forest_of_random_edges_equals_union_find(spark):
    draw = random.Random(0)
    edges = [(draw.randrange(6000), draw.randrange(6000), draw.randrange(3)) for _ in range(10_000)]
    edges += [(0, k, 1) for k in range(6000, 7000)] + edges[:50]  # a hub and repeated edges
    frame = spark.createDataFrame([*edges, (None, 1, 0), (5, None, 0)], "a long, b long, place int").repartition(6).withColumn("kind", F.lit("x"))
    found, roots = forest.spanning_forest(frame, "place")
    kept, tops = taken_in_order(edges)
    rows = found.collect()
    assert len(rows) == len(kept) and {(r["a"], r["b"], r["place"]) for r in rows} == kept
    assert roots.count() == len(tops - {x for x in tops if all(x not in e[:2] or e[0] == e[1] for e in edges)})


@pytest.mark.parametrize("shuffled", [False, True])
def test_a_long_path_takes_logarithmic_rounds(spark, monkeypatch, shuffled):
    n, rounds = 100_000, []
    written = forest.materialise
    monkeypatch.setattr(forest, "materialise", lambda df, name: (rounds.append(name), written(df, name))[1])
    weight = F.xxhash64("id") if shuffled else F.col("id")
    path = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), weight.alias("place"))
    found, roots = forest.spanning_forest(path, "place")
    assert found.count() == n - 1 and roots.count() == 1
    assert Counter(rounds)["first"] <= 17 and Counter(rounds)["tops"] <= 60
    if shuffled:
        return
    sized = forest.bridges(path)
    assert Counter(rounds)["lists"] <= 20
    assert sized.agg(F.count("*"), F.sum("size_a"), F.min(F.col("size_a") + F.col("size_b")), F.max(F.abs(F.col("size_a") - F.col("a") - 1))).first()[:] == (n - 1, n * (n - 1) // 2, n, 0)


def by_removal(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)

    def side(start, gone):
        seen, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for y in near[x]:
                if {x, y} != gone and y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    out = set()
    for a, b in {(min(e), max(e)) for e in edges if e[0] != e[1]}:
        left = side(a, {a, b})
        if b not in left:
            out.add((a, b, len(left), len(side(b, {a, b}))))
    return out


def test_bridges_equal_removal(spark):
    draw = random.Random(3)
    edges = [(100 + k, 100 + k // 2) for k in range(1, 40)] + [(200, 200 + k) for k in range(1, 30)] + [(201, 202), (500, 501)]
    for start, nodes, count in ((1000, 60, 45), (2000, 60, 70), (3000, 40, 120)):
        edges += [(start + draw.randrange(nodes), start + draw.randrange(nodes)) for _ in range(count)]
    frame = spark.createDataFrame([*edges, *[(b, a) for a, b in edges[:9]], (7, 7), (None, 3)], "a long, b long").repartition(3)
    assert {tuple(r) for r in frame.transform(forest.bridges).collect()} == by_removal(edges)


def test_bridges_of_text_nodes_and_of_none(spark):
    frame = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x"), ("z", "w")], "a string, b string")
    assert {tuple(r) for r in forest.bridges(frame).collect()} == {("w", "z", 1, 3)}
    empty = spark.createDataFrame([], "a long, b long")
    assert forest.bridges(empty).collect() == []
    assert [d.count() for d in forest.spanning_forest(empty)] == [0, 0]


def test_double_stars_keep_a_blocks_bridges(spark):
    draw = random.Random(5)
    rows = [(k, f"b{draw.randrange(14)}", f"c{draw.randrange(25)}") for k in range(40)] + [(99, None, None)]
    frame = spark.createDataFrame(rows, "id long, x string, y string")
    every = [(i, j) for i, bi, ci in rows for j, bj, cj in rows if i < j and (bi == bj or ci == cj)]
    stars = pairs.double_star_edges(frame, "x", "id").union(pairs.double_star_edges(frame, "y", "id"))
    assert {tuple(r) for r in forest.bridges(stars).collect()} == by_removal(every)


def test_ranks_by_two_columns_and_of_an_empty_table(spark):
    frame = spark.createDataFrame([(k % 7, f"v{k:03d}", k) for k in range(200)], "a int, b string, part int").repartition(5)
    found = sorted((r["rank"], r["a"], r["b"]) for r in ranked(frame, "a", "b").collect())
    assert found == [(k, a, b) for k, (a, b) in enumerate(sorted((k % 7, f"v{k:03d}") for k in range(200)), 1)]
    assert ranked(frame.where("a < 0"), "a").collect() == []


@pytest.mark.parametrize(("count", "radius", "bands"), [(4, 14, None), (4, 14, 8), (1, 5, 2), (4, 0, None)])
def test_hamming_pairs_by_any_number_of_bands(spark, count, radius, bands):
    draw = random.Random(radius)
    base = [draw.getrandbits(64 * count) for _ in range(25)]
    flip = lambda v, n: v ^ sum(1 << k for k in draw.sample(range(64 * count), n))
    values = base + [flip(v, draw.randrange(0, 20)) for v in base] + [flip(base[0], n) for n in range(1, 16)]
    limbs = lambda v: [((v >> 64 * k) & (2**64 - 1)) - (2**64 if v >> 64 * k + 63 & 1 else 0) for k in range(count)]
    rows = [(k, limbs(v), f"s{k % 3}") for k, v in enumerate(values)] + [(900, None, "s0")]
    frame = spark.createDataFrame(rows, "id long, h array<long>, split string")
    want = {(i, j, d) for i in range(len(values)) for j in range(i + 1, len(values)) if (d := (values[i] ^ values[j]).bit_count()) <= radius}
    assert {tuple(r) for r in pairs.hamming_pairs(frame, "id", "h", count, radius, bands).collect()} == want
    across = pairs.hamming_pairs(frame, "id", "h", count, radius, bands, keep=("split",), where="split_a <> split_b")
    assert {tuple(r) for r in across.collect()} == {(i, j, d) for i, j, d in want if i % 3 != j % 3}


def test_band_masks_are_all_small_errors():
    assert sorted(pairs.band_masks(4, 1)) == [0, 1, 2, 4, 8] and len(pairs.band_masks(51, 2)) == 1 + 51 + 51 * 25


def test_profiles_count_words_and_compare_cells(spark):
    import hashlib

    body = " ".join(f"w{k % 37}" for k in range(80))
    rows = spark.createDataFrame([(1, body), (2, None), (3, "few words"), (4, "\t\n".join(body.split())), (5, body + " tail")], "id long, text string")
    found = {r["id"]: r for r in signatures.profiles(rows, "id", "text").collect()}
    cells = [0] * 257
    for w in body.split():
        cells[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 257] += 1
    assert set(found) == {1, 4, 5} and found[1]["fine"] == cells[:256] == found[4]["fine"]
    assert found[1]["coarse"] == [sum(cells[k : k + 4]) for k in range(0, 256, 4)] and found[1]["of_fine"][:] == (256, sum(cells[:256]), sum(c * c for c in cells[:256]))
    bits = "".join("1" if cells[k] > cells[k + 1] else "0" for k in range(256))
    assert [v % 2**64 for v in found[1]["h"]] == [int(bits[k : k + 64], 2) for k in range(0, 256, 64)]
    assert sum((a ^ b).bit_count() for a, b in zip((v % 2**64 for v in found[1]["h"]), (v % 2**64 for v in found[5]["h"]), strict=True)) <= 2
