import random

import numpy as np
from pyspark.sql import functions as F

from lodestrata.functions import scalar
from lodestrata.operators import hamming, signatures


def _signed(value, limbs):
    return [((value >> 64 * k) & (2**64 - 1)) - (2**64 if value >> 64 * k + 63 & 1 else 0) for k in range(limbs)]


def test_near_pairs_of_a_hot_cell_meet_once_in_blocks(spark, monkeypatch):
    """Sparse hashes share nearly all bands, so cells are far larger than a block; copies, null tags and wide counts are among them."""
    monkeypatch.setattr(hamming, "BLOCK", 40)
    draw = random.Random(5)
    sparse = lambda n: sum(1 << k for k in draw.sample(range(256), n))
    values = [sparse(draw.randrange(0, 14)) for _ in range(120)]
    values += values[:30] + [v ^ sparse(3) for v in values[:20]]
    fine = {v: [draw.randrange(0, 300 if n % 7 == 0 else 9) for _ in range(256)] if n % 11 else [4] * 256 for n, v in enumerate(values)}
    rows = [(k, _signed(v, 4), f"s{k % 3}", None if k % 4 == 0 else f"f{k % 50}", fine[v]) for k, v in enumerate(values)] + [(900, None, "s0", "x", None)]
    frame = spark.createDataFrame(rows, "id long, h array<long>, split string, family string, fine array<long>")
    found = hamming.near_pairs(frame, "id", "h", 4, 14, ("split", "family"), fine="fine")
    want = {(i, j): d for i in range(len(values)) for j in range(i + 1, len(values)) if (d := (values[i] ^ values[j]).bit_count()) <= 14 and rows[i][2] != rows[j][2] and rows[i][3] != rows[j][3]}
    got = found.collect()
    assert len(got) == len(want) > 300 and {(r["a"], r["b"]): r["distance"] for r in got} == want
    side = lambda x: frame.select(F.col("id").alias(x), F.col("fine").alias(f"fine_{x}"))
    both = found.join(side("a"), "a").join(side("b"), "b")
    of = lambda cut: scalar.pearson_of(cut("fine_a"), cut("fine_b"), scalar.moments(cut("fine_a")), scalar.moments(cut("fine_b")))
    assert both.where(~F.col("corr").eqNullSafe(of(lambda c: signatures.coarse(F.col(c)))) | ~F.col("full_corr").eqNullSafe(of(F.col))).isEmpty()
    assert hamming.near_pairs(frame.where("id < 0"), "id", "h", 4, 14, ("split",)).collect() == []


def test_close_pairs_in_rows_with_many_partners():
    draw = np.random.default_rng(3)
    limbs = [draw.integers(0, 4, 1500).astype(np.uint64), draw.integers(0, 2**5, 1500).astype(np.uint64)]
    part = np.repeat([1, 2], [1400, 100])
    pick = draw.random(1500) < 0.1
    want = {(i, j) for i in range(1500) for j in np.flatnonzero((part == part[i]) & (sum(np.bitwise_count(x ^ x[i]) for x in limbs) <= 2)).tolist() if i < j}
    for some in (None, pick):
        found = [tuple(sorted(p)) for left, right, _ in hamming.close_pairs(limbs, part, 2, some) for p in zip(left.tolist(), right.tolist(), strict=True)]
        assert len(found) == len(set(found)) and set(found) == {p for p in want if some is None or some[p[0]] or some[p[1]]}


def test_thinned_edges_keep_components_and_are_fewer_than_nodes(spark):
    from lodestrata.operators.components import connected_components, thinned

    draw = random.Random(9)
    rows = [(draw.randrange(300), draw.randrange(300)) for _ in range(250)] + [(k, k + j) for k in range(1000, 1050) for j in range(50)] + [(None, 3)]
    edges = spark.createDataFrame(rows, "a long, b long").coalesce(1)
    thin = thinned(edges, "a", "b")
    assert thin.count() < len({x for r in rows for x in r})
    assert {tuple(r) for r in connected_components(thin, "a", "b").collect()} == {tuple(r) for r in connected_components(edges, "a", "b").collect()}


def test_class_matching_has_no_frame_for_an_image(spark):
    """Images of a task are one stream of rows: the same outcomes whatever the order in which an image's options come."""
    from lodestrata.operators import assignment

    draw = random.Random(2)
    box = lambda: [x := draw.random(), y := draw.random(), x + 1, y + 1]
    truth = spark.createDataFrame([(k // 5, k, k % 2, box(), k % 7 == 3) for k in range(100)], "image_id long, id long, cls int, box array<double>, ignore boolean")
    predicted = spark.createDataFrame([(k // 5, k, k % 2, box(), k) for k in range(100)], "image_id long, id long, cls int, box array<double>, ordinal int")
    found = assignment.match_by_class(truth, predicted, 0.3)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    rows = {tuple(r) for r in found.collect()}
    assert len(rows) == 100 and {r[3] for r in rows} == {"hit", "ignored", "false_positive"}
    assert rows == {tuple(r) for r in assignment.match_by_class(truth.orderBy(F.desc("id")), predicted.orderBy(F.xxhash64("id")), 0.3).collect()}


def test_split_trials_hold_columns_not_objects():
    import tracemalloc

    from lodestrata.operators import assignment

    n = 20_000
    columns = {c: np.arange(n, dtype=np.int64) % m + 1 for c, m in (("images", 5), ("multi", 3), ("good", 4))}
    tracemalloc.start()
    order, splits = assignment.greedy_columns(np.arange(n), columns, ["good"], (0.7, 0.2, 0.1), 3, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * n and sorted(order.tolist()) == list(range(n)) and len(splits) == n
