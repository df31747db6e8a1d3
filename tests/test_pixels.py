"""Stacked pixel operators against plain loops over single pixels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import images, pixels


def drawn(n, height, width, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (n, height, width), dtype=np.uint8)


def slow_line(line, after, kernel):
    shape, support = {"triangle": (lambda t: max(0.0, 1 - abs(t)), 1.0), "lanczos": (lambda t: 1.0 if t == 0 else math.sin(math.pi * t) * math.sin(math.pi * t / 3) * 3 / (math.pi * t) ** 2 if abs(t) < 3 else 0.0, 3.0)}[kernel]
    scale, out = len(line) / after, []
    for k in range(after):
        centre, wide = (k + 0.5) * scale, max(scale, 1.0)
        inside = range(max(0, int(centre - support * wide + 0.5)), min(len(line), int(centre + support * wide + 0.5)))
        shares = [shape((i + 0.5 - centre) / wide) for i in inside]
        whole = [math.floor(s / sum(shares) * 2**22 + 0.5) for s in shares]
        value = sum(s * int(line[i]) for s, i in zip(whole, inside, strict=True))
        out.append(min(255, max(0, (value + 2**21) >> 22)))
    return out


@pytest.mark.parametrize("kernel", ["triangle", "lanczos"])
@pytest.mark.parametrize(("before", "after"), [((9, 14), (5, 4)), ((5, 3), (12, 7)), ((6, 6), (6, 2)), ((1, 1), (3, 3)), ((40, 30), (8, 8))])
def test_resample_by_loops(kernel, before, after):
    stack = drawn(3, *before)
    for image, found in zip(stack, pixels.resample(stack, *after, kernel), strict=True):
        wide = [slow_line(row, after[1], kernel) for row in image]
        expected = np.array([slow_line(column, after[0], kernel) for column in zip(*wide, strict=True)]).T
        assert (found == expected).all()


def test_same_size_and_flat_images_stay():
    stack = drawn(2, 7, 5)
    assert (pixels.resample(stack, 7, 5, "lanczos") == stack).all()
    assert (pixels.resample(np.full((1, 30, 40), 77, np.uint8), 8, 9, "lanczos") == 77).all()


def test_edges_by_loops():
    stack = drawn(2, 6, 7)
    for image, found in zip(stack, pixels.edges(stack), strict=True):
        for y in range(6):
            for x in range(7):
                inner = 0 < y < 5 and 0 < x < 6
                total = sum(int(image[v, u]) for v in (y - 1, y, y + 1) for u in (x - 1, x, x + 1)) if inner else 0
                assert found[y, x] == (min(255, max(0, 9 * int(image[y, x]) - total)) if inner else image[y, x])
    assert (pixels.edges(stack[:, :2]) == stack[:, :2]).all()


def test_stacked_figures_equal_those_of_single_images():
    a, b = drawn(20, 64, 64, 1), drawn(20, 64, 64, 2)
    b[:5], b[5] = a[:5], 9
    a[6] = b[6] = 3
    flat = [v.reshape(20, -1) for v in (a, b)]
    found = np.array([pixels.correlations(*flat), pixels.similarities(a, b), pixels.affinities(*flat)])
    for k in range(20):
        x, y = a[k].tobytes(), b[k].tobytes()
        assert found[:, k] == pytest.approx([images.correlation(x, y), images.block_ssim(x, y), images.histogram_affinity(x, y)], abs=1e-12)
    assert pixels.hashes(a).tolist() == [images.difference_hash(x.tobytes()) for x in a]


def test_grey_levels():
    rgb = np.array([[[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255], [0, 0, 0]]]], np.uint8)
    assert pixels.grey(rgb).ravel().tolist() == [76, 150, 29, 255, 0]


def test_columns_with_void_images(spark):
    draw = random.Random(4)
    image = lambda w, h: bytes(draw.randrange(256) for _ in range(w * h * 3))
    rows = [(1, image(10, 8), 10, 8, image(5, 4), 5, 4), (2, None, 10, 8, image(5, 4), 5, 4), (3, image(4, 4), 4, 5, image(4, 4), 4, 4), (4, image(4, 4), 4, None, image(4, 4), 4, 4), (5, b"", 0, 0, b"", 0, 0), (6, image(6, 6), 6, 6, image(6, 6), 6, 6)]
    rows += [rows[0]]
    df = spark.createDataFrame(rows, "id long, a binary, aw int, ah int, b binary, bw int, bh int")
    a, b = (F.col("a"), F.col("aw"), F.col("ah")), (F.col("b"), F.col("bw"), F.col("bh"))
    seen = df.select("id", pixels.signature(*a, channels=3).alias("s"), pixels.pair_diagnostics(a, b, channels=3).alias("d"), pixels.resize_metrics(a, b).alias("m"))
    found = [(r["id"], r) for r in seen.withColumn("h", pixels.difference_hash(F.col("s"))).collect()]
    assert len({repr(r) for k, r in found if k == 1}) == 1 and len(found) == 7
    found = dict(found)
    for void in (2, 3, 4, 5):
        assert found[void]["s"] is None and found[void]["h"] is None and set(found[void]["d"]) == {None} and set(found[void]["m"]) == {None}
    one = np.frombuffer(rows[0][1], np.uint8).reshape(1, 8, 10, 3)
    assert bytes(found[1]["s"]) == pixels.resample(pixels.grey(one), 64, 64).tobytes() and found[1]["d"]["full_corr"] is None and found[6]["d"]["full_corr"] is not None
    small = np.frombuffer(rows[0][4], np.uint8).reshape(4, 5, 3)
    brought = np.stack([pixels.resample(one[..., c], 4, 5, "lanczos")[0] for c in range(3)], axis=2)
    assert found[1]["m"]["mae"] == pytest.approx(np.abs(brought.astype(int) - small).mean())
    assert found[1]["h"] == images.difference_hash(bytes(found[1]["s"]))
    assert df.limit(0).select(pixels.resize_metrics(a, b).alias("m")).collect() == []


def test_sizes_meet_in_one_batch(spark, monkeypatch):
    monkeypatch.setattr(pixels, "STACK", 50)
    stack = {k: drawn(1, 3 + k % 4, 5 + k % 3, k)[0] for k in range(40)}
    df = spark.createDataFrame([(k, v.tobytes(), v.shape[1], v.shape[0]) for k, v in stack.items()], "id long, a binary, w int, h int")
    for r in df.select("id", pixels.signature(F.col("a"), F.col("w"), F.col("h"), side=4).alias("s")).collect():
        assert bytes(r["s"]) == pixels.resample(stack[r["id"]][None], 4, 4).tobytes()
