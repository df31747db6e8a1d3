import json
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import images, scalar
from lodestrata.operators import assignment, checks, pairs
from lodestrata.operators.components import connected_components
from lodestrata.sources import files, sinks
from lodestrata.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def union_find(edges):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {a: find(a) for a in parent}


def test_components_against_union_find(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)]
    edges = [(a, b) for a, b in edges if a != b]
    found = connected_components(spark.createDataFrame([*edges, *edges[:5], (7, None)], "src long, dst long"))
    rows = found.collect()
    assert {r["node"]: r["component"] for r in rows} == union_find(edges)
    assert len(rows) == len({r["node"] for r in rows})


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_name_functions(spark):
    assert one(spark, scalar.family(F.lit("a/IMG_1_Brightness.JPG"))) == "img_1"
    assert one(spark, scalar.augmentation_type(F.lit("x_gamma.jpg"))) == "gamma"
    assert one(spark, scalar.augmentation_type(F.lit("x.jpg"))) == "none"
    assert one(spark, scalar.bare_stem(F.lit("x_aug_640.jpg"))) == "x_640"
    assert one(spark, scalar.bare_stem(F.lit("A_aug_640-.png"))) == "a_640"


def test_seed_from_digest(spark):
    import hashlib

    digest = hashlib.sha256(b"data").hexdigest()
    expected = int.from_bytes(hashlib.sha256(bytes.fromhex(digest) + b"ctx").digest()[:8], "big")
    assert one(spark, scalar.derived_seed(F.lit(digest), "ctx")) == str(expected)


def test_pearson_rules(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 4.0, 6.0]), ([1.0, 1.0], [1.0, 1.0]), ([1.0, 1.0], [2.0, 2.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r["c"] for r in rows.select(scalar.pearson(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 1.0, 0.0, None]


def test_geometry(spark):
    square = F.array(*map(F.lit, (0.0, 2.0, 2.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 2.0, 2.0)))
    assert one(spark, scalar.twice_area(*square)) == 8.0
    box = lambda *v: F.array(*map(F.lit, map(float, v)))
    assert one(spark, scalar.box_iou(box(0, 0, 2, 2), box(1, 0, 3, 2))) == pytest.approx(1 / 3)
    assert one(spark, scalar.box_iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0


@pytest.mark.parametrize(("policy", "expected"), [("inspect", ["outside", "zero_area", "malformed", None]), ("audit", ["boundary", "zero_area", "malformed", None]), ("convert", [None, "zero_area", "malformed", None])])
def test_polygon_policies(spark, policy, expected):
    rows = spark.createDataFrame(
        [(0, [0.0, 10.0, 10.0], [0.0, 0.0, 5.0]), (1, [1.0, 2.0, 3.0], [1.0, 1.0, 1.0]), (2, [1.0], [1.0]), (3, [1.0, 5.0, 5.0], [1.0, 1.0, 5.0])], "k int, xs array<double>, ys array<double>"
    )
    reason = checks.polygon_reason(F.col("xs"), F.col("ys"), F.lit(10.0), F.lit(10.0), policy)
    assert [r["r"] for r in rows.orderBy("k").select(reason.alias("r")).collect()] == expected


def test_hamming_pairs_lose_nothing(spark):
    draw = random.Random(1)
    base = [draw.getrandbits(63) for _ in range(30)]
    values = base + [v ^ (1 << draw.randrange(62)) ^ (1 << draw.randrange(62)) for v in base] + base[:3]
    rows = spark.createDataFrame([(k, [v]) for k, v in enumerate(values)], "id long, h array<long>")
    found = {(r["a"], r["b"], r["distance"]) for r in pairs.hamming_pairs(rows, "id", "h", 1, 3).collect()}
    assert found == {(i, j, d) for i in range(len(values)) for j in range(i + 1, len(values)) if (d := (values[i] ^ values[j]).bit_count()) <= 3}


def test_blocked_pairs_and_precedence(spark):
    rows = spark.createDataFrame([(1, "x", "train"), (2, "x", "test"), (3, "x", "train"), (4, None, "test")], "id long, f string, s string")
    assert {(r["a"], r["b"]) for r in pairs.blocked_pairs(rows, "f", "id", "s", True).collect()} == {(1, 2), (2, 3)}
    assert {(r["a"], r["b"]) for r in pairs.blocked_pairs(rows, "f", "id", "s", False).collect()} == {(1, 3)}
    edges = spark.createDataFrame([(1, 2, "named"), (2, 1, "exact"), (2, 3, "named")], "a long, b long, kind string")
    best = pairs.first_writer(edges, F.when(F.col("kind") == "exact", 0).otherwise(1))
    assert {tuple(r) for r in best.collect()} == {(1, 2, "exact"), (2, 3, "named")}


def test_tiers_and_modes(spark):
    rows = [("exact", None, None, None, None), ("named", 0.996, True, None, None), ("named", 0.996, False, None, None), ("named", 0.9, True, None, None), ("visual", 0.996, False, 12, 0.97), ("visual", 0.996, False, 13, 0.99), ("visual", 0.996, False, 5, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, kind string, corr double, same boolean, d int, full double").orderBy("k")
    columns = [F.col(c) for c in ("kind", "corr", "same", "d", "full")]
    assert [r["t"] for r in df.select(pairs.tier(*columns).alias("t")).collect()] == ["Confirmed", "Strongly Supported", "Supported", "Candidate", "Supported", "Outside current shortlist", "Candidate"]
    for mode, expected in (("conservative", [1, 1, 0, 0, 0, 0, 0]), ("current", [1, 1, 1, 0, 1, 0, 0]), ("worst", [1, 1, 1, 1, 1, 0, 1])):
        assert [int(r["t"]) for r in df.select(pairs.included(mode, *columns).alias("t")).collect()] == expected


def test_override_checks_the_prior(spark):
    edges = spark.createDataFrame([(1, 2, "Candidate"), (3, 4, "Supported")], "a long, b long, tier string")
    good = spark.createDataFrame([(2, 1, "Candidate", "Confirmed")], "a long, b long, prior string, reviewed string")
    assert {tuple(r) for r in checks.override(edges, good).collect()} == {(1, 2, "Confirmed"), (3, 4, "Supported")}
    assert checks.unused_decisions(edges, good).count() == 0
    with pytest.raises(Exception, match="reviewed"):
        checks.override(edges, good.withColumn("prior", F.lit("Supported"))).collect()


@pytest.mark.parametrize("lexicographic", [True, False])
def test_splits_are_deterministic_and_balanced(spark, lexicographic):
    draw = random.Random(2)
    rows = [(f"g{k:03d}", draw.randint(1, 4), draw.randint(0, 1), draw.randint(0, 3), draw.randint(0, 3)) for k in range(200)]
    trials = [(11, (0.7, 0.15, 0.15)), (12, (0.7, 0.1, 0.2))]
    run = lambda data: {(r["trial"], r["id"]): r["split"] for r in assignment.split_trials(spark.createDataFrame(data, "id string, images long, multi long, x long, y long"), ["x", "y"], trials, lexicographic).collect()}
    found = run(rows)
    assert len(found) == 400 and found == run(rows[::-1])
    images_ = dict((r[0], r[1]) for r in rows)
    share = sum(images_[g] for (t, g), s in found.items() if t == 0 and s == "train") / sum(images_.values())
    assert abs(share - 0.7) < (0.02 if lexicographic else 0.05)


def test_split_without_instances_of_a_class(spark):
    found = assignment.greedy_split([{"id": 1, "images": 1, "multi": 0, "x": 0}], ["x"], (0.7, 0.2, 0.1), 1, False)
    assert found == {1: "train"}


def test_matching_and_categories(spark):
    truth = spark.createDataFrame([(1, 10, 0, [0.0, 0.0, 2.0, 2.0]), (1, 2, 2, [5.0, 5.0, 7.0, 7.0]), (2, 1, 1, [0.0, 0.0, 1.0, 1.0])], "image_id long, id long, cls int, box array<double>")
    predicted = spark.createDataFrame([(1, 1, 2, 0.9, [0.0, 0.0, 2.0, 2.0]), (1, 2, 1, 0.8, [5.0, 5.0, 7.0, 7.0]), (3, 1, 1, 0.5, [0.0, 0.0, 1.0, 1.0])], "image_id long, id long, cls int, confidence double, box array<double>")
    rows = assignment.failure_category(assignment.match_boxes(truth, predicted)).collect()
    assert {(r["image_id"], r["kind"], r["gt_id"], r["pred_id"], r["category"]) for r in rows} == {(1, "matched", 10, 1, "F4 severe"), (1, "matched", 2, 2, "F3 adjacent"), (2, "missed", 1, None, "F1 missed"), (3, "false_positive", None, 1, "F2 false positive")}


def test_ties_go_by_id_text(spark):
    truth = spark.createDataFrame([(1, 2, 0, [0.0, 0.0, 1.0, 1.0]), (1, 10, 0, [0.0, 0.0, 1.0, 1.0])], "image_id long, id long, cls int, box array<double>")
    predicted = spark.createDataFrame([(1, 1, 0, 0.9, [0.0, 0.0, 1.0, 1.0])], "image_id long, id long, cls int, confidence double, box array<double>")
    assert {(r["gt_id"], r["kind"]) for r in assignment.match_boxes(truth, predicted).collect()} == {(10, "matched"), (2, "missed")}


def test_image_functions():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 31, 17)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 48, 64)
    assert images.header_size(png) == (31, 17) and images.header_size(jpeg) == (64, 48)
    assert images.header_size(b"GIF89a") is None and images.header_size(jpeg[:12]) is None
    pixels = np.random.default_rng(0).integers(0, 256, 4096).astype(np.uint8)
    data = pixels.tobytes()
    bits = 0
    for y in range(16):
        for x in range(16):
            at = y * 256 + x * 4
            bits = bits << 1 | int(pixels[at] > pixels[at + 4])
    assert b"".join(struct.pack(">q", v) for v in images.difference_hash(data)) == bits.to_bytes(32, "big")
    assert images.block_ssim(data, data) == pytest.approx(1.0) and images.histogram_affinity(data, data) == pytest.approx(1.0)
    assert images.correlation(data, data) == pytest.approx(1.0) and images.correlation(b"aa", b"bb") == 0.0
    square = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]
    assert images.mask_iou(square, [[(0.0, 0.0), (2.0, 0.0), (2.0, 4.0), (0.0, 4.0)]], 8, 8) == 0.5
    assert images.mask_iou([], [], 8, 8) == 0.0


def test_annotations_in_both_forms(spark, tmp_path):
    region = {"shape_attributes": {"name": "polygon", "all_points_x": [1, 2, 3], "all_points_y": [1, 1, 2]}, "region_attributes": {"name": " ripe "}}
    (tmp_path / "a.json").write_text(json.dumps({"k1": {"filename": "a.jpg", "regions": [region]}, "k2": {"filename": "b.jpg", "regions": []}}))
    (tmp_path / "b.json").write_text(json.dumps({"_via_img_metadata": {"k": {"filename": "c.jpg", "regions": {"10": region, "2": {**region, "region_attributes": {}}}}}}))
    rows = files.annotations(spark, str(tmp_path)).collect()
    assert {(r["filename"], r["region_index"], r["label"]) for r in rows} == {("a.jpg", 0, "ripe"), ("b.jpg", None, None), ("c.jpg", 0, None), ("c.jpg", 1, "ripe")}


def test_archives(spark, tmp_path):
    path = str(tmp_path / "p.zip")
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("root/train/a.png", b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 3, 4))
        archive.writestr("root/readme.txt", b"x")
        archive.writestr("__MACOSX/root/._a.png", b"")
    members = files.archive_members(spark, path)
    assert files.single_root(members) == "root"
    assert [r["path"] for r in files.image_members(members, ["train"]).collect()] == ["root/train/a.png"]
    assert ("root/train/a.png", 3, 4) in {tuple(r) for r in files.archive_image_sizes(spark, path).collect()}
    assert {r["path"] for r in files.open_source(spark, path).collect()} == {"root/train/a.png", "root/readme.txt"}  # sidecars are hidden files


def test_label_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("f", 0, 1, [0.1, 0.2, 0.3], [0.5, 0.5, 0.25])], "file string, region_index int, cls int, xs array<double>, ys array<double>")
    text = sinks.label_text(rows).first()["value"]
    (tmp_path / "f.txt").write_text(text + "\n")
    back = files.label_lines(spark, str(tmp_path / "f.txt")).first()
    assert (back["cls"], back["xs"], back["ys"]) == (1, [0.1, 0.2, 0.3], [0.5, 0.5, 0.25])


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "o.csv")
    sinks.write_csv(spark.createDataFrame([(2, True), (1, None)], "k long, ok boolean"), path, ["k"])
    assert open(path, "rb").read() == b"k,ok\n1,\n2,true\n"
    with pytest.raises(FileExistsError):
        sinks.write_csv(spark.range(1), path, ["id"])
    sinks.write_protocol({"seed": 13436313853456744620, "name": "x"}, str(tmp_path / "p.yaml"))
    assert files.flat_protocol(str(tmp_path / "p.yaml")) == {"seed": 13436313853456744620, "name": "x"}


def test_checks(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k long"), spark.createDataFrame([(1,), (3,)], "k long")
    assert {tuple(r) for r in checks.difference(a, b).collect()} == {(1, "expected"), (2, "expected"), (3, "found")}
    with pytest.raises(ValueError, match="unique"):
        checks.require({"unique": checks.repeated_keys(a, "k")})
    with pytest.raises(checks.GateFailure, match="second"):
        checks.run_gates([("first", lambda: 1), ("second", lambda: 1 / 0)])
    kept, report = checks.filter_predictions(spark.createDataFrame([(0.2,), (0.7,)], "confidence double"), 0.5)
    assert kept.count() == 1 and tuple(report.first()) == (2, 1, 1)


def test_event_windows(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a"), (1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 01:10:00", "a")], "event_id long, ts string, kind string")
    assert events.first_seen(rows, ["event_id"]).count() == 2
    assert sorted(r["n"] for r in events.windowed_counts(rows, "kind").collect()) == [1, 2]


def test_match_by_class_uses_a_box_once_and_skips_ignored(spark):
    from lodestrata.operators import assignment

    truth = spark.createDataFrame([(1, 1, 0, [0.0, 0.0, 10.0, 10.0], False), (1, 2, 1, [0.0, 0.0, 10.0, 10.0], True)], "image_id long, id long, cls int, box array<double>, ignore boolean")
    predicted = [(1, 5, 0, [0.0, 0.0, 10.0, 9.0], 0), (1, 6, 0, [0.0, 0.0, 10.0, 10.0], 1), (1, 7, 1, [0.0, 0.0, 10.0, 10.0], 2), (1, 8, 1, [0.0, 0.0, 10.0, 10.0], 3), (1, 9, 2, [0.0, 0.0, 1.0, 1.0], 4)]
    found = assignment.match_by_class(truth, spark.createDataFrame(predicted, "image_id long, id long, cls int, box array<double>, ordinal int")).collect()
    assert {(r["pred_id"], r["gt_id"], r["outcome"]) for r in found} == {(5, 1, "hit"), (6, 2, "ignored"), (7, 2, "ignored"), (8, 2, "ignored"), (9, None, "false_positive")}


def test_a_free_box_goes_before_an_ignored_one_of_any_class(spark):
    from lodestrata.operators import assignment

    truth = [(1, 1, 0, [0.0, 0.0, 10.0, 8.0], False), (1, 2, 0, [0.0, 0.0, 10.0, 10.0], True), (2, 3, 1, [0.0, 0.0, 4.0, 4.0], True), (3, 4, 0, [0.0, 0.0, 2.0, 2.0], False), (3, 5, 0, [0.0, 0.0, 2.0, 2.0], False)]
    predicted = [(1, 5, 0, [0.0, 0.0, 10.0, 10.0], 0), (2, 6, 0, [0.0, 0.0, 4.0, 4.0], 0), (3, 7, 0, [0.0, 0.0, 2.0, 2.0], 0), (4, 8, 0, [0.0, 0.0, 2.0, 2.0], 0)]
    frame = spark.createDataFrame(truth, "image_id long, id long, cls int, box array<double>, ignore boolean")
    found = assignment.match_by_class(frame, spark.createDataFrame(predicted, "image_id long, id long, cls int, box array<double>, ordinal int")).collect()
    assert {(r["pred_id"], r["gt_id"], r["outcome"]) for r in found} == {(5, 1, "hit"), (6, 3, "ignored"), (7, 5, "hit"), (8, None, "false_positive")}


def test_mask_overlap_decides_poor_localisation(spark):
    from pyspark.sql import functions as F

    from lodestrata.functions import images
    from lodestrata.operators import assignment

    square, corner = [[[0.0, 0.0], [8.0, 0.0], [8.0, 8.0], [0.0, 8.0]]], [[[0.0, 0.0], [8.0, 0.0], [0.0, 2.0]]]
    rows = [("matched", 0, 0, 0.9, square, square), ("matched", 0, 0, 0.9, square, corner), ("missed", 0, None, None, square, None)]
    df = spark.createDataFrame(rows, "kind string, gt_class int, pred_class int, box_iou double, a array<array<array<double>>>, b array<array<array<double>>>")
    found = assignment.failure_category(df.withColumn("mask_iou", images.mask_overlaps("a", "b", F.lit(10), F.lit(10)))).collect()
    assert [r["category"] for r in found] == ["", "F5 poor localisation", "F1 missed"]


def test_identity_finds_altered_missing_and_extra(spark):
    from lodestrata.operators import checks

    written = spark.createDataFrame([(1, 3, "a"), (2, 3, "b"), (3, 1, "c")], "doc_id long, bytes long, sha string")
    actual = spark.createDataFrame([(1, 3, "a"), (2, 4, "x"), (4, 1, "d")], "doc_id long, bytes long, sha string")
    assert {r["doc_id"]: r["status"] for r in checks.identity(written, actual).collect()} == {1: "identical", 2: "altered", 3: "missing", 4: "extra"}


def test_ranks_are_those_of_one_sort(spark):
    from lodestrata.operators.order import ranked

    values = [(k * 7919) % 1009 for k in range(300)]
    found = {r["v"]: r["rank"] for r in ranked(spark.createDataFrame([(v,) for v in values], "v long"), "v").collect()}
    assert found == {v: k for k, v in enumerate(sorted(values), 1)}


def test_locks_labels_and_plain_values(tmp_path):
    import datetime

    import numpy as np

    from lodestrata.operators import checks
    from lodestrata.sources import sinks

    assert checks.operating_threshold("test", 0.25) == 0.25 and checks.operating_threshold("val", 0.25, 0.5) == 0.5 and checks.threshold_label(0.65) == "0p65"
    for call in (lambda: checks.operating_threshold("test", 0.25, 0.5), lambda: checks.operating_threshold("val", 0.25, 2.0), lambda: checks.checked_split("other")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(PermissionError):
        checks.checked_split("test")
    assert checks.checked_split("test", unlocked=True) == "test"
    assert sinks.plain({"a": {3, 1}, "b": np.float64(0.5), "c": datetime.date(2020, 1, 2), "d": tmp_path}) == {"a": [1, 3], "b": 0.5, "c": "2020-01-02", "d": str(tmp_path)}
    with pytest.raises(TypeError):
        sinks.plain(object())


def test_keyed_annotations_adjudications_and_label_faults(spark, tmp_path):
    import json

    from lodestrata.operators import checks
    from lodestrata.sources import files

    region = {"shape_attributes": {"name": "polygon", "all_points_x": [1, 2, 3], "all_points_y": [1, 2, 1]}, "region_attributes": {"name": "ripe"}}
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "one.json").write_text(json.dumps({"k1": {"filename": "a.jpg", "regions": [region, region]}, "k2": {"filename": "b.jpg", "regions": []}}))
    rows = {r["filename"]: (r["split"], len(r["regions"])) for r in files.keyed_annotations(spark, str(tmp_path / "train")).collect()}
    assert rows == {"a.jpg": ("train", 2), "b.jpg": ("train", 0)}
    (tmp_path / "train" / "two.json").write_text(json.dumps({"k1": {"filename": "a.jpg", "regions": [region]}}))
    with pytest.raises(Exception, match="there twice"):
        files.keyed_annotations(spark, str(tmp_path / "train")).collect()
    reviewed = tmp_path / "reviewed.json"
    reviewed.write_text(json.dumps([{"a": "y", "b": "x", "prior": "Candidate", "reviewed": "Supported"}]))
    assert [tuple(r) for r in files.adjudications(spark, str(reviewed)).collect()] == [("x", "y", "Candidate", "Supported")]
    reviewed.write_text(json.dumps([{"a": "x", "b": "x", "prior": "Candidate", "reviewed": "Supported"}]))
    with pytest.raises(ValueError):
        files.adjudications(spark, str(reviewed))
    lines = spark.createDataFrame([("f", 0, 1, [0.1, 0.2, 0.3], [0.1, 0.2, 0.3]), ("f", 1, 7, [0.1] * 3, [0.1] * 3), ("f", 2, 1, [0.1, 0.2], [0.1] * 3), ("f", 3, 1, [0.1, 1.2, 0.3], [0.1] * 3)], "file string, line int, cls int, xs array<double>, ys array<double>")
    faults = checks.label_line_faults(lines, 3, spark.createDataFrame([("f", 5), ("g", 1)], "file string, n long")).collect()
    assert {(r["file"], r["line"], r["fault"]) for r in faults} == {("f", 1, "class"), ("f", 2, "tokens"), ("f", 3, "range"), ("f", None, "count"), ("g", None, "count")}


def test_hamming_join_shuffles_no_probes(spark, monkeypatch):
    """However many hashes there are, a hash is a row for each band, not one for each value near it, and a pair leaves the join once."""
    rows = spark.range(40).select(F.col("id").alias("n"), F.array(F.col("id") * 3, F.xxhash64("id")).alias("h"))
    near = pairs.hamming_pairs(rows, "n", "h", 2, 14, payload=("n",), also={"sum": F.col("n_a") + F.col("n_b")})
    masks = []
    monkeypatch.setattr(pairs, "band_masks", lambda *a: masks.append(a) or [0])
    monkeypatch.setattr(pairs.math, "log2", lambda n: 21.5)  # as with three million hashes
    pairs.hamming_pairs(rows, "n", "h", 2, 14)
    assert not masks
    assert all(r["sum"] == r["a"] + r["b"] for r in near.collect())
