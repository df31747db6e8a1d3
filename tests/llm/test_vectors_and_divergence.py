"""Exact top-k, source divergence and whitening against brute force, with nulls, ties, repeats, long texts and empty tables."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import divergence, innerproduct, queries, vectors, whitening

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def table(seed=0, rows=400, width=9, copies=0):
    draw = np.random.default_rng(seed)
    scale = draw.uniform(0.2, 3, rows)
    made = [(int(k), [float(v) for v in scale[k] * draw.standard_normal(width).astype(np.float32)], 0) for k in range(rows)]
    made += [(rows + k, made[7][1], 1) for k in range(copies)]
    nan, inf = float("nan"), float("inf")
    odd = [(100_000, None, 0), (100_100, [1.0, None] + [0.0] * (width - 2), 0), (100_200, [nan] * width, 0), (100_300, [inf] + [0.0] * (width - 1), 0)]
    odd += [(100_400, [], 0), (100_500, [1.0, 2.0], 0), (None, made[0][1], None), (100_600, [0.0] * width, 0), (100_601, [-0.0] * width, 0)]
    return made + odd


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("id", F.lit("clash")).withColumn("x", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("length", F.lit(3))


def sound(rows, width):
    return [(i, v) for i, v, _ in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]


def top(rows, width, every, k=10):
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in sound(rows, width) if i is not None]
    out = []
    for i, q in kept:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in kept if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("copies", [0, 150])
def test_top_products_equal_brute_force(spark, copies):
    rows = table(copies=copies)
    found = innerproduct.top_inner_products(frame(spark, rows), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, found.collect())) == top(rows, 9, 5)


def test_top_products_in_small_blocks_and_steps(spark, monkeypatch):
    for name, value in (("BLOCK", 7), ("SEED", 12), ("CELLS", 64)):
        monkeypatch.setattr(innerproduct, name, value)
    rows = table(seed=1, rows=120)
    found = innerproduct.top_inner_products(frame(spark, rows), F.col("vec_id") % 5 == 0, k=3)
    assert sorted(map(tuple, found.collect())) == top(rows, 9, 5, k=3)


def test_top_products_repeated_rows_and_few_candidates(spark):
    one = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [2.0, 1.0], 0), (1, [2.0, 1.0], 0), (2, [-1.0, 3.0], 0)]
    found = innerproduct.top_inner_products(frame(spark, one), F.col("vec_id") == 0)
    each = [(0, 1, 1, 2 << 20), (0, 2, 1, 2 << 20), (0, 3, 2, -(1 << 20))]
    assert sorted(map(tuple, found.collect())) == sorted(each * 2)
    for rows in ([], [(0, None, 0)], [(1, [1.0], 0)]):
        assert innerproduct.top_inner_products(frame(spark, rows), F.col("vec_id") % 5 == 0).collect() == []


def test_scores_beyond_float64_are_exact():
    q, c = np.array([[(1 << 30) + 1, 1]]), np.array([[(1 << 30) + 1, -3], [1 << 40, 1 << 40]])
    assert innerproduct.exact_scores(q, c)[0, 0] == ((1 << 30) + 1) ** 2 - 3
    assert innerproduct.exact_scores(np.array([[1 << 40] * 2]), c)[0, 1] == (1 << 63) - 1


def test_bounds_hold_and_prune():
    """The rotated partial sum with the lengths of the rest is never below the score, and leaves few candidates where lengths differ."""
    draw = np.random.default_rng(3)
    x = (draw.standard_normal((500, 16)) * draw.uniform(0.01, 1, (500, 1)) * np.linspace(3, 0.1, 16) * 1024).astype(np.int64)
    rotation = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    y, h = x @ rotation, 4
    tail = np.sqrt((y[:, h:] ** 2).sum(axis=1))
    bound = y[:, :h] @ y[:, :h].T + np.outer(tail, tail) * (1 + 1e-9)
    scores = x @ x.T
    assert (bound >= scores - 1e-6).all()
    tenth = np.sort(scores, axis=1)[:, -10]
    assert (bound >= tenth[:, None]).mean() < 0.3


@pytest.mark.parametrize("name", ["op11_exact_topk", "op12_source_divergence"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    found = queries.queries()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    wanted = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, found.select(columns).collect())) == Counter(wanted)


def whitened(rows, width, k, scale=256):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in sound(rows, width)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    centred = fit - fit.mean(axis=0)
    values, parts = np.linalg.eigh(centred.T @ centred / len(fit))
    return kept, fit, values[::-1][:k], parts[:, ::-1][:, :k], values.sum()


def test_whitening_equals_numpy(spark):
    rows = table(seed=5, rows=300, width=24, copies=120)
    found = whitening.whiten(frame(spark, rows).withColumn("n", F.lit(0))).collect()
    kept, fit, values, parts, trace = whitened(rows, 24, 4)
    assert len(found) == 4 * len(kept) and {r["n"] for r in found} == {len(fit)} and Counter(r["id"] for r in found) == Counter(i for i, _ in kept for _ in range(4))
    sums = [int(s) for s in fit.sum(axis=0)]
    far = {i: sum((len(fit) * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in kept}
    assert all(int(r["deviation"]) == far[r["id"]] for r in found)
    want = {i: (np.array(x) - fit.mean(axis=0)) @ parts / np.sqrt(values) for i, x in kept}
    for c in range(4):
        pairs = np.array([(r["whitened"], want[r["id"]][c]) for r in found if r["component"] == c + 1 and r["id"] is not None])
        assert np.abs(np.abs(pairs[:, 0]) - np.abs(pairs[:, 1])).max() < 1e-8 and abs(abs(np.corrcoef(pairs.T)[0, 1]) - 1) < 1e-9
        assert abs(next(r["explained"] for r in found if r["component"] == c + 1) - values[c] / trace) < 1e-9
    assert {r["identity_error"] for r in found}.pop() < 1e-9


def test_block_iteration_certifies_flat_and_repeated_spectra():
    draw = np.random.default_rng(2)
    for spectrum in (np.linspace(2, 1.9, 90), np.array([5.0, 5.0, 5.0, 1.0] + [0.5] * 40), np.array([3.0, 2.0, 0.0, 0.0, 0.0])):
        q, _ = np.linalg.qr(draw.standard_normal((len(spectrum), len(spectrum))))
        v = (q * spectrum) @ q.T
        passes = []
        values, parts = whitening.leading(lambda m, v=v, seen=passes: (seen.append(m.shape[1]), v @ m)[1], len(spectrum), 3)
        assert np.allclose(values, spectrum[:3], atol=1e-10)
        assert np.abs(v @ parts - parts * values).max() < 1e-9 and np.abs(parts.T @ parts - np.eye(3)).max() < 1e-12
        assert len(passes) < 40


def test_whitening_of_few_and_equal_vectors(spark):
    for rows in ([], [(1, None, 0)], [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0)]):
        assert whitening.whiten(frame(spark, rows)).collect() == []
    line = [(k, [float(k), float(k)], 0) for k in range(5)]  # one direction varies: one component
    found = whitening.whiten(frame(spark, line)).collect()
    assert {r["component"] for r in found} == {1} and abs(found[0]["explained"] - 1) < 1e-12


def test_huge_entries_stay_exact(spark):
    rows = [(0, [1e30, 1.0], 0), (1, [-1e30, 2.0], 0), (2, [3.0, 5.0], 0)]
    found = {r["id"]: int(r["deviation"]) for r in whitening.whiten(frame(spark, rows)).collect()}
    x = {0: (vectors.LIMIT, 256), 1: (-vectors.LIMIT, 512), 2: (768, 1280)}
    sums = [sum(v[k] for v in x.values()) for k in range(2)]
    assert found == {i: sum((3 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in x.items()}


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def audit(rows, least, top_terms=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        terms = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower)))
        docs[lang].update(terms.keys())
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def p(count, kept=kept, v=v):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * v) for t in kept}

        shares = {s: p(counts[lang, s]) for s in sources}
        q = p(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(shares[s][t] - shares[o][t]) for t in kept)) for o in sources if o != s]
            over = [(t, shares[s][t] - q[t]) for t in kept if counts[lang, s][t] and shares[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", over, top_terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, r + 1) for r, (item, value) in enumerate(ranked)]
    return Counter(out)


def corpus(seed, docs, sources, words):
    """Common words everywhere, rare words in a few sources each, one source with a third of all rows."""
    draw = random.Random(seed)
    rare = [f"r{chr(97 + k % 26)}{'abcdefghij'[k // 26 % 10]}é" for k in range(words)]
    rows = []
    for k in range(docs):
        s = 0 if k % 3 == 0 else draw.randrange(sources)
        body = [draw.choice(("the", "of", "und", "Ünd", "漢字")) for _ in range(draw.randint(0, 12))] + [rare[(s * 7 + draw.randrange(5)) % words] for _ in range(draw.randint(0, 9))]
        rows.append((k, " ".join(body) + draw.choice(("", "!", " 12_3", "\x00\t")), "en" if k % 4 else "de", f"s{s}", 0))
    rows += [(1, None, "en", "s0", None), (1, None, "en", "s0", None), (None, "The OF the", None, None, 0), (None, "", "fr", "x", 0), (None, "", "fr", "y", 0), (5, "alone", "it", "z", 0), (6, "the " * 50_000, "en", "s1", 0), (7, "", "en", "empty", 0)]
    return rows


@pytest.mark.parametrize(("seed", "sources", "words"), [(0, 5, 20), (1, 40, 90)])
def test_audit_equals_brute_force(spark, monkeypatch, seed, sources, words):
    monkeypatch.setattr(divergence, "LEAST", 4)
    monkeypatch.setattr(divergence, "TILE", 9)
    monkeypatch.setattr(divergence, "TERMS", 16)
    rows = corpus(seed, 700, sources, words)
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("term", F.lit(1)).withColumn("value", F.lit(2)).withColumn("a.b", F.lit(3))
    found = Counter(map(tuple, divergence.audit(docs).collect()))
    assert found == audit(rows, 4)


def test_audit_flushes_and_reads_long_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "LONG", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "a", "b"]), pa.array(["s"] * 3), pa.array([b"x y z X", b"x word word Word \xc3\x9c", b""], pa.binary())], names=["lang", "source", "text"])
    total = Counter()
    for out in divergence._counts(iter([batch])):
        for r in out.to_pylist():
            total[r["lang"], r["term"]] += r["n"] + 100 * r["docs"]
    assert total == {("a", b"x"): 203, ("a", b"y"): 101, ("a", b"z"): 101, ("a", b"word"): 103, ("a", b"\xc3\x9c"): 101}


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_light_and_heavy_sums_agree(spark):
    """All terms dense or all of them sparse: the same sums."""
    import pandas as pd

    draw = random.Random(4)
    rows = [("en", 0, 0, 0, f"s{s}", 0, None, 100 + s, False) for s in range(8)]
    rows += [("en", 0, 0, 0, f"s{s}", 0, f"t{t}", draw.randrange(50, 900), False) for t in range(40) for s in range(8) if draw.random() < 0.4]
    names = ["lang", "block", "one", "two", "source", "tile", "term", "p", "heavy"]
    light = pd.DataFrame(rows, columns=names)
    dense = light.assign(heavy=light["term"].notna())
    a, b = (divergence._tile_pair(("en", 0, 0, 0), x) for x in (light, dense))
    assert (a["part"] + a["gap"] * light["term"].nunique()).tolist() == b["part"].tolist()


def test_repeats_are_dropped_from_tables_with_dotted_names(spark):
    from lodestrata.llm import substring

    passage = " ".join(f"w{k}" for k in range(60))
    rows = [(1, passage, "x", 5), (2, "before " + passage + " after", None, 6), (3, None, "y", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, `row` int")
    found = {r["doc_id"]: (r["text"], r["a.b"], r["row"]) for r in substring.drop_repeats(docs).collect()}
    assert found == {1: (passage, "x", 5), 2: ("before after", None, 6), 3: (None, "y", 7)}
    assert substring.drop_repeats(docs).columns == docs.columns


def test_numerals_are_no_letters_and_tables_shrink_with_languages(spark):
    from lodestrata.llm import langid

    assert not langid.has_letter("½ ② ² 12 _ – ́") and langid.has_letter("12 é") and langid.has_letter("漢")
    assert langid.rows_for(20_000, 4) == 20_000 and langid.rows_for(20_000, 512) * 512 <= 20_000 * 8
    rows = [(k, f"der hund und die katze {k}" if k % 2 else f"the dog and the cat {k}", "de" if k % 2 else "en") for k in range(40)] + [(100, "½ ② ²", "en"), (101, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, F.col("doc_id") < 30).collect()}
    assert found[100] == found[101] == "und" and found[31] == "de" and found[32] == "en"
