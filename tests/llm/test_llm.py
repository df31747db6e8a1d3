"""Each operator against a brute-force version on small tables with nulls, ties, repeats, empty and long texts."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import bwt, classlm, decontaminate, jaccard, langid, licences, packing, quality, queries, repeats, simhash, substring, suffixes, text, urls
from lodestrata.llm.tokens import PackedEncoder, default_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0, docs=60):
    """Prose over a small vocabulary with copies, shared passages, an unusual text of each kind and repeated rows."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(400)]
    passage = " ".join(draw.choice(words) for _ in range(70))
    rows = []
    for k in range(docs):
        body = [draw.choice(words) for _ in range(draw.randint(1, 160))]
        if k % 4 == 0:
            body.insert(draw.randrange(len(body)), passage)
        if k % 9 == 0 and rows:
            body = rows[-1][1].split() + body[: k % 2]
        rows.append((k, " ".join(body), "en", "s", 0))
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, " \n\t ", "fr", "s", 3), (103, "Der " * 300, "de", "s", 0), (104, "é漢字 " * 40, "de", "s", 0)]
    rows += [(105, rows[3][1], "en", "s", 0), (105, rows[3][1], "en", "s", 0), (None, rows[3][1], "en", "s", 0), (106, "one", None, "s", 0), (107, "Two WORDS", "en", "s", 0), (108, rows[4][1] + "\n" + "x" * 3000, "en", "s", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).withColumn("id", F.lit("clash")).withColumn("spans", F.lit(1)).withColumn("text_", F.lit(0))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def removals(rows, units, length):
    """Mask of removed units for each row, from the definition."""
    first = {}
    for doc_id, u in rows:
        if doc_id is not None:
            for p in range(len(u) - length + 1):
                key = tuple(u[p : p + length])
                first[key] = min(doc_id, first.get(key, doc_id))
    out = []
    for doc_id, u in rows:
        gone = [False] * len(u)
        if doc_id is not None:
            for p in range(len(u) - length + 1):
                if first[tuple(u[p : p + length])] < doc_id:
                    gone[p : p + length] = [True] * length
        out.append((doc_id, u, gone))
    return out


@pytest.mark.parametrize("length", [50, 12, 200])
def test_substring_dedup(spark, length):
    long = " ".join(f"w{k * k % 97}" for k in range(260))
    rows = [*corpus(), (109, long + " end", "en", "s", 0), (110, "start " + long, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("id", F.lit("clash"))
    expected = Counter()
    for doc_id, u, gone in removals([(r[0], (r[1] or "").encode().split()) for r in rows], bytes.split, length):
        kept = b" ".join(w for w, g in zip(u, gone, strict=True) if not g)
        expected[doc_id, len(u), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    found = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digests(docs, length=length).collect())
    assert found == expected and any(k[2] for k in found)


@pytest.mark.parametrize(("large", "heavy"), [(5_000, 32), (0, 32), (5_000, 2)])
def test_suffix_array_dedup(docs, large, heavy, monkeypatch):
    monkeypatch.setattr(suffixes, "LARGE", large)
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    expected = Counter()
    for doc_id, u, gone in removals([(r[0], (r[1] or "").encode()) for r in corpus()], None, 50):
        kept = bytes(c for c, g in zip(u, gone, strict=True) if not g)
        spans = sum(g and not h for g, h in zip(gone, [False, *gone], strict=False))
        expected[doc_id, len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    found = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.digests(docs).collect())
    assert found == expected and any(k[2] for k in found)


def test_occurrences_travel_as_one_row_of_arrays_for_each_group(monkeypatch):
    monkeypatch.setattr(repeats, "GROUPS", 8)
    monkeypatch.setattr(repeats, "HEAVY", 3)
    s = suffixes.scheme()
    draw = random.Random(5)
    line = bytes(draw.randrange(97, 123) for _ in range(150)) + b"\n"
    texts = [line * 3 + bytes(draw.randrange(256) for _ in range(70_000)) + line, line * 2, line, b"short", bytes(300)]
    ids = pa.array([40, 7, 90, 8, 41])
    parts = [repeats.marked(s.hashes()(x), s) for x in texts]
    doc = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    anchor, cls, pos, run, halves = (np.concatenate(x) for x in zip(*parts, strict=True))
    packed = repeats._combined(ids, pa.array(np.zeros(len(ids), np.int32)), doc, anchor, cls, pos.astype(np.int64) << 32 | run, halves)
    assert len(packed) <= 2 * 8 < len(doc)
    found, ends, last = Counter(), Counter(), -1
    for batch in (packed.slice(0, 5), packed.slice(5)):
        for r in repeats._listed(batch).to_pylist():
            assert last <= r["group"] and r["group"] == (r["anchor"] % 8 if r["kind"] != repeats.DEFERRED else r["group"])
            last = r["group"]
            if r["kind"] == repeats.SUMMARY:
                ends[r["cls"]] += 1
            else:
                found.update((r["anchor"], r["cls"], r["id"], at >> 32, at & 0xFFFFFFFF) for at in [r["at"], *(r["more"] or [])])
    expected = Counter(zip((anchor & repeats.ANCHOR).tolist(), cls.tolist(), ids.take(pa.array(doc)).to_pylist(), pos.tolist(), run.tolist(), strict=True))
    assert found == expected and max(pos) > 65_536 and set(ends.values()) == {2}


def test_texts_are_looked_up_only_for_classes_that_share_half_a_context():
    s = suffixes.scheme()
    draw = random.Random(2)
    letters = lambda n: bytes(draw.randrange(97, 123) for _ in range(n))
    shared, seed = letters(120), letters(s.seed)
    texts = [letters(80) + seed + letters(80) for _ in range(40)] + [letters(90) + shared + letters(90) for _ in range(2)]
    ids = pa.array(range(len(texts)))
    parts = [repeats.marked(s.hashes()(x), s) for x in texts]
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    common = int(columns[0][0])  # as if the 40 texts had one anchor and nothing else in common
    alone = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    first = np.unique(alone, return_index=True)[1][:40]
    columns[0][first] = common
    anchor, cls, pos, run, halves = columns
    packed = repeats._combined(ids, pa.array(np.zeros(len(ids), np.int32)), alone, anchor, cls, pos.astype(np.int64) << 32 | run, halves)
    found = repeats._verdicts(pa.Table.from_batches([repeats._listed(packed)])).to_pylist()
    asked = {r["id"] for r in found if r["rep"]}
    assert {40, 41} <= asked and len(asked) < 20
    # What is asked are all classes of the two texts that share a half, and only bytes that happen to agree besides.
    half = s.context // 2
    for r in (r for r in found if r["rep"] and r["id"] >= 40):
        at, text, other = r["at"] >> 32, texts[r["id"]], texts[81 - r["id"]]
        assert text[at - half : at] in other or text[at + s.seed : at + s.seed + half] in other


@pytest.mark.parametrize("seed", range(40))
def test_merged_transforms(seed):
    draw = random.Random(seed)
    strings = [bytes(draw.choice(b"ab\0\xff") for _ in range(draw.randint(0, 14))) for _ in range(draw.randint(1, 9))]
    ids, length = np.array([draw.randint(0, 5) for _ in strings]), draw.randint(1, 4)
    owner, offset = suffixes.repeated_starts(strings, ids, length, draw.randint(1, 4))
    first = {}
    for s, i in zip(strings, ids, strict=True):
        for p in range(len(s) - length + 1):
            first[s[p : p + length]] = min(i, first.get(s[p : p + length], 99))
    expected = {(k, p) for k, s in enumerate(strings) for p in range(len(s) - length + 1) if first[s[p : p + length]] < ids[k]}
    assert set(zip(owner.tolist(), offset.tolist(), strict=True)) == expected


@pytest.mark.parametrize("depth", [1, 2, 4, 20])
def test_merge_refines_the_interleave_of_all_shards(depth):
    strings = [b"banana", b"bandana", b"ananas", b"banana", b""]
    shards = [strings[:2], strings[2:]]
    built = [bwt.shard(x) for x in shards]
    row, interval, common = bwt.merge([t for t, _, _ in built], depth)
    every = [x[k][o:] for x, (_, owner, offset) in zip(shards, built, strict=True) for k, o in zip(owner, offset, strict=True)]
    shared = lambda x, y: next((n for n, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    longest = [min(depth, max(shared(x, y) for j, y in enumerate(every) if j != k)) for k, x in enumerate(every)]
    assert common.tolist() == longest
    merged = [every[k][:depth] for k in row]
    assert merged == sorted(x[:depth] for x, n in zip(every, longest, strict=True) if n == depth)
    assert [x == y for x, y in zip(merged, merged[1:], strict=False)] == (interval[1:] == interval[:-1]).tolist()


def test_anchors_are_shared_by_equal_passages():
    s = substring.scheme(20, 5)
    draw = random.Random(3)
    common = [str(draw.randrange(99)).encode() for _ in range(20)]
    found = []
    for _ in range(2):
        words = [str(draw.random()).encode() for _ in range(31)] + common + [str(draw.random()).encode() for _ in range(17)]
        anchor, _, pos, _ = repeats.anchors(s.hashes()(b" ".join(words)), s)
        found.append({(int(a), int(p) - 31) for a, p in zip(anchor, pos, strict=True) if 31 <= p <= 46})
    assert found[0] & found[1]


def fingerprint(value):
    words = value.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[p : p + 3]) for p in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, radius=3):
    fps = {k: fp for k, (_, fp) in enumerate(rows)}
    parent = list(fps)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(j)] = find(i)
    smallest = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[find(k)] = min(doc_id, smallest.get(find(k), doc_id))
    return Counter((doc_id, f"{fp:016x}", smallest.get(find(k))) for k, (doc_id, fp) in enumerate(rows))


def test_simhash(docs):
    rows = [(r[0], fingerprint((r[1] or "").encode())) for r in corpus()]
    found = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert found == components(rows)


@pytest.mark.parametrize("frequent", [16, 2])
def test_near_dedup_stage_by_jaccard(spark, frequent, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    draw = random.Random(21)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 6)))
    line, rows = [word() for _ in range(40)], []
    for k in range(12):
        body = [word() for _ in range(draw.randint(20, 200))] + line * (k % 2)
        for _ in range(draw.randint(1, 12)):
            copy = list(body)
            for _ in range(draw.randint(0, 6)):
                copy[draw.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, " "), (902, "One two"), (903, "one TWO"), (None, rows[0][1]), (0, rows[0][1])]
    sets = []
    for _, value in rows:
        w = (value or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    expected = sorted(min(rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None) for g in set(group))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect())
    assert found == expected and 12 < len(expected) < len(rows) - 6


def test_near_dedup_keeps_columns_of_clashing_names(spark):
    a = "alpha beta gamma delta epsilon zeta"
    names = ["_id", "_var", "_text_checksum", "id", "var", "row", "fp", "component", "first_id"]
    df = spark.createDataFrame([(k, a if k < 3 else f"text {k}") for k in (2, 1, 4)], "doc_id int, text string")
    for n in names:
        df = df.withColumn(n, F.lit(n))
    for kept in (simhash.keep_one(df), jaccard.keep_one(df), substring.drop_repeats(df), quality.keep_good(df)):
        assert kept.columns == df.columns
        assert all(r[n] == n for r in kept.collect() for n in names)
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == [1, 4]


def test_lower_bound_of_the_embedding():
    draw = random.Random(4)
    counts = lambda x: [(x >> k & 1) + (x >> k + 1 & 1) for k in range(0, 64, 2)]
    for _ in range(200):
        x, y = draw.getrandbits(64), draw.getrandbits(64)
        unary = [(v | v >> 1) & simhash._LOW | (v & v >> 1 & simhash._LOW) << 1 for v in (x, y)]
        apart = sum(abs(a - b) for a, b in zip(counts(x), counts(y), strict=True))
        assert (unary[0] ^ unary[1]).bit_count() == apart <= (x ^ y).bit_count()


def test_ids_of_other_types_and_long_texts(spark):
    long = "word " * 250_000  # more than a megabyte
    rows = [("b", long), ("a", long + "end"), ("c", None), (None, long)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert {(r["doc_id"], r["n_removed"] > 0) for r in substring.digests(df).collect()} == {("a", False), ("b", True), ("c", False), (None, False)}
    assert {(r["doc_id"], r["n_removed"] > 0) for r in suffixes.digests(df).collect()} == {("a", False), ("b", True), ("c", False), (None, False)}
    assert {(r["doc_id"], r["text"] is None) for r in substring.drop_repeats(df).collect() if r["doc_id"] == "c"} == {("c", True)}
    ints = spark.createDataFrame([(1, "nothing"), (2, "a question about rivers and hills")], "doc_id int, text string")
    items = spark.createDataFrame([(7, "question about rivers and hills"), (None, "other words altogether here")], "item_id int, text string")
    found = decontaminate.contamination(ints, items)
    assert [(r["doc_id"], r["item_id"]) for r in found.collect()] == [(2, 7)] and dict(found.dtypes)["item_id"] == "int"
    assert packing.pack(df).groupBy().sum("length").first()[0] > 250_000


def test_long_words_train_whole():
    pieces = {bytes([c]): k for k, c in enumerate(b"ab")} | {b"ab": 2, b"aab": 3}
    p = np.array([0.2, 0.3, 0.4, 0.1])
    word = b"aab" * 40
    counts = np.zeros(4)
    for piece, n in langid.expected_counts(word, pieces, 3, p):
        counts[piece] += n
    short = np.zeros(4)
    for piece, n in langid.expected_counts(word[:30], pieces, 3, p):
        short[piece] += n
    lengths = np.array([1, 1, 2, 3])
    assert counts @ lengths == pytest.approx(len(word)) and counts == pytest.approx(short * 4)


def test_one_of_each_component_stays(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    rows = [(3, a), (1, a), (1, a), (None, a), (None, b), (None, b), (7, "x y z"), (7, "quite another text it is")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(0))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, a), (None, b), (7, "x y z"), (7, "quite another text it is")])


@pytest.mark.parametrize(("block", "small"), [(1024, 32), (4, 2)])
def test_links_lose_no_component(spark, block, small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_CELL", small)
    draw = random.Random(7)
    values = [draw.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        v = draw.choice(values)
        for _ in range(draw.randint(1, 4)):
            v ^= 1 << draw.randrange(64)
        values.append(v)
    values = sorted(set(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = [(r["src"], r["dst"]) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), block=block).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)
    parent = {v: v for v in signed}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        parent[find(a)] = find(b)
    groups = Counter(find(v) for v in signed)
    assert sorted(groups.values()) == sorted(Counter(c for (_, _, c) in components(list(enumerate(values))).elements()).values())


def test_quality_figures(docs):
    expected = Counter()
    for doc_id, value, *_ in corpus():
        value = value or ""
        words = value.encode().split()
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {p + d for p in range(len(words) - 2) if windows[tuple(words[p : p + 3])] > 1 for d in range(3)}
        lines = [x for x in value.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        n = len(words)
        failed = n < 50 or 100 * len(covered) > 50 * n
        expected[doc_id, n, sum(len(w.decode()) for w in words), sum(value.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed] += 1
    rows = quality.quality_rules(docs).collect()
    found = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert found == expected and not any(r["base_failed"] and r["kept"] for r in rows)


def test_order_of_rules_changes_no_verdict(spark):
    prose = " ".join(f"word{k} plain" for k in range(60))
    rows = spark.createDataFrame([(1, prose), (2, prose.replace(" plain", "### | |")), (3, prose.upper()), (4, prose + "\n" + "same line here\n" * 30)], "id long, text string")
    for rules in (list(quality.RULES), list(quality.RULES)[::-1]):
        judged = quality.with_figures(rows).select("id", quality.verdict(rules).isNull().alias("kept"))
        assert {r["id"] for r in judged.collect() if r["kept"]} == {1}


def test_runs_order_the_rules_alike(spark):
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    runs = [[(r.name, r.rate, r.cost) for r in quality.order_rules(docs_)] for _ in range(5)]
    assert all(run == runs[0] for run in runs) and sorted(n for n, *_ in runs[0]) == sorted(r.name for r in quality.RULES)
    assert len({cost for *_, cost in runs[0]}) >= 3


def test_a_costly_rule_goes_behind_a_cheap_one(spark):
    docs_ = spark.createDataFrame([(k, " ".join(f"word{k} thing{j}{'#' * (k % 3)}" for j in range(40))) for k in range(60)], "id long, text string")
    # The costly rule rejects a little more, and would go first by its rate alone.
    costly = quality.Rule("a_costly", r"length(regexp_replace(regexp_replace(text, '#', ''), '[^\\p{L}]', '')) < length(text) - 100 or n_symbols > 0")
    cheap = quality.Rule("b_cheap", "n_symbols > 40")
    found = quality.order_rules(docs_, (costly, cheap))
    assert [r.name for r in found] == ["b_cheap", "a_costly"] and found[0].rate < found[1].rate and found[1].cost > 100 * found[0].cost
    assert [r.name for r in quality.order_rules(docs_.limit(0), (costly, cheap))] == ["a_costly", "b_cheap"]


def test_work_counts_columns_and_regular_expressions_outside_quotes():
    plain, regex = quality.work("length(text) > 9"), quality.work("text rlike 'n_words split text'")
    assert plain == "(length(text)) * (1D + 0D / 1)" and regex == f"(length(text)) * (1D + {quality.REGEX}D / 1)"
    assert quality.work("true") == "(1) * (1D + 0D / 1)"


def test_url_rules(spark):
    pages = [(1, "http://a.Example.COM/en/7x?y"), (2, "https://b.com/en/z"), (3, "http://x.net/de/1"), (4, "http://q.example.net/de/88#t"), (5, "http://org/es/"), (6, None), (7, "no scheme"), (8, "http://notcom/en/"), (9, "://net"), (9, "://net"), (10, "http://com/e")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("id", F.lit(0)).withColumn("rule", F.lit("x"))
    expected = {1: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 2: ("b.com", "/en/z", "com/en/", "block"), 3: ("x.net", "/de/1", "net/de/", "allow"), 4: ("q.example.net", "/de/88", "example.net/de/8", "block"), 5: ("org", "/es/", "org/es/", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("notcom", "/en/", None, "allow"), 9: ("net", "", None, "allow"), 10: ("com", "/e", None, "allow")}
    for limit in (1000, 0):
        rows = urls.filter_urls(df, queries.URL_RULES, max_broadcast_bytes=limit).collect()
        assert len(rows) == len(pages)
        assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows} == expected


@pytest.mark.parametrize("limit", [1000, 0])
def test_longest_url_rule_wins(spark, limit):
    rules = [("block", "com", "/xxxxxxxxxxxx"), ("allow", "a.com", "/"), ("block", "b.com", "/xxx"), ("allow", "com", "/xxxxx"), ("allow", "c.com", "/q"), ("block", "c.com", "/q")]
    df = spark.createDataFrame([(1, "http://a.com/xxxxxxxxxxxxz"), (2, "http://a.com/x"), (3, "http://b.com/xxxxxx"), (4, "http://c.com/q")], "page_id int, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(df, rules, max_broadcast_bytes=limit).collect()}
    # 1: the whole rule counts, not the host alone; 3: of equal lengths the longer host; 4: block of one rule in both lists
    assert found == {1: ("com/xxxxxxxxxxxx", "block"), 2: ("a.com/", "allow"), 3: ("b.com/xxx", "block"), 4: ("c.com/q", "block")}


def test_packing(docs):
    encode = PackedEncoder(default_vocabulary()).encode
    whole = Counter()
    for doc_id, value, *_ in corpus():
        whole[doc_id, len(encode(value or "")) // 4 + 1] += 1
    rows = packing.pack(docs, width=64, rows_per_part=3).collect()
    by_sequence, pieces = {}, Counter()
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]] += r["length"]
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert pieces == Counter({k: k[1] * n for k, n in whole.items()})
    used = sum(r["length"] for r in rows)
    assert used / (64 * len(by_sequence)) > 0.9


def test_piece_checksums(spark):
    value = "The naïve café — 漢字 <|endoftext|> it's  \n\n fine\x85 ok"
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(default_vocabulary()).encode(value, add_special_tokens=False).ids + [1]
    row = packing.pack(spark.createDataFrame([(1, value)], "doc_id long, text string")).first()
    assert (row["doc_tokens"], row["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_fast_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    encoder, tokenizer = PackedEncoder(default_vocabulary()), Tokenizer.from_file(default_vocabulary())
    draw = random.Random(4)
    assert encoder.single is not None
    for _ in range(300):
        value = "".join(draw.choice("aeio tn'sÉé ñß\n\t.,!19#*$ ") for _ in range(draw.randint(0, 60)))
        assert np.frombuffer(encoder.encode(value), "<u4").tolist() == tokenizer.encode(value, add_special_tokens=False).ids


def test_plan_places_every_piece():
    draw = random.Random(9)
    histogram = {draw.randint(1, 100): draw.randint(1, 500) for _ in range(60)}
    patterns = packing.plan(histogram, 100)
    placed = Counter()
    for copies, lengths in patterns:
        assert sum(lengths) <= 100
        for n in lengths:
            placed[n] += copies
    assert placed == Counter(histogram) and len(patterns) <= 100


def test_plan_fills_sequences_with_a_hot_length():
    draw = random.Random(10)
    histogram = Counter(draw.randint(1, 2048) for _ in range(2000)) + Counter({120: 9001})
    patterns = packing.plan(histogram, 2048)
    placed = Counter()
    for copies, lengths in patterns:
        assert sum(lengths) <= 2048
        for n in lengths:
            placed[n] += copies
    assert placed == histogram and len(patterns) <= 2 * 2048
    bound = -(-sum(n * c for n, c in histogram.items()) // 2048)
    assert sum(copies for copies, _ in patterns) <= 1.02 * bound
    assert packing.plan({3: 7}, 10) == [(2, [3, 3, 3]), (1, [3])]


def segmentations(word, p):
    if not word:
        return 1.0
    return sum(p[word[:k]] * segmentations(word[k:], p) for k in range(1, len(word) + 1) if word[:k] in p)


def test_forward_algorithm_sums_all_segmentations():
    draw = random.Random(2)
    words = {bytes(draw.choice(b"ab") for _ in range(draw.randint(1, 3))) for _ in range(9)} | {b"a", b"b"}
    pieces = {w: k for k, w in enumerate(sorted(words))}
    p = np.array([[draw.random(), draw.random()] for _ in pieces] + [[0, 0]])
    tests = [bytes(draw.choice(b"ab") for _ in range(n)) for n in (1, 4, 9, 9)]
    for longest in (3,):
        found = langid.score_words(tests, pieces, longest, p)
        for w, row in zip(tests, found, strict=True):
            for lang in range(2):
                assert row[lang] == pytest.approx(np.log(segmentations(w, {x: p[k, lang] for x, k in pieces.items()})))
            assert row == pytest.approx(langid._score_long(w, pieces, longest, p))
    counts = dict.fromkeys(pieces.values(), 0.0)
    for piece, uses in langid.expected_counts(b"abab", pieces, 3, p[:, 0]):
        counts[piece] += uses
    assert sum(counts[k] * len(w) for w, k in pieces.items()) == pytest.approx(4)


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = text.remainder(F.col("doc_id"), 4) == 2
    rows = langid.identify(df, ~held_out, rows_per_language=40, keep={"held_out": held_out}).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_undetermined(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "123 !", "en"), (3, "", None), (4, "the and of", "en"), (5, "le la et", "fr"), (5, "le la et", "fr"), (None, "the of", "en")], "doc_id long, text string, lang string")
    rows = langid.identify(df, F.lit(True)).collect()
    assert Counter((r["doc_id"], r["lang_pred"]) for r in rows) == Counter({(1, "und"): 1, (2, "und"): 1, (3, "und"): 1, (4, "en"): 1, (5, "fr"): 2, (None, "en"): 1})
    assert all(r["lang_pred"] == "und" for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect())


@pytest.mark.parametrize("head", [50_000, 20])
def test_class_model_base_figures(docs, head):
    from zlib import crc32

    data = [(r[0], (r[1] or "").encode().lower().split()) for r in corpus()]
    held = lambda d: d is not None and crc32(str(d).encode()) % 10 == 0
    c = Counter()
    for d, ws in data:
        if not held(d):
            c.update([*ws, b"\n"])
    n, v = sum(c.values()), len(c)
    expected = sorted((d is None, d or 0, len(ws) + 1, sum(c[w] > 0 for w in [*ws, b"\n"]), round(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, b"\n"]), 6)) for d, ws in data)
    flag = text.remainder(F.col("doc_id"), 10) == 0
    rows = classlm.score(docs, ~flag, keep={"held_out": flag}, cluster_words=15, classes=4, head_words=head).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == expected
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in rows)


@pytest.mark.parametrize("head", [50_000, 60])
def test_class_model_scores_follow_the_definition(docs, head):
    flag = text.remainder(F.col("doc_id"), 10) == 0
    data = [(r[0], [*(r[1] or "").encode().lower().split(), b"\n"]) for r in corpus()]
    learnt = [ws for d, ws in data if d is None or zlib.crc32(str(d).encode()) % 10]
    c = Counter(w for ws in learnt for w in ws)
    texts = docs.where(~flag).select(F.col("text").cast("binary").alias("text"))
    model = classlm.train(texts, cluster_words=15, classes=4, head_words=head)
    find = classlm.class_of({w: x for w, (_, x) in model["head"].items()}, model["tails"])
    k = len(model["transition"])
    pairs = Counter((find(a), find(b)) for ws in learnt for a, b in zip([b"\n", *ws], ws, strict=False))
    n, v = Counter(), Counter()
    for w, x in c.items():
        n[find(w)] += x
        v[find(w)] += 1
    step = lambda a, b: (pairs[a, b] + classlm.ALPHA) / (sum(pairs[a, x] for x in range(k)) + classlm.ALPHA * k)
    word = lambda w: 1.0 if w == b"\n" else (c[w] + 0.1) / (n[find(w)] + 0.1 * (v[find(w)] + 1))
    for a in range(k):
        assert sum(step(a, b) for b in range(k)) == pytest.approx(1)
        if n[a] and a != model["end"]:  # the last part is that of all words not seen
            assert sum(word(w) for w in c if find(w) == a) + 0.1 / (n[a] + 0.1 * (v[a] + 1)) == pytest.approx(1)
    expected = sorted((d or -1, round(sum(np.log10(step(find(a), find(b)) * word(b)) for a, b in zip([b"\n", *ws], ws, strict=False)), 5)) for d, ws in data)
    rows = classlm.score(docs, ~flag, cluster_words=15, classes=4, head_words=head).collect()
    found = sorted((r["doc_id"] or -1, round(r["score"], 5)) for r in rows)
    assert [d for d, _ in found] == [d for d, _ in expected]
    assert [x for _, x in found] == pytest.approx([float(x) for _, x in expected], abs=1e-4)


def test_class_model_beats_unigrams(spark):
    rows = queries.op8_class_lm(spark, "/root/testdata/sf0.001").where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert rows["s"] > rows["b"]


def test_exchange_raises_the_likelihood():
    draw = np.random.default_rng(0)
    true = np.arange(30) % 3
    bigrams = np.zeros((32, 32), np.int64)
    bigrams[:30, :30] = draw.poisson(np.where((true[:, None] + 1) % 3 == true[None, :], 20, 1))
    of = classlm.exchange(bigrams, 3, fixed=2)[:30]
    assert all(len({true[k] for k in range(30) if of[k] == c}) == 1 for c in set(of.tolist()))


def distance(pattern, value):
    """(best distance, first end) of the pattern in any substring, by the plain recurrence."""
    row = list(range(len(pattern) + 1))
    best = (row[-1], 0)
    for end, c in enumerate(value, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, (row[-1], end))
    return best


@pytest.mark.parametrize("seed", range(25))
def test_myers_distance(seed):
    draw = random.Random(seed)
    pattern, value = ("".join(draw.choice("abc") for _ in range(n)) for n in (draw.randint(1, 80), draw.randint(1, 120)))
    found = decontaminate.best_substring(decontaminate.masks_of(pattern), len(pattern), value, len(pattern))
    expected = distance(pattern, value)
    assert found == (expected if expected[1] else found) and found[0] >= expected[0]


def test_contamination_finds_edited_items(spark):
    draw = random.Random(8)
    prose = lambda n: " ".join("".join(draw.choice("abcdefghijklmno") for _ in range(draw.randint(2, 8))) for _ in range(n))
    items = [(k, prose(30)) for k in range(6)] + [(6, None), (7, "  "), (8, "tiny"), (0, None)]
    rows = [(0, None), (1, ""), (2, prose(50)), (2, prose(50))]
    for k in range(60):
        item = list(items[k % 6][1])
        allowed = len(decontaminate.normalise("".join(item))) // decontaminate.CHARS_PER_ERROR
        for _ in range(draw.randint(0, allowed + 2)):
            at = draw.randrange(len(item))
            item[at] = draw.choice(["", "z", item[at] + "q"])
        rows.append((10 + k, prose(20) + " " + "".join(item).upper().replace(" ", "  ") + " " + prose(20)))
    rows.append((99, "a tiny dog")), rows.append((98, "destiny"))
    docs_ = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for d, value in rows:
        value = decontaminate.normalise(value)
        for i, item in items[:6]:
            item = decontaminate.normalise(item)
            best, _ = distance(item, value)
            if value and best <= len(item) // decontaminate.CHARS_PER_ERROR:
                expected.add((d, i, best))
    expected.add((99, 8, 0))
    for block in (20_000, 2):
        found = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.contamination(docs_, bench, item_block=block).collect()}
        assert found == expected
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs_, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _, _ in expected}


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software. The above copyright notice and this permission notice shall be included in all\ncopies. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions of source code must retain the above copyright notice. Redistributions in binary form must reproduce the above copyright notice. "


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        (MIT, ["MIT"]), (BSD, ["BSD-2-Clause"]), (BSD + "The name may not be used; it may be used to endorse or promote products derived from it.", ["BSD-3-Clause"]),
        ("x\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0"]), ("Released under the MIT License.\nAll rights reserved.", ["All-Rights-Reserved", "MIT"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]), ("under the GNU General Public License, version 3. or (at your option) any later version.", ["GPL-3.0-or-later"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC"]), ("no word of it", []), ("a licence to thrill", []), ("", []), (None, []),
    ],
)
def test_licences(value, expected):
    assert licences.licences(licences.identifiers(value)) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("Released under CC BY-SA 4.0.", ["CC-BY-SA"]), ("Dedicated under Creative Commons Zero.", ["CC0-1.0"]),
        ("It is free. Use it under a Creative Commons Attribution 4.0 International License.", ["CC-BY"]), ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0", ["CC-BY-NC-SA"]),
        ("Creative Commons Attribution-NoDerivatives 4.0", ["CC-BY-ND"]), ("// SPDX-License-Identifier: MIT\ncode", ["MIT"]), ("# SPDX-License-Identifier: GPL-2.0+\n", ["GPL-2.0-or-later"]),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0)", ["Apache-2.0", "MIT"]), ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", ["GPL-2.0", "MIT"]),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", ["LGPL-2.1-or-later"]), ("SPDX-License-Identifier: Unheard-1.0", []), ("Any person may use it, at any time.", []),
    ],
)
def test_licences_without_hint_words_and_by_identifier(value, expected):
    assert licences.licences(licences.identifiers(value)) == expected


def brute_identifiers(sentence, entries):
    """Leftmost longest entries at word boundaries, by trying every entry at every word."""
    words, out, at = licences.normalise(sentence).split(), [], 0
    while at < len(words):
        fits = [(len(e), name) for e, name in entries if words[at : at + len(e)] == e]
        if fits:
            out.append(max(fits)[1])
        at += max(fits)[0] if fits else 1
    return out


def test_every_known_sentence_is_found():
    for entry, name in licences.table().items():
        assert licences.sentence_identifiers(f"Then, {entry.upper()}, so.") == [name], entry


def test_licence_sentences_by_brute_force():
    draw = random.Random(12)
    table = licences.table()
    entries = [(e.split(), name) for e, name in table.items()]
    for _ in range(150):
        parts = [draw.choice([draw.choice(list(table)), "mit", "the", "license", "or later", "gnu general public", "cc by", "version 3", "x"]) for _ in range(draw.randint(1, 6))]
        sentence = " ".join(parts)
        if "spdx" not in sentence:
            assert licences.sentence_identifiers(sentence) == brute_identifiers(sentence, entries), sentence


def test_licence_rules_by_brute_force():
    draw = random.Random(13)
    names = sorted({x for _, rule in licences.RULES for x in rule})
    for _ in range(200):
        found = draw.choices([*names[:6], "later", "GPL-3.0", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", licences.UNKNOWN, licences.COPYRIGHT], k=draw.randint(0, 9))
        text_, expected = "".join(f"<{x}>" for x in found if x not in (licences.UNKNOWN, licences.COPYRIGHT)), set()
        for name, rule in licences.RULES:
            joined = "".join(f"<{x}>" for x in rule)
            while joined in text_:
                text_ = text_.replace(joined, "#", 1)
                expected.add(name)
        assert licences.licences(found) == sorted(expected)


def test_licence_recall_and_precision(spark):
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "All-Rights-Reserved", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: set((r["licences"] or "").split("|")) - {""} for r in licences.scan(docs_).collect()}
    truth = {r["doc_id"]: {v for k, v in lines.items() if k in (r["text"] or "")} for r in docs_.collect()}
    right = sum(len(found[d] & truth[d]) for d in truth)
    assert right >= 0.9 * sum(map(len, truth.values())) and right >= 0.9 * sum(map(len, found.values())) and right > 10


# Notices as projects carry them, written down apart from the table of sentences, with what they grant.
NOTICES = (
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2.", "GPL-2.0"),
    ("This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.", "GPL-3.0-or-later"),
    ("it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.", "AGPL-3.0"),
    ("modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "LGPL-2.0-or-later"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.", "MPL-1.1"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0", "Apache-2.0"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.", "MIT"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES", "0BSD"),
    ("This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "Zlib"),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)", "BSL-1.0"),
    ("Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL", "EUPL-1.2"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "OFL-1.1"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
    ("The contents of this file are subject to the terms of the Common Development and Distribution License, Version 1.0 only", "CDDL-1.0"),
    ("This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.", "Artistic-2.0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright notice.\n3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\n4. Neither the name of the author may be used to endorse or promote products derived from this software.", "BSD-4-Clause"),
    ("Use of this source code is governed by a BSD-style 3-Clause BSD License that can be found in the LICENSE file.", "BSD-3-Clause"),
    ("// SPDX-License-Identifier: BSD-4-Clause\n", "BSD-4-Clause"), ("# SPDX-License-Identifier: LGPL-2.0-or-later", "LGPL-2.0-or-later"), ("/* SPDX-License-Identifier: Zlib */", "Zlib"), ("-- SPDX-License-Identifier: MPL-1.1", "MPL-1.1"),
    ("SPDX-License-Identifier: MIT-0", "MIT-0"), ("SPDX-License-Identifier: PHP-3.01", "PHP-3.01"), ("SPDX-License-Identifier: AFL-2.1", "AFL-2.1"), ("SPDX-License-Identifier: GPL-1.0+", "GPL-1.0-or-later"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA"),
    ("We do not use the MIT License.", ""), ("The driver is no longer licensed under the GNU General Public License, version 2.", ""), ("Your driving license, version 2, was issued in Boston.", ""),
    ("The artistic director obtained a copy of the general permission.", ""), ("The eclipse was public in 2.0 minutes, under no license at all.", ""),
    ("GNU General Public License version 2.5", "GPL"),
)


def test_recall_and_precision_on_notices_apart_from_the_table():
    right = wrong = missed = 0
    for text_, expected in NOTICES:
        found, truth = set(licences.licences(licences.identifiers(text_))), {expected} - {""}
        right, wrong, missed = right + len(found & truth), wrong + len(found - truth), missed + len(truth - found)
    assert right >= 0.9 * (right + missed) and right >= 0.9 * (right + wrong), (right, wrong, missed)


def test_versions_are_never_guessed():
    for text_, expected in (("SPDX-License-Identifier: LGPL-2.0-or-later", ["LGPL-2.0-or-later"]), ("the GNU Lesser General Public License", ["LGPL"]), ("Mozilla Public License 7.3", ["MPL"]), ("GPL v2.5 licensed", [])):
        assert licences.licences(licences.identifiers(text_)) == expected, text_


def test_licence_rows(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, None), (3, "a licence to thrill")], "doc_id long, text string").withColumn("licences", F.lit(0))
    assert Counter(tuple(r) for r in licences.scan(df).collect()) == Counter({(1, "MIT", "MIT", 0): 2, (2, None, None, 0): 1, (3, None, "unknown", 1): 1})


def test_empty_tables(empty, spark):
    flag = text.remainder(F.col("doc_id"), 10) == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (
        suffixes.digests(empty), licences.scan(empty), decontaminate.contamination(empty, bench), langid.identify(empty, ~flag), packing.pack(empty), simhash.near_duplicates(empty), quality.quality_rules(empty),
        classlm.score(empty, ~flag), urls.filter_urls(empty.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), queries.URL_RULES), substring.digests(empty), quality.keep_good(empty), simhash.keep_one(empty), substring.drop_repeats(empty),
    ):
        assert df.count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(12)
    prose = lambda n: " ".join("".join(draw.choice("abcdefghijklmno") for _ in range(draw.randint(3, 7))) for _ in range(n))
    passage, item, first = prose(60), prose(30), prose(120)
    rows = [(1, first), (2, first), (3, prose(80) + " " + passage), (4, prose(80) + " " + passage), (5, prose(90) + " " + item), (6, "short"), (7, prose(100).replace(" ", " ### ")), (8, prose(150)), (9, None)]
    df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        if len(kept) < 4:
            assert out.columns == df.columns
            df = spark.createDataFrame(out.collect(), out.schema)
        kept.append({r["doc_id"] for r in out.collect()})
    assert kept == [{1, 2, 3, 4, 5, 8}, {1, 3, 4, 5, 8}, {1, 3, 4, 5, 8}, {1, 3, 4, 8}, {1, 3, 4, 8}]
    assert passage not in next(r["text"] for r in df.collect() if r["doc_id"] == 4)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 3, 4, 8}


def test_class_model_sizes_grow_without_bound():
    assert classlm.sizes_for(0) == (16, 2000, 50_000)
    small, middle, large = map(classlm.sizes_for, (400_000, 10**8, 10**10))
    assert small == (125, 2011, 50_102) and all(a < b < c for a, b, c in zip(small, middle, large, strict=True))
    assert all(classlm.sizes_for(v)[1] ** 2 <= 6_400 * v**0.5 for v in (10**6, 10**8, 10**10))


def test_exchange_moves_by_the_whole_likelihood():
    draw = np.random.default_rng(5)
    bigrams = draw.poisson(draw.gamma(0.3, 6, (24, 24)))

    def value(of, k=6):
        one = np.eye(k)[of]
        t = one.T @ bigrams @ one
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(t) - f(t.sum(1)) - f(t.sum(0))

    of = np.concatenate([np.arange(22) % 4, [4, 5]])
    for _ in range(2):
        for w in range(22):
            values = []
            for c in range(4):
                of[w] = c
                values.append(value(of))
            of[w] = int(np.argmax(values))
    assert classlm.exchange(bigrams, 4, fixed=2).tolist() == of.tolist()


def test_simhash_cells_are_not_broadcast(spark):
    """Spark sizes the 56 cells of a fingerprint as one row; a broadcast of the shared ones would grow with the table on the driver."""
    points = spark.range(100).select(F.xxhash64("id").alias("fp"))
    joins = [line for line in simhash.links(points)._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("BroadcastHashJoin" in line for line in joins)


def test_near_dedup_begins_with_simhash(spark):
    """Sets whose fingerprints differ by three bits at most are candidates; sets of one fingerprint meet their smallest key."""
    draw = random.Random(8)
    fps = [draw.getrandbits(62) for _ in range(6)]
    rows = [(k, fp) for k, fp in enumerate(fps)] + [(10, fps[0]), (11, fps[1] ^ 0b111), (12, fps[2] ^ 0b11110000)]
    found = {tuple(r) for r in jaccard.simhash_pairs(spark.createDataFrame(rows, "key long, fp long")).collect()}
    assert found == {(0, 10), (1, 11)}
    values = np.array([3, 1, -1], np.int64)
    assert jaccard._fingerprint(values) == 3 and jaccard._fingerprint(values[:0]) == 0


@pytest.mark.parametrize("listed", [0, 4, 64])
def test_candidates_meet_once(spark, listed, monkeypatch):
    """Lists of hashes and counts hash by hash give the pairs that brute force does, and repeated rows change nothing."""
    monkeypatch.setattr(jaccard, "LISTED", listed)
    draw = random.Random(5)
    sets = {k: (40 + k % 3, k % 5, set(draw.sample(range(30), draw.randint(2, 9)))) for k in range(40)}
    rows = [(h, k, n, g, h % 5) for k, (n, g, hs) in sets.items() for h in hs]
    found = {tuple(r) for r in jaccard.pairs_across(spark.createDataFrame(rows, "h long, key long, size long, g long, main long")).collect()}
    rest = lambda n: -(-4 * n // 5) - 1
    expected = set()
    for a, (na, ga, ha) in sets.items():
        for b, (nb, gb, hb) in sets.items():
            if a < b and ga != gb and ha & hb and len(ha & hb) >= -(-4 * (na + nb) // 9) - max(rest(na), rest(nb)):
                expected.add((a, b))
    assert found == expected and 0 < len(expected) < 300
