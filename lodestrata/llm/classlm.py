"""Class-based bigram model (Brown clustering by exchange) for perplexity scores.

Tokens: words with A-Z lower-cased, then one end token. Every word has a class:

* the ``cluster_words`` most frequent words are clustered by the exchange algorithm: starting from frequency order
  dealt round, each word in turn moves to the class that raises the likelihood of the class bigrams most;
* every other of the ``head_words`` most frequent words makes one exchange step, all of them side by side: its neighbours'
  classes are counted over the corpus and it moves to the class where they are most likely;
* any other word, seen or not, has the class that most head words with its longest known ending (up to four bytes) have.

All three sizes grow with the vocabulary V and have no upper bound (``sizes_for``): classes and clustered words with its fourth
root, so the square of clustered words that the driver holds has at most 6,400 * sqrt(V) cells (3 million at 200,000 words,
64 million at 100 million), head words with its cube root. The counts cover every
training token, shuffled by word, and the class bigrams all neighbours. The model is
p(word | previous) = p(class | previous class) * p(word | class): transitions are smoothed by ``ALPHA``; a word has
(c + 0.1) / (n + 0.1 * (v + 1)) of its class, where the last part is that of the words not seen, so the probabilities
of all words sum to one. The end token is alone in its class.

Only the ``head_words`` most frequent words with their counts and classes are broadcast; the counts of
all other words reach the documents by a join on the word. Head words hold the
frequent keys, so the join has none.

Defined results: null text is the end token alone. A null doc_id is in no held-out
fold. Repeated rows are scored once each. An empty table gives an empty table;
without training rows, N and V are 0 and every token has the unseen share.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.text import map_arrow, texts_of
from lodestrata.session import materialise

#: Lower bounds of the numbers of classes, clustered words and head words, and their shares of a root of the vocabulary.
CLASSES, CLUSTERED, HEAD = (16, 5), (2000, 80), (50_000, 680)
#: Passes of the exchange, and bytes of the longest ending.
PASSES, ENDING = 2, 4
ALPHA, SMOOTHING = 0.1, 0.1
END = b"\n"  # no word holds white space
FLUSH, LONG, SLICE = 300_000, 48, 500


def key_of(word: bytes) -> bytes:
    """The word, or for a long one a digest that no word can equal."""
    return word if len(word) <= LONG else b" " + hashlib.sha256(word).digest()


def _table(names: list[str], columns: list, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def count_tokens(texts: DataFrame) -> DataFrame:
    """(word, c) over the column ``text`` (binary)."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch["text"]):
                seen.update(text.lower().split())
                seen[END] += 1
                if len(seen) > FLUSH:
                    yield _table(["word", "c"], [[key_of(w) for w in seen], seen.values()], [pa.binary(), pa.int64()])
                    seen = Counter()
        yield _table(["word", "c"], [[key_of(w) for w in seen], seen.values()], [pa.binary(), pa.int64()])

    return map_arrow(texts, count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def sizes_for(vocabulary: int) -> tuple[int, int, int]:
    """(classes, clustered words, head words) for so many distinct tokens."""
    fourth, third = vocabulary**0.25, vocabulary ** (1 / 3)
    return tuple(max(least, int(share * root)) for (least, share), root in ((CLASSES, fourth), (CLUSTERED, fourth), (HEAD, third)))


def _summed(texts: DataFrame, pairs_of) -> DataFrame:
    """(pair, n) over all texts. ``pairs_of`` is made on the executors and maps the tokens of a text, ends about it, to pair numbers."""

    def count(batches):
        pairs, held, n = pairs_of(), [], 0

        def flush():
            at, times = np.unique(np.concatenate(held), return_counts=True)
            return _table(["pair", "n"], [at, times.astype(np.int64)], [pa.int64(), pa.int64()])

        for batch in batches:
            for text in texts_of(batch["text"]):
                held.append(pairs([END, *text.lower().split(), END]))
                n += len(held[-1])
            if n > 4 * FLUSH:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return map_arrow(texts, count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _square(pairs: DataFrame, size: int) -> np.ndarray:
    """At most size * size counts, as an array of whole doubles."""
    found = pairs.toArrow()
    out = np.zeros(size * size)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def count_bigrams(texts: DataFrame, index: dict[bytes, int], size: int) -> np.ndarray:
    """size x size counts of neighbours; the end token also stands before the first word. Words not in ``index`` are ``size - 1``."""
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def pairs_of():
        get = shared.value.get

        def pairs(tokens):
            row = np.array([get(w, size - 1) for w in tokens], np.int64)
            return row[:-1] * size + row[1:]

        return pairs

    return _square(_summed(texts, pairs_of), size)


def placed(texts: DataFrame, of: dict[bytes, int], rest: list[bytes], table: np.ndarray, end: int) -> np.ndarray:
    """Class of each word of ``rest`` after one exchange step against the class bigrams ``table``: most mutual information with its neighbours' classes.

    ``of``: classes of the clustered words. Classes up to the last but two are open to words; ``end`` is that of the end token.
    """
    k = len(table)
    shared = texts.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(rest)}, of))

    def pairs_of():
        index, classes = shared.value
        number = {w: -1 - c for w, c in classes.items()} | index  # a clustered word is negative
        get, unknown = number.get, len(index)

        def pairs(tokens):
            row = np.array([get(w, unknown) for w in tokens], np.int64)
            word = (row >= 0) & (row < unknown)
            out = []
            for at, beside, side in ((slice(1, None), slice(None, -1), 0), (slice(None, -1), slice(1, None), 1)):
                ok = word[at] & (row[beside] < 0)
                out.append((row[at][ok] * 2 + side) * k + (-1 - row[beside][ok]))
            return np.concatenate(out)

        return pairs

    found = _summed(texts, pairs_of)
    n = table + ALPHA
    information = np.log(n * n.sum() / np.outer(n.sum(1), n.sum(0)))  # of class a before class b
    weights = np.stack([information, information.T])  # [side][class beside, own class]
    open_ = k - 2

    def choose(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:  # a task has whole words
            pair, times = batch["pair"].to_numpy(), batch["n"].to_numpy()
            word, side, beside = pair // (2 * k), pair // k % 2, pair % k
            order = np.argsort(word, kind="stable")
            word, gain = word[order], (weights[side, beside, :open_] * times[:, None])[order]
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
            for w, total in zip(word[starts].tolist(), np.add.reduceat(gain, starts, axis=0) if len(word) else (), strict=True):
                sums[w] = sums[w] + total if w in sums else total
        yield _table(["word", "cls"], [list(sums), [int(v.argmax()) for v in sums.values()]], [pa.int64(), pa.int64()])

    dealt = found.repartition(F.floor(F.col("pair") / (2 * k)))
    chosen = map_arrow(dealt, choose, "word long, cls long").toArrow()  # at most one row for each head word
    out = np.full(len(rest), -1, np.int64)
    out[chosen["word"].to_numpy()] = chosen["cls"].to_numpy()
    return out


def endings(of: dict[bytes, int]) -> dict[bytes, int]:
    """Class of every ending of up to ``ENDING`` bytes: the one that most of its words have, of equals the smallest."""
    seen: Counter = Counter()
    for word, c in of.items():
        seen.update((word[len(word) - n :], c) for n in range(min(ENDING, len(word)) + 1))
    best: dict[bytes, tuple[int, int]] = {}
    for (ending, c), n in seen.items():
        if (-n, c) < best.get(ending, (1, 0)):
            best[ending] = (-n, c)
    return {ending: c for ending, (_, c) in best.items()}


def class_of(known: dict[bytes, int], tails: dict[bytes, int]):
    """The class of any word, from the classes of the head and of endings."""
    get, tail = known.get, tails.get

    def find(word: bytes) -> int:
        c = get(word)
        for n in range(ENDING, -1, -1):
            if c is not None:
                return c
            if n <= len(word):
                c = tail(word[len(word) - n :])
        return c if c is not None else 0

    return find


def exchange(bigrams: np.ndarray, classes: int, fixed: int, passes: int = PASSES) -> np.ndarray:
    """Class of each of the ``len(bigrams) - fixed`` first words; each of the last ``fixed`` tokens keeps a class of its own.

    Maximises sum n(a,b) log n(a,b) - sum n(a) log n(a) - sum n(b) log n(b) over classes.
    """
    n = len(bigrams)
    free = n - fixed
    k = min(classes, max(free, 1)) + fixed
    of = np.concatenate([np.arange(free) % (k - fixed), np.arange(k - fixed, k)]).astype(np.int64)
    one = np.eye(k)[of]
    pairs = np.asarray(bigrams, np.float64)
    table = one.T @ pairs @ one
    right = pairs @ one  # word -> class that follows
    left = pairs.T @ one  # word <- class that precedes
    total_out, total_in = pairs.sum(1), pairs.sum(0)

    def f(x):
        return x * np.log(np.maximum(x, 1e-300)) * (x > 0)

    terms = f(table)  # kept up to date: only two rows and columns change with a word

    def refresh(c):
        terms[c, :], terms[:, c] = f(table[c, :]), f(table[:, c])

    for _ in range(passes):
        moved = 0
        for w in range(free):
            a, own = of[w], pairs[w, w]
            r, l = right[w].copy(), left[w].copy()
            # take w out of its class
            table[a, :] -= r
            table[:, a] -= l
            table[a, a] += own
            r[a] -= own
            l[a] -= own
            refresh(a)
            rows, columns = table.sum(1) + l, table.sum(0) + r  # of the other words, their neighbours w included
            # gain of putting w into each class c, from the cells that change
            beside, above = np.flatnonzero(r), np.flatnonzero(l)
            gain = (f(table[:, beside] + r[beside]) - terms[:, beside]).sum(1) + (f(table[above] + l[above, None]) - terms[above]).sum(0)
            d, dr, dl = np.diag(table), r, l
            gain += f(d + dr + dl + own) - f(d + dr) - f(d + dl) + f(d)
            gain -= f(rows + total_out[w]) - f(rows)
            gain -= f(columns + total_in[w]) - f(columns)
            b = int(np.argmax(gain[: k - fixed]))
            r[b] += own
            l[b] += own
            table[b, :] += r
            table[:, b] += l
            table[b, b] -= own
            refresh(b)
            if b != a:
                moved += 1
                of[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w, :]
                left[:, b] += pairs[w, :]
        if not moved:
            break
    return of


def train(texts: DataFrame, *, cluster_words: int | None = None, classes: int | None = None, head_words: int | None = None) -> dict:
    """The model. ``texts``: the column ``text`` (binary) of the training rows. Sizes that are not given are those of ``sizes_for``."""
    counts = materialise(count_tokens(texts), "token-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    classes, cluster_words, head_words = (given or own for given, own in zip((classes, cluster_words, head_words), sizes_for(v), strict=True))
    head = counts.orderBy(F.desc("c"), "word").limit(head_words).toArrow()
    c = dict(zip(map(bytes, head["word"].to_pylist()), head["c"].to_pylist(), strict=True))
    words = [w for w in c if w != END and len(w) <= LONG]  # a digest of a long word has no ending
    first, rest = words[:cluster_words], words[cluster_words:]
    index = {w: i for i, w in enumerate(first)} | {END: len(first)}
    size = len(first) + 2  # the clustered words, the end, any other
    bigrams = count_bigrams(texts, index, size)
    of = exchange(bigrams, classes, fixed=2)
    k = int(of.max()) + 1  # the last two: the end, words not clustered
    end, one = k - 2, np.eye(k)[of]
    known = {w: int(of[i]) for w, i in index.items()}
    if rest:
        cls = placed(texts, known, rest, one.T @ bigrams @ one, end)
    plain = {w: x for w, x in known.items() if w != END}
    plain |= {w: int(x) for w, x in zip(rest, cls, strict=True) if x >= 0} if rest else {}
    tails = endings(plain)
    find = class_of(plain, tails)
    known = {w: find(w) if w != END else end for w in (*c, END)}
    k = end + 1
    shared = texts.sparkSession.sparkContext.broadcast((known, tails))

    def pairs_of():
        of_word = class_of(*shared.value)

        def pairs(tokens):
            row = np.array([of_word(w) for w in tokens], np.int64)
            return row[:-1] * k + row[1:]

        return pairs

    table = _square(_summed(texts, pairs_of), k)

    def by_class(batches):
        of_word = class_of(*shared.value)
        for batch in batches:
            yield _table(["cls", "c"], [[of_word(w) for w in batch["word"].to_pylist()], batch["c"]], [pa.int64(), pa.int64()])

    sums = map_arrow(counts, by_class, "cls long, c long").groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()
    total = np.full(k, SMOOTHING)
    total[sums["cls"].to_numpy()] = sums["n"].to_numpy() + SMOOTHING * (sums["v"].to_numpy() + 1)
    transition = np.log10((table + ALPHA) / (table.sum(1, keepdims=True) + ALPHA * k))
    return {"counts": counts, "n": n, "v": v, "head": {w: (c.get(w, 0), x) for w, x in known.items()}, "tails": tails, "transition": transition, "total": np.log10(total), "end": end}


def score(
    docs: DataFrame,
    learn_from: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: dict[str, Column] | None = None,
    cluster_words: int | None = None,
    classes: int | None = None,
    head_words: int | None = None,
) -> DataFrame:
    """Columns id, those of ``keep``, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    texts = docs.where(learn_from).select(F.col(text_col).cast("binary").alias("text"))
    model = train(texts, cluster_words=cluster_words, classes=classes, head_words=head_words)
    small = {x: model[x] for x in ("head", "tails", "transition", "total", "end")}
    shared = spark.sparkContext.broadcast(small)
    extra = keep or {}
    rows = docs.select(F.col(id_col).alias("id"), *(c.alias(x) for x, c in extra.items()), F.spark_partition_id().alias("part"), F.col(text_col).cast("binary").alias("text"))
    given = [f for f in rows.schema.fields if f.name not in ("text", "part")]
    names = [f.name for f in given]

    def scan(batches):
        m = shared.value
        head, transition, end = m["head"], m["transition"], m["end"]
        order = {w: k for k, w in enumerate(head)}
        count, cls = (np.array([x[i] for x in head.values()]) for i in range(2))
        # entry -1: a word that the head doesn't have; its count comes by the join
        log_count = np.append(np.log10(count + SMOOTHING), 0.0)
        known, cls = np.append(count > 0, False), np.append(cls, 0).astype(np.int64)
        share = np.append(log_count[:-1] - m["total"][cls[:-1]], 0.0)
        share[order[END]] = 0.0
        of_word = class_of({}, m["tails"])
        get, k, serial = order.get, len(transition), 0
        flat = transition.ravel()
        for whole in batches:
            part = whole["part"][0].as_py() if len(whole) else 0
            for batch in (whole.slice(at, SLICE) for at in range(0, len(whole), SLICE)):
                out: list[list] = [[] for _ in range(5)]
                words, times, ends = [], [], [0]
                for text in texts_of(batch["text"]):
                    tokens = text.lower().split()
                    ids = np.array([*[get(w, -1) for w in tokens], order[END]], np.int64)
                    c, missing = cls[ids], np.flatnonzero(ids < 0)
                    rare = [tokens[i] for i in missing.tolist()]
                    c[missing] = list(map(of_word, rare))
                    tail = Counter(rare)
                    words.extend(map(key_of, tail))
                    times.extend(tail.values())
                    ends.append(len(words))
                    before = np.concatenate(([end], c[:-1]))
                    serial += 1
                    model_score = flat[before * k + c].sum() + share[ids].sum() - m["total"][c[missing]].sum()
                    values = ((part << 33) + serial, len(ids), int(known[ids].sum()), float(log_count[ids].sum()), float(model_score))
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                tails = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["word", "n"])
                types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                columns = [*(batch[x] for x in names), *(pa.array(x, t) for x, t in zip(out, types, strict=True)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tails)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "uid", "n_tokens", "n_known", "base", "model", "tail"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given)
    scanned = materialise(
        map_arrow(rows, scan, f"{kept}, uid long, n_tokens long, n_known long, base double, model double, tail array<struct<word: binary, n: long>>"),
        "scanned",
    )
    tail = scanned.select("uid", F.explode("tail").alias("t")).select("uid", F.col("t.word").alias("word"), F.col("t.n").alias("n"))
    # Words of the tail are many and rare: an equi-join on the word, then a sum for each document.
    found = tail.join(model["counts"], "word", "left").select(
        "uid", "n", F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("known"), (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING)).alias("log_count")
    )
    sums = found.groupBy("uid").agg(F.sum("known").alias("tail_known"), F.sum("log_count").alias("tail_log"))
    zero = F.lit(0.0)
    total = math.log10(model["n"] + SMOOTHING * (model["v"] + 1))
    joined = scanned.drop("tail").join(sums, "uid", "left")
    score_column = F.col("model") + F.coalesce("tail_log", zero)
    return joined.select(
        F.col("id").alias(id_col),
        *extra,
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(model["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_log", zero) - F.col("n_tokens") * total).alias("base_score"),
        score_column.alias("score"),
        F.pow(F.lit(10.0), -score_column / F.col("n_tokens")).alias("perplexity"),
    )
