"""Language identification by segmentation-marginalised unigrams.

Words (lower case, a leading space marking the word's start) are byte strings over
a fixed public vocabulary of byte pieces, in which every single byte is a piece.
Each language has a probability for every piece. A word's probability is the sum
over all its segmentations of the product of the pieces' probabilities, found by
the forward algorithm; a text's is the product over its words. The language with
the highest probability wins; the score is its posterior under equal priors.

The probabilities come from expectation maximisation over word counts, starting
from equal probabilities. Training rows are a documented sample: about
``rows_per_language`` rows of each language, chosen by a hash of the id; every row
is scored on its whole text.

Defined results: null text, or text without a letter: ``und`` with score 0. No
labelled row at all: ``und``. Words of any length train and are scored whole. Null ids are in no held-out fold and may train.
Ties go to the first language in alphabetical order. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.text import map_arrow
from lodestrata.session import discard, materialise

ROWS_PER_LANGUAGE, ROUNDS, SMOOTHING = 2000, 2, 0.05
#: The model is broadcast: (pieces + 1) x languages doubles. 50,256 pieces and 512 languages are 206 MB.
MAX_LANGUAGES = 512
CACHE_WORDS, LONG_WORD, SCORE_BLOCK = 300_000, 48, 20_000
#: Languages up to which the worker's tables have the rows above; beyond it rows shrink as languages grow, so memory stays.
FEW_LANGUAGES = 8


def has_letter(text: str) -> bool:
    """Numerals of any script are no letters."""
    return any(map(str.isalpha, text))


def rows_for(rows: int, languages: int) -> int:
    return max(1, rows * FEW_LANGUAGES // max(FEW_LANGUAGES, languages))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_pieces(path: str) -> dict[bytes, int]:
    with open(path, "rb") as source:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, source)}


def words_of(text: str) -> list[bytes]:
    """Words without their leading space, which is put before a word once, when it is scored."""
    return text.lower().encode("utf-8", "surrogatepass").split()


class PieceIndex:
    """Finds the pieces among substrings of many words at once, by 64-bit hashes in two direct tables.

    Pieces that share a slot of the first table are in the second, whose hash is salted until none collide.
    """

    BITS, BASE = 20, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: dict[bytes, int]):
        self.none = len(pieces)
        hashes = np.zeros(len(pieces) + 1, np.uint64)
        for piece, k in pieces.items():
            h = 0
            for c in piece:
                h = (h * int(self.BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
            hashes[k] = h
        self.hashes = hashes
        size, ids = 1 << self.BITS, np.arange(len(pieces), dtype=np.int32)
        self.first = np.full(size, self.none, np.int32)
        self.first[self._slot(hashes[:-1], 0)] = ids
        rest = ids[self.first[self._slot(hashes[:-1], 0)] != ids]
        for self.salt in range(1, 1000):
            slots = self._slot(hashes[rest], self.salt)
            if len(np.unique(slots)) == len(rest):
                break
        self.second = np.full(size, self.none, np.int32)
        self.second[slots] = rest

    def _slot(self, h: np.ndarray, salt: int) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * salt) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def extend(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Hashes of the substrings that are one byte longer."""
        return h * self.BASE + c

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, piece) of those hashes that are pieces'."""
        ids = self.first[self._slot(h, 0)]
        missed = np.flatnonzero(self.hashes[ids] != h)
        ids[missed] = self.second[self._slot(h[missed], self.salt)]
        which = np.flatnonzero((self.hashes[ids] == h) & (ids != self.none))
        return which, ids[which]


@lru_cache(maxsize=1)
def piece_table(path: str) -> tuple[dict[bytes, int], int, PieceIndex]:
    """(pieces, longest piece, index) of a vocabulary file: read once by each Python worker, whose tasks share it."""
    pieces = read_pieces(path)
    return pieces, max(map(len, pieces)), PieceIndex(pieces)


def expected_counts(word: bytes, pieces: dict[bytes, int], longest: int, p: np.ndarray) -> list[tuple[int, float]]:
    """(piece, expected uses) over the word's segmentations."""
    n = len(word)
    if n > LONG_WORD:
        return _expected_long(word, pieces, longest, p)
    forward = [0.0] * (n + 1)
    forward[0] = 1.0
    found = []
    for i in range(n):
        a = forward[i]
        for j in range(i + 1, min(n, i + longest) + 1):
            piece = pieces.get(word[i:j])
            if piece is not None:
                q = float(p[piece])
                forward[j] += a * q
                found.append((i, j, piece, q))
    total = forward[n]
    if not total:
        return []
    backward = [0.0] * n + [1.0]
    out = []
    for i, j, piece, q in reversed(found):
        backward[i] += q * backward[j]
        out.append((piece, forward[i] * q * backward[j] / total))
    return out


def _expected_long(word: bytes, pieces: dict[bytes, int], longest: int, p: np.ndarray) -> list[tuple[int, float]]:
    """The same in logarithms, for words whose probability would underflow."""
    n = len(word)
    ends: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]  # pieces by where they end
    for i in range(n):
        for j in range(i + 1, min(n, i + longest) + 1):
            piece = pieces.get(word[i:j])
            if piece is not None and p[piece] > 0:
                ends[j].append((i, piece, math.log(p[piece])))
    forward = [0.0] + [-math.inf] * n
    for j in range(1, n + 1):
        forward[j] = _log_sum([forward[i] + q for i, _, q in ends[j]])
    if forward[n] == -math.inf:
        return []
    later: list[list[float]] = [[] for _ in range(n)] + [[0.0]]
    out = []
    for j in range(n, 0, -1):
        after = _log_sum(later[j])
        for i, piece, q in ends[j]:
            later[i].append(q + after)
            out.append((piece, math.exp(forward[i] + q + after - forward[n])))
    return out


def _log_sum(values: list[float]) -> float:
    top = max(values, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def score_words(words: list[bytes], pieces: dict[bytes, int], longest: int, p: np.ndarray, index: PieceIndex | None = None) -> np.ndarray:
    """Log probability of every word under every language. ``p``: pieces + 1 rows, the last zero."""
    index = index or PieceIndex(pieces)
    out = np.empty((len(words), p.shape[1]))
    by_length: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        by_length.setdefault(len(word), []).append(k)
    for n, positions in by_length.items():
        if n > LONG_WORD:
            for k in positions:
                out[k] = _score_long(words[k], pieces, longest, p)
            continue
        step = rows_for(SCORE_BLOCK, p.shape[1])
        for lo in range(0, len(positions), step):
            at = positions[lo : lo + step]
            data = np.frombuffer(b"".join([words[k] for k in at]), np.uint8).reshape(len(at), n).T.astype(np.uint64) + np.uint64(1)
            forward = np.zeros((n + 1, len(at), p.shape[1]))
            forward[0] = 1.0
            for i in range(n):
                h = np.zeros(len(at), np.uint64)
                for j in range(i + 1, min(n, i + longest) + 1):
                    h = index.extend(h, data[j - 1])
                    which, piece = index.find(h)
                    if which.size:
                        forward[j, which] += forward[i, which] * p[piece]
            out[at] = np.log(np.maximum(forward[n], 1e-300))
            for k in np.flatnonzero((forward[n] < 1e-290).any(axis=1)).tolist():
                out[at[k]] = _score_long(words[at[k]], pieces, longest, p)
    return out


def _score_long(word: bytes, pieces: dict[bytes, int], longest: int, p: np.ndarray) -> np.ndarray:
    """The same with rescaling, for words whose probability would underflow."""
    n, scale = len(word), np.zeros(p.shape[1])
    forward = {0: np.ones(p.shape[1])}
    for j in range(1, n + 1):
        total = np.zeros(p.shape[1])
        for i in range(max(0, j - longest), j):
            piece = pieces.get(word[i:j])
            if piece is not None:
                total += forward[i] * p[piece]
        forward[j] = total
        forward.pop(j - longest - 1, None)
        small = np.maximum(total, 1e-300)
        if small.max() < 1e-100:
            scale += np.log(small)
            forward = {i: v / small for i, v in forward.items()}
    return np.log(np.maximum(forward[n], 1e-300)) + scale


def train(
    docs: DataFrame,
    *,
    vocabulary: str | None = None,
    rows_per_language: int = ROWS_PER_LANGUAGE,
    rounds: int = ROUNDS,
) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities. ``docs``: id, text, lang of the rows to learn from."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    path = vocabulary or default_vocabulary()
    pieces = read_pieces(path)
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((len(pieces) + 1, 0))
    scale = 1 << 20
    limit = F.lit(0)
    for lang in languages:
        limit = F.when(F.col("lang") == lang, math.ceil(scale * min(1.0, rows_per_language / counts[lang]))).otherwise(limit)
    sample = labelled.where(F.pmod(F.xxhash64("id"), F.lit(scale)) < limit).select("lang", "text")
    index = {lang: k for k, lang in enumerate(languages)}

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                k = index[lang]
                seen.update((k, word) for word in words_of(text))
            if len(seen) > CACHE_WORDS:
                yield _counted(seen)
                seen = Counter()
        yield _counted(seen)

    words = map_arrow(sample, count, "k int, word binary, n long").groupBy("k", "word").agg(F.sum("n").alias("n"))
    words = materialise(words, "langid-words")
    p = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(p)

        def expect(batches, shared=shared):
            (table, longest, _), p = piece_table(path), shared.value
            sums: dict[tuple[int, int], float] = {}
            for batch in batches:
                for k, word, n in zip(*(batch[c].to_pylist() for c in ("k", "word", "n")), strict=True):
                    for piece, uses in expected_counts(b" " + word, table, longest, p[:, k]):
                        sums[k, piece] = sums.get((k, piece), 0.0) + n * uses
            k, piece = zip(*sums, strict=True) if sums else ((), ())
            arrays = [pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(sums.values(), pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["k", "piece", "n"])

        rows = map_arrow(words, expect, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toArrow()  # at most pieces x languages
        shared.unpersist()
        p = np.full((len(pieces), len(languages)), SMOOTHING)
        p[rows["piece"].to_numpy(), rows["k"].to_numpy()] += rows["n"].to_numpy()
        p /= p.sum(axis=0)
    discard(words)
    return languages, np.vstack([p, np.zeros((1, len(languages)))])


def _counted(seen: Counter) -> pa.RecordBatch:
    k, word = zip(*seen, strict=True) if seen else ((), ())
    arrays = [pa.array(k, pa.int32()), pa.array(word, pa.binary()), pa.array(seen.values(), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["k", "word", "n"])


def identify(
    docs: DataFrame,
    learn_from: Column,
    *,
    vocabulary: str | None = None,
    rows_per_language: int = ROWS_PER_LANGUAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """Columns id, those of ``keep``, lang_pred, score. ``learn_from``: rows whose label may be learnt (a column of ``docs``)."""
    spark = docs.sparkSession
    known = docs.where(learn_from).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    languages, p = train(known, vocabulary=vocabulary, rows_per_language=rows_per_language)
    path, model = vocabulary or default_vocabulary(), spark.sparkContext.broadcast(p)
    extra = keep or {}
    rows = docs.select(F.col(id_col).alias("id"), *(c.alias(n) for n, c in extra.items()), F.col(text_col).alias("text"))
    given = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in given]

    def predict(batches):
        (pieces, longest, index), p = piece_table(path), model.value
        cache: dict[bytes, int] = {}
        scores = np.empty((0, len(languages)))
        for batch in batches:
            texts = [t if t and has_letter(t) else "" for t in batch["text"].to_pylist()]
            langs, best = ["und"] * len(texts), np.zeros(len(texts))
            if len(cache) > rows_for(CACHE_WORDS, len(languages)):
                cache, scores = {}, scores[:0]
            tokens = [words_of(t) for t in texts]
            new = list(set().union(*tokens).difference(cache))
            cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
            scores = np.vstack([scores, score_words([b" " + w for w in new], pieces, longest, p, index)])
            for k, ws in enumerate(tokens):
                if ws and languages:
                    total = scores[list(map(cache.__getitem__, ws))].sum(axis=0)
                    top = int(total.argmax())
                    langs[k], best[k] = languages[top], 1.0 / np.exp(total - total[top]).sum()
            columns = [*(batch[n] for n in names), pa.array(langs, pa.string()), pa.array(best, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given) + ", lang_pred string, score double"
    return map_arrow(rows, predict, schema).withColumnRenamed("id", id_col)
