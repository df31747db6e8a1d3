"""Substring dedup by seed and extend over words: every word of a passage of ``LENGTH`` words that also
starts in a document with a smaller id is removed. See ``repeats`` for the method.

Defined results: null or empty text has no words. Texts shorter than a passage stay
whole. Documents with equal ids don't remove from each other; those with a null id
neither remove nor lose anything. Repeated rows are treated alike. Passages are judged
on the input, so what is removed doesn't depend on any order. Extra columns pass through
``drop_repeats`` unchanged. An empty table gives an empty table.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import repeats
from lodestrata.llm.text import map_arrow, texts_of

LENGTH, SEED = 50, 12
_CACHE = 300_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes():
    """Maps a text to the hashes of its words."""
    get = _WordHash().__getitem__

    def hashes(text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(get, words), np.uint64, len(words))

    return hashes


def scheme(length: int = LENGTH, seed: int = SEED) -> repeats.Scheme:
    return repeats.Scheme(length, min(seed, length), word_hashes)


def _cut(rows: DataFrame, s: repeats.Scheme, keep: list[str]) -> DataFrame:
    """``keep``, n_words, n_removed, kept (binary): the kept words joined by one space."""
    spans = repeats.covered_spans(rows.select("id", "var", "text"), s)
    joined = rows.join(spans, ["id", "var"], "left").select(*dict.fromkeys([*keep, "text"]), "spans")
    fields = [f for f in joined.schema.fields if f.name in keep]

    def cut(batches):
        for batch in batches:
            n, removed, kept = [], [], []
            for text, spans in zip(texts_of(batch["text"]), repeats.spans_of(batch["spans"]), strict=True):
                words = text.split()
                n.append(len(words))
                if spans is not None:
                    gone = repeats.mask(len(words), spans)
                    removed.append(int(gone.sum()))
                    words = list(compress(words, (~gone).tolist()))
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            columns = [*(batch[f.name] for f in fields), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in fields), "n_words", "n_removed", "kept"])

    made = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())]
    return map_arrow(joined, cut, T.StructType([*fields, *made]))  # as types: names within a kept row may hold dots


def removed_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Columns id, n_words, n_removed, kept (the remaining words, joined by one space): one row for each document."""
    out = _cut(repeats.rows_of(docs, id_col, text_col), scheme(length), ["id"])
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.decode("kept", "UTF-8").alias("kept"))


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Columns id, n_words, n_removed, kept_sha256."""
    out = _cut(repeats.rows_of(docs, id_col, text_col), scheme(length), ["id"])
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated words cut from their texts; a text without removals (a null one too) stays as it is, one with no word left goes."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    var = repeats.telling(docs, id_col, text)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), var.alias("var"), text.alias("text"), F.col(text_col).isNull().alias("none"))
    rows = rows.withColumn("row", F.col("row").withField(f"`{text_col}`", F.lit(None).cast("string")))
    out = _cut(rows, scheme(length), ["row", "text", "none"])
    left = F.when(~F.col("none"), F.decode(F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")), "UTF-8"))
    kept = out.where((F.col("n_removed") == 0) | (F.length("kept") > 0))
    return kept.select(F.col("row").withField(f"`{text_col}`", left).alias("row")).select("row.*").select(*(f"`{c}`" for c in docs.columns))
