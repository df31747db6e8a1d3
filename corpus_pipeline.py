"""The corpus pipeline: quality rules, near-dedup (Jaccard of 0.8 over five-word shingles), substring dedup, benchmark decontamination, packing.

Each stage works on all rows that the one before it kept. Rows with equal ids are
one document after near-dedup (the first of a component stays). Every stage takes nulls in any column,
an empty table (and gives one), repeated rows and extra columns of any name, which pass through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontaminate, jaccard, packing, quality, substring
from lodestrata.session import discard, materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; a null or empty text is rejected, repeated rows are judged alike."""
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id (null last), of equal ids one text; null counts as empty text."""
    return jaccard.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a null text stays null, one with no word left goes, null ids lose nothing."""
    return substring.drop_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; null and blank texts and items match nothing."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; a null text is the closing id alone, repeated rows are packed once each."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL has no XXH64 and no tokenizer; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        discard(before)  # a stage's table goes as soon as the next one is written; the input is none
    return STAGES[-1][1](spark, docs, sf_dir)
