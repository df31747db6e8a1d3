"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Every rule is a boolean expression over a few per-document figures. On a sample
the cost and the rejection rate of each rule are estimated in one job; rules then run in order of rejections
per cost, in one CASE expression whose later branches are not evaluated once a rule has rejected the
document. The cost is counted, not timed: the characters and figures that a rule reads on the rows of the
sample, and again ``REGEX`` times for each regular expression, so equal rows give equal orders on every machine.
The order changes the work only: a document is kept if no rule rejects it.

Defined results: a null or empty text has no words and fails the base rule.
A doc_id may be null or repeated; every row is judged by itself. Extra columns
are ignored. An empty table gives an empty table, with rules in the given order.
Repeated three-word windows are compared by their 64-bit XXH64 within one text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rows of the sample that orders the cascade, and the text of each that it looks at. They never change a verdict.
SAMPLE_ROWS, SAMPLE_CHARS = 2048, 20_000
#: What a regular expression costs for a character it is asked about, against a plain reading of it.
REGEX = 8
#: Characters that a rule goes through where it names one of these; any other name is a figure and counts once.
AMOUNTS = {"text": "length(text)", "words": "(word_chars + n_words)"}


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over text and the base figures; ``cost`` and ``rate`` are filled in by ``order_rules``."""

    name: str
    rejects: str
    cost: float = 0.0
    rate: float = 0.0


#: Thresholds in the manner of published web-corpus filters.
RULES = (
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * greatest(n_lines, 10)"),
    Rule("alphabetic_words", r"size(filter(words, w -> w rlike '\\p{L}')) * 10 < 8 * n_words"),
    Rule("upper_case", r"length(regexp_replace(text, '[^\\p{Lu}]', '')) * 2 > length(regexp_replace(text, '[^\\p{L}]', ''))"),
    Rule("bullets", r"size(filter(split(text, '\n'), l -> l rlike '^[ \t]*[-*•]')) * 10 > 9 * n_lines"),
    Rule("ellipses", r"size(filter(split(text, '\n'), l -> l rlike '(\\.\\.\\.|…)[ \t\r]*$')) * 10 > 3 * n_lines"),
)

_REPEAT_WORDS = """
size(array_distinct(flatten(transform(
  filter(sequence(1, size(sorted)), k ->
    (k > 1 and element_at(sorted, k).h = element_at(sorted, k - 1).h) or
    (k < size(sorted) and element_at(sorted, k).h = element_at(sorted, k + 1).h)),
  k -> array(element_at(sorted, k).i, element_at(sorted, k).i + 1, element_at(sorted, k).i + 2)))))
"""


def _blank(column: Column) -> Column:
    return F.translate(column, SPACES[1:], " " * (len(SPACES) - 1))


def with_figures(docs: DataFrame) -> DataFrame:
    """Columns text and the base figures. ``docs`` has id and text.

    ``part`` is not deterministic for Catalyst, so a filter that names it stays above
    the arrays; pushed below, it would build them anew for every element.
    """
    text = F.coalesce("text", F.lit(""))
    bare = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    trimmed = F.trim(_blank(text))
    out = docs.select(
        "id",
        text.alias("text"),
        F.when(F.length(trimmed) > 0, F.split(trimmed, " +")).otherwise(F.array().cast("array<string>")).alias("words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    windows = F.expr(
        "transform(sequence(0, size(words) - 3), i -> named_struct('h', xxhash64(words[i], words[i + 1], words[i + 2]), 'i', i))"
    )
    out = out.select(
        "id",
        "text",
        "words",
        "word_chars",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 4, F.sort_array(windows)).alias("sorted"),
    )
    repeats = F.when(F.col("sorted").isNull(), 0).otherwise(F.expr(_REPEAT_WORDS)).cast("long")
    return out.withColumns({"n_repeat_words": repeats, "part": F.spark_partition_id()}).drop("sorted")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def work(rejects: str) -> str:
    """SQL for the cost of a rule on a row, from the columns its text reads and the regular expressions it holds."""
    bare = re.sub(r"'(?:[^'\\]|\\.)*'", "''", rejects.lower())
    calls = len(re.findall(r"\b(?:rlike|regexp|regexp_\w+|split)\b", bare))
    read = [AMOUNTS.get(name, "1") for name in re.findall(r"\b(?:text|words|word_chars|n_\w+)\b", bare)] or ["1"]
    amount = " + ".join(read)
    return f"({amount}) * (1D + {REGEX * calls}D / {len(read)})"


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by estimated rejections per cost, best first; ties by cost, then name. ``docs`` has id and text."""
    spread = docs.where(F.abs(F.xxhash64("text")) % 4 == 0)
    rows = spread.select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(sample_rows).collect()
    if not rows:
        return list(rules)
    sample = docs.sparkSession.createDataFrame([(0, r["text"]) for r in rows], "id long, text string")
    sample = with_figures(sample).where(~base_failed() & (F.col("part") >= 0))
    both = [(F.avg(F.expr(work(r.rejects))).alias(f"cost{i}"), F.count_if(F.expr(r.rejects)).alias(f"hits{i}")) for i, r in enumerate(rules)]
    seen = sample.select(F.count("*").alias("total"), *(c for pair in both for c in pair)).first()
    found = [Rule(r.name, r.rejects, seen[f"cost{i}"] or 1.0, seen[f"hits{i}"] / max(1, seen["total"])) for i, r in enumerate(rules)]
    return sorted(found, key=lambda r: (-r.rate / r.cost, r.cost, r.name))


def verdict(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, or null; later rules are not evaluated."""
    out = F.when(base_failed(), F.lit("base"))
    for rule in rules:
        out = out.when(F.expr(rule.rejects), F.lit(rule.name))
    return out


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Columns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    figures = with_figures(rows).withColumn("rejected_by", verdict(order_rules(rows, rules)))
    return figures.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        F.col("rejected_by").isNull().alias("kept"),
    )


def keep_good(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    rows = docs.select(F.struct("*").alias("id"), F.col(text_col).alias("text"))
    rejected_by = verdict(order_rules(rows.select(F.lit(0).alias("id"), "text"), rules))
    return with_figures(rows).where(rejected_by.isNull() & (F.col("part") >= 0)).select("id.*")
