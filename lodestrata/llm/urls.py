"""URL filter: a trie over reversed host labels and path segments, broadcast, longest match first.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased
(user and port stay part of it). Path: from there up to ``?``, ``#`` or the end.
A rule fits its host and all subdomains if the path starts with the rule's path.
Of several rules that fit, the longest wins: the one whose host and path together have most
characters, of equals the one with the longer host; if the same rule is listed for both actions, block wins.

Defined results: a null url, or one without ``://``, has an empty host and an
empty path, so no rule with a host fits it and it gets the default verdict.
Repeated rows stay repeated; extra columns are ignored; an empty table gives an
empty table; without rules every url gets the default.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.text import ascii_lower, map_arrow

#: A trie is broadcast up to this many bytes of rules; beyond it, rules are joined by host and folder.
MAX_BROADCAST_BYTES = 16_000_000


def split_host(host: str) -> list[str]:
    return host.split(".")[::-1]


class RuleTrie:
    """Host labels from the right, then path segments; the last segment of a rule is matched as a prefix."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for action, host, path in rules:
            node = self.root
            for label in split_host(host):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})  # None: the paths of the rules for exactly these labels
            *full, last = path.split("/")
            for segment in full:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})
            if ends.get(last, ("", ""))[1] != "block":
                ends[last] = (host + path, action)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, action) of the longest match, or None."""
        best, node = None, self.root
        segments = path.split("/")
        for label in split_host(host):
            node = node.get(label)
            if node is None:
                break
            found = self._along(node[None], segments) if None in node else None
            if found and (best is None or len(found[0]) >= len(best[0])):  # hosts come with growing length
                best = found
        return best

    @staticmethod
    def _along(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            ends = node.get(None)
            if ends:
                for n in range(min(len(segment), max(map(len, ends))), -1, -1):
                    if segment[:n] in ends:
                        best = ends[segment[:n]]
                        break
            node = node.get(segment)
            if node is None:
                break
        return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Columns id, host, path, rule, verdict. ``rules``: (action, host, path) with action allow or block."""
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = urls.select("id", host.alias("host"), path.alias("path"))
    if sum(len(h.encode()) + len(p.encode()) for _, h, p in rules) > max_broadcast_bytes:
        return _by_join(urls, rules, default).withColumnRenamed("id", id_col)
    spark = pages.sparkSession
    trie = spark.sparkContext.broadcast(RuleTrie(rules))
    id_type = urls.schema["id"].dataType.simpleString()

    def judge(batches):
        find = trie.value.find
        for batch in batches:
            found = [find(h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]
            rule = pa.array([f[0] if f else None for f in found], pa.string())
            verdict = pa.array([f[1] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["host"], batch["path"], rule, verdict], ["id", "host", "path", "rule", "verdict"])

    out = map_arrow(urls, judge, f"id {id_type}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


def _by_join(urls: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """The same for rule sets too large to broadcast: an equi-join on (host suffix, folder), then the prefix test."""
    spark = urls.sparkSession
    rows = [(h, p[: p.rfind("/") + 1], p, h + p, a) for a, h, p in rules]
    table = spark.createDataFrame(rows, "r_host string, r_folder string, r_path string, rule string, action string")
    keyed = urls.withColumn("uid", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.split("path", "/")
    folders = F.transform(
        F.sequence(F.lit(0), F.size(segments) - 1),
        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(segments, 1, i), "/"), F.lit("/"))),
    )
    spread = keyed.select("uid", "path", F.explode(suffixes).alias("r_host"), folders.alias("folders"))
    spread = spread.select("uid", "path", "r_host", F.explode("folders").alias("r_folder"))
    fits = spread.join(table, ["r_host", "r_folder"]).where(F.startswith("path", "r_path"))
    rank = F.struct(F.length("rule"), F.length("r_host"), F.col("action") == "block")
    best = fits.groupBy("uid").agg(F.max_by(F.struct("rule", "action"), rank).alias("best"))
    return keyed.join(best, "uid", "left").select(
        "id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
