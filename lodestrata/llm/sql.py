"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_OP9 = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
rules(action, rule_host, rule_path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
judged AS (
  SELECT page_id, host, path,
         (SELECT max({'n': len(rule_host) + len(rule_path), 'rule': rule_host || rule_path, 'action': action}) FROM rules
          WHERE (parts.host = rule_host OR ends_with(parts.host, '.' || rule_host)) AND starts_with(parts.path, rule_path)) AS best
  FROM parts)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM judged
"""

_OP7 = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
figures AS (
  SELECT doc_id, text, words, len(words) AS n_words, len(lines) AS n_lines,
         CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines
  FROM base),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT doc_id, words, unnest(range(1, n_words - 1)) AS i FROM figures WHERE n_words > 2)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY doc_id),
all_figures AS (
  SELECT f.*, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM figures f LEFT JOIN covered c USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM all_figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR word_chars < 3 * n_words OR word_chars > 10 * n_words
    OR 10 * n_symbols > n_words
    OR 10 * n_dup_lines > 3 * greatest(n_lines, 10)
    OR len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) * 10 < 8 * n_words
    OR length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) * 2 > length(regexp_replace(text, '[^\p{L}]', '', 'g'))
    OR len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^[ \t]*[-*•]'))) * 10 > 9 * n_lines
    OR len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '(\.\.\.|…)[ \t\r]*$'))) * 10 > 3 * n_lines
  ) AS kept
FROM judged
"""

_OP10 = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
firsts AS (SELECT k, min(doc_id) AS f FROM windows GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (k) WHERE doc_id > f),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

#: op11: integer inner products of all queries with all rows, by list functions.
_OP11 = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""

#: op12: every kept term in every source of its language, then all pairs of sources term by term.
_OP12 = r"""WITH d AS (
  SELECT row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tok AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY ALL HAVING count(DISTINCT r) >= 30),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS whole, sum(coalesce(n, 0)) OVER (PARTITION BY lang, term) AS n_lang,
         sum(coalesce(n, 0)) OVER (PARTITION BY lang) AS whole_lang, count(*) OVER (PARTITION BY lang, source) AS terms
  FROM grp JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)),
p AS (
  SELECT lang, source, term, n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (whole + 5 * terms) AS BIGINT) AS p, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n_lang + 5)) // (whole_lang + 5 * terms) AS BIGINT) AS q FROM grid),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER w AS INTEGER) AS rank FROM parts
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) QUALIFY part = 'pair' OR row_number() OVER w <= 50"""

ORACLES = {"op7_quality_rules": _OP7, "op9_url_filter": _OP9, "op10_substring_dedup": _OP10, "op11_exact_topk": _OP11, "op12_source_divergence": _OP12}
