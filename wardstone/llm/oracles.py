"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from wardstone.llm import quality_rules as Q

_STRIP = r"'^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$'"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"
_KEY = f"translate(regexp_replace(line, {_STRIP}, '', 'g'), {_LOWER})"

OP8 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
keyed AS (SELECT doc_id, i, line, {_KEY} AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT doc_id, i, line, shared.k IS NOT NULL AND keyed.doc_id <> keeper AS dropped
  FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def _words(of: str) -> str:
    return rf"regexp_extract_all({of}, '[^\x20\x09-\x0D]+')"


def _share(chars: str) -> str:
    return f"(length(line) - length(translate(line, '{chars}', '')))"


OP10 = rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS x
  FROM base WHERE len(w) >= 3),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n >= 2),
covered AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
each AS (SELECT doc_id, unnest(lines) AS line FROM base),
parted AS (SELECT doc_id, line, {_words("line")} AS lw FROM each),
judged AS (
  SELECT doc_id, line, lw, len(lw) > 0 AND (
    {_share("|")} >= {Q.BARS} OR {_share(Q.SYMBOLS)} * {Q.SYMBOL_SHARE} > length(line) OR {_share("!")} * {Q.SHOUT_SHARE} > length(line)
    OR (len(lw) >= {Q.LONG_LINE} AND (list_sum(list_transform(range(0, len(lw), {Q.REPEAT_WINDOW}), lambda k: len(list_distinct(lw[k + 1:k + {Q.REPEAT_WINDOW}])))) * 4 < len(lw) OR {_share(".,;:?!…。，！？،؟।")} = 0))
    OR (len(lw) <= {Q.BOILERPLATE_WORDS} AND regexp_matches(line, '{Q.BOILERPLATE}'))) AS fails
  FROM parted),
by_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE len(lw) > 0) - count(DISTINCT line) FILTER (WHERE len(lw) > 0) AS n_dup_lines,
         sum(len(lw)) FILTER (WHERE fails) AS lost, count(*) FILTER (WHERE fails) AS n_lines_failed
  FROM judged GROUP BY doc_id),
counted AS (
  SELECT base.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(translate(text, '{Q.SYMBOLS}', '')) AS n_symbols, n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost, n_lines_failed
  FROM base JOIN by_doc USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND lost * {Q.MAX_LOSS} <= n_words AS kept,
       n_lines_failed
FROM counted
"""

_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id::VARCHAR AS item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
g AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
m AS (SELECT doc_id, i, g.n, item FROM g JOIN bw ON g.s = bw.s AND g.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

SQL = {"op6_benchmark_decontamination": OP6, "op8_line_dedup": OP8, "op10_quality_rules": OP10}
