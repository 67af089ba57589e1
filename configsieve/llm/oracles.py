"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others hash, draw, search or learn; tests hold them against brute force,
the libraries they stand in for, or held-out labels.
"""

from __future__ import annotations

OP10 = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), counted AS (
  SELECT doc_id, words, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS filled,
    length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_calls
  FROM base
), places AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM counted
), three AS (
  SELECT doc_id, p, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3
  FROM places WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), windows AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS times FROM three WHERE w3 IS NOT NULL
), covered AS (
  SELECT doc_id, count(DISTINCT q)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM windows WHERE times > 1) GROUP BY doc_id
), stats AS (
  SELECT c.*, (len(filled) - len(list_distinct(filled)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM counted c LEFT JOIN covered USING (doc_id)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR NOT word_chars BETWEEN 2 * n_words AND 15 * n_words
    OR (n_dup_lines > 0 AND 2 * n_dup_lines > n_lines) OR 10 * n_upper > 3 * word_chars
    OR 10 * n_digits > 3 * word_chars OR 5 * n_calls > n_words) AS kept
FROM based
"""

ORACLES: dict[str, str] = {"op10_quality_rules": OP10}
