"""The operators that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

from lexispan.llm.quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, STOP_WORDS, THRESHOLDS, WINDOW
from lexispan.llm.substring_dedup import LENGTH

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
_RULE = " AND ".join(
    f"{measure} {sign} {bound}" for measure, least, most in THRESHOLDS for sign, bound in ((">=", least), ("<=", most)) if bound is not None
)

QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, sum(least({WINDOW}, coalesce(following - i, {WINDOW}))) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM twice) GROUP BY doc_id),
c AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  len(list_filter(words, lambda w: lower(rtrim(w, '.,;:!?')) IN ({_STOP}))) AS n_stop_words FROM d),
m AS (SELECT c.*, coalesce(r.n, 0) AS n_repeat_words, word_chars / cast(greatest(n_words, 1) AS double) AS mean_word_chars, n_symbols / cast(greatest(n_words, 1) AS double) AS symbols_per_word,
  n_stop_words / cast(greatest(n_words, 1) AS double) AS stop_word_ratio, n_dup_lines / cast(greatest(n_lines, 1) AS double) AS duplicate_line_ratio FROM c LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_RULE} AS kept, n_stop_words, n_lines FROM b"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
w AS (SELECT doc_id, generate_subscripts(words, 1) AS k, unnest(words) AS word FROM d),
g AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + {LENGTH - 1}], ' ')) AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - {LENGTH - 2})) AS i FROM d)),
twice AS (SELECT doc_id, i AS k, 1 AS hit FROM (SELECT *, count(*) OVER (PARTITION BY gram) AS n FROM g) WHERE n > 1),
m AS (SELECT doc_id, k, word, max(hit) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM w LEFT JOIN twice USING (doc_id, k)),
s AS (SELECT doc_id, count(*) AS n_words, count(gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (WHERE gone IS NULL) AS kept FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)"""
