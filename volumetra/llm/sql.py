"""DuckDB SQL for the corpus operators whose rows SQL can express, over the table documents."""

from __future__ import annotations

from .near_dedup import LINK
from .quality_rules import BOILERPLATE, GRAM, LEAST_KEPT, LEAST_WORDS, MOST_REPEATED, NAVIGATION, SENTENCE_END

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace(r"\s", r"[\x09-\x0D\x20]").replace("'", "''") + "'"


def _times(part: str, text: str = "line") -> str:
    return f"((strlen({text}) - strlen(replace({text}, '{part}', '')))::DOUBLE / {len(part.encode())})"


def _symbols(text: str) -> str:
    return f"(length({text}) - length(regexp_replace({text}, '[#*$%&|<>]', '', 'g')))"


def _sum_of_lengths(parts: str) -> str:
    return f"coalesce(list_sum(list_transform({parts}, lambda x: length(x))), 0)"


NEAR_DEDUP = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) s
  FROM words WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id a, b.doc_id b, count(*) n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= {LINK} * (x.n + y.n - shared.n)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM words UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT n_shingles, min(b) component_id, min(b) = doc_id kept
FROM reach JOIN words ON words.doc_id = reach.a LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

_N = f"({_times(' ')} + 1)"
_PASSES = " AND ".join(
    [
        f"{_symbols('line')} <= greatest(3, {_N} * 0.3::DOUBLE)",
        f"{_times('!!')} <= greatest(2, {_N} * 0.2::DOUBLE)",
        f"{' + '.join(_times(c) for c in '|»›•')} < greatest(3, {_N} * 0.2::DOUBLE)",
        f"regexp_matches(right(rtrim(line, ' '), 8), {_quoted(SENTENCE_END)})",
        f"NOT ({_N} <= 12 AND regexp_matches(line, {_quoted(NAVIGATION)}))",
        f"NOT regexp_matches(line, {_quoted(BOILERPLATE)})",
    ]
)

QUALITY_RULES = f"""
WITH texts AS (
  SELECT row_number() OVER () r, doc_id, coalesce(text, '') t FROM documents
), parts AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) lines FROM texts
), grams AS (
  SELECT r, i, array_to_string(w[i : i + {GRAM - 1}], ' ') gram FROM (SELECT r, w, unnest(range(1, len(w) - {GRAM - 2})) i FROM parts WHERE len(w) >= {GRAM})
), repeated AS (
  SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, gram) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) n FROM repeated, range({GRAM}) g(k) GROUP BY r
), judged AS (
  SELECT r, sum(length(line)) total, coalesce(sum(length(line)) FILTER (WHERE {_PASSES}), 0) good FROM (SELECT r, unnest(lines) line FROM parts) GROUP BY r
), counted AS (
  SELECT doc_id, len(w)::BIGINT n_words, {_sum_of_lengths('w')}::BIGINT word_chars, {_symbols('t')}::BIGINT n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT n_dup_lines, coalesce(covered.n, 0)::BIGINT n_repeat_words, coalesce(good >= {LEAST_KEPT} * total, true) enough
  FROM parts LEFT JOIN covered USING (r) LEFT JOIN judged USING (r)
)
SELECT * EXCLUDE (enough), n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND enough kept
FROM counted
"""

ORACLE_SQL = {"op2_near_dedup": NEAR_DEDUP, "op7_quality_rules": QUALITY_RULES}
