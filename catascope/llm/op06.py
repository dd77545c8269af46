"""op6: quality rules over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catascope.llm.common import table
from catascope.llm.quality import BOILERPLATE, quality_report


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


QUERIES = {"op6_quality_rules": op6_quality_rules}
W = r"list_filter(regexp_split_to_array({}, '[ \t-\r]+'), lambda x: x <> '')"
PHRASES = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)


def _count(c: str) -> str:
    return f"(length(line) - length(regexp_replace(line, '{c}', '', 'g')))"


#: The default line rules, over one row per line.
FAILS = f"""n > 0 AND ({_count("[#*$%&|<>]")} / n > 0.2 OR {_count("[|»›•]")} / n > 0.15 OR (contains(line, '!!') AND len(regexp_extract_all(line, '!!([ \t-\r]|$)')) / n > 0.3)
 OR (n >= 4 AND regexp_matches(line, '[A-Z]{{4}}') AND {_count("[A-Z]")} > 0.7 * {_count("[A-Za-z]")}) OR (n >= 12 AND len(list_distinct(ws)) / n < 0.2)
 OR (n >= 12 AND NOT regexp_matches(line, '[.!?…。]')) OR (n <= 60 AND ({PHRASES})))"""
ORACLES: dict[str, str] = {
    "op6_quality_rules": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
 l AS (SELECT r, i, line, ws, len(ws) AS n FROM (SELECT *, {W.format("line")} AS ws FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d))),
 p AS (SELECT r, count(*) AS n_lines, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines, coalesce(sum(n) FILTER ({FAILS}), 0) AS n_removed_words FROM l GROUP BY r),
 w AS (SELECT r, {W.format("text")} AS ws FROM d), g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
 q AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1), e AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 8)) FROM q) GROUP BY r),
 b AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 n_dup_lines, coalesce(e.n, 0) AS n_repeat_words, n_lines, CAST(n_removed_words AS BIGINT) AS n_removed_words FROM d JOIN w USING (r) JOIN p USING (r) LEFT JOIN e USING (r))
 SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed_words >= 0.5 * n_words AS kept FROM b""",
}
