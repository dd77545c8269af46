"""op2: repeated 50-byte strings removed from the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catascope.llm.common import table
from catascope.llm.suffix_dedup import dedup_report


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
#: Every 50-byte string with its least document, starts that another document precedes, and the runs they cover.
ORACLES: dict[str, str] = {
    "op2_suffix_dedup": """WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
 s AS (SELECT r, k, i, md5(substr(h, 2 * i - 1, 100)) AS g FROM (SELECT r, k, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM d WHERE length(h) >= 100)),
 m AS (SELECT g, min(k) AS least FROM s GROUP BY g), x AS (SELECT r, i FROM s JOIN m USING (g) WHERE least < k),
 y AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS b FROM x),
 z AS (SELECT r, i, sum(b) OVER (PARTITION BY r ORDER BY i) AS n FROM y), runs AS (SELECT r, n, min(i) AS a, max(i) + 49 AS e FROM z GROUP BY r, n),
 p AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY r ORDER BY n), 0) AS pe FROM runs),
 o AS (SELECT r, count(*) AS n_spans, sum(e - a + 1) AS n_removed, max(e) AS le, string_agg(substr(h, 2 * pe + 1, 2 * (a - 1 - pe)), '' ORDER BY n) AS head FROM p JOIN d USING (r) GROUP BY r)
 SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(le, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN o USING (r)""",
}
