"""op8: benchmark decontamination over the whole documents and benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catascope.llm.common import table
from catascope.llm.decontaminate import decontaminate


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontamination": op8_decontamination}
WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
#: Windows of the items, all runs of as many words in the documents, and what the equal ones cover.
ORACLES: dict[str, str] = {
    "op8_decontamination": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents), b AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
 v AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
 g AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(ws) >= n)),
 o AS (SELECT r, i, n, item_id FROM g JOIN v USING (n, g)), h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) FROM o) GROUP BY r),
 t AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM o) GROUP BY r)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
 FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)""",
}
