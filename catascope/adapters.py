"""Operator inputs derived from the test tables, in Spark and (for the oracles) as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = ["project_id", "database_id", "schema_hash"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity captures (one row per node, table and time) from ``events``."""
    e = F.col("event_id")
    back = lambda n: F.col("ts") - F.make_dt_interval(days=(e % n).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.lit("p").alias("project_id"),
        F.concat(F.lit("db"), (F.col("user_id") % 3).cast("string")).alias("database_id"),
        (e % 3).cast("string").alias("content_hash"),
        F.lit("h").alias("schema_hash"),
        F.concat(F.lit("node"), (e % 4).cast("string")).alias("node_label"),
        F.lit("public").alias("table_schema"),
        F.col("event_type").alias("table_name"),
        F.col("ts").alias("captured_at"),
        F.floor("value").cast("long").alias("seq_scan"),
        (e % 7).alias("idx_scan"),
        (e % 100).alias("n_dead_tup"),
        F.when(e % 5 != 0, back(30)).alias("last_vacuum"),
        F.when(e % 6 != 0, back(17)).alias("last_autovacuum"),
        F.when(e % 3 != 0, back(11)).alias("last_analyze"),
        F.lit(None).cast("timestamp").alias("last_autoanalyze"),
        (e % 9).alias("vacuum_count"),
        (e % 4).alias("autovacuum_count"),
        F.when(e % 13 != 0, back(5)).alias("stats_reset"),
        e.alias("event_id"),
    )


CAPTURES = """captures AS (SELECT 'p' AS project_id, 'db' || (user_id % 3) AS database_id, CAST(event_id % 3 AS VARCHAR) AS content_hash,
 'h' AS schema_hash, 'node' || (event_id % 4) AS node_label, 'public' AS table_schema, event_type AS table_name, ts AS captured_at,
 CAST(floor(value) AS BIGINT) AS seq_scan, event_id % 7 AS idx_scan, event_id % 100 AS n_dead_tup,
 CASE WHEN event_id % 5 <> 0 THEN ts - to_days(CAST(event_id % 30 AS INT)) END AS last_vacuum,
 CASE WHEN event_id % 6 <> 0 THEN ts - to_days(CAST(event_id % 17 AS INT)) END AS last_autovacuum,
 CASE WHEN event_id % 3 <> 0 THEN ts - to_days(CAST(event_id % 11 AS INT)) END AS last_analyze,
 CAST(NULL AS TIMESTAMP) AS last_autoanalyze, event_id % 9 AS vacuum_count, event_id % 4 AS autovacuum_count,
 CASE WHEN event_id % 13 <> 0 THEN ts - to_days(CAST(event_id % 5 AS INT)) END AS stats_reset, event_id FROM events)"""


def latest_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest capture of every (stream, node, table)."""
    from catascope.operators.history import latest

    return latest(captures(spark, sf_dir), ["project_id", "database_id", "node_label", "table_name"], "captured_at")


LATEST = CAPTURES + """, act AS (SELECT * FROM captures QUALIFY row_number() OVER
 (PARTITION BY project_id, database_id, node_label, table_name ORDER BY captured_at DESC) = 1)"""


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of two catalog versions from ``part``: 1 lacks every tenth key, 2 another tenth, with changed types."""
    p = F.col("p_partkey")
    versions = F.explode(F.array(F.lit(1), F.lit(2))).alias("version")
    kind = F.when((F.col("version") == 2) & (p % 7 == 0), F.lit("text")).otherwise(
        F.element_at(
            F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), F.col("p_type")
        )
    )
    return (
        table(spark, sf_dir, "part").select("*", versions)
        .where(((F.col("version") == 1) & (p % 10 != 0)) | ((F.col("version") == 2) & (p % 10 != 1)))
        .select(
            F.lit("p").alias("project_id"), F.lit("db").alias("database_id"), F.concat(F.lit("v"), F.col("version").cast("string")).alias("schema_hash"),
            "version", F.lit("public").alias("table_schema"), F.concat(F.lit("t"), (F.col("p_size") % 10).cast("string")).alias("table_name"),
            F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), p.cast("string")).alias("column_name"),
            F.row_number().over(Window.partitionBy("version", F.col("p_size") % 10).orderBy("p_partkey")).alias("ordinal"),
            kind.alias("type_name"), (p % 3 == 0).alias("nullable"),
            F.when(p % 4 == 0, F.concat(F.lit("nextval('s"), (p % 5 + F.when(F.col("version") == 2, p % 2).otherwise(0)).cast("string"), F.lit("')"))).alias("default"),
            F.when(p % 6 == 0, F.concat(F.lit("c"), (p % 8).cast("string"))).alias("comment"), p.alias("p_partkey"), "p_retailprice",
        )
    )


TYPES = {
    "ECONOMY": "varchar(20)", "SMALL": "integer", "MEDIUM": "timestamp", "PROMO": "boolean", "STANDARD": "bigint", "LARGE": "uuid",
}

COLUMNS = """cols AS (SELECT 'p' AS project_id, 'db' AS database_id, 'v' || version AS schema_hash, version, 'public' AS table_schema,
 't' || (p_size % 10) AS table_name, replace(p_name, ' ', '_') || '_' || p_partkey AS column_name,
 row_number() OVER (PARTITION BY version, p_size % 10 ORDER BY p_partkey) AS ordinal,
 CASE WHEN version = 2 AND p_partkey % 7 = 0 THEN 'text' ELSE map {'ECONOMY': 'varchar(20)', 'SMALL': 'integer', 'MEDIUM': 'timestamp',
 'PROMO': 'boolean', 'STANDARD': 'bigint', 'LARGE': 'uuid'}[p_type] END AS type_name, p_partkey % 3 = 0 AS nullable,
 CASE WHEN p_partkey % 4 = 0 THEN 'nextval(''s' || (p_partkey % 5 + CASE WHEN version = 2 THEN p_partkey % 2 ELSE 0 END) || ''')' END AS "default",
 CASE WHEN p_partkey % 6 = 0 THEN 'c' || (p_partkey % 8) END AS comment, p_partkey, p_retailprice
 FROM part, (VALUES (1), (2)) v(version)
 WHERE (version = 1 AND p_partkey % 10 <> 0) OR (version = 2 AND p_partkey % 10 <> 1))"""
