"""A catalog derived from ``part`` in SQL that both engines read (``dflt`` stands for a column's default)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catascope.adapters import table
from catascope.sources.scratch import shared_folder

PARTS = {
    "base": """SELECT 'db' || (p_partkey % 3) AS database_id,
 CASE p_size % 6 WHEN 0 THEN 'orders' WHEN 1 THEN 'item' WHEN 2 THEN 'Users' WHEN 3 THEN 'tags' WHEN 4 THEN 'log_all' ELSE 'log_' || (p_size % 4) END AS table_name,
 CASE p_partkey % 40 WHEN 0 THEN 'created_at' WHEN 1 THEN 'updated_at' WHEN 2 THEN 'order' WHEN 3 THEN 'isActive' WHEN 4 THEN 'is_open'
  ELSE replace(p_name, ' ', '_') || '_' || p_partkey END AS column_name, min(p_partkey) AS k, max(p_retailprice) AS price FROM part GROUP BY 1, 2, 3""",
    "cols": """SELECT 'p' AS project_id, database_id, 'v1' AS schema_hash, 'public' AS table_schema, table_name, column_name,
 row_number() OVER (PARTITION BY database_id, table_name ORDER BY k) AS ordinal, CASE k % 8 WHEN 0 THEN 'varchar(20)' WHEN 1 THEN 'integer' WHEN 2 THEN 'timestamp'
 WHEN 3 THEN 'boolean' WHEN 4 THEN 'bigint' WHEN 5 THEN 'uuid' WHEN 6 THEN 'timestamptz' ELSE 'text' END AS type_name, k % 3 = 0 AS nullable,
 CASE WHEN k % 9 = 0 THEN 'nextval(''s'')' END AS dflt, CASE WHEN k % 10 < 3 THEN 'always' END AS identity, CASE WHEN k % 6 = 0 THEN 'c' END AS comment, k, price FROM base""",
    "tabs": """SELECT project_id, database_id, schema_hash, table_schema, table_name, count(*) AS n_columns, min(k) AS k, CASE WHEN table_name = 'item' THEN 'i' END AS comment,
 CASE WHEN table_name = 'log_all' THEN 'range' END AS partition_strategy, CASE WHEN table_name = 'log_all' THEN 'created_at' END AS partition_key,
 CASE WHEN table_name = 'tags' THEN 'autovacuum_vacuum_scale_factor=0.05' ELSE '' END AS reloption, CAST(min(k) + 1 AS DOUBLE) * 30000 AS reltuples, min(k) * 100 AS relpages
 FROM cols GROUP BY 1, 2, 3, 4, 5""",
    "cons": """SELECT project_id, database_id, schema_hash, table_schema, table_name, table_name || '_pkey' AS name, 'primary_key' AS kind, column_name AS col, CAST(NULL AS VARCHAR(99)) AS fk_table, k
 FROM cols WHERE ordinal = 1 AND table_name <> 'Users' UNION ALL
 SELECT project_id, database_id, schema_hash, table_schema, table_name, CASE WHEN k % 2 = 0 THEN 'fk_' || table_name || '_' || column_name ELSE column_name || '_fkey' END, 'foreign_key', column_name,
 CASE WHEN k % 5 = 0 THEN 'public.item' ELSE 'public.orders' END, k FROM cols WHERE ordinal BETWEEN 2 AND 6""",
    "idx": """SELECT project_id, database_id, schema_hash, table_schema, table_name, CASE WHEN k % 3 = 0 THEN 'idx_' || table_name || '_' || column_name ELSE table_name || '_' || column_name || '_i' END AS name, ordinal AS pos,
 column_name AS col, CASE WHEN k % 7 = 0 THEN 'gin' ELSE 'btree' END AS index_type, k % 4 = 0 AS is_unique, ordinal = 1 AS is_primary, k FROM cols WHERE ordinal <= 14 AND k % 2 = 0""",
    "kids": """SELECT project_id, database_id, schema_hash, table_schema AS parent_schema, 'log_all' AS parent_name, table_schema AS child_schema, table_name AS child_name,
 'FOR VALUES FROM (''' || k || ''') TO (''' || (k + CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END) || ''')' AS bound, k FROM tabs WHERE table_name LIKE 'log!_%' ESCAPE '!' AND table_name <> 'log_all'""",
    "sets": """SELECT DISTINCT project_id, database_id, schema_hash, 'enable_partition_pruning' AS name, CASE WHEN database_id = 'db1' THEN 'off' ELSE 'on' END AS setting FROM tabs""",
}
SQL = ",\n".join(f"{k} AS ({v})" for k, v in PARTS.items())
K = ["project_id", "database_id", "schema_hash"]
#: Where the frames of a session and input were written, and their types.
_WRITTEN: dict[tuple[str, str], dict[str, tuple]] = {}


def derived(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The same rows as frames of the operators' shape."""
    part = table(spark, sf_dir, "part")
    frame = lambda name: spark.sql("WITH " + ", ".join(f"{k} AS ({v})" for k, v in PARTS.items()).replace("FROM part ", "FROM {part} ") + f" SELECT * FROM {name}", part=part)
    one = lambda c: F.split(c, ",")
    frames = {
        "table": frame("tabs").withColumns({"reloptions": F.array_compact(F.array(F.nullif("reloption", F.lit("")))), "rls_enabled": F.lit(False)}),
        "column": frame("cols").withColumnRenamed("dflt", "default"),
        "constraint": frame("cons").withColumns({"columns": one("col"), "fk_columns": F.array("col"), "definition": F.concat_ws(" ", "kind", "col")}),
        "index": frame("idx").withColumns({
            "columns": one("col"), "include_columns": F.array().cast("array<string>"), "predicate": F.lit(None).cast("string"),
            "definition": F.concat(F.lit("on "), "col"), "is_valid": F.lit(True), "backs_constraint": F.col("is_primary"),
        }),
        "partition_child": frame("kids"),
        "setting": frame("sets"),
        "stat_table": frame("tabs").select(*K, "table_schema", "table_name", "reltuples", "relpages", (F.col("relpages") * 8192).alias("table_size")),
        "stat_index": frame("idx").select(
            *K, F.col("table_schema").alias("index_schema"), F.col("name").alias("index_name"), ((F.col("k") % 50) * 100).alias("relpages"),
            (F.col("k") * 1000).cast("double").alias("reltuples"), F.col("k").alias("size"),
        ),
    }
    return frames


def catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The derived frames, written once per session and input: every query reads what it needs, nothing stays cached."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _WRITTEN:
        path = shared_folder(spark, "catalog")
        frames = derived(spark, sf_dir)
        for name, frame in frames.items():
            frame.write.parquet(f"{path}/{name}")
        _WRITTEN[at] = {name: (f"{path}/{name}", frame.schema) for name, frame in frames.items()}
    return {name: spark.read.schema(schema).parquet(path) for name, (path, schema) in _WRITTEN[at].items()}
