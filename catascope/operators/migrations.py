"""Lock risk of migration logs: a small rule table joined to the log, with size context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catascope.functions.names import format_bytes

K = ["project_id", "database_id", "schema_hash"]
TABLE = [*K, "table_schema", "table_name"]
RANK = {"safe": 0, "caution": 1, "dangerous": 2}
ANY = None
#: op, has_default, not_valid, concurrently, least major, major below, constraint type, safety, lock, duration; null: any value
#: --- fixed values: operations, safety and locks ---
RULES = (
    ("ADD COLUMN", False, ANY, ANY, ANY, ANY, ANY, "safe", "ACCESS EXCLUSIVE", "brief"),
    ("ADD COLUMN", True, ANY, ANY, 11, ANY, ANY, "caution", "ACCESS EXCLUSIVE", "brief if the default is immutable, else a table rewrite"),
    ("ADD COLUMN", True, ANY, ANY, 0, 11, ANY, "dangerous", "ACCESS EXCLUSIVE", "table rewrite"),
    ("DROP COLUMN", ANY, ANY, ANY, ANY, ANY, ANY, "safe", "ACCESS EXCLUSIVE", "brief, metadata only"),
    ("SET NOT NULL", ANY, ANY, ANY, 12, ANY, ANY, "caution", "ACCESS EXCLUSIVE", "scan unless a check proves it"),
    ("SET NOT NULL", ANY, ANY, ANY, 0, 12, ANY, "dangerous", "ACCESS EXCLUSIVE", "full scan"),
    ("ALTER COLUMN TYPE", ANY, ANY, ANY, ANY, ANY, ANY, "dangerous", "ACCESS EXCLUSIVE", "table rewrite"),
    ("ADD FOREIGN KEY", ANY, True, ANY, ANY, ANY, "foreign_key", "safe", "ACCESS EXCLUSIVE (brief)", "brief, metadata only"),
    ("ADD FOREIGN KEY", ANY, False, ANY, ANY, ANY, "foreign_key", "dangerous", "ACCESS EXCLUSIVE", "full scan of both tables"),
    ("ADD CHECK CONSTRAINT", ANY, True, ANY, ANY, ANY, "check", "safe", "ACCESS EXCLUSIVE (brief)", "brief, metadata only"),
    ("ADD CHECK CONSTRAINT", ANY, False, ANY, ANY, ANY, "check", "dangerous", "ACCESS EXCLUSIVE", "full scan"),
    ("ADD CONSTRAINT", ANY, True, ANY, ANY, ANY, "other", "safe", "ACCESS EXCLUSIVE (brief)", "brief, metadata only"),
    ("ADD CONSTRAINT", ANY, False, ANY, ANY, ANY, "other", "dangerous", "ACCESS EXCLUSIVE", "full scan or index build"),
    ("VALIDATE CONSTRAINT", ANY, ANY, ANY, ANY, ANY, ANY, "safe", "SHARE UPDATE EXCLUSIVE", "full scan without blocking writes"),
    ("CREATE INDEX CONCURRENTLY", ANY, ANY, True, ANY, ANY, ANY, "safe", "SHARE UPDATE EXCLUSIVE", "two scans without blocking writes"),
    ("CREATE INDEX", ANY, ANY, False, ANY, ANY, ANY, "dangerous", "SHARE (blocks writes)", "full scan blocking writes"),
    ("RENAME", ANY, ANY, ANY, ANY, ANY, ANY, "dangerous", "ACCESS EXCLUSIVE", "brief, breaks callers"),
)
RULE_SCHEMA = (
    "operation string, r_default boolean, r_not_valid boolean, r_concurrently boolean, r_from int, r_below int, r_type string, "
    "safety string, lock string, duration string"
)
#: Statement that undoes an operation, where one does; ``{t}``, ``{c}``, ``{o}``: table, column, constraint or index.
ROLLBACK = {
    "ADD COLUMN": "ALTER TABLE {t} DROP COLUMN {c};", "SET NOT NULL": "ALTER TABLE {t} ALTER COLUMN {c} DROP NOT NULL;",
    "ADD FOREIGN KEY": "ALTER TABLE {t} DROP CONSTRAINT {o};", "ADD CHECK CONSTRAINT": "ALTER TABLE {t} DROP CONSTRAINT {o};",
    "ADD CONSTRAINT": "ALTER TABLE {t} DROP CONSTRAINT {o};", "CREATE INDEX": "DROP INDEX CONCURRENTLY {o};",
    "CREATE INDEX CONCURRENTLY": "DROP INDEX CONCURRENTLY {o};", "RENAME": "ALTER TABLE {t} RENAME TO its old name;",
}


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*RULES], RULE_SCHEMA)


def operations(ops: DataFrame) -> DataFrame:
    """``ops`` with ``constraint_type`` reduced to the kinds that the rules tell apart."""
    kind = F.col("constraint_type") if "constraint_type" in ops.columns else F.lit(None).cast("string")
    return ops.withColumn("constraint_type", F.when(F.col("op") == "ADD CONSTRAINT", F.when(kind.isin("foreign_key", "check"), kind).otherwise("other")))


def assess(ops: DataFrame, stat_table: DataFrame, stat_column: DataFrame | None = None) -> DataFrame:
    """``ops`` with operation, safety, lock, duration, rollback and the table's size.

    DROP TABLE counts only where nothing else of its migration matched.
    """
    spark, ops = ops.sparkSession, operations(ops)
    fits = lambda rule, value: F.col(rule).isNull() | (F.col(rule) == F.coalesce(value, F.lit(False)))
    major = F.coalesce("major", F.lit(0))
    known = rules(spark).withColumn("op", F.when(F.col("r_type").isNotNull(), "ADD CONSTRAINT").when(F.col("r_concurrently").isNotNull(), "CREATE INDEX").otherwise(F.col("operation")))
    found = ops.join(F.broadcast(known), "op").where(  # as many rows as RULES
        fits("r_default", F.col("has_default")) & fits("r_not_valid", F.col("not_valid")) & fits("r_concurrently", F.col("concurrently"))
        & (F.col("r_from").isNull() | (major >= F.col("r_from"))) & (F.col("r_below").isNull() | (major < F.col("r_below")))
        & F.col("r_type").eqNullSafe(F.col("constraint_type"))
    ).drop("r_default", "r_not_valid", "r_concurrently", "r_from", "r_below", "r_type")
    matched = found.select(*K, "migration_id").distinct()
    drops = ops.where("op = 'DROP TABLE'").join(matched, [*K, "migration_id"], "left_anti")
    drops = drops.withColumns({"operation": F.col("op"), "safety": F.lit("dangerous"), "lock": F.lit("ACCESS EXCLUSIVE"), "duration": F.lit("brief, data is gone")})
    out = found.unionByName(drops).withColumn("table_schema", F.coalesce("table_schema", F.lit("public")))
    undo = F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLLBACK.items() for x in kv]), F.col("operation"))
    named = F.col("object_name") if "object_name" in out.columns else F.lit(None).cast("string")
    for mark, value in (("{t}", F.concat_ws(".", "table_schema", "table_name")), ("{c}", F.col("column_name")), ("{o}", named)):
        undo = F.replace(undo, F.lit(mark), F.coalesce(value, F.lit("<name>")))
    out = out.withColumn("rollback", undo)
    sizes = stat_table.select(*TABLE, F.col("reltuples").alias("rows"), format_bytes(F.col("table_size")).alias("size"))
    out = out.join(sizes, TABLE, "left")
    if stat_column is not None:
        nulls = stat_column.select(*TABLE, "column_name", "null_frac")
        out = out.join(nulls, [*TABLE, "column_name"], "left").withColumn("estimated_nulls", F.when(F.col("op") == "SET NOT NULL", F.round(F.col("null_frac") * F.col("rows")).cast("long"))).drop("null_frac")
    return out


def per_migration(assessed: DataFrame) -> DataFrame:
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("safety"))
    worst = F.max_by("safety", rank)
    return assessed.groupBy(*K, "migration_id").agg(F.bool_or(F.col("safety") == "dangerous").alias("has_dangerous"), worst.alias("worst"))
