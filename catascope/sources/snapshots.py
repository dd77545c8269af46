"""Snapshot documents in and out: JSON sources with lenient defaults, exploded catalog frames, history tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catascope import schemas
from catascope.functions.names import constraint_kind, is_user_object, parse_pg_array, partition_strategy, policy_command

K = ["project_id", "database_id", "schema_hash"]


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array())


def read_schema_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Schema documents; absent lists are empty, the database id falls back to the database's name."""
    docs = _json(spark, path, schemas.SNAPSHOT).withColumn("database_id", F.coalesce("database_id", "database"))
    lists = ("tables", "enums", "domains", "composites", "views", "functions", "extensions", "settings")
    return docs.withColumns({c: _list(c) for c in lists}).withColumnRenamed("content_hash", "schema_hash")


def explode_catalog(docs: DataFrame) -> dict[str, DataFrame]:
    """Flat frames of every object kind, keyed by K."""
    t = docs.select(*K, F.explode("tables").alias("t")).select(*K, F.col("t.schema").alias("table_schema"), F.col("t.name").alias("table_name"), "t.*").drop("schema", "name")
    own = [*K, "table_schema", "table_name"]

    def inner(field: str, position: bool = False) -> DataFrame:
        rows = t.select(*own, F.posexplode(field).alias("pos", "x")).select(*own, "pos", "x.*")
        return rows if position else rows.drop("pos")

    def top(field: str) -> DataFrame:
        return docs.select(*K, F.explode(field).alias("x")).select(*K, "x.*")

    kids = t.select(*K, F.col("table_schema").alias("parent_schema"), F.col("table_name").alias("parent_name"), F.explode("partition_info.children").alias("c"))
    return {
        "table": t.select(*own, "comment", F.coalesce("reloptions", F.array().cast("array<string>")).alias("reloptions"), F.coalesce("rls_enabled", F.lit(False)).alias("rls_enabled"),
                          F.col("partition_info.strategy").alias("partition_strategy"), F.col("partition_info.key").alias("partition_key")),
        "column": inner("columns").withColumnRenamed("name", "column_name"),
        "constraint": inner("constraints"),
        "index": inner("indexes", True).withColumns({"is_valid": F.coalesce("is_valid", F.lit(True)), "backs_constraint": F.coalesce("backs_constraint", F.lit(False)), "include_columns": F.coalesce("include_columns", F.array().cast("array<string>"))}),
        "partition_child": kids.select(*K, "parent_schema", "parent_name", F.col("c.schema").alias("child_schema"), F.col("c.name").alias("child_name"), "c.bound"),
        "policy": inner("policies"), "trigger": inner("triggers"), "enum": top("enums"), "domain": top("domains"), "composite": top("composites"),
        "view": top("views"), "function": top("functions"), "extension": top("extensions"), "setting": top("settings"),
    }


def assemble_tables(
    tables: DataFrame, columns: DataFrame, constraints: DataFrame, indexes: DataFrame, children: DataFrame | None = None,
    policies: DataFrame | None = None, triggers: DataFrame | None = None, comments: DataFrame | None = None,
) -> DataFrame:
    """Nested tables from flat dumps keyed by (K, oid); unknown constraint kinds and strategies are dropped.

    ``comments`` (K, oid, column_name, comment): of the table where the column is null, else of the column.
    """
    key = [*K, "oid"]

    def gather(rows: DataFrame, order: str, name: str) -> DataFrame:
        fields = [c for c in rows.columns if c not in (*key, order)]
        return rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias(name))

    known = constraints.withColumn("kind", constraint_kind(F.col("contype"))).where("kind is not null").drop("contype")
    out = tables.withColumn("partition_strategy", partition_strategy(F.col("partstrat"))).drop("partstrat") if "partstrat" in tables.columns else tables
    if comments is not None:
        columns = columns.join(comments.where("column_name is not null").select(*key, "column_name", "comment"), [*key, "column_name"], "left")
        out = out.join(comments.where("column_name is null").select(*key, "comment"), key, "left")
    rules = policies.withColumn("command", policy_command(F.col("polcmd"))).drop("polcmd") if policies is not None else None
    parts = ((columns, "ordinal", "columns"), (known, "name", "constraints"), (indexes, "name", "indexes"), (children, "child_name", "children"), (rules, "name", "policies"), (triggers, "name", "triggers"))
    for rows, order, name in parts:
        if rows is not None:
            out = out.join(gather(rows, order, name), key, "left")
    return out


def user_relations(relations: DataFrame) -> DataFrame:
    """Ordinary and partitioned tables outside the system's schemas, of rows with schema and relkind."""
    return relations.where(is_user_object(F.col("schema")) & F.col("relkind").isin("r", "p"))


def own_indexes(indexes: DataFrame, inherits: DataFrame) -> DataFrame:
    """Indexes outside the system's schemas that no index of a parent table brought along (``inherits``: K, inhrelid)."""
    brought = inherits.select(*K, F.col("inhrelid").alias("indexrelid")).distinct()
    return indexes.where(is_user_object(F.col("schema"))).join(brought, [*K, "indexrelid"], "left_anti")


def assemble_types(fields: DataFrame, labels: DataFrame, checks: DataFrame) -> dict[str, DataFrame]:
    """Composite fields in attribute order, enum labels in sort order, domain checks by name."""
    own = [*K, "schema", "name"]
    put = lambda rows, order, value, name: rows.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(name))
    return {"composite": put(fields, "attnum", "field", "fields"), "enum": put(labels, "sort_order", "label", "labels"), "domain": put(checks, "check_name", "check", "checks")}


def read_planner_stats(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    docs = _json(spark, path, schemas.PLANNER).withColumnRenamed("schema_ref_hash", "schema_hash")
    at = lambda field: docs.select(*K, F.explode(field).alias("x")).select(*K, "x.*")
    cols = at("columns").select(
        *K, F.col("schema").alias("table_schema"), F.col("table").alias("table_name"), F.col("name").alias("column_name"), "null_frac", "n_distinct",
        parse_pg_array(F.col("most_common_vals")).alias("mcv"), F.transform(parse_pg_array(F.col("most_common_freqs")), lambda x: x.try_cast("double")).alias("mcf"),
        parse_pg_array(F.col("histogram_bounds")).alias("bounds"), "correlation",
    )
    return {
        "stat_table": at("tables").withColumnsRenamed({"schema": "table_schema", "name": "table_name"}),
        "stat_index": at("indexes").withColumnsRenamed({"schema": "index_schema", "name": "index_name"}),
        "stat_column": cols,
    }


def read_activity_stats(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Counters per node; absent counts are zero, absent times stay null, a primary has no lag."""
    docs = _json(spark, path, schemas.ACTIVITY).withColumnsRenamed({"schema_ref_hash": "schema_hash", "timestamp": "captured_at"}).withColumn("node_label", F.col("node.label"))

    def counters(field: str, schema: str, name: str) -> DataFrame:
        rows = docs.select(*K, "node_label", "captured_at", F.explode(field).alias("x")).select(*K, "node_label", "captured_at", "x.*")
        return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c, t in rows.dtypes if t == "bigint"}).withColumnsRenamed({"schema": schema, "name": name})

    lag = F.when(F.col("node.is_standby"), F.col("node.replication_lag_bytes"))
    return {
        "act_node": docs.select(*K, "node_label", "captured_at", "node.host", "node.is_standby", lag.alias("lag_bytes"), "node.stats_reset"),
        "act_table": counters("tables", "table_schema", "table_name"), "act_index": counters("indexes", "index_schema", "index_name"),
    }


def write_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("project_id", "database_id", "kind").parquet(path)


def export_snapshots(rows: DataFrame, path: str) -> None:
    """Every schema snapshot of every stream, compressed, under its stream's folders."""
    rows.where("kind = 'schema'").drop("kind").write.mode("overwrite").option("compression", "zstd").partitionBy("project_id", "database_id").parquet(path)
