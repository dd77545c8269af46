"""Catalog documentation over all catalogs at once: listings, descriptions, search, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = ["project_id", "database_id", "schema_hash"]
TABLE = [*K, "table_schema", "table_name"]


def list_tables(tables: DataFrame, stats: DataFrame, children: DataFrame, schema: str | None = None, sort: str = "name", limit: int | None = 50, offset: int = 0, nodes: DataFrame | None = None) -> DataFrame:
    """Tables with rows, size and partitions in the asked order; ``total`` counts them before the limit.

    With ``nodes`` (activity rows) ``n_nodes`` tells how many nodes of the catalog report.
    """
    n = children.groupBy(*K, F.col("parent_schema").alias("table_schema"), F.col("parent_name").alias("table_name")).agg(F.count(F.lit(1)).alias("n_partitions"))
    rows = tables if schema is None else tables.where(F.col("table_schema") == schema)
    out = rows.select(*TABLE, "comment", "partition_strategy").join(stats.select(*TABLE, "reltuples", "table_size"), TABLE, "left").join(n, TABLE, "left").fillna(0, ["n_partitions"])
    total = rows.groupBy(*K).agg(F.count(F.lit(1)).alias("total"))
    order = {"name": [], "rows": [F.col("reltuples").desc_nulls_last()], "size": [F.col("table_size").desc_nulls_last()]}[sort]
    out = out.join(total, K)
    if nodes is not None:
        out = out.join(nodes.groupBy(*K).agg(F.countDistinct("node_label").alias("n_nodes")), K, "left").fillna(0, ["n_nodes"])
    out = out.orderBy(*order, *TABLE)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def describe_tables(
    tables: DataFrame, columns: DataFrame, constraints: DataFrame, indexes: DataFrame, stats: DataFrame, merged: DataFrame | None = None,
    children: DataFrame | None = None, profiles: DataFrame | None = None, stat_index: DataFrame | None = None, detail: str = "full",
    act_index: DataFrame | None = None,
) -> DataFrame:
    """One nested row per table. ``detail``: summary (structure and sizing), stats (sizing, partitions, profiles) or full.

    ``children`` are listed with their own sizing, ``profiles`` (a row per column) in the order of the columns, and
    ``stat_index`` puts its sizing beside each index, ``act_index`` (rows per node) its scans over all nodes; ``merged`` (a row per table) joins its counters.
    """
    if detail not in ("summary", "stats", "full"):
        raise ValueError(f"unknown detail {detail}; one of summary, stats, full")

    def gather(rows: DataFrame, order: list[str], fields: list[str], name: str) -> DataFrame:
        return rows.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias(name))

    out = tables.select(*TABLE, "comment").join(stats.select(*TABLE, "reltuples", "table_size"), TABLE, "left")
    if detail != "stats":
        sized = indexes
        if stat_index is not None:
            sizes = stat_index.select(*K, F.col("index_schema").alias("table_schema"), F.col("index_name").alias("name"), F.col("size").alias("index_size"))
            sized = indexes.join(sizes, [*K, "table_schema", "name"], "left")
        if act_index is not None:
            scans = act_index.groupBy(*K, F.col("index_schema").alias("table_schema"), F.col("index_name").alias("name")).agg(F.sum("idx_scan").alias("idx_scan"))
            sized = sized.join(scans, [*K, "table_schema", "name"], "left")
        out = out.join(gather(columns, ["ordinal"], ["column_name", "type_name", "nullable"], "columns"), TABLE, "left")
        out = out.join(gather(constraints, ["name"], ["kind", "definition"], "constraints"), TABLE, "left")
        out = out.join(gather(sized, ["name"], ["index_type", "is_unique", "definition", *(["index_size"] if stat_index is not None else []), *(["idx_scan"] if act_index is not None else [])], "indexes"), TABLE, "left")
    if detail != "summary" and children is not None:
        own = stats.select(*K, F.col("table_schema").alias("child_schema"), F.col("table_name").alias("child_name"), "reltuples", "table_size")
        kids = children.join(own, [*K, "child_schema", "child_name"], "left").withColumnsRenamed({"parent_schema": "table_schema", "parent_name": "table_name"})
        out = out.join(gather(kids, ["child_schema", "child_name"], ["bound", "reltuples", "table_size"], "partitions"), TABLE, "left")
    if detail != "summary" and profiles is not None:
        rows = columns.select(*TABLE, "column_name", "ordinal").join(profiles, [*TABLE, "column_name"])
        fields = [c for c in profiles.columns if c not in TABLE]
        out = out.join(gather(rows, ["ordinal"], fields, "profiles"), TABLE, "left")
    return out if merged is None else out.join(merged, TABLE, "left")


def search_catalog(text: str, tables: DataFrame, columns: DataFrame, constraints: DataFrame, indexes: DataFrame, limit: int | None = 30, offset: int = 0, views: DataFrame | None = None, functions: DataFrame | None = None, enums: DataFrame | None = None) -> DataFrame:
    """Case-insensitive substring over names, comments and definitions of every grain; enums also by their labels.

    Views, functions and enums (K, schema, name, ...) stand in the place of the table.
    """
    has = lambda c: F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))

    def hit(rows: DataFrame, kind: str, obj: Column, where: Column) -> DataFrame:
        return rows.where(where).select(*TABLE, F.lit(kind).alias("kind"), obj.alias("object"))

    by_name = has("table_name")
    parts = [
        hit(tables, "table", F.col("table_name"), by_name), hit(tables, "table_comment", F.col("comment"), ~by_name & has("comment")),
        hit(columns, "column", F.col("column_name"), has("column_name")), hit(columns, "column_comment", F.col("column_name"), ~has("column_name") & has("comment")),
        hit(constraints, "constraint", F.col("name"), has("definition")), hit(indexes, "index", F.col("name"), has("name") | has("definition")),
    ]
    labelled = F.exists(F.coalesce(F.col("labels"), F.array().cast("array<string>")), lambda x: F.lower(x).contains(text.lower()))
    for rows, kind, where in ((views, "view", has("name") | has("definition")), (functions, "function", has("name")), (enums, "enum", has("name") | labelled)):
        if rows is not None:
            named = rows.where(where).select(*K, F.col("schema").alias("table_schema"), F.col("name").alias("table_name"), F.lit(kind).alias("kind"), F.col("name").alias("object"))
            parts.append(named)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.orderBy(*TABLE, "kind", "object")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def find_related(constraints: DataFrame) -> DataFrame:
    """Every foreign key seen from both its tables, with a sample join."""
    fk = constraints.where("kind = 'foreign_key' and fk_table is not null").withColumn("own", F.concat_ws(".", "table_schema", "table_name"))
    on = F.array_join(F.zip_with("columns", "fk_columns", lambda a, b: F.concat(F.lit("a."), a, F.lit(" = b."), b)), " AND ")
    join = F.concat(F.lit("SELECT * FROM "), "own", F.lit(" a JOIN "), "fk_table", F.lit(" b ON "), on)
    both = F.explode(F.array(F.struct(F.lit("outgoing").alias("direction"), F.col("own").alias("this"), F.col("fk_table").alias("other")), F.struct(F.lit("incoming").alias("direction"), F.col("fk_table").alias("this"), F.col("own").alias("other")))).alias("x")
    return fk.select(*K, "name", join.alias("sample_join"), both).select(*K, "x.this", "x.direction", "x.other", "name", "sample_join")
