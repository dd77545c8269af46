"""Checks of a query log against catalogs. ``facts`` has a row per query (see README for its columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = ["project_id", "database_id", "schema_hash"]
TABLE = [*K, "table_schema", "table_name"]
OUT = [*K, "query_id", "rule", "severity", "object"]


def references(facts: DataFrame) -> DataFrame:
    """A row per referenced table, schema defaulting to public."""
    rows = facts.select(*K, "query_id", F.explode("tables").alias("t"))
    return rows.select(*K, "query_id", F.coalesce("t.schema", F.lit("public")).alias("table_schema"), F.col("t.name").alias("table_name"), "t.alias", "t.context")


def _issue(rows: DataFrame, rule: str, severity: str, obj) -> DataFrame:
    return rows.select(*K, "query_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), obj.cast("string").alias("object"))


def missing_relations(facts: DataFrame, tables: DataFrame, views: DataFrame | None = None) -> DataFrame:
    known = tables.select(*TABLE)
    if views is not None:
        known = known.unionByName(views.select(*TABLE))
    rows = references(facts).join(known.distinct(), TABLE, "left_anti")
    return _issue(rows, "missing_relation", "error", F.concat_ws(".", "table_schema", "table_name")).distinct()


def _filters(facts: DataFrame) -> DataFrame:
    rows = facts.select(*K, "query_id", F.explode("filter_columns").alias("c"))
    return rows.select(*K, "query_id", F.col("c.qualifier").alias("qualifier"), F.col("c.column").alias("column_name"))


def _filtered_references(facts: DataFrame, bare: bool) -> DataFrame:
    """(TABLE, query_id, column_name): a query's references with its filter columns, both from the query's own row.

    A qualified column goes with the references that it names by table or alias, with ``bare`` an unqualified one with
    the only reference.
    """
    rows = facts.select(*K, "query_id", "tables", F.explode("filter_columns").alias("c")).select(*K, "query_id", "c", F.size("tables").alias("n"), F.explode("tables").alias("t"))
    named = (F.col("c.qualifier") == F.col("t.name")) | (F.col("c.qualifier") == F.col("t.alias"))
    if bare:
        named = named | (F.col("c.qualifier").isNull() & (F.col("n") == 1))
    return rows.where(named).select(*K, F.coalesce("t.schema", F.lit("public")).alias("table_schema"), F.col("t.name").alias("table_name"), "query_id", F.col("c.column").alias("column_name"))


def missing_columns(facts: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    rows = _filtered_references(facts, bare=False).join(tables.select(*TABLE), TABLE, "left_semi").join(columns.select(*TABLE, "column_name"), [*TABLE, "column_name"], "left_anti")
    return _issue(rows, "missing_column", "error", F.concat_ws(".", "table_name", "column_name")).distinct()


def expand_star(facts: DataFrame, columns: DataFrame) -> DataFrame:
    """Ordered column list of every table that a ``SELECT *`` refers to."""
    lists = columns.groupBy(*TABLE).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda x: x["column_name"]).alias("columns"))
    return references(facts.where("has_select_star")).select(*TABLE, "query_id").join(lists, TABLE)


def antipatterns(facts: DataFrame, stat_table: DataFrame, partitioned: DataFrame, large: float = 10_000) -> DataFrame:
    """``partitioned``: TABLE and partition_key (column names joined by commas)."""
    none = F.lit(None)
    select = F.col("statement_type") == "SELECT"
    refs = references(facts)
    big = stat_table.where(F.col("reltuples") > large).select(*TABLE)
    open_ = facts.where(select & ~F.col("has_where") & ~F.col("has_limit")).select(*K, "query_id")
    keys = partitioned.select(*TABLE, F.transform(F.split("partition_key", ","), lambda x: F.lower(F.trim(x))).alias("keys"))
    key = keys.select(*TABLE, F.explode("keys").alias("key"))
    on_key = _filters(facts).select(*K, "query_id", F.lower("column_name").alias("key"))
    parted = refs.where("context = 'select'").join(key, TABLE)
    unfiltered = parted.select(*K, "query_id", "table_schema", "table_name").distinct().join(parted.join(on_key, [*K, "query_id", "key"], "left_semi").select(*K, "query_id", "table_schema", "table_name").distinct(), [*K, "query_id", "table_schema", "table_name"], "left_anti")
    wrapped = facts.select(*K, "query_id", F.explode("func_wrapped").alias("w")).select(*K, "query_id", F.lower("w.column").alias("key"), "w.func")
    hint = F.when(F.lower("func").isin("date_trunc", "date", "extract", "date_part"), "compare with a range of times").when(F.lower("func").isin("lower", "upper"), "store the folded value").otherwise("keep the key bare")
    updates = facts.where("statement_type = 'UPDATE'").select(*K, "query_id", F.explode("update_targets").alias("u")).select(*K, "query_id", F.lower("u").alias("key"))
    tables_in = F.size(F.filter("tables", lambda t: t["context"] == "select"))
    parts = [
        _issue(facts.where(F.col("has_select_star")), "select_star", "warning", none),
        _issue(refs.join(open_, [*K, "query_id"], "left_semi").join(big, TABLE, "left_semi"), "unbounded_select", "warning", F.col("table_name")),
        _issue(facts.where(select & (tables_in > 1) & ~F.col("has_join")), "cartesian", "warning", none),
        _issue(facts.where(F.col("statement_type").isin("UPDATE", "DELETE") & ~F.col("has_where")), "write_without_where", "error", none),
        _issue(unfiltered, "partition_key_unfiltered", "warning", F.col("table_name")),
        _issue(parted.join(wrapped, [*K, "query_id", "key"]), "partition_key_wrapped", "warning", hint),
        _issue(refs.join(key, TABLE).join(updates, [*K, "query_id", "key"]), "partition_key_update", "warning", F.col("key")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def suggest_from_filters(facts: DataFrame, stat_table: DataFrame, indexes: DataFrame, least: float = 1000) -> DataFrame:
    """Filter columns of large tables that no index leads on; unqualified ones only where one table is referenced."""
    rows = _filtered_references(facts, bare=True).distinct()
    lead = indexes.select(*TABLE, F.get("columns", F.lit(0)).alias("column_name")).distinct()
    return rows.join(stat_table.where(F.col("reltuples") >= least).select(*TABLE), TABLE, "left_semi").join(lead, [*TABLE, "column_name"], "left_anti")


def validate(facts: DataFrame, issues: DataFrame) -> DataFrame:
    """Per query: valid (no error), counts, number of referenced objects."""
    counts = issues.groupBy(*K, "query_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    rows = facts.select(*K, "query_id", F.size("tables").alias("n_objects")).join(counts, [*K, "query_id"], "left").fillna(0, ["errors", "warnings"])
    return rows.withColumn("valid", F.col("errors") == 0)


def advise(suggestions: DataFrame, plan_advice: DataFrame) -> DataFrame:
    """Plan advice first, then suggestions from the log that no plan gave, per query."""
    key = [*K, "query_id", "table_name", "column_name"]
    both = plan_advice.select(*key, F.lit("plan").alias("origin")).unionByName(suggestions.select(*key, F.lit("query").alias("origin")))
    # a window over each suggestion: a join might send one side, which grows with the log, to every task
    given = F.max(F.col("origin") == "plan").over(Window.partitionBy(*key)) & F.col("column_name").isNotNull()
    return both.withColumn("given", given).where("origin = 'plan' or not given").drop("given")
