"""Multi-node activity: merged counters per object, unused, stale and imbalanced objects.

``act`` has the latest row per node and object. A selector (list of node labels) narrows the nodes; unknown
labels are ignored and an empty list gives no rows. Nodes per catalog are few, so per-node lists are bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = ["project_id", "database_id", "schema_hash"]
TABLE = [*K, "table_schema", "table_name"]
INDEX = [*K, "index_schema", "index_name"]


def select_nodes(act: DataFrame, nodes: Sequence[str] | None = None) -> DataFrame:
    return act if nodes is None else act.where(F.col("node_label").isin(*nodes) if nodes else F.lit(False))


def merge_tables(act: DataFrame) -> DataFrame:
    """Sums and latest times per table over its nodes, in one aggregate."""
    return act.groupBy(*TABLE).agg(
        F.sum("seq_scan").alias("seq_scan_sum"),
        F.sum("n_dead_tup").alias("n_dead_tup_sum"),
        F.max(F.greatest("last_vacuum", "last_autovacuum")).alias("last_vacuum_max"),
        F.max(F.greatest("last_analyze", "last_autoanalyze")).alias("last_analyze_max"),
        F.sum(F.col("vacuum_count") + F.col("autovacuum_count")).alias("vacuum_count_sum"),
    )


def index_scan_sum(act_index: DataFrame) -> DataFrame:
    return act_index.groupBy(*INDEX).agg(F.sum("idx_scan").alias("idx_scan_sum"))


def per_node(act: DataFrame, nodes: DataFrame, objects: Sequence[str], counter: str) -> DataFrame:
    """A row per object and known node of its catalog; zero where the object is absent on the node."""
    every = act.select(*objects).distinct().join(nodes.select(*K, "node_label").distinct(), K)
    have = act.groupBy(*objects, "node_label").agg(F.sum(counter).alias(counter))
    return every.join(have, [*objects, "node_label"], "left").withColumn(counter, F.coalesce(counter, F.lit(0)))


def merge_window(nodes: DataFrame) -> DataFrame:
    """Start of the merged counting window; partial if a node never tells its reset."""
    return nodes.groupBy(*K).agg(
        F.min(F.coalesce("stats_reset", "captured_at")).alias("window_start"),
        F.bool_or(F.col("stats_reset").isNull()).alias("partial"),
        F.array_sort(F.collect_set("node_label")).alias("nodes"),
    )


def with_planner(objects: DataFrame, stats: DataFrame, on: Sequence[str]) -> DataFrame:
    """Planner figures beside any object frame: one left join, nulls where the planner knows nothing."""
    return objects.join(stats, list(on), "left")


def unused_indexes(act_index: DataFrame, cat_index: DataFrame, stat_index: DataFrame) -> DataFrame:
    """Indexes in the activity that no node scanned, primary keys aside; unknown ones keep empty names."""
    sums = index_scan_sum(act_index).where("idx_scan_sum = 0")
    sizes = stat_index.groupBy(*INDEX).agg(F.max("size").alias("size"))
    known = cat_index.select(*K, F.col("table_schema").alias("index_schema"), F.col("name").alias("index_name"), "table_name", "definition", "is_primary")
    out = sums.join(known, INDEX, "left").where(~F.coalesce("is_primary", F.lit(False))).join(sizes, INDEX, "left")
    return out.select(
        *INDEX, F.coalesce("table_name", F.lit("")).alias("table_name"), F.coalesce("definition", F.lit("")).alias("definition"),
        F.coalesce("size", F.lit(0)).alias("size"),
    ).orderBy(F.col("size").desc(), "index_name")


def stale_stats(act: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """(node, table) not analysed for more than ``days``, with whole days since, or never (null)."""
    last = F.greatest("last_analyze", "last_autoanalyze")
    age = F.unix_micros(as_of) - F.unix_micros(last.cast("timestamp"))
    out = act.withColumn("last_analyzed", last).where(last.isNull() | (age > days * 86_400_000_000))
    return out.select(*TABLE, "node_label", "last_analyzed", F.floor(age / 86_400_000_000).cast("long").alias("days_since"))


def seq_scan_imbalance(act: DataFrame, ratio: int = 5) -> DataFrame:
    """Tables that one node scans at least ``ratio`` times as often as the least of the scanning nodes."""
    per = act.groupBy(*TABLE, "node_label").agg(F.sum("seq_scan").alias("seq_scan"))
    low = F.min(F.when(F.col("seq_scan") > 0, F.col("seq_scan")))
    out = per.groupBy(*TABLE).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("seq_scan") > 0).alias("busy"),
        F.max_by("node_label", F.struct("seq_scan", "node_label")).alias("hot_node"), F.max("seq_scan").alias("high"), low.alias("low"),
    )
    out = out.where("n >= 2 and busy >= 2").withColumn("multiplier", F.expr("high div low"))
    return out.where(F.col("multiplier") >= ratio).select(*TABLE, "hot_node", "multiplier")


def compare_nodes(
    act: DataFrame, stat_table: DataFrame, nodes: DataFrame | None = None, unused: DataFrame | None = None, imbalance: DataFrame | None = None, stale_days: int = 7
) -> DataFrame:
    """Per node and table: planner sizing (the same for all nodes), counters, and whether the capture lags.

    With ``nodes``, each of them has a row for every table, without data where it reports none. With ``unused``
    (unused indexes) and ``imbalance`` their findings stand beside the table.
    """
    freshest = act.groupBy(*K).agg(F.max("captured_at").alias("freshest"))  # a row per catalog
    lag = F.unix_micros(F.col("freshest").cast("timestamp")) - F.unix_micros(F.col("captured_at").cast("timestamp"))
    out = act.join(freshest, K).withColumns({"stale": lag > stale_days * 86_400_000_000, "has_data": F.lit(True)}).select(*TABLE, "node_label", "seq_scan", "idx_scan", "captured_at", "stale", "has_data")
    if nodes is not None:
        every = nodes.select(*K, "node_label").distinct().join(act.select(*TABLE).distinct(), K)
        out = every.join(out, [*TABLE, "node_label"], "left").withColumn("has_data", F.coalesce("has_data", F.lit(False)))
    out = with_planner(out, stat_table, TABLE).select(*TABLE, "node_label", "reltuples", "seq_scan", "idx_scan", "captured_at", "stale", "has_data")
    if unused is not None:
        names = unused.groupBy(*K, F.col("index_schema").alias("table_schema"), "table_name").agg(F.array_sort(F.collect_set("index_name")).alias("unused_indexes"))
        out = out.join(names, TABLE, "left")
    return out if imbalance is None else out.join(imbalance, TABLE, "left")


def detect(unused: DataFrame, stale: DataFrame, imbalance: DataFrame, bloated: DataFrame, kind: str = "all", schema: str | None = None, table: str | None = None) -> DataFrame:
    """One findings frame; a schema or table filter narrows every part."""
    name = lambda schema_col: F.concat_ws(".", schema_col, F.col("table_name"))
    parts = {
        "unused_indexes": unused.select(*K, F.lit("unused_indexes").alias("kind"), F.col("index_schema").alias("s"), F.col("table_name").alias("t"), F.col("index_name").alias("object"), F.col("size").cast("double").alias("measure")),
        "stale_stats": stale.select(*K, F.lit("stale_stats").alias("kind"), F.col("table_schema").alias("s"), F.col("table_name").alias("t"), F.concat_ws("@", name(F.col("table_schema")), "node_label").alias("object"), F.col("days_since").cast("double").alias("measure")),
        "seq_imbalance": imbalance.select(*K, F.lit("seq_imbalance").alias("kind"), F.col("table_schema").alias("s"), F.col("table_name").alias("t"), F.col("hot_node").alias("object"), F.col("multiplier").cast("double").alias("measure")),
        "bloated_indexes": bloated.select(*K, F.lit("bloated_indexes").alias("kind"), F.col("table_schema").alias("s"), F.col("table_name").alias("t"), F.col("name").alias("object"), F.col("ratio").cast("double").alias("measure")),
    }
    out = None
    for k, part in parts.items():
        if kind in ("all", k):
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"unknown kind {kind}; one of all, {', '.join(parts)}")
    for col, value in (("s", schema), ("t", table)):
        out = out if value is None else out.where(F.col(col) == value)
    return out.withColumnsRenamed({"s": "table_schema", "t": "table_name"})
