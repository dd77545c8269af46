"""Index bloat from planner sizes and autovacuum health from settings and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catascope.functions.names import type_width

K = ["project_id", "database_id", "schema_hash"]
TABLE = [*K, "table_schema", "table_name"]
# --- fixed values: page layout and autovacuum defaults ---
PAGE, FILL, ENTRY = 8192, 0.9, 8
DEFAULTS = {
    "autovacuum": "on", "autovacuum_vacuum_threshold": 50.0, "autovacuum_analyze_threshold": 50.0,
    "autovacuum_vacuum_scale_factor": 0.2, "autovacuum_analyze_scale_factor": 0.1,
}


def index_bloat(indexes: DataFrame, columns: DataFrame, stat_index: DataFrame) -> DataFrame:
    """Ratio of an index's pages to the pages its rows would need, for B-trees with known sizes."""
    trees = indexes.where("index_type = 'btree'").select(*TABLE, "name", F.posexplode("columns").alias("place", "column_name"))
    wide = trees.join(columns.select(*TABLE, "column_name", "type_name"), [*TABLE, "column_name"], "left")
    widths = wide.groupBy(*TABLE, "name").agg(F.sum(F.when(F.col("type_name").isNull(), 32).otherwise(type_width(F.col("type_name")))).alias("width"))
    sizes = stat_index.where("reltuples > 0 and relpages > 0").withColumnsRenamed({"index_schema": "table_schema", "index_name": "name"})
    per_page = F.lit(PAGE * FILL) / (ENTRY + F.col("width"))
    expected = F.greatest(F.lit(1), F.ceil(F.col("reltuples") / per_page)).cast("long")
    out = widths.where("width > 0").join(sizes.select(*K, "table_schema", "name", "reltuples", "relpages"), [*K, "table_schema", "name"])
    return out.withColumn("expected_pages", expected).withColumn("ratio", F.col("relpages") / F.col("expected_pages"))


def bloated_indexes(bloat: DataFrame, threshold: float = 1.5) -> DataFrame:
    return bloat.where(F.col("ratio") > threshold).orderBy(F.col("ratio").desc(), "name")


def number(raw: Column, name: str) -> Column:
    """A setting's value: thresholds are whole numbers, so one with a fraction does not count."""
    return raw.try_cast("bigint").cast("double") if name.endswith("threshold") else raw.try_cast("double")


def autovacuum_defaults(settings: DataFrame) -> DataFrame:
    """One row per catalog of the five settings; what is absent or unreadable keeps its default."""

    def value(name: str) -> Column:
        raw = F.max(F.when(F.col("name") == name, F.col("setting")))
        default = DEFAULTS[name]
        return F.coalesce(raw == "on", F.lit(True)) if name == "autovacuum" else F.coalesce(number(raw, name), F.lit(default))

    return settings.groupBy(*K).agg(*[value(n).alias(n) for n in DEFAULTS])


def parse_reloptions(options: Column) -> Column:
    """Map of key=value entries, split at the first equals sign; the last of repeated keys holds."""
    pairs = F.transform(F.filter(options, lambda x: x.contains("=")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, "^[^=]*=", "").alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def vacuum_health(tables: DataFrame, stats: DataFrame, merged: DataFrame, defaults: DataFrame, min_rows: int = 10_000) -> DataFrame:
    """Trigger points and progress of tables with enough rows; table options override the settings."""
    rows = tables.select(*TABLE, parse_reloptions(F.col("reloptions")).alias("o")).join(stats.select(*TABLE, "reltuples").where(F.col("reltuples") >= min_rows), TABLE)
    rows = rows.join(merged.select(*TABLE, F.col("n_dead_tup_sum").alias("dead")), TABLE, "left").join(defaults, K, "left")

    def setting(name: str) -> Column:
        return F.coalesce(number(F.try_element_at("o", F.lit(name)), name), F.col(name), F.lit(DEFAULTS[name]))

    off = F.coalesce(F.lower(F.try_element_at("o", F.lit("autovacuum_enabled"))).isin("false", "off", "0"), F.lit(False))
    enabled = F.coalesce(F.col("autovacuum"), F.lit(True)) & ~off
    trigger = lambda kind: setting(f"autovacuum_{kind}_threshold") + setting(f"autovacuum_{kind}_scale_factor") * F.col("reltuples")
    out = rows.select(
        *TABLE, "reltuples", F.coalesce("dead", F.lit(0)).alias("dead"), enabled.alias("enabled"), trigger("vacuum").alias("vacuum_trigger"),
        trigger("analyze").alias("analyze_trigger"), F.exists(F.map_keys("o"), lambda k: k.startswith("autovacuum_")).alias("overridden"),
    )
    return out.withColumn("progress", F.when(F.col("vacuum_trigger") > 0, F.col("dead") / F.col("vacuum_trigger")).otherwise(0.0)).orderBy(F.col("progress").desc(), "table_name")


def tuned(rows: Column) -> dict[str, Column]:
    """Settings suggested for a table of a million rows or more."""
    scale = F.greatest(F.lit(0.001), F.round(100_000 / rows, 3))
    threshold = F.least(F.greatest(F.floor(rows * 0.01), F.lit(500)), F.lit(5000))
    return {"scale_factor": scale, "analyze_scale_factor": F.round(scale / 2, 3), "threshold": threshold, "analyze_threshold": F.greatest(F.floor(threshold / 2), F.lit(250))}


def vacuum_recommendations(health: DataFrame) -> DataFrame:
    """A row per table and advice that holds."""
    rows = F.col("reltuples")
    t = tuned(rows)
    advice = {
        "enable autovacuum": ~F.col("enabled"),
        "tune a large table": (rows >= 1_000_000) & ~F.col("overridden"),
        "many dead rows": F.col("dead") / rows > 0.1,
        "trigger is very high": F.col("vacuum_trigger") > 10_000_000,
    }
    each = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(a)) for a, c in advice.items()]))).alias("advice")
    return health.select(*TABLE, each, *[v.alias(k) for k, v in t.items()])
