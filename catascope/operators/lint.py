"""Convention rules over catalogs: naming, keys, types, constraints, timestamps, partitions.

Rules of one grain (table, column, constraint, index) are one pass: each row emits the findings of all its
rules. Rules that are disabled never enter the plan. Partition children are left out throughout.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catascope.functions.names import is_snake_case, looks_plural

K = ["project_id", "database_id", "schema_hash"]
TABLE = [*K, "table_schema", "table_name"]
RANK = {"info": 0, "warning": 1, "error": 2}
FINDING = [*TABLE, "column_name", "rule", "severity", "message"]
GUCS = ("enable_partition_pruning", "enable_partitionwise_join", "enable_partitionwise_aggregate")
#: (what fires, what it hides) on the same table and column
HIDES = (
    ("timestamps/correct_type", "types/timestamptz"), ("pk/bigint_identity", "types/no_serial"), ("pk/bigint_identity", "types/bigint_pk_fk"),
)


@dataclass(frozen=True)
class LintConfig:
    table_style: str = "auto"
    table_regex: str | None = None
    column_style: str = "snake_case"
    column_regex: str | None = None
    fk_pattern: str = "fk_{table}_{column}"
    index_pattern: str = "idx_{table}_{column}"
    pk_type: str = "bigint_identity"
    timestamp_type: str = "timestamptz"
    require_created_at: bool = True
    require_updated_at: bool = True
    max_partitions: int = 500
    typed_bounds: bool = False
    min_severity: str = "warning"
    disabled: Sequence[str] = field(default_factory=tuple)


def without_children(rows: DataFrame, children: DataFrame) -> DataFrame:
    """Rows of tables that are nobody's partition, at any depth (every parent's children are listed)."""
    own = children.select(*K, F.col("child_schema").alias("table_schema"), F.col("child_name").alias("table_name")).distinct()
    return rows.join(own, TABLE, "left_anti")


def table_style(tables: DataFrame) -> DataFrame:
    """Per catalog: plural if most snake-case names look so; under five names singular."""
    snake = tables.where(is_snake_case(F.col("table_name")))
    plural = F.count_if(looks_plural(F.col("table_name")))
    n = F.count(F.lit(1))
    counts = snake.groupBy(*K).agg(n.alias("n"), plural.alias("plural"))
    style = F.when((F.col("n") >= 5) & (2 * F.col("plural") > F.col("n")), "snake_plural").otherwise("snake_singular")
    return counts.select(*K, style.alias("style"))


def _emit(rows: DataFrame, rules: list[tuple[str, str, Column, str | Column]], config: LintConfig, column: str | None = None) -> DataFrame:
    """Findings of one grain: an array of the rules that hold, exploded."""
    each = [
        F.when(holds, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (F.lit(m) if isinstance(m, str) else m).alias("message")))
        for rule, severity, holds, m in rules
        if rule not in config.disabled
    ]
    if not each:
        each = [F.lit(None).cast("struct<rule:string,severity:string,message:string>")]
    name = F.col(column) if column else F.lit(None).cast("string")
    return rows.select(*TABLE, name.alias("column_name"), F.explode(F.array_compact(F.array(*each))).alias("f")).select(*TABLE, "column_name", "f.rule", "f.severity", "f.message")


def _styled(name: Column, style: str, regex: str | None) -> Column:
    fixed = {"snake_case": "^[a-z][a-z0-9_]*$", "camelCase": "^[a-z][a-zA-Z0-9]*$", "PascalCase": "^[A-Z][a-zA-Z0-9]*$", "snake_plural": "^[a-z][a-z0-9_]*$"}
    if style == "snake_singular":
        return is_snake_case(name) & ~looks_plural(name)
    if style == "custom_regex":
        return name.rlike(regex) if regex else F.lit(True)
    return name.rlike(fixed[style]) if style in fixed else F.lit(True)


def table_rules(tables: DataFrame, columns: DataFrame, constraints: DataFrame, all_tables: DataFrame, config: LintConfig) -> DataFrame:
    has = columns.groupBy(*TABLE).agg(
        F.bool_or(F.col("column_name") == "created_at").alias("created"), F.bool_or(F.col("column_name") == "updated_at").alias("updated")
    )
    keyed = constraints.where("kind = 'primary_key'").select(*TABLE).distinct().withColumn("pk", F.lit(True))
    rows = tables.join(has, TABLE, "left").join(keyed, TABLE, "left")
    name = F.col("table_name")
    if config.table_style == "auto":
        rows = rows.join(table_style(all_tables), K, "left")
        plural = F.coalesce(F.col("style") == "snake_plural", F.lit(False))
        good = F.when(plural, _styled(name, "snake_plural", None)).otherwise(_styled(name, "snake_singular", None))
    else:
        good = _styled(name, config.table_style, config.table_regex)
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    rules = [("naming/table_style", "warning", ~good, "table name is off the style"), ("pk/exists", "error", no("pk"), "no primary key")]
    if config.require_created_at:
        rules.append(("timestamps/has_created_at", "warning", no("created"), "no created_at column"))
    if config.require_updated_at:
        rules.append(("timestamps/has_updated_at", "warning", no("updated"), "no updated_at column"))
    return _emit(rows, rules, config)


def column_rules(columns: DataFrame, constraints: DataFrame, config: LintConfig) -> DataFrame:
    member = constraints.where("kind in ('primary_key', 'foreign_key')").select(*TABLE, F.explode("columns").alias("column_name"), "kind")
    member = member.groupBy(*TABLE, "column_name").agg(F.bool_or(F.col("kind") == "primary_key").alias("is_pk"), F.lit(True).alias("is_key"))
    rows = columns.join(member, [*TABLE, "column_name"], "left")
    low, name = F.lower("type_name"), F.col("column_name")
    key, pk = F.coalesce("is_key", F.lit(False)), F.coalesce("is_pk", F.lit(False))
    big, small = low.isin("bigint", "int8"), low.isin("integer", "int", "int4", "smallint", "int2")
    whole = low.isin("integer", "int", "int4")
    naked = low.isin("timestamp", "timestamp without time zone")
    ints = config.pk_type == "int_identity"
    rules = [
        ("naming/column_style", "warning", ~_styled(name, config.column_style, config.column_regex), "column name is off the style"),
        ("types/text_over_varchar", "warning", low.startswith("character varying") | low.startswith("varchar"), "text needs no length"),
        ("types/timestamptz", "warning", naked, "timestamp without time zone"),
        ("types/no_serial", "warning", F.coalesce(F.lower("default").contains("nextval("), F.lit(False)), "serial default; use identity"),
        ("types/bigint_pk_fk", "warning", key & small & ~(whole & F.lit(ints)), "key column is narrower than bigint"),
    ]
    if config.pk_type in ("bigint_identity", "int_identity"):
        fits = (big | (whole & F.lit(ints))) & F.col("identity").isNotNull()
        rules.append(("pk/bigint_identity", "warning", pk & ~fits, "primary key column is not an identity of the asked type"))
    if config.timestamp_type == "timestamptz":
        rules.append(("timestamps/correct_type", "warning", name.isin("created_at", "updated_at", "deleted_at") & naked, "timestamp without time zone"))
    return _emit(rows, rules, config, "column_name")


def _pattern(pattern: str, columns: Column) -> Column:
    out = F.lit(pattern)
    for key, value in (("{table}", F.col("table_name")), ("{column}", F.array_join(columns, "_"))):
        out = F.replace(out, F.lit(key), value)
    return out


def constraint_rules(constraints: DataFrame, indexes: DataFrame, config: LintConfig) -> DataFrame:
    fk = (F.col("kind") == "foreign_key") & (F.size("columns") > 0)
    unnamed = F.col("name").rlike("_(?:pkey|fkey|key|check|excl)$")
    rules = [
        ("naming/fk_pattern", "info", fk & (F.col("name") != _pattern(config.fk_pattern, F.col("columns"))), F.col("name")),
        ("constraints/unnamed", "info", unnamed, F.col("name")),
    ]
    each = constraints.withColumn("column_name", F.array_join("columns", ","))
    out = _emit(each, rules, config, "column_name")
    if "constraints/fk_has_index" in config.disabled:
        return out
    lead = indexes.select(*TABLE, F.get("columns", F.lit(0)).alias("c0"), F.col("columns").alias("ix"))
    bare = constraints.where(fk).withColumn("c0", F.get("columns", F.lit(0))).alias("f").join(
        lead.alias("i"),
        [F.col(f"f.{c}") == F.col(f"i.{c}") for c in [*TABLE, "c0"]] + [F.slice("i.ix", F.lit(1), F.size("f.columns")) == F.col("f.columns")],
        "left_anti",
    )
    return out.unionByName(_emit(bare.withColumn("column_name", F.array_join("columns", ",")), [("constraints/fk_has_index", "error", F.lit(True), F.col("name"))], config, "column_name"))


def index_rules(indexes: DataFrame, config: LintConfig) -> DataFrame:
    off = ~F.col("is_primary") & (F.col("name") != _pattern(config.index_pattern, F.col("columns")))
    return _emit(indexes, [("naming/index_pattern", "info", off, F.col("name"))], config)


def parse_bounds(bound: Column) -> Column:
    """(lo, hi) of a single-column range bound in quotes, else nulls."""
    part = lambda i: F.nullif(F.regexp_extract(bound, r"(?i)FROM \('([^']*)'\) TO \('([^']*)'\)", i), F.lit(""))
    return F.struct(part(1).alias("lo"), part(2).alias("hi"))


def range_breaks(bounds: DataFrame, typed: bool = False) -> DataFrame:
    """(TABLE, kind, ends, starts): where the range partitions of a table leave a gap, or overlap.

    As text, each range is compared with the next one by its start, and any difference counts as a gap. ``typed`` reads a
    table's bounds as numbers if all are, else as times if all are, else as text, and sweeps them by their start with the
    greatest end so far: a later start leaves a gap, an earlier one overlaps. Equal starts follow by end.
    """
    rows = bounds.where("b.lo is not null and b.hi is not null").select(*TABLE, "b.lo", "b.hi")
    if not typed:
        after = F.lead("lo").over(Window.partitionBy(*TABLE).orderBy("lo", "hi"))
        return rows.withColumn("next", after).where("next is not null and hi <> next").select(*TABLE, F.lit("gap").alias("kind"), F.col("hi").alias("ends"), F.col("next").alias("starts"))
    as_number = lambda c: F.expr(f"try_cast({c} as double)")
    as_time = lambda c: F.unix_micros(F.expr(f"try_cast({c} as timestamp)")).cast("double")
    every = lambda read: F.bool_and(read("lo").isNotNull() & read("hi").isNotNull())
    kinds = rows.groupBy(*TABLE).agg(every(as_number).alias("numbers"), every(as_time).alias("times"))
    value = lambda c: F.when(F.col("numbers"), as_number(c)).when(F.col("times"), as_time(c))
    # texts have no number; null first, so each kind is ordered by what it has
    point = lambda c: F.struct(value(c).alias("x"), F.when(~F.col("numbers") & ~F.col("times"), F.col(c)).alias("t"), F.col(c).alias("shown"))
    order = Window.partitionBy(*TABLE).orderBy("lo", "hi")
    placed = rows.join(kinds, TABLE).select(*TABLE, point("lo").alias("lo"), point("hi").alias("hi"))
    swept = placed.withColumn("reach", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))).where("reach is not null")
    key = lambda c: F.struct(F.col(c)["x"], F.col(c)["t"])
    kind = F.when(key("lo") > key("reach"), "gap").when(key("lo") < key("reach"), "overlap")
    return swept.withColumn("kind", kind).where("kind is not null").select(*TABLE, "kind", F.col("reach.shown").alias("ends"), F.col("lo.shown").alias("starts"))


def partition_rules(tables: DataFrame, children: DataFrame, settings: DataFrame, config: LintConfig) -> DataFrame:
    """Rules of partitioned tables; one without any partition has none by default either, and counts for the settings."""
    parent = children.withColumnsRenamed({"parent_schema": "table_schema", "parent_name": "table_name"})
    counts = parent.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.upper("bound").contains("DEFAULT")).alias("default"))
    parents = tables.where("partition_strategy is not null").join(counts, TABLE, "left")
    whole = _emit(
        parents,
        [
            ("partition/too_many_children", "warning", F.col("n") > config.max_partitions, "many partitions"),
            ("partition/no_default", "info", ~F.coalesce("default", F.lit(False)), "no default partition"),
        ],
        config,
    )
    ranges = parent.join(tables.where("partition_strategy = 'range'").select(*TABLE), TABLE, "left_semi").withColumn("b", parse_bounds(F.col("bound")))
    breaks = range_breaks(ranges, config.typed_bounds)
    text = F.concat_ws(" -> ", "ends", "starts") if not config.typed_bounds else F.concat(F.col("kind"), F.lit(": "), F.col("ends"), F.lit(" -> "), F.col("starts"))
    gap = _emit(breaks, [("partition/range_gaps", "warning", F.lit(True), text)], config)
    on = settings.where(F.col("name").isin(*GUCS)).select(*K, F.col("name").alias("guc"), "setting")
    keys = parents.select(*K).distinct().select(*K, F.explode(F.array(*[F.lit(g) for g in GUCS])).alias("guc"))
    off = keys.join(on, [*K, "guc"], "left").where("setting is not null and lower(setting) <> 'on'")
    off = off.withColumns({"table_schema": F.lit(""), "table_name": F.lit("")})
    return whole.unionByName(gap).unionByName(_emit(off, [("partition/gucs", "warning", F.lit(True), F.col("guc"))], config))


def suppress(findings: DataFrame) -> DataFrame:
    """Drop findings that another finding on the same table and column covers."""
    hides = F.explode(F.array(*[F.struct(F.lit(a).alias("by"), F.lit(b).alias("rule")) for a, b in HIDES])).alias("h")
    winners = findings.where(F.col("rule").isin(*{a for a, _ in HIDES})).select(*TABLE, F.col("column_name").alias("c"), F.col("rule").alias("winner"), hides)
    winners = winners.where("winner = h.by").select(*TABLE, "c", "h.rule").distinct().alias("w")
    on = [F.col(f"f.{k}") == F.col(f"w.{k}") for k in [*TABLE, "rule"]] + [F.col("f.column_name").eqNullSafe(F.col("w.c"))]
    return findings.alias("f").join(winners, on, "left_anti")


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(F.col("severity").isin(*[s for s, r in RANK.items() if r >= RANK[severity]]))


def lint(cat: dict[str, DataFrame], config: LintConfig = LintConfig()) -> DataFrame:
    """All rules over ``cat`` (table, column, constraint, index, partition_child, setting)."""
    child = cat["partition_child"]
    tables, columns, constraints, indexes = (without_children(cat[n], child) for n in ("table", "column", "constraint", "index"))
    parts = [
        table_rules(tables, columns, constraints, cat["table"], config), column_rules(columns, constraints, config),
        constraint_rules(constraints, indexes, config), index_rules(indexes, config), partition_rules(tables, child, cat["setting"], config),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return at_least(suppress(out), config.min_severity).select(*FINDING)


def report_summary(findings: DataFrame, tables: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s)
    sums = findings.groupBy(*K).agg(count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"))
    checked = tables.groupBy(*K).agg(F.count(F.lit(1)).alias("tables_checked"))
    return checked.join(sums, K, "left").fillna(0, ["errors", "warnings", "infos"])


def compact_report(findings: DataFrame, max_examples: int = 5) -> DataFrame:
    """Per catalog and rule: count, first message, some examples, how many were left out."""
    where = F.concat_ws(".", "table_schema", "table_name", "column_name")
    place = F.row_number().over(Window.partitionBy(*K, "rule").orderBy("table_schema", "table_name", "column_name", "message"))
    rows = findings.withColumn("where", where).withColumn("__n", place)
    out = rows.groupBy(*K, "rule", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("message", "__n").alias("message"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("__n") <= max_examples, F.struct("__n", "where")))), lambda x: x["where"]).alias("examples"),
    )
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return out.withColumn("omitted", F.col("n") - F.size("examples")).orderBy(*K, rank, F.col("n").desc(), "rule")
