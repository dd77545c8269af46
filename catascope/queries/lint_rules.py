"""Queries of the convention rules over the derived catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catascope.adapters import table
from catascope.operators import lint as L
from catascope.queries._catalog import SQL, catalog

QUERIES, ORACLES = {}, {}
ALL = L.LintConfig(min_severity="info")
T = "project_id, database_id, schema_hash, table_schema, table_name"
FREE = f"WITH {SQL}, free AS (SELECT database_id, table_name FROM tabs WHERE (database_id, 'log_all', table_name) NOT IN (SELECT database_id, parent_name, child_name FROM kids)), c AS (SELECT * FROM cols SEMI JOIN free USING (database_id, table_name)), t AS (SELECT * FROM tabs SEMI JOIN free USING (database_id, table_name))"
OUT = "SELECT 'p' AS project_id, database_id, table_name, {col} AS column_name, '{rule}' AS rule, '{severity}' AS severity FROM {of} WHERE {where}"


def rule(rule, severity, of, where, col="column_name"):
    return OUT.format(rule=rule, severity=severity, of=of, where=where, col=col)


NONE = "CAST(NULL AS VARCHAR)"
PK = "(database_id, table_name, column_name) IN (SELECT database_id, table_name, col FROM cons WHERE kind = 'primary_key')"
KEY = "(database_id, table_name, column_name) IN (SELECT database_id, table_name, col FROM cons)"
STYLE = "(SELECT database_id, 2 * count(*) FILTER (table_name IN ('orders', 'tags', 'items')) > count(*) AND count(*) >= 5 AS plural FROM tabs WHERE regexp_full_match(table_name, '[a-z][a-z0-9_]*') GROUP BY 1)"
RULES = {
    "naming": [
        rule("naming/column_style", "warning", "c", "NOT regexp_full_match(column_name, '[a-z][a-z0-9_]*')"),
        rule("naming/table_style", "warning", f"t JOIN {STYLE} s USING (database_id)", "NOT regexp_full_match(table_name, '[a-z][a-z0-9_]*') OR (NOT plural AND table_name IN ('orders', 'tags'))", NONE),
        rule("naming/fk_pattern", "info", "cons SEMI JOIN free USING (database_id, table_name)", "kind = 'foreign_key' AND name <> 'fk_' || table_name || '_' || col", "col"),
        rule("naming/index_pattern", "info", "idx SEMI JOIN free USING (database_id, table_name)", "NOT is_primary AND name <> 'idx_' || table_name || '_' || col", NONE),
        rule("constraints/unnamed", "info", "cons SEMI JOIN free USING (database_id, table_name)", "regexp_matches(name, '_(pkey|fkey|key|check|excl)$')", "col"),
    ],
    "types": [
        rule("types/text_over_varchar", "warning", "c", "type_name LIKE 'varchar%'"),
        rule("types/timestamptz", "warning", "c", "type_name = 'timestamp' AND column_name NOT IN ('created_at', 'updated_at', 'deleted_at')"),
        rule("types/no_serial", "warning", "c", f"dflt IS NOT NULL AND NOT ({PK} AND NOT (type_name = 'bigint' AND identity IS NOT NULL))"),
        rule("types/bigint_pk_fk", "warning", "c", f"type_name = 'integer' AND {KEY} AND NOT {PK}"),
        rule("timestamps/correct_type", "warning", "c", "column_name IN ('created_at', 'updated_at', 'deleted_at') AND type_name = 'timestamp'"),
    ],
    "keys": [
        rule("pk/exists", "error", "t", "(database_id, table_name) NOT IN (SELECT database_id, table_name FROM cons WHERE kind = 'primary_key')", NONE),
        rule("pk/bigint_identity", "warning", "c", f"{PK} AND NOT (type_name = 'bigint' AND identity IS NOT NULL)"),
        rule("constraints/fk_has_index", "error", "cons SEMI JOIN free USING (database_id, table_name)", "kind = 'foreign_key' AND (database_id, table_name, col) NOT IN (SELECT database_id, table_name, col FROM idx)", "col"),
        rule("timestamps/has_created_at", "warning", "t", "(database_id, table_name) NOT IN (SELECT database_id, table_name FROM cols WHERE column_name = 'created_at')", NONE),
        rule("timestamps/has_updated_at", "warning", "t", "(database_id, table_name) NOT IN (SELECT database_id, table_name FROM cols WHERE column_name = 'updated_at')", NONE),
    ],
    "partitions": [
        rule("partition/no_default", "info", "t", "partition_strategy IS NOT NULL AND database_id IN (SELECT database_id FROM kids)", NONE),
        rule("partition/gucs", "warning", "(SELECT database_id, '' AS table_name FROM sets WHERE setting = 'off' AND database_id IN (SELECT database_id FROM kids))", "true", NONE),
        rule("partition/range_gaps", "warning", "(SELECT database_id, 'log_all' AS table_name, regexp_extract(bound, 'TO \\(''(\\d+)''', 1) AS hi, lead(regexp_extract(bound, 'FROM \\(''(\\d+)''', 1)) OVER (PARTITION BY database_id ORDER BY regexp_extract(bound, 'FROM \\(''(\\d+)''', 1)) AS nx FROM kids)", "nx IS NOT NULL AND hi <> nx", NONE),
    ],
}
SHOWN = ["project_id", "database_id", "table_name", "column_name", "rule", "severity"]


def _query(names):
    """Only the asked rules, and those whose findings hide theirs, enter the plan."""
    wanted = {*names, *(by for by, hidden in L.HIDES if hidden in names)}
    others = tuple(n for g in RULES for n in _names(g) if n not in wanted)

    def run(s, d):
        found = L.lint(catalog(s, d), L.LintConfig(min_severity="info", disabled=others))
        return found.where(F.col("rule").isin(*names)).select(*SHOWN)

    return run


def _names(group):
    return [q.split(" AS column_name, '")[1].split("'")[0] for q in RULES[group]]


for group in RULES:
    QUERIES[f"l_{group}"] = _query(_names(group))
    ORACLES[f"l_{group}"] = f"{FREE} " + " UNION ALL ".join(RULES[group])
EVERY = f"{FREE}, f AS ({' UNION ALL '.join(q for g in RULES.values() for q in g)})"


def l23(s, d):
    cat = catalog(s, d)
    return L.report_summary(L.lint(cat), cat["table"]).select("database_id", "errors", "warnings", "infos", "tables_checked")


def l24(s, d):
    return L.compact_report(L.lint(catalog(s, d), ALL), 5).select("database_id", "rule", "severity", "n", "omitted")


def l1(s, d):
    return L.table_style(catalog(s, d)["table"]).select("database_id", "style")


def l17(s, d):
    """Partitions from ``lineitem``: an order's lines are children of its customerless table; over three are many."""
    li = table(s, d, "lineitem")
    key = [F.lit("p").alias("project_id"), F.concat(F.lit("db"), (F.col("l_orderkey") % 5).cast("string")).alias("database_id"), F.lit("v1").alias("schema_hash")]
    name = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    tables = li.select(*key, F.lit("public").alias("table_schema"), name.alias("table_name"), F.lit("hash").alias("partition_strategy")).distinct()
    bound = F.when(F.col("l_linenumber") == 5, "DEFAULT").otherwise("FOR VALUES")
    kids = li.select(*key, F.lit("public").alias("parent_schema"), name.alias("parent_name"), F.lit("public").alias("child_schema"), F.concat_ws("_", name, "l_linenumber").alias("child_name"), bound.alias("bound"))
    settings = s.createDataFrame([], "project_id string, database_id string, schema_hash string, name string, setting string")
    return L.partition_rules(tables, kids, settings, L.LintConfig(max_partitions=3)).select("database_id", "table_name", "rule", "severity")


def _ranges(s, d):
    """Partitioned tables from ``orders``: a customer's is split by order keys; every third has no partitions, some ranges are short or long."""
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("next"))
    key = [F.lit("p").alias("project_id"), F.concat(F.lit("db"), (F.col("o_custkey") % 5).cast("string")).alias("database_id"), F.lit("v1").alias("schema_hash")]
    name = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    tables = o.select(*key, F.lit("public").alias("table_schema"), name.alias("table_name"), F.lit("range").alias("partition_strategy")).distinct()
    k = F.col("o_orderkey")
    stop = F.when(k % 10 == 0, F.col("next") - 1).when(k % 10 == 1, F.col("next") + 1).otherwise(F.col("next"))
    bound = F.concat(F.lit("FOR VALUES FROM ('"), k.cast("string"), F.lit("') TO ('"), stop.cast("string"), F.lit("')"))
    kids = o.where("o_custkey % 3 > 0 and next is not null").select(*key, F.lit("public").alias("parent_schema"), name.alias("parent_name"), F.lit("public").alias("child_schema"), F.concat_ws("_", name, k).alias("child_name"), bound.alias("bound"))
    settings = tables.select("project_id", "database_id", "schema_hash").distinct().select("*", F.lit("enable_partition_pruning").alias("name"), F.when(F.col("database_id") == "db1", "off").otherwise("on").alias("setting"))
    return tables, kids, settings


def l18_typed(s, d):
    """Gaps and overlaps of numbers, which text order would not see."""
    found = L.partition_rules(*_ranges(s, d), L.LintConfig(typed_bounds=True, disabled=("partition/no_default", "partition/gucs")))
    return found.select("database_id", "table_name", "rule", "message")


def l19_l20(s, d):
    found = L.partition_rules(*_ranges(s, d), L.LintConfig(disabled=("partition/range_gaps",)))
    return found.select("database_id", "table_name", "rule", "message")


STYLES = {"camelCase": "^[a-z][a-zA-Z0-9]*$", "PascalCase": "^[A-Z][a-zA-Z0-9]*$", "custom_regex": "^(log|is)"}


def l3_l4(s, d):
    """Names of tables and columns against every style that is not drawn from the names themselves."""
    c, out = catalog(s, d), None
    tables, columns, constraints = (L.without_children(c[n], c["partition_child"]) for n in ("table", "column", "constraint"))
    for style, pattern in STYLES.items():
        config = L.LintConfig(table_style=style, table_regex=pattern, column_style=style, column_regex=pattern)
        found = L.table_rules(tables, columns, constraints, c["table"], config).unionByName(L.column_rules(columns, constraints, config)).where(F.col("rule").isin("naming/table_style", "naming/column_style")).select(F.lit(style).alias("style"), "database_id", "table_name", "column_name", "rule")
        out = found if out is None else out.unionByName(found)
    return out


QUERIES |= {"l3_l4_other_styles": l3_l4}
ORACLES |= {
    "l3_l4_other_styles": f"{FREE}, s AS (SELECT * FROM (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in STYLES.items())}) v(style, pattern)) SELECT style, database_id, table_name, NULL AS column_name, 'naming/table_style' AS rule FROM t, s WHERE NOT regexp_matches(table_name, pattern) UNION ALL SELECT style, database_id, table_name, column_name, 'naming/column_style' FROM c, s WHERE NOT regexp_matches(column_name, pattern)",
}
QUERIES |= {"l18_typed_range_breaks": l18_typed, "l19_l20_childless_parents": l19_l20}
RANGES = "o AS (SELECT o_custkey AS c, o_orderkey AS k, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nx FROM orders), r AS (SELECT *, CASE WHEN k % 10 = 0 THEN nx - 1 WHEN k % 10 = 1 THEN nx + 1 ELSE nx END AS hi FROM o WHERE c % 3 > 0 AND nx IS NOT NULL)"
ORACLES |= {
    "l18_typed_range_breaks": f"WITH {RANGES}, w AS (SELECT c, k, max(hi) OVER (PARTITION BY c ORDER BY k, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r) SELECT 'db' || (c % 5) AS database_id, 'c' || c AS table_name, 'partition/range_gaps' AS rule, CASE WHEN k > reach THEN 'gap' ELSE 'overlap' END || ': ' || reach || ' -> ' || k AS message FROM w WHERE k <> reach",
    "l19_l20_childless_parents": "SELECT DISTINCT 'db' || (o_custkey % 5) AS database_id, 'c' || o_custkey AS table_name, 'partition/no_default' AS rule, 'no default partition' AS message FROM orders UNION ALL SELECT DISTINCT 'db1', '', 'partition/gucs', 'enable_partition_pruning' FROM orders WHERE o_custkey % 5 = 1",
}

QUERIES |= {"l17_partition_counts": l17, "l1_table_style": l1, "l22_l23_report_summary": l23, "l24_compact_report": l24}
ORACLES |= {
    "l17_partition_counts": "WITH c AS (SELECT 'db' || (l_orderkey % 5) AS database_id, 'o' || l_orderkey AS table_name, count(*) AS n, bool_or(l_linenumber = 5) AS dflt FROM lineitem GROUP BY l_orderkey) SELECT database_id, table_name, 'partition/too_many_children' AS rule, 'warning' AS severity FROM c WHERE n > 3 UNION ALL SELECT database_id, table_name, 'partition/no_default', 'info' FROM c WHERE NOT dflt",
    "l1_table_style": f"WITH {SQL} SELECT database_id, CASE WHEN plural THEN 'snake_plural' ELSE 'snake_singular' END AS style FROM {STYLE}",
    "l22_l23_report_summary": f"{EVERY} SELECT database_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, 0::BIGINT AS infos, (SELECT count(*) FROM tabs x WHERE x.database_id = f.database_id) AS tables_checked FROM f GROUP BY database_id",
    "l24_compact_report": f"{EVERY} SELECT database_id, rule, severity, count(*) AS n, greatest(count(*) - 5, 0) AS omitted FROM f GROUP BY ALL",
}
