"""Queries of version differences over two versions derived from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from catascope.adapters import COLUMNS, catalog_columns, table
from catascope.operators import diff as D

QUERIES, ORACLES = {}, {}


def _cat(s, d):
    cols = catalog_columns(s, d)
    tables = cols.groupBy("project_id", "database_id", "schema_hash", "version", "table_schema", "table_name").agg(F.min("comment").alias("comment"), F.bool_or(F.col("p_partkey") % 10 == 1).alias("rls_enabled"))
    pairs = D.consecutive_pairs(cols.select("project_id", "database_id", F.col("schema_hash").alias("content_hash"), F.col("version").alias("captured_at")).distinct())
    return cols, tables, pairs


def _objects(cols):
    return cols.select("project_id", "database_id", "schema_hash", "table_schema", F.col("column_name").alias("view_name"), F.coalesce("default", F.lit("x")).alias("definition"), "type_name")


J = f"WITH {COLUMNS}, a AS (SELECT * FROM cols WHERE version = 1), b AS (SELECT * FROM cols WHERE version = 2), j AS (SELECT coalesce(a.table_name, b.table_name) AS table_name, coalesce(a.column_name, b.column_name) AS column_name, a.p_partkey IS NULL AS isnew, b.p_partkey IS NULL AS isgone, a.type_name <> b.type_name AS ty, a.\"default\" IS DISTINCT FROM b.\"default\" AS de FROM a FULL JOIN b ON a.table_name = b.table_name AND a.column_name = b.column_name), dt AS (SELECT table_name, column_name, unnest(list_filter([CASE WHEN isnew THEN 'added' END, CASE WHEN isgone THEN 'removed' END, CASE WHEN NOT isnew AND NOT isgone AND ty THEN 'type changed' END, CASE WHEN NOT isnew AND NOT isgone AND de THEN 'default changed' END], lambda x: x IS NOT NULL)) AS detail FROM j), tb AS (SELECT version, table_name, min(comment) AS comment, bool_or(p_partkey % 10 = 1) AS rls FROM cols GROUP BY 1, 2), tj AS (SELECT x.table_name, unnest(list_filter([CASE WHEN x.comment IS DISTINCT FROM y.comment THEN 'comment changed' END, CASE WHEN NOT x.rls AND y.rls THEN 'row security enabled' END, CASE WHEN x.rls AND NOT y.rls THEN 'row security disabled' END], lambda q: q IS NOT NULL)) AS detail FROM tb x JOIN tb y ON x.table_name = y.table_name AND x.version = 1 AND y.version = 2)"
CH = f"{J}, al AS (SELECT table_name, detail FROM dt UNION ALL SELECT table_name, detail FROM tj), ob AS (SELECT version, column_name, coalesce(\"default\", 'x') AS d, type_name FROM cols), oj AS (SELECT coalesce(x.column_name, y.column_name) AS n, CASE WHEN x.version IS NULL THEN 'added' WHEN y.version IS NULL THEN 'removed' ELSE 'modified' END AS change, CASE WHEN x.d <> y.d THEN 1 ELSE 0 END + CASE WHEN x.type_name <> y.type_name THEN 1 ELSE 0 END AS nd FROM (SELECT * FROM ob WHERE version = 1) x FULL JOIN (SELECT * FROM ob WHERE version = 2) y ON x.column_name = y.column_name), ch AS (SELECT 'table' AS kind, 'public.' || table_name AS object, 'modified' AS change, count(*) AS n_details FROM al GROUP BY table_name UNION ALL SELECT 'view', 'public.' || n, change, CASE WHEN change = 'modified' THEN nd ELSE 0 END FROM oj WHERE change <> 'modified' OR nd > 0)"


def d2(s, d):
    cols, _, pairs = _cat(s, d)
    return D.column_details(cols, pairs).select("table_name", "column_name", "detail")


def d3(s, d):
    cols, _, pairs = _cat(s, d)
    return D.member_details(cols.withColumn("name", F.col("column_name")), pairs, "index").select("table_name", "object", "detail")


def d4(s, d):
    _, tables, pairs = _cat(s, d)
    return D.table_details(tables, pairs).select("table_name", "detail")


def _changes(s, d):
    cols, tables, pairs = _cat(s, d)
    changes = D.diff_tables(tables, cols, pairs).unionByName(D.diff_objects(_objects(cols), pairs, "view", ["table_schema", "view_name"], ["definition", "type_name"]))
    return changes, pairs


def d1(s, d):
    return _changes(s, d)[0].select("kind", "object", "change", "n_details")


def _versions(cols):
    return cols.select("project_id", "database_id", F.col("schema_hash").alias("content_hash"), F.col("version").alias("captured_at")).distinct()


def d8(s, d):
    changes, pairs = _changes(s, d)
    return D.diff_header(pairs, changes, _versions(catalog_columns(s, d))).select("from_hash", "to_hash", "from_at", "to_at", "n_changes", "is_empty")


def d6(s, d):
    """A function per column: overloads differ by argument, the second version changes results and rights."""
    cols, _, pairs = _cat(s, d)
    p = F.col("p_partkey")
    rows = cols.select(
        "project_id", "database_id", "schema_hash", "table_schema", F.concat(F.lit("f"), (p % 97).cast("string")).alias("function_name"), p.cast("string").alias("identity_args"),
        F.col("type_name").alias("return_type"), F.when((F.col("version") == 2) & (p % 4 == 0), "stable").otherwise("volatile").alias("volatility"), ((F.col("version") == 2) & (p % 5 == 0)).alias("security_definer"),
    )
    return D.diff_objects(rows, pairs, "function", ["table_schema", "function_name", "identity_args"], ["return_type", "volatility", "security_definer"]).select("kind", "object", "change", "n_details")


def d7(s, d):
    """Enums, domains, composites and extensions from a quarter of the columns each."""
    cols, _, pairs = _cat(s, d)
    base = cols.select("project_id", "database_id", "schema_hash", "table_schema", "column_name", "type_name", "default", (F.col("p_partkey") % 4).alias("of"))
    parts = [
        D.diff_objects(base.where("of = 0").withColumn("labels", F.array("type_name", "default")), pairs, "enum", ["table_schema", "column_name"], ["labels"]),
        D.diff_objects(base.where("of = 1").withColumn("checks", F.array("default")), pairs, "domain", ["table_schema", "column_name"], ["type_name", "checks"]),
        D.diff_objects(base.where("of = 2").withColumn("fields", F.array(F.struct("column_name", "type_name"))), pairs, "composite", ["table_schema", "column_name"], ["fields"]),
        D.diff_objects(base.where("of = 3"), pairs, "extension", ["column_name"], ["type_name"]),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("kind", "object", "change", "n_details")


def d9(s, d):
    return D.drift(_changes(s, d)[0]).select("from_hash", "to_hash", "ahead", "behind", "diverged")


def d10(s, d):
    cols, _, _ = _cat(s, d)
    v = cols.select("project_id", "database_id", F.col("schema_hash").alias("content_hash"), F.col("version").alias("captured_at")).distinct()
    return D.choose_pair(v.where("captured_at = 1"), None, v.where("captured_at = 2")).select("from_hash", "to_hash")


BOTH = f"WITH {COLUMNS}, j2 AS (SELECT coalesce(a.p_partkey, b.p_partkey) AS p, coalesce(a.column_name, b.column_name) AS n, a.p_partkey AS ka, b.p_partkey AS kb, a.type_name AS ta, b.type_name AS tb, a.\"default\" AS da, b.\"default\" AS db FROM (SELECT * FROM cols WHERE version = 1) a FULL JOIN (SELECT * FROM cols WHERE version = 2) b ON a.p_partkey = b.p_partkey)"
#: Twenty versions of three streams from ``part``: columns come and go every few versions, types and comments change.
LONG = """h AS (SELECT p_partkey AS p, p_type, v, 'db' || (p_partkey % 3) AS database_id, 't' || (p_partkey % 40) AS table_name, 'c' || p_partkey AS column_name,
 CASE WHEN (p_partkey + v // 6) % 5 = 0 THEN 'text' ELSE lower(p_type) END AS type_name, (p_partkey + v) % 11 < 6 AS nullable, CASE WHEN (p_partkey + v // 4) % 7 < 2 THEN 'c' || (v // 4) END AS comment
 FROM part, (SELECT unnest(range(1, 21)) AS v) WHERE (p_partkey * 7 + v) % 13 > 1 AND NOT (p_partkey % 40 = 7 AND v BETWEEN 8 AND 9))"""


def _long(s, d):
    """(tables, columns, timeline) of the same versions."""
    p, v = F.col("p_partkey"), F.col("v")
    fourth = F.floor(v / 4)
    rows = table(s, d, "part").select("*", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("v")).where(((p * 7 + v) % 13 > 1) & ~((p % 40 == 7) & v.between(8, 9)))
    cols = rows.select(
        F.lit("p").alias("project_id"), F.concat(F.lit("db"), (p % 3).cast("string")).alias("database_id"), F.concat(F.lit("h"), v.cast("string")).alias("schema_hash"), v.alias("at"), F.lit("public").alias("table_schema"),
        F.concat(F.lit("t"), (p % 40).cast("string")).alias("table_name"), F.concat(F.lit("c"), p.cast("string")).alias("column_name"),
        F.when((p + F.floor(v / 6)) % 5 == 0, "text").otherwise(F.lower("p_type")).alias("type_name"), ((p + v) % 11 < 6).alias("nullable"), F.lit(None).cast("string").alias("default"),
        F.when((p + fourth) % 7 < 2, F.concat(F.lit("c"), fourth.cast("string"))).alias("comment"),
    )
    tables = cols.select("project_id", "database_id", "schema_hash", "table_schema", "table_name", F.lit(None).cast("string").alias("comment"), F.lit(False).alias("rls_enabled")).distinct()
    versions = cols.select("project_id", "database_id", F.col("schema_hash").alias("content_hash"), F.col("at").alias("captured_at")).distinct()
    return tables, cols, D.Timeline.of(versions)


def d2_all(s, d):
    _, cols, timeline = _long(s, d)
    return D.column_details(cols, timeline).select("database_id", "from_hash", "to_hash", "table_name", "column_name", "detail")


def d1_all(s, d):
    tables, cols, timeline = _long(s, d)
    return D.diff_tables(tables, cols, timeline).select("database_id", "from_hash", "to_hash", "object", "change", "n_details")


def d8_all(s, d):
    tables, cols, timeline = _long(s, d)
    changes = D.diff_tables(tables, cols, timeline)
    drift = D.drift(changes).select(*D.PAIR, "ahead", "behind", "diverged")
    return D.diff_header(timeline.pairs(), changes).join(drift, D.PAIR, "left").fillna(0).select("database_id", "from_hash", "to_hash", "n_changes", "is_empty", "ahead", "behind", "diverged")


def d_intervals(s, d):
    _, cols, timeline = _long(s, d)
    return D.intervals(cols, timeline, ["table_schema", "table_name", "column_name"], ["type_name", "nullable", "default", "comment"]).select("database_id", "table_name", "column_name", "start", "stop", "body.type_name", "body.nullable", "body.comment")


SIDES = f"""WITH {LONG}, pr AS (SELECT DISTINCT database_id, v FROM h WHERE v > 1), k AS (SELECT DISTINCT pr.database_id, pr.v, table_name, column_name FROM pr JOIN h ON h.database_id = pr.database_id AND h.v IN (pr.v, pr.v - 1)),
 s AS (SELECT k.*, o.p IS NULL AS isnew, n.p IS NULL AS isgone, o.type_name AS ot, n.type_name AS nt, o.nullable AS onu, n.nullable AS nnu, o.comment AS oc, n.comment AS nc FROM k LEFT JOIN h o ON o.database_id = k.database_id AND o.v = k.v - 1 AND o.column_name = k.column_name LEFT JOIN h n ON n.database_id = k.database_id AND n.v = k.v AND n.column_name = k.column_name),
 dt AS (SELECT database_id, v, table_name, column_name, unnest(list_filter([CASE WHEN isnew THEN 'added' END, CASE WHEN isgone THEN 'removed' END, CASE WHEN ot <> nt THEN 'type changed' END, CASE WHEN onu AND NOT nnu THEN 'not null added' END, CASE WHEN nnu AND NOT onu THEN 'not null removed' END, CASE WHEN NOT isnew AND NOT isgone AND oc IS DISTINCT FROM nc THEN 'comment changed' END], lambda x: x IS NOT NULL)) AS detail FROM s),
 tc AS (SELECT database_id, v, table_name, bool_and(isnew) AS isnew, bool_and(isgone) AS isgone FROM s GROUP BY 1, 2, 3), dc AS (SELECT database_id, v, table_name, count(*) AS n FROM dt GROUP BY 1, 2, 3),
 ch AS (SELECT database_id, 'h' || (v - 1) AS from_hash, 'h' || v AS to_hash, 'public.' || table_name AS object, CASE WHEN isnew THEN 'added' WHEN isgone THEN 'removed' ELSE 'modified' END AS change, coalesce(n, 0) AS n_details FROM tc LEFT JOIN dc USING (database_id, v, table_name) WHERE isnew OR isgone OR n > 0)"""
QUERIES |= {"d2_column_details_all_versions": d2_all, "d1_changes_all_versions": d1_all, "d8_d9_headers_all_versions": d8_all, "d_validity_intervals": d_intervals}
ORACLES |= {
    "d2_column_details_all_versions": f"{SIDES} SELECT database_id, 'h' || (v - 1) AS from_hash, 'h' || v AS to_hash, table_name, column_name, detail FROM dt",
    "d1_changes_all_versions": f"{SIDES} SELECT * FROM ch",
    "d8_d9_headers_all_versions": f"{SIDES} SELECT pr.database_id, 'h' || (v - 1) AS from_hash, 'h' || v AS to_hash, count(ch.object) AS n_changes, count(ch.object) = 0 AS is_empty, count(*) FILTER (change = 'added') AS ahead, count(*) FILTER (change = 'removed') AS behind, count(*) FILTER (change = 'modified') AS diverged FROM pr LEFT JOIN ch ON ch.database_id = pr.database_id AND ch.to_hash = 'h' || v GROUP BY pr.database_id, v",
    "d_validity_intervals": f"WITH {LONG}, f AS (SELECT *, CASE WHEN lag(v) OVER w = v - 1 AND lag(type_name) OVER w = type_name AND lag(nullable) OVER w = nullable AND lag(comment) OVER w IS NOT DISTINCT FROM comment THEN 0 ELSE 1 END AS n FROM h WINDOW w AS (PARTITION BY database_id, column_name ORDER BY v)), g AS (SELECT *, sum(n) OVER (PARTITION BY database_id, column_name ORDER BY v) AS r FROM f) SELECT database_id, table_name, column_name, CAST(min(v) AS INT) AS start, CAST(max(v) + 1 AS INT) AS stop, any_value(type_name) AS type_name, any_value(nullable) AS nullable, any_value(comment) AS comment FROM g GROUP BY database_id, table_name, column_name, r",
}
QUERIES |= {"d2_column_details": d2, "d3_member_details": d3, "d4_table_details": d4, "d1_d5_d6_d7_changes": d1, "d6_function_changes": d6, "d7_type_changes": d7, "d8_diff_header": d8, "d9_drift": d9, "d10_choose_versions": d10}
ORACLES |= {
    "d2_column_details": f"{J} SELECT * FROM dt",
    "d3_member_details": f"{J} SELECT table_name, column_name AS object, 'index ' || detail AS detail FROM dt WHERE detail IN ('added', 'removed')",
    "d4_table_details": f"{J} SELECT * FROM tj",
    "d1_d5_d6_d7_changes": f"{CH} SELECT * FROM ch",
    "d6_function_changes": f"{BOTH}, x AS (SELECT p, ka IS NULL AS isnew, kb IS NULL AS isgone, CAST(ta <> tb AS INT) + CAST(p % 4 = 0 AS INT) + CAST(p % 5 = 0 AS INT) AS nd FROM j2) SELECT 'function' AS kind, 'public.f' || (p % 97) || '.' || p AS object, CASE WHEN isnew THEN 'added' WHEN isgone THEN 'removed' ELSE 'modified' END AS change, CASE WHEN isnew OR isgone THEN 0 ELSE nd END AS n_details FROM x WHERE isnew OR isgone OR nd > 0",
    "d7_type_changes": f"{BOTH}, x AS (SELECT *, ka IS NULL AS isnew, kb IS NULL AS isgone, ta <> tb AS ty, da IS DISTINCT FROM db AS de FROM j2), y AS (SELECT ['enum', 'domain', 'composite', 'extension'][p % 4 + 1] AS kind, CASE WHEN p % 4 = 3 THEN n ELSE 'public.' || n END AS object, CASE WHEN isnew THEN 'added' WHEN isgone THEN 'removed' ELSE 'modified' END AS change, CASE WHEN isnew OR isgone THEN 0 WHEN p % 4 = 0 THEN CAST(ty OR de AS INT) WHEN p % 4 = 1 THEN CAST(ty AS INT) + CAST(de AS INT) ELSE CAST(ty AS INT) END AS n_details FROM x) SELECT * FROM y WHERE change <> 'modified' OR n_details > 0",
    "d8_diff_header": f"{CH} SELECT 'v1' AS from_hash, 'v2' AS to_hash, 1 AS from_at, 2 AS to_at, count(*) AS n_changes, count(*) = 0 AS is_empty FROM ch",
    "d9_drift": f"{CH} SELECT 'v1' AS from_hash, 'v2' AS to_hash, count(*) FILTER (change = 'added') AS ahead, count(*) FILTER (change = 'removed') AS behind, count(*) FILTER (change = 'modified') AS diverged FROM ch",
    "d10_choose_versions": f"WITH {COLUMNS} SELECT 'v1' AS from_hash, 'v2' AS to_hash FROM cols LIMIT 1",
}
