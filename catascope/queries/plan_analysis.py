"""Queries over EXPLAIN documents derived from ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from catascope.adapters import table
from catascope.functions.names import parse_version
from catascope.plans import plan_corpus as P

QUERIES, ORACLES = {}, {}


def documents(s, d):
    """A plan per order, in one of three shapes; every tenth is a bare object, every 97th has no plan, every second has times.

    Nested Loop(Seq Scan t, Sort(Seq Scan u)); Append over one to three partitions; CTE Scan over an Append or a scan.
    """
    k = F.col("o_orderkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    rows = F.floor(F.col("o_totalprice") / 10).cast("long")
    outer = text('{"Node Type":"Seq Scan","Relation Name":"t', F.col("o_custkey") % 9, '","Plan Rows":', rows, ',"Filter":"((t.c', k % 3, ' = 1))"}')
    scan = text('{"Node Type":"Seq Scan","Relation Name":"u","Plan Rows":', k % 250, ',"Filter":"(u.z > 3)","Actual Rows":5,"Rows Removed by Filter":', k % 100, "}")
    inner = F.when(k % 4 == 0, scan).otherwise(text('{"Node Type":"Sort","Sort Key":["a","b"],"Plan Rows":', rows, ',"Plans":[', scan, "]}"))
    loop = text('{"Node Type":"Nested Loop","Total Cost":', k % 1000, ',"Plan Rows":', rows, ',"Plans":[', outer, ",", inner, "]}")
    part = lambda n: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: text('{"Node Type":"Seq Scan","Relation Name":"x', i, '","Plan Rows":50}')), ",")
    append = text('{"Node Type":"Append","Plan Rows":', rows, ',"Plans":[', part((1 + k % 3).cast("int")), "]}")
    below = F.when(k % 2 == 0, text('{"Node Type":"Append","Plan Rows":9,"Plans":[', part(F.lit(2)), "]}")).otherwise(F.lit('{"Node Type":"Seq Scan","Relation Name":"u","Plan Rows":10}'))
    cte = text('{"Node Type":"CTE Scan","CTE Name":"w","Plan Rows":', k % 3000, ',"Plans":[', below, "]}")
    root = F.when(k % 11 == 5, append).when(k % 13 == 6, cte).otherwise(loop)
    times = F.when(k % 2 == 0, text(',"Planning Time":1.5,"Execution Time":', k)).otherwise("")
    doc = F.when(k % 97 == 0, F.lit("{}")).when(k % 10 == 0, text('{"Plan":', root, times, "}")).otherwise(text('[{"Plan":', root, times, "}]"))
    return table(s, d, "orders").select(F.lit("p").alias("project_id"), F.lit("db").alias("database_id"), F.lit("v1").alias("schema_hash"), k.alias("plan_id"), doc.alias("plan_json"))


N = """WITH al AS (SELECT o_orderkey AS plan_id, o_custkey % 9 AS t, floor(o_totalprice / 10) AS r, o_orderkey AS k FROM orders WHERE o_orderkey % 97 <> 0),
o AS (SELECT * FROM al WHERE k % 11 <> 5 AND k % 13 <> 6), ap AS (SELECT * FROM al WHERE k % 11 = 5), ct AS (SELECT * FROM al WHERE k % 11 <> 5 AND k % 13 = 6),
n AS (SELECT plan_id, '' AS path, 0 AS depth, 'Nested Loop' AS node_type, NULL AS relation, r AS plan_rows, NULL AS removed FROM o
UNION ALL SELECT plan_id, '0', 1, 'Seq Scan', 't' || t, r, NULL FROM o
UNION ALL SELECT plan_id, '1', 1, 'Sort', NULL, r, NULL FROM o WHERE k % 4 <> 0
UNION ALL SELECT plan_id, CASE WHEN k % 4 = 0 THEN '1' ELSE '1.0' END, CASE WHEN k % 4 = 0 THEN 1 ELSE 2 END, 'Seq Scan', 'u', k % 250, k % 100 FROM o
UNION ALL SELECT plan_id, '', 0, 'Append', NULL, r, NULL FROM ap UNION ALL SELECT plan_id, CAST(i AS VARCHAR), 1, 'Seq Scan', 'x' || i, 50, NULL FROM ap, range(3) x(i) WHERE i <= k % 3
UNION ALL SELECT plan_id, '', 0, 'CTE Scan', NULL, k % 3000, NULL FROM ct UNION ALL SELECT plan_id, '0', 1, CASE WHEN k % 2 = 0 THEN 'Append' ELSE 'Seq Scan' END, CASE WHEN k % 2 = 1 THEN 'u' END, CASE WHEN k % 2 = 0 THEN 9 ELSE 10 END, NULL FROM ct
UNION ALL SELECT plan_id, '0.' || i, 2, 'Seq Scan', 'x' || i, 50, NULL FROM ct, range(2) x(i) WHERE k % 2 = 0)"""


def _nodes(s, d):
    return P.flatten_plans(P.read_documents(documents(s, d))[0])


def _stats(s):
    return s.createDataFrame([("p", "db", "v1", "public", "u", 6000.0)], "project_id string, database_id string, schema_hash string, table_schema string, table_name string, reltuples double")


def _children(s):
    return s.createDataFrame([("p", "db", "v1", "public", "part", "public", f"x{i}") for i in range(3)], "project_id string, database_id string, schema_hash string, parent_schema string, parent_name string, child_schema string, child_name string")


def _indexes(s):
    return s.createDataFrame([("p", "db", "v1", "public", f"t{i}", ["c1"]) for i in range(0, 9, 2)], "project_id string, database_id string, schema_hash string, table_schema string, table_name string, columns array<string>")


def _columns(s):
    return s.createDataFrame([("p", "db", "v1", "public", f"t{i}", f"c{j}", "jsonb" if j == 2 else "integer") for i in range(9) for j in range(3)], "project_id string, database_id string, schema_hash string, table_schema string, table_name string, column_name string, type_name string")


def _column_stats(s):
    rows = [("p", "db", "v1", "public", f"t{i}", f"c{j}", 0.6 if i == 1 else 0.1, 3.0 if j == 0 else 400.0, ["7"], [0.7 if i == 3 else 0.2], 0.1) for i in range(9) for j in range(3)]
    return s.createDataFrame(rows, "project_id string, database_id string, schema_hash string, table_schema string, table_name string, column_name string, null_frac double, n_distinct double, mcv array<string>, mcf array<double>, correlation double")


def p1(s, d):
    return _nodes(s, d).select("plan_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"), "depth", "node_type", "relation", "plan_rows")


def p2(s, d):
    docs = P.read_documents(documents(s, d))[0]
    return P.summary(P.flatten_plans(docs), docs).select("plan_id", "node_type", "total_cost", "estimated_rows", "planning_time", "execution_time")


def p3(s, d):
    return P.warnings(_nodes(s, d), _stats(s), _children(s)).select("plan_id", "path", "rule", "table")


def p9(s, d):
    rows = P.scan_advice(_nodes(s, d), _indexes(s), _columns(s), _column_stats(s), _stats(s), activity=_activity(s, d))
    return rows.select("plan_id", "table_name", "column_name", "severity", "nodes", "ddl", F.array_join("hints", ",").alias("hints"))


def _activity(s, d):
    """Scans of t0..t4 by node, summed from ``orders``; t0 is seen by one node only."""
    k = F.col("o_orderkey")
    rows = table(s, d, "orders").select(F.lit("p").alias("project_id"), F.lit("db").alias("database_id"), F.lit("v1").alias("schema_hash"), F.lit("public").alias("table_schema"), F.concat(F.lit("t"), (k % 5).cast("string")).alias("table_name"), F.concat(F.lit("n"), F.when(k % 5 == 0, 0).otherwise(k % 2).cast("string")).alias("node_label"))
    return rows.groupBy(*P.TABLE, "node_label").agg(F.count(F.lit(1)).alias("seq_scan"))


def p11(s, d):
    return P.nested_loop_advice(_nodes(s, d)).select("plan_id", "table_name", "column_name", "rows_per_loop", "ddl")


def p13(s, d):
    return P.cte_advice(_nodes(s, d)).select("plan_id", "cte_name", "plan_rows")


def p12(s, d):
    return P.sort_advice(_nodes(s, d)).select("plan_id", "table_name", F.array_join("sort_key", ",").alias("sort_key"))


def p17(s, d):
    return P.dedupe_suggestions(P.suggest_indexes(_nodes(s, d), _indexes(s))).select("plan_id", "table_name", "columns", "impact")


def p19(s, d):
    return P.rollup_suggestions(P.dedupe_suggestions(P.suggest_indexes(_nodes(s, d), _indexes(s)))).select("table_name", "columns", "n_plans", "max_rows")


def p16(s, d):
    v = F.concat(F.lit("Server "), (F.col("o_custkey") % 9 + 8).cast("string"), F.lit("."), (F.col("o_custkey") % 4).cast("string"), F.lit("beta on x"))
    return table(s, d, "orders").select("o_orderkey", P.version_note(parse_version(v)).alias("note"), parse_version(v)["minor"].alias("minor"))


def p1_bad(s, d):
    """Why plans cannot be read: every third has a root whose cost or rows are words, an odd one is a list."""
    k = F.col("plan_id")
    words = F.regexp_replace("plan_json", '"Plan Rows":[0-9]+', '"Plan Rows":"many"')
    docs = documents(s, d).withColumn("plan_json", F.when(k % 3 == 1, words).when(k % 3 == 2, F.lit('{"Plan":[1]}')).otherwise(F.col("plan_json")))
    return P.unreadable_plans(P.read_documents(docs)[0]).select("plan_id", "problem")


def s11(s, d):
    good, bad = P.read_documents(documents(s, d))
    return good.select(F.lit("accepted").alias("outcome")).unionByName(bad.select(F.lit("rejected").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


SUG = f"{N}, g AS (SELECT plan_id, 't' || t AS table_name, 'c' || (k % 3) AS columns, r FROM o WHERE r >= 1000 AND NOT (t % 2 = 0 AND k % 3 = 1) UNION ALL SELECT plan_id, 'u', 'a,b', r FROM o WHERE k % 4 <> 0 AND r >= 5000)"
QUERIES |= {"p1_unreadable_plans": p1_bad, "p1_flatten_plans": p1, "p2_plan_summary": p2, "p3_p8_plan_warnings": p3, "p9_p10_p14_p15_scan_advice": p9, "p11_nested_loop_advice": p11, "p12_sort_advice": p12, "p13_cte_advice": p13, "p16_version_note": p16, "p17_p18_suggest_indexes": p17, "p19_suggestion_rollup": p19, "s11_read_plan_documents": s11}
ORACLES |= {
    "p1_unreadable_plans": "SELECT o_orderkey AS plan_id, CASE WHEN o_orderkey % 3 = 1 THEN 'Plan Rows: \"many\"' ELSE 'node is no object: [1]' END AS problem FROM orders WHERE o_orderkey % 3 = 2 OR (o_orderkey % 3 = 1 AND o_orderkey % 97 <> 0)",
    "p1_flatten_plans": f"{N} SELECT plan_id, path, depth, node_type, relation, plan_rows FROM n",
    "p2_plan_summary": f"{N} SELECT plan_id, CASE WHEN k % 11 = 5 THEN 'Append' WHEN k % 13 = 6 THEN 'CTE Scan' ELSE 'Nested Loop' END AS node_type, CASE WHEN k % 11 = 5 OR k % 13 = 6 THEN 0.0 ELSE CAST(k % 1000 AS DOUBLE) END AS total_cost, CASE WHEN k % 11 <> 5 AND k % 13 = 6 THEN CAST(k % 3000 AS DOUBLE) ELSE r END AS estimated_rows, CASE WHEN k % 2 = 0 THEN 1.5 END AS planning_time, CASE WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) END AS execution_time FROM al",
    "p11_nested_loop_advice": f"{N} SELECT plan_id, 'u' AS table_name, 'z' AS column_name, CAST(k % 250 AS DOUBLE) AS rows_per_loop, 'CREATE INDEX ON public.u (z)' AS ddl FROM o WHERE k % 4 = 0 AND k % 250 > 100",
    "p13_cte_advice": f"{N} SELECT plan_id, 'w' AS cte_name, CAST(k % 3000 AS DOUBLE) AS plan_rows FROM ct WHERE k % 3000 >= 1000",
    "p3_p8_plan_warnings": f"{N} SELECT plan_id, path, 'seq_scan' AS rule, relation AS \"table\" FROM n WHERE node_type = 'Seq Scan' AND CASE WHEN plan_rows > 0 THEN plan_rows WHEN relation = 'u' THEN 6000 ELSE 0 END >= 5000 UNION ALL SELECT plan_id, '', 'nested_loop_seq_scan', 'u' FROM o WHERE k % 4 = 0 AND k % 250 > 100 UNION ALL SELECT plan_id, path, 'large_sort', NULL FROM n WHERE node_type = 'Sort' AND plan_rows > 10000 UNION ALL SELECT plan_id, path, 'filter_removes_most', 'u' FROM n WHERE removed > 0 AND removed / (removed + 5.0) > 0.9 UNION ALL SELECT plan_id, '', CASE WHEN k % 3 = 2 THEN 'no_pruning' ELSE 'weak_pruning' END, 'part' FROM ap WHERE k % 3 > 0 UNION ALL SELECT plan_id, '0', 'weak_pruning', 'part' FROM ct WHERE k % 2 = 0 UNION ALL SELECT plan_id, '', CASE WHEN k % 2 = 0 THEN 'cte_over_partitions' ELSE 'large_cte' END, CASE WHEN k % 2 = 0 THEN 'part' ELSE 'w' END FROM ct WHERE k % 3000 >= 1000",
    "p9_p10_p14_p15_scan_advice": f"{N}, ac AS (SELECT o_orderkey % 5 AS a, 'n0: ' || count(*) FILTER (o_orderkey % 2 = 0) || ', n1: ' || count(*) FILTER (o_orderkey % 2 = 1) AS nodes FROM orders GROUP BY 1) SELECT plan_id, 't' || t AS table_name, (SELECT nodes FROM ac WHERE a = t AND t BETWEEN 1 AND 4) AS nodes, 'c' || (k % 3) AS column_name, CASE WHEN t % 2 = 0 AND k % 3 = 1 THEN 'info' ELSE 'warning' END AS severity, CASE WHEN t % 2 = 0 AND k % 3 = 1 THEN 'ANALYZE public.t' || t ELSE 'CREATE INDEX ON public.t' || t || ' USING ' || CASE WHEN k % 3 = 2 THEN 'gin' ELSE 'btree' END || ' (c' || (k % 3) || ')' || CASE t WHEN 1 THEN ' WHERE c' || (k % 3) || ' IS NOT NULL' WHEN 3 THEN ' WHERE c' || (k % 3) || ' <> ''7''' ELSE '' END END AS ddl, array_to_string(list_filter([CASE WHEN k % 3 = 0 THEN 'few_values' END, CASE WHEN t = 3 THEN 'dominant_value' END, CASE WHEN t = 1 THEN 'mostly_null' END, CASE WHEN r > 10000 THEN 'unordered' END], lambda x: x IS NOT NULL), ',') AS hints FROM o WHERE r >= 10000",
    "p12_sort_advice": f"{N} SELECT plan_id, 'u' AS table_name, 'a,b' AS sort_key FROM o WHERE k % 4 <> 0 AND r >= 10000",
    "p16_version_note": "SELECT o_orderkey, CASE WHEN o_custkey % 9 + 8 >= 13 THEN 'B-tree deduplication' WHEN o_custkey % 9 + 8 >= 11 THEN 'INCLUDE columns' END AS note, CAST(o_custkey % 4 AS INT) AS minor FROM orders",
    "p17_p18_suggest_indexes": f"{SUG} SELECT plan_id, table_name, columns, CASE WHEN r >= 1000000 THEN 'high' WHEN r >= 10000 THEN 'medium' ELSE 'low' END AS impact FROM g",
    "p19_suggestion_rollup": f"{SUG} SELECT table_name, columns, count(DISTINCT plan_id) AS n_plans, max(r) AS max_rows FROM g GROUP BY 1, 2",
    "s11_read_plan_documents": "SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'rejected' ELSE 'accepted' END AS outcome, count(*) AS n FROM orders GROUP BY 1",
}
