"""Queries of the query log, migration log and catalog documentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catascope.adapters import table
from catascope.operators import browse as B
from catascope.operators import migrations as M
from catascope.operators import querylog as Q
from catascope.plans.plan_corpus import dedupe_suggestions, rollup_suggestions, suggest_indexes, with_query_suggestions
from catascope.queries._catalog import SQL, catalog
from catascope.queries.plan_analysis import SUG as PLANS
from catascope.queries.plan_analysis import _indexes as _plan_indexes
from catascope.queries.plan_analysis import _nodes

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _facts(s, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    ref = lambda n, a: F.struct(F.lit(None).cast("string").alias("schema"), n.alias("name"), a.alias("alias"), F.lit("select").alias("context"))
    one = ref(F.concat(F.lit("t"), (c % 9).cast("string")), F.lit("a"))
    two = ref(F.concat(F.lit("t"), ((c + 1) % 9).cast("string")), F.lit("b"))
    return table(s, d, "orders").select(
        F.lit("p").alias("project_id"), F.lit("db").alias("database_id"), F.lit("v1").alias("schema_hash"), o.alias("query_id"),
        F.when(o % 4 == 0, "UPDATE").when(o % 4 == 1, "DELETE").otherwise("SELECT").alias("statement_type"), (o % 3 == 0).alias("has_where"), (o % 5 == 0).alias("has_limit"),
        (o % 7 == 0).alias("has_join"), (o % 2 == 0).alias("has_select_star"), F.when(o % 3 == 1, F.array(one, two)).otherwise(F.array(one)).alias("tables"),
        F.array(F.struct(F.when(o % 2 == 0, F.lit("a")).alias("qualifier"), F.concat(F.lit("c"), (o % 4).cast("string")).alias("column"))).alias("filter_columns"),
        F.when(o % 6 == 0, F.array(F.struct(F.lit(None).cast("string").alias("table"), F.lit("c0").alias("column"), F.lit("date_trunc").alias("func")))).alias("func_wrapped"),
        F.array(F.concat(F.lit("c"), (o % 8).cast("string"))).alias("update_targets"),
    )


def _log_catalog(s, d):
    """The catalog that the orders' log names: tables t0..t7 with c0..c2 (t8 is unknown), t0..t3 large, t2 partitioned by c0, an index on c1 of even tables."""
    i = F.col("i")
    base = table(s, d, "orders").select((F.col("o_custkey") % 9).alias("i")).distinct().where("i < 8").select(
        F.lit("p").alias("project_id"), F.lit("db").alias("database_id"), F.lit("v1").alias("schema_hash"), F.lit("public").alias("table_schema"), F.concat(F.lit("t"), i.cast("string")).alias("table_name"), "i"
    )
    columns = base.withColumn("ordinal", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("column_name", F.concat(F.lit("c"), F.col("ordinal").cast("string")))
    stats = base.withColumns({"reltuples": F.when(i < 4, 20000.0).otherwise(500.0), "table_size": F.lit(20000 * 100).cast("long")})
    return {
        "tables": base.drop("i"), "columns": columns.drop("i"), "stats": stats.drop("i"), "partitioned": base.where("i = 2").drop("i").withColumn("partition_key", F.lit("c0, x")),
        "indexes": base.where("i % 2 = 0").drop("i").withColumn("columns", F.array(F.lit("c1"))),
    }


O = "WITH o AS (SELECT o_orderkey AS q, o_custkey % 9 AS t, (o_custkey + 1) % 9 AS u, o_orderkey % 3 = 1 AS two, CASE o_orderkey % 4 WHEN 0 THEN 'UPDATE' WHEN 1 THEN 'DELETE' ELSE 'SELECT' END AS st FROM orders), r AS (SELECT q, t, st FROM o UNION ALL SELECT q, u, st FROM o WHERE two)"
MISSING = "SELECT DISTINCT q AS query_id, 'missing_relation' AS rule, 'error' AS severity, 'public.t8' AS object FROM r WHERE t = 8"
MISSCOL = "SELECT q AS query_id, 'missing_column' AS rule, 'error' AS severity, 't' || t || '.c3' AS object FROM o WHERE q % 2 = 0 AND q % 4 = 3 AND t <> 8"
ANTI = f"""SELECT q AS query_id, 'select_star' AS rule, 'warning' AS severity, NULL AS object FROM o WHERE q % 2 = 0
 UNION SELECT q, 'unbounded_select', 'warning', 't' || t FROM r WHERE st = 'SELECT' AND q % 3 <> 0 AND q % 5 <> 0 AND t < 4
 UNION SELECT q, 'cartesian', 'warning', NULL FROM o WHERE st = 'SELECT' AND two AND q % 7 <> 0
 UNION SELECT q, 'write_without_where', 'error', NULL FROM o WHERE st <> 'SELECT' AND q % 3 <> 0
 UNION SELECT q, 'partition_key_unfiltered', 'warning', 't2' FROM r WHERE t = 2 AND q % 4 <> 0
 UNION SELECT q, 'partition_key_wrapped', 'warning', 'compare with a range of times' FROM r WHERE t = 2 AND q % 6 = 0
 UNION SELECT q, 'partition_key_update', 'warning', 'c0' FROM r WHERE t = 2 AND st = 'UPDATE' AND q % 8 = 0"""


def _issues(s, d):
    c = _log_catalog(s, d)
    f = _facts(s, d)
    return f, Q.missing_relations(f, c["tables"]).unionByName(Q.missing_columns(f, c["tables"], c["columns"])).unionByName(Q.antipatterns(f, c["stats"], c["partitioned"]))


@query("q1_q2_missing_objects", f"{O} {MISSING} UNION ALL {MISSCOL}")
def q1(s, d):
    c, f = _log_catalog(s, d), _facts(s, d)
    return Q.missing_relations(f, c["tables"]).unionByName(Q.missing_columns(f, c["tables"], c["columns"])).select("query_id", "rule", "severity", "object")


@query("q3_expand_star", f"{O} SELECT q AS query_id, 't' || t AS table_name, 'c0,c1,c2' AS columns FROM r WHERE q % 2 = 0 AND t <> 8")
def q3(s, d):
    return Q.expand_star(_facts(s, d), _log_catalog(s, d)["columns"]).select("query_id", "table_name", F.array_join("columns", ",").alias("columns"))


@query("q4_q10_antipatterns", f"{O} {ANTI}")
def q4(s, d):
    c = _log_catalog(s, d)
    return Q.antipatterns(_facts(s, d), c["stats"], c["partitioned"]).select("query_id", "rule", "severity", "object")


SUGG = "SELECT q AS query_id, 't' || t AS table_name, 'c' || (q % 4) AS column_name FROM o WHERE t < 4 AND NOT (t % 2 = 0 AND q % 4 = 1) AND (q % 2 = 0 OR NOT two)"


@query("q11_suggest_from_filters", f"{O} {SUGG}")
def q11(s, d):
    c = _log_catalog(s, d)
    return Q.suggest_from_filters(_facts(s, d), c["stats"], c["indexes"]).select("query_id", "table_name", "column_name")


@query("q12_validate", f"{O}, i AS ({MISSING} UNION ALL {MISSCOL} UNION ALL ({ANTI})) SELECT q AS query_id, CASE WHEN two THEN 2 ELSE 1 END AS n_objects, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS valid FROM o LEFT JOIN i ON q = query_id GROUP BY q, two")
def q12(s, d):
    f, issues = _issues(s, d)
    return Q.validate(f, issues).select("query_id", "n_objects", "errors", "warnings", "valid")


@query("q13_advise", f"{PLANS}, lo AS (SELECT o_orderkey AS q, o_custkey % 9 AS t, o_orderkey % 3 = 1 AS two FROM orders), s AS ({SUGG.replace('FROM o ', 'FROM lo ')}) SELECT plan_id AS query_id, table_name, columns AS column_name, 'plan' AS origin FROM g UNION ALL SELECT query_id, table_name, column_name, 'query' FROM s WHERE (query_id, table_name, column_name) NOT IN (SELECT plan_id, table_name, columns FROM g)")
def q13(s, d):
    c = _log_catalog(s, d)
    plans = dedupe_suggestions(suggest_indexes(_nodes(s, d), _plan_indexes(s))).withColumnsRenamed({"plan_id": "query_id", "columns": "column_name"})
    return Q.advise(Q.suggest_from_filters(_facts(s, d), c["stats"], c["indexes"]), plans).select("query_id", "table_name", "column_name", "origin")


@query("p19_all_suggestions", f"{PLANS}, lo AS (SELECT o_orderkey AS q, o_custkey % 9 AS t, o_orderkey % 3 = 1 AS two FROM orders), s AS ({SUGG.replace('FROM o ', 'FROM lo ')}), u AS (SELECT plan_id, table_name, columns FROM g UNION SELECT query_id, table_name, column_name FROM s) SELECT table_name, columns, 'btree' AS method, count(*) AS n_plans FROM u GROUP BY 1, 2")
def p19_all(s, d):
    """Suggestions of plans and of query filters, deduped together, over the whole corpus."""
    c = _log_catalog(s, d)
    queries = Q.suggest_from_filters(_facts(s, d), c["stats"], c["indexes"])
    both = with_query_suggestions(suggest_indexes(_nodes(s, d), _plan_indexes(s)), queries, c["columns"].withColumn("type_name", F.lit("bigint")))
    return rollup_suggestions(dedupe_suggestions(both), "method").select("table_name", "columns", "method", "n_plans")


OPS = ("ADD COLUMN", "DROP COLUMN", "SET NOT NULL", "ALTER COLUMN TYPE", "ADD CONSTRAINT", "VALIDATE CONSTRAINT", "CREATE INDEX", "RENAME", "DROP TABLE")


def _ddl(s, d):
    o = F.col("o_orderkey")
    return table(s, d, "orders").select(
        F.lit("p").alias("project_id"), F.lit("db").alias("database_id"), F.lit("v1").alias("schema_hash"), F.floor(o / 4).cast("long").alias("migration_id"), o.alias("op_id"),
        F.element_at(F.array(*[F.lit(x) for x in OPS]), (o % 9).cast("int") + 1).alias("op"), F.lit(None).cast("string").alias("table_schema"), F.concat(F.lit("t"), (o % 10).cast("string")).alias("table_name"),
        F.lit("c0").alias("column_name"), (F.col("o_custkey") % 2 == 0).alias("has_default"), (F.col("o_custkey") % 3 == 0).alias("not_valid"), (F.col("o_custkey") % 5 == 0).alias("concurrently"),
        F.when(F.col("o_custkey") % 7 > 0, (F.col("o_custkey") % 7 + 8).cast("int")).alias("major"),
        F.when(o % 5 < 3, F.element_at(F.array(*[F.lit(x) for x in ("foreign_key", "check", "unique")]), (o % 5).cast("int") + 1)).alias("constraint_type"),
        F.concat(F.lit("n"), o.cast("string")).alias("object_name"),
    )


G = """WITH o AS (SELECT o_orderkey AS op_id, o_orderkey // 4 AS migration_id, o_orderkey % 9 AS op, o_orderkey % 10 AS t, o_custkey % 2 = 0 AS de, o_custkey % 3 = 0 AS nv, o_custkey % 5 = 0 AS co, CASE WHEN o_custkey % 7 > 0 THEN o_custkey % 7 + 8 ELSE 0 END AS major FROM orders),
a AS (SELECT *, CASE op WHEN 0 THEN CASE WHEN NOT de THEN 'safe' WHEN major >= 11 THEN 'caution' ELSE 'dangerous' END WHEN 1 THEN 'safe' WHEN 2 THEN CASE WHEN major >= 12 THEN 'caution' ELSE 'dangerous' END WHEN 3 THEN 'dangerous'
 WHEN 4 THEN CASE WHEN nv THEN 'safe' ELSE 'dangerous' END WHEN 5 THEN 'safe' WHEN 6 THEN CASE WHEN co THEN 'safe' ELSE 'dangerous' END ELSE 'dangerous' END AS safety FROM o WHERE op <> 8 OR migration_id NOT IN (SELECT migration_id FROM o WHERE op <> 8))"""


def _assessed(s, d):
    c = _log_catalog(s, d)
    nulls = c["columns"].where("column_name = 'c0'").withColumn("null_frac", F.lit(0.3))
    return M.assess(_ddl(s, d), c["stats"], nulls)


OPERATION = "CASE op WHEN 0 THEN 'ADD COLUMN' WHEN 1 THEN 'DROP COLUMN' WHEN 2 THEN 'SET NOT NULL' WHEN 3 THEN 'ALTER COLUMN TYPE' WHEN 4 THEN CASE op_id % 5 WHEN 0 THEN 'ADD FOREIGN KEY' WHEN 1 THEN 'ADD CHECK CONSTRAINT' ELSE 'ADD CONSTRAINT' END WHEN 5 THEN 'VALIDATE CONSTRAINT' WHEN 6 THEN CASE WHEN co THEN 'CREATE INDEX CONCURRENTLY' ELSE 'CREATE INDEX' END WHEN 7 THEN 'RENAME' ELSE 'DROP TABLE' END"
LOCK = "CASE WHEN op = 4 AND nv THEN 'ACCESS EXCLUSIVE (brief)' WHEN op = 5 OR (op = 6 AND co) THEN 'SHARE UPDATE EXCLUSIVE' WHEN op = 6 THEN 'SHARE (blocks writes)' ELSE 'ACCESS EXCLUSIVE' END"
DURATION = """CASE op WHEN 0 THEN CASE WHEN NOT de THEN 'brief' WHEN major >= 11 THEN 'brief if the default is immutable, else a table rewrite' ELSE 'table rewrite' END
 WHEN 1 THEN 'brief, metadata only' WHEN 2 THEN CASE WHEN major >= 12 THEN 'scan unless a check proves it' ELSE 'full scan' END WHEN 3 THEN 'table rewrite'
 WHEN 4 THEN CASE WHEN nv THEN 'brief, metadata only' ELSE CASE op_id % 5 WHEN 0 THEN 'full scan of both tables' WHEN 1 THEN 'full scan' ELSE 'full scan or index build' END END
 WHEN 5 THEN 'full scan without blocking writes' WHEN 6 THEN CASE WHEN co THEN 'two scans without blocking writes' ELSE 'full scan blocking writes' END
 WHEN 7 THEN 'brief, breaks callers' ELSE 'brief, data is gone' END"""
UNDO = """CASE op WHEN 0 THEN 'ALTER TABLE public.t' || t || ' DROP COLUMN c0;' WHEN 2 THEN 'ALTER TABLE public.t' || t || ' ALTER COLUMN c0 DROP NOT NULL;'
 WHEN 4 THEN 'ALTER TABLE public.t' || t || ' DROP CONSTRAINT n' || op_id || ';' WHEN 6 THEN 'DROP INDEX CONCURRENTLY n' || op_id || ';'
 WHEN 7 THEN 'ALTER TABLE public.t' || t || ' RENAME TO its old name;' END"""


@query("g1_g9_migration_risk", f"{G} SELECT op_id, {OPERATION} AS operation, safety, {LOCK} AS lock, {DURATION} AS duration, {UNDO} AS rollback, CASE WHEN t < 4 THEN 20000.0 WHEN t < 8 THEN 500.0 END AS rows, CASE WHEN t < 8 THEN '1.9 MB' END AS size, CASE WHEN op = 2 AND t < 8 THEN CASE WHEN t < 4 THEN 6000 ELSE 150 END END AS estimated_nulls FROM a")
def g1(s, d):
    return _assessed(s, d).select("op_id", "operation", "safety", "lock", "duration", "rollback", "rows", "size", "estimated_nulls")


@query("g10_migration_rollup", f"{G} SELECT migration_id, bool_or(safety = 'dangerous') AS has_dangerous, CASE WHEN bool_or(safety = 'dangerous') THEN 'dangerous' WHEN bool_or(safety = 'caution') THEN 'caution' ELSE 'safe' END AS worst FROM a GROUP BY 1")
def g10(s, d):
    return M.per_migration(_assessed(s, d)).select("migration_id", "has_dangerous", "worst")


@query("x1_list_tables", f"WITH {SQL} SELECT database_id, table_name, reltuples, CASE WHEN table_name = 'log_all' THEN (SELECT count(*) FROM kids k WHERE k.database_id = t.database_id) ELSE 0 END AS n_partitions, CASE WHEN database_id = 'db0' THEN 0 ELSE 4 END AS n_nodes, count(*) OVER (PARTITION BY database_id) AS total FROM tabs t ORDER BY reltuples DESC, database_id, table_name LIMIT 10 OFFSET 2")
def x1(s, d):
    c = catalog(s, d)
    nodes = c["column"].where("database_id <> 'db0'").select("project_id", "database_id", "schema_hash", (F.col("ordinal") % 4).alias("node_label"))
    return B.list_tables(c["table"], c["stat_table"], c["partition_child"], sort="rows", limit=10, offset=2, nodes=nodes).select("database_id", "table_name", "reltuples", "n_partitions", "n_nodes", "total")


DESCRIBED = """SELECT t.database_id, t.table_name, reltuples, (SELECT string_agg(column_name || ' ' || type_name, ',' ORDER BY ordinal) FROM cols c WHERE c.database_id = t.database_id AND c.table_name = t.table_name) AS columns,
 (SELECT string_agg(name || ' ' || kind || ' ' || col, ',' ORDER BY name) FROM cons c WHERE c.database_id = t.database_id AND c.table_name = t.table_name) AS constraints,
 (SELECT string_agg(name || ' ' || index_type || ' ' || k, ',' ORDER BY name) FROM idx i WHERE i.database_id = t.database_id AND i.table_name = t.table_name) AS indexes,
 CASE WHEN table_name = 'log_all' THEN (SELECT string_agg(child_name || ' ' || CAST(s.reltuples AS BIGINT), ',' ORDER BY child_name) FROM kids k JOIN tabs s ON s.database_id = k.database_id AND s.table_name = k.child_name WHERE k.database_id = t.database_id) END AS partitions,
 (SELECT string_agg(column_name || ' ' || k, ',' ORDER BY ordinal) FROM cols c WHERE c.database_id = t.database_id AND c.table_name = t.table_name) AS profiles FROM tabs t"""


def _described(s, d, detail):
    c = catalog(s, d)
    profiles = c["column"].select(*B.TABLE, "column_name", F.col("k").alias("note"))
    return B.describe_tables(c["table"], c["column"], c["constraint"], c["index"], c["stat_table"], children=c["partition_child"], profiles=profiles, stat_index=c["stat_index"], detail=detail)


def _line(c, *fields):
    items = F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *[x[f].cast("long") if f == "reltuples" else x[f] for f in fields])), ",")
    return F.when(F.size(c) > 0, items)


@query("x2_describe_tables", f"WITH {SQL} {DESCRIBED}")
def x2(s, d):
    return _described(s, d, "full").select(
        "database_id", "table_name", "reltuples", _line("columns", "column_name", "type_name").alias("columns"), _line("constraints", "name", "kind", "definition").alias("constraints"),
        _line("indexes", "name", "index_type", "index_size").alias("indexes"), _line("partitions", "child_name", "reltuples").alias("partitions"), _line("profiles", "column_name", "note").alias("profiles"),
    ).withColumn("constraints", F.regexp_replace("constraints", " (primary_key|foreign_key) (primary_key|foreign_key) ", " $1 "))


@query("x2_describe_index_scans", f"WITH {SQL} SELECT t.database_id, t.table_name, (SELECT string_agg(name || ' ' || k || coalesce(' ' || CASE WHEN pos % 4 > 0 THEN (pos % 4) * k + (pos % 4) * (pos % 4 - 1) // 2 END, ''), ',' ORDER BY name) FROM idx i WHERE i.database_id = t.database_id AND i.table_name = t.table_name) AS indexes FROM tabs t")
def x2_scans(s, d):
    """Scans of an index by none to three nodes beside its size."""
    c = catalog(s, d)
    nodes = F.explode(F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda n: n < F.col("pos") % 4)).alias("node")
    scans = c["index"].select(*B.K, F.col("table_schema").alias("index_schema"), F.col("name").alias("index_name"), "k", nodes).withColumn("idx_scan", F.col("k") + F.col("node"))
    rows = B.describe_tables(c["table"], c["column"], c["constraint"], c["index"], c["stat_table"], stat_index=c["stat_index"], detail="summary", act_index=scans)
    return rows.select("database_id", "table_name", _line("indexes", "name", "index_size", "idx_scan").alias("indexes"))


@query("x2_describe_stats", f"WITH {SQL}, x AS ({DESCRIBED}) SELECT database_id, table_name, reltuples, partitions, profiles FROM x")
def x2_stats(s, d):
    return _described(s, d, "stats").select("database_id", "table_name", "reltuples", _line("partitions", "child_name", "reltuples").alias("partitions"), _line("profiles", "column_name", "note").alias("profiles"))


FOUND = """SELECT database_id, table_name, 'table' AS kind, table_name AS object FROM tabs WHERE table_name ILIKE '%log%' UNION ALL SELECT database_id, table_name, 'column', column_name FROM cols WHERE column_name ILIKE '%log%'
 UNION ALL SELECT database_id, table_name, 'constraint', name FROM cons WHERE kind || ' ' || col ILIKE '%log%' UNION ALL SELECT database_id, table_name, 'index', name FROM idx WHERE name ILIKE '%log%' OR col ILIKE '%log%'
 UNION ALL SELECT database_id, 'v' || k, 'view', 'v' || k FROM cols WHERE table_name ILIKE '%log%' UNION ALL SELECT database_id, table_name || k, 'function', table_name || k FROM cols WHERE table_name ILIKE '%log%'
 UNION ALL SELECT database_id, 'e' || k, 'enum', 'e' || k FROM cols WHERE column_name ILIKE '%log%' OR table_name ILIKE '%log%'"""


@query("x3_search_catalog", f"WITH {SQL} {FOUND}")
def x3(s, d):
    """Views, functions and enums from the columns: a view's definition, a function's name and an enum's labels hold the text."""
    c = catalog(s, d)
    own = c["column"].select(*B.K, F.lit("public").alias("schema"), "table_name", "column_name", F.col("k").cast("string").alias("k"))
    views = own.select(*B.K, "schema", F.concat(F.lit("v"), "k").alias("name"), F.concat(F.lit("SELECT * FROM "), F.upper("table_name")).alias("definition"))
    functions = own.select(*B.K, "schema", F.concat("table_name", "k").alias("name"))
    enums = own.select(*B.K, "schema", F.concat(F.lit("e"), "k").alias("name"), F.array("column_name", "table_name").alias("labels"))
    return B.search_catalog("LOG", c["table"], c["column"], c["constraint"], c["index"], limit=None, views=views, functions=functions, enums=enums).select("database_id", "table_name", "kind", "object")


@query("x4_find_related", f"WITH {SQL}, f AS (SELECT database_id, 'public.' || table_name AS own, fk_table, name, 'SELECT * FROM public.' || table_name || ' a JOIN ' || fk_table || ' b ON a.' || col || ' = b.' || col AS sample_join FROM cons WHERE kind = 'foreign_key') SELECT database_id, own AS this, 'outgoing' AS direction, fk_table AS other, name, sample_join FROM f UNION ALL SELECT database_id, fk_table, 'incoming', own, name, sample_join FROM f")
def x4(s, d):
    return B.find_related(catalog(s, d)["constraint"]).select("database_id", "this", "direction", "other", "name", "sample_join")
