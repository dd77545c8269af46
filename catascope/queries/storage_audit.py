"""Queries of index bloat, autovacuum health and the structural audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catascope.adapters import table
from catascope.functions.names import type_width
from catascope.operators import audit as A
from catascope.operators import lint as L
from catascope.operators import storage as S
from catascope.queries._catalog import SQL, catalog

QUERIES, ORACLES = {}, {}
K = ["project_id", "database_id", "schema_hash"]


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


WIDTH = "CASE type_name WHEN 'varchar(20)' THEN 32 WHEN 'integer' THEN 4 WHEN 'timestamp' THEN 8 WHEN 'boolean' THEN 1 WHEN 'bigint' THEN 8 WHEN 'uuid' THEN 16 WHEN 'timestamptz' THEN 8 ELSE 32 END"
BLOAT = f"WITH {SQL}, b AS (SELECT i.database_id, i.table_name, i.name, i.col, {WIDTH} AS width, (i.k % 50) * 100 AS relpages, i.k * 1000.0 AS reltuples FROM idx i JOIN cols c ON c.database_id = i.database_id AND c.table_name = i.table_name AND c.column_name = i.col WHERE index_type = 'btree'), r AS (SELECT *, greatest(1, ceil(reltuples / (8192 * 0.9::DOUBLE / (8 + width))))::BIGINT AS expected_pages FROM b WHERE relpages > 0 AND reltuples > 0)"


@query("b1_b3_index_bloat", f"{BLOAT} SELECT database_id, table_name, name, width, expected_pages, relpages / expected_pages::DOUBLE AS ratio FROM r")
def b1(s, d):
    c = catalog(s, d)
    return S.index_bloat(c["index"], c["column"], c["stat_index"]).select("database_id", "table_name", "name", "width", "expected_pages", "ratio")


#: Widths of the types by their names; the last ones are not in the table of widths.
WIDTHS = {
    2: "smallint INT2", 4: "integer int int4 real float4 date oid", 8: "bigint int8 timestamp timestamptz float8", 1: "boolean bool", 16: "uuid numeric(10,2)", 19: "inet cidr",
    6: "macaddr", 32: "text varchar(20) character char(3) bpchar bytea text[] time interval decimal money tsvector", 64: "jsonb json xml jsonb[]",
}
SPACED = {8: ("double precision", "timestamp without time zone", " Timestamp with time zone"), 32: ("character varying(9)",)}
TYPED = [(t, w) for w, names in WIDTHS.items() for t in names.split()] + [(t, w) for w, names in SPACED.items() for t in names]


@query("b3_type_widths", f"SELECT p_partkey, [{', '.join(str(w) for _, w in TYPED)}][1 + p_partkey % {len(TYPED)}] AS width FROM part")
def b3(s, d):
    name = F.element_at(F.array(*[F.lit(t) for t, _ in TYPED]), (F.col("p_partkey") % len(TYPED)).cast("int") + 1)
    return table(s, d, "part").select("p_partkey", type_width(name).alias("width"))


@query("b2_bloated_indexes", f"{BLOAT} SELECT database_id, name, relpages / expected_pages::DOUBLE AS ratio FROM r WHERE relpages / expected_pages::DOUBLE > 1.5")
def b2(s, d):
    c = catalog(s, d)
    return S.bloated_indexes(S.index_bloat(c["index"], c["column"], c["stat_index"])).select("database_id", "name", "ratio")


def _settings(s, d):
    """Three settings for each database, from ``part``; some values do not parse."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, "autovacuum_vacuum_threshold").when(k % 3 == 1, "autovacuum_vacuum_scale_factor").otherwise("autovacuum")
    value = F.when(k % 3 == 2, F.when(k % 2 == 0, "off").otherwise("on")).when(k % 7 == 4, F.lit("bad")).otherwise((k % 90).cast("string"))
    return table(s, d, "part").select(F.lit("p").alias("project_id"), F.concat(F.lit("db"), F.floor(k / 3).cast("string")).alias("database_id"), F.lit("v1").alias("schema_hash"), name.alias("name"), value.alias("setting"))


DEFAULTS = "n AS (SELECT 'db' || (p_partkey // 3) AS database_id, p_partkey % 3 AS r, CASE WHEN p_partkey % 3 = 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 'off' ELSE 'on' END WHEN p_partkey % 7 = 4 THEN 'bad' ELSE CAST(p_partkey % 90 AS VARCHAR) END AS v FROM part), df AS (SELECT database_id, coalesce(bool_or(v = 'on') FILTER (r = 2), true) AS autovacuum, coalesce(try_cast(max(v) FILTER (r = 0) AS DOUBLE), 50) AS thr, coalesce(try_cast(max(v) FILTER (r = 1) AS DOUBLE), 0.2) AS sf FROM n GROUP BY 1)"


@query("v1_autovacuum_defaults", f"WITH {DEFAULTS} SELECT database_id, autovacuum, thr AS autovacuum_vacuum_threshold, sf AS autovacuum_vacuum_scale_factor FROM df")
def v1(s, d):
    return S.autovacuum_defaults(_settings(s, d)).select("database_id", "autovacuum", "autovacuum_vacuum_threshold", "autovacuum_vacuum_scale_factor")


FIVE = ("autovacuum", "autovacuum_vacuum_threshold", "autovacuum_vacuum_scale_factor", "autovacuum_analyze_threshold", "autovacuum_analyze_scale_factor")


@query("v1_autovacuum_all_settings", """WITH n AS (SELECT 'db' || (p_partkey // 5) AS database_id, p_partkey % 5 AS r, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'on' ELSE 'off' END WHEN p_partkey % 11 = 4 THEN 'none' WHEN p_partkey % 7 = 2 THEN p_partkey % 90 || '.5' ELSE CAST(p_partkey % 90 AS VARCHAR) END AS v FROM part),
 g AS (SELECT database_id, max(v) FILTER (r = 0) AS a, max(v) FILTER (r = 1) AS vt, max(v) FILTER (r = 2) AS vs, max(v) FILTER (r = 3) AS t, max(v) FILTER (r = 4) AS sf FROM n GROUP BY 1)
 SELECT database_id, coalesce(a = 'on', true) AS autovacuum, coalesce(CASE WHEN vt NOT LIKE '%.5' THEN try_cast(vt AS DOUBLE) END, 50) AS autovacuum_vacuum_threshold, coalesce(try_cast(vs AS DOUBLE), 0.2) AS autovacuum_vacuum_scale_factor, coalesce(CASE WHEN t NOT LIKE '%.5' THEN try_cast(t AS DOUBLE) END, 50) AS autovacuum_analyze_threshold, coalesce(try_cast(sf AS DOUBLE), 0.1) AS autovacuum_analyze_scale_factor FROM g""")
def v1_all(s, d):
    """All five settings of a database from five parts; some are words, and thresholds with a fraction do not count."""
    k = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(x) for x in FIVE]), (k % 5).cast("int") + 1)
    value = F.when(k % 5 == 0, F.when(k % 2 == 0, "on").otherwise("off")).when(k % 11 == 4, "none").when(k % 7 == 2, F.concat((k % 90).cast("string"), F.lit(".5"))).otherwise((k % 90).cast("string"))
    rows = table(s, d, "part").select(F.lit("p").alias("project_id"), F.concat(F.lit("db"), F.floor(k / 5).cast("string")).alias("database_id"), F.lit("v1").alias("schema_hash"), name.alias("name"), value.alias("setting"))
    return S.autovacuum_defaults(rows).select("database_id", *FIVE)


def _health(s, d):
    c = catalog(s, d)
    merged = c["table"].select(*S.TABLE, (F.col("k") * 9000).alias("n_dead_tup_sum"))
    return S.vacuum_health(c["table"], c["stat_table"], merged, S.autovacuum_defaults(_settings(s, d)))


HEALTH = f"WITH {SQL}, {DEFAULTS}, h AS (SELECT t.database_id, table_name, reltuples, t.k * 9000 AS dead, coalesce(autovacuum, true) AS enabled, coalesce(thr, 50) + CASE WHEN table_name = 'tags' THEN 0.05::DOUBLE ELSE coalesce(sf, 0.2) END * reltuples AS vacuum_trigger, table_name = 'tags' AS overridden FROM tabs t LEFT JOIN df USING (database_id) WHERE reltuples >= 10000)"


@query("v2_v3_vacuum_health", f"{HEALTH} SELECT *, CASE WHEN vacuum_trigger > 0 THEN dead / vacuum_trigger ELSE 0 END AS progress FROM h")
def v3(s, d):
    return _health(s, d).select("database_id", "table_name", "reltuples", "dead", "enabled", "vacuum_trigger", "overridden", "progress")


@query("v4_vacuum_recommendations", f"{HEALTH}, z AS (SELECT *, greatest(0.001::DOUBLE, round(100000 / reltuples, 3)) AS scale_factor, least(greatest(floor(reltuples * 0.01::DOUBLE), 500), 5000) AS threshold FROM h) SELECT database_id, table_name, unnest(list_filter([CASE WHEN NOT enabled THEN 'enable autovacuum' END, CASE WHEN reltuples >= 1000000 AND NOT overridden THEN 'tune a large table' END, CASE WHEN dead / reltuples > 0.1 THEN 'many dead rows' END, CASE WHEN vacuum_trigger > 10000000 THEN 'trigger is very high' END], lambda x: x IS NOT NULL)) AS advice, scale_factor, threshold::BIGINT AS threshold FROM z")
def v4(s, d):
    return S.vacuum_recommendations(_health(s, d)).select("database_id", "table_name", "advice", "scale_factor", F.col("threshold").cast("long").alias("threshold"))


def _line_indexes(s, d):
    """Indexes from ``lineitem``: each order is a catalog, its lines are indexes of two tables."""
    cols = F.slice(F.array(*[F.lit(x) for x in ("a", "b", "c")]), F.lit(1), 1 + F.col("l_linenumber") % 3)
    return table(s, d, "lineitem").select(
        F.lit("p").alias("project_id"), F.concat(F.lit("db"), F.col("l_orderkey").cast("string")).alias("database_id"), F.lit("v1").alias("schema_hash"), F.lit("public").alias("table_schema"),
        F.concat(F.lit("t"), (F.col("l_partkey") % 2).cast("string")).alias("table_name"), F.concat_ws("_", F.lit("i"), "l_linenumber", "l_partkey", "l_suppkey").alias("name"),
        (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("pos"), cols.alias("columns"), F.lit("btree").alias("index_type"), F.lit(None).cast("string").alias("predicate"),
        F.array().cast("array<string>").alias("include_columns"), (F.col("l_suppkey") % 4 == 0).alias("is_unique"), F.lit(False).alias("is_primary"), (F.col("l_suppkey") % 8 == 0).alias("backs_constraint"),
    )


LI = "li AS (SELECT 'db' || l_orderkey AS database_id, 't' || (l_partkey % 2) AS table_name, 'i_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS name, l_linenumber * 1000000 + l_partkey AS pos, 1 + l_linenumber % 3 AS n, l_suppkey % 4 = 0 AS u, l_suppkey % 8 = 0 AS c FROM lineitem)"


@query("a1_duplicate_indexes", f"WITH {LI} SELECT a.database_id, a.table_name, a.name || ',' || b.name AS object, CASE WHEN a.u = b.u AND NOT (a.c AND b.c) THEN 'error' ELSE 'warning' END AS severity, CASE WHEN a.u = b.u AND a.c AND b.c THEN 'both back constraints' WHEN a.u = b.u THEN 'drop ' || CASE WHEN b.c AND NOT a.c THEN a.name ELSE b.name END ELSE 'drop ' || CASE WHEN a.u THEN b.name ELSE a.name END END AS message FROM li a JOIN li b ON a.database_id = b.database_id AND a.table_name = b.table_name AND a.n = b.n AND a.pos < b.pos")
def a1(s, d):
    return A.duplicate_indexes(_line_indexes(s, d)).select("database_id", "table_name", "object", "severity", "message")


@query("a2_redundant_indexes", f"WITH {LI} SELECT a.database_id, a.table_name, a.name || ',' || b.name AS object FROM li a JOIN li b ON a.database_id = b.database_id AND a.table_name = b.table_name AND a.n < b.n AND NOT a.u")
def a2(s, d):
    return A.redundant_indexes(_line_indexes(s, d)).select("database_id", "table_name", "object")


@query("a1_duplicate_index_classes", f"WITH {LI}, k AS (SELECT database_id, table_name, n, count(*) AS m, arg_max({{'name': name, 'pos': pos, 'u': u, 'c': c}}, (u, c, -pos, name)) AS keep FROM li GROUP BY 1, 2, 3 HAVING count(*) > 1) SELECT li.database_id, li.table_name, li.name || ',' || keep.name AS object, CASE WHEN li.u = keep.u AND NOT (li.c AND keep.c) THEN 'error' ELSE 'warning' END AS severity, CASE WHEN li.u = keep.u AND li.c AND keep.c THEN 'both back constraints' ELSE 'drop ' || li.name END AS message FROM li JOIN k USING (database_id, table_name, n) WHERE li.name <> keep.name OR li.pos <> keep.pos")
def a1_classes(s, d):
    return A.duplicate_index_classes(_line_indexes(s, d)).select("database_id", "table_name", "object", "severity", "message")


@query("a2_redundant_index_classes", f"WITH {LI} SELECT a.database_id, a.table_name, a.name || ',' || arg_min(b.name, (b.n, b.name)) AS object, 'covered by ' || count(*) AS message FROM li a JOIN li b ON a.database_id = b.database_id AND a.table_name = b.table_name AND a.n < b.n AND NOT a.u GROUP BY a.database_id, a.table_name, a.name, a.pos")
def a2_classes(s, d):
    return A.redundant_index_classes(_line_indexes(s, d)).select("database_id", "table_name", "object", "message")


@query("a3_too_many_indexes", f"WITH {LI} SELECT database_id, table_name FROM li GROUP BY 1, 2 HAVING count(*) > 3")
def a3(s, d):
    return A.too_many_indexes(_line_indexes(s, d), 3).select("database_id", "table_name")


@query("a4_wide_columns", f"WITH {SQL} SELECT i.database_id, i.name AS object, i.col AS message FROM idx i JOIN cols c ON c.database_id = i.database_id AND c.table_name = i.table_name AND c.column_name = i.col WHERE type_name IN ('text', 'varchar(20)')")
def a4(s, d):
    c = catalog(s, d)
    return A.wide_columns(c["index"], c["column"]).select("database_id", "object", "message")


@query("a5_bloated_indexes", f"{BLOAT} SELECT database_id, name AS object FROM r WHERE relpages / expected_pages::DOUBLE > 1.5")
def a5(s, d):
    c = catalog(s, d)
    return A.bloated(c["index"], c["column"], c["stat_index"]).select("database_id", "object")


def _links(s, d):
    """Foreign keys between columns of the derived catalog: each to the column of the same rank in ``orders``."""
    c = catalog(s, d)
    target = c["column"].where("table_name = 'orders'").select(*K, "ordinal", F.col("column_name").alias("ref"))
    rows = c["constraint"].where("kind = 'foreign_key'").join(c["column"].select(*S.TABLE, F.col("column_name").alias("col"), "ordinal"), [*S.TABLE, "col"]).join(target, [*K, "ordinal"])
    return c, rows.withColumns({"fk_table": F.lit("public.orders"), "fk_columns": F.array("ref")})


@query("a6_fk_type_mismatch", f"WITH {SQL} SELECT x.database_id, x.table_name, x.col AS object, a.type_name || ' references ' || b.type_name AS message FROM cons x JOIN cols a ON a.database_id = x.database_id AND a.table_name = x.table_name AND a.column_name = x.col JOIN cols b ON b.database_id = x.database_id AND b.table_name = 'orders' AND b.ordinal = a.ordinal WHERE kind = 'foreign_key' AND a.type_name <> b.type_name")
def a6(s, d):
    c, rows = _links(s, d)
    return A.fk_type_mismatch(rows, c["column"]).select("database_id", "table_name", "object", "message")


def _edges(s, d):
    """A foreign-key graph of up to twelve tables for every eight parts."""
    n = F.col("p_partkey")
    name = lambda x: F.concat(F.lit("public.t"), x.cast("string"))
    key = [F.lit("p").alias("project_id"), F.concat(F.lit("db"), F.floor(n / 8).cast("string")).alias("database_id"), F.lit("v1").alias("schema_hash")]
    return table(s, d, "part").select(*key, name(n % 12).alias("a"), name((n * 5 + F.col("p_size")) % 12).alias("b")).distinct()


EDGES = "e AS (SELECT DISTINCT 'db' || (p_partkey // 8) AS database_id, 'public.t' || (p_partkey % 12) AS a, 'public.t' || ((p_partkey * 5 + p_size) % 12) AS b FROM part)"


@query("a7_fk_cycles", f"WITH RECURSIVE {EDGES}, p AS (SELECT database_id, a AS start, b AS cur, [a] AS path FROM e WHERE b >= a UNION ALL SELECT p.database_id, start, e.b, list_append(path, cur) FROM p JOIN e ON e.a = p.cur AND e.database_id = p.database_id WHERE p.cur <> start AND e.b >= start AND (e.b = start OR NOT list_contains(list_append(path, cur), e.b)) AND len(path) < 10) SELECT database_id, array_to_string(path, ' -> ') AS cycle FROM p WHERE cur = start")
def a7(s, d):
    return A.fk_cycles(_edges(s, d)).select("database_id", F.array_join("path", " -> ").alias("cycle"))


@query("a8_fk_orphans", f"WITH {EDGES}, t AS (SELECT DISTINCT 'db' || (p_partkey // 8) AS database_id, 't' || i AS table_name FROM part, range(14) x(i)) SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.database_id = t.database_id AND (a = 'public.' || table_name OR b = 'public.' || table_name))")
def a8(s, d):
    n = F.explode(F.sequence(F.lit(0), F.lit(13))).alias("i")
    t = table(s, d, "part").select(F.floor(F.col("p_partkey") / 8).cast("string").alias("g")).distinct().select("g", n)
    t = t.select(F.lit("p").alias("project_id"), F.concat(F.lit("db"), "g").alias("database_id"), F.lit("v1").alias("schema_hash"), F.lit("public").alias("table_schema"), F.concat(F.lit("t"), F.col("i").cast("string")).alias("table_name"))
    return A.fk_orphans(t, _edges(s, d)).select("database_id", "table_name")


PKC = "(database_id, table_name, column_name) IN (SELECT database_id, table_name, col FROM cons WHERE kind = 'primary_key')"


@query("a9_non_sequential_pk", f"WITH {SQL} SELECT database_id, table_name, column_name AS object FROM cols WHERE type_name = 'uuid' AND {PKC}")
def a9(s, d):
    c = catalog(s, d)
    return A.non_sequential_pk(c["constraint"], c["column"]).select("database_id", "table_name", "object")


@query("a10_bool_prefix", f"WITH {SQL} SELECT database_id, table_name, column_name AS object FROM cols WHERE type_name = 'boolean' AND column_name NOT LIKE 'is!_%' ESCAPE '!'")
def a10(s, d):
    return A.bool_prefix(catalog(s, d)["column"]).select("database_id", "table_name", "object")


#: Names to judge: every reserved word in one case or the other, and words that only look like one.
NAMES = (
    "all ALTER and any as asc between by Case check column constraint create cross current default delete desc distinct drop else end exists false "
    "fetch for foreign from full grant group having in INDEX inner insert into is join key left like limit not null offset on or order outer primary "
    "references right select set table then to true union unique update User using values when where with orders keys name type status analyze "
    "window lateral both do collate returning"
).split()
FREE_NAMES = ("orders", "keys", "name", "type", "status", "analyze", "window", "lateral", "both", "do", "collate", "returning")
NAMED = f"[{', '.join(repr(x) for x in NAMES)}][1 + p_partkey % {len(NAMES)}]"
FREE_SQL = ", ".join(repr(x) for x in FREE_NAMES)


def _named(s, d):
    """A column per part, named by one of NAMES; every 50th table has that name too."""
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.col("p_partkey") % len(NAMES)).cast("int") + 1)
    own = F.when(F.col("p_partkey") % 50 == 0, name).otherwise(F.concat(F.lit("t"), F.col("p_partkey").cast("string")))
    rows = table(s, d, "part").select(F.lit("p").alias("project_id"), F.lit("db").alias("database_id"), F.lit("v1").alias("schema_hash"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("table_schema"), own.alias("table_name"), name.alias("column_name"))
    return rows.select(*S.TABLE).distinct(), rows


@query("a11_reserved_names", f"WITH n AS (SELECT 's' || p_partkey AS table_schema, {NAMED} AS name, p_partkey % 50 = 0 AS own FROM part) SELECT table_schema, name AS object FROM n WHERE lower(name) NOT IN ({FREE_SQL}) UNION ALL SELECT table_schema, NULL FROM n WHERE own AND lower(name) NOT IN ({FREE_SQL})")
def a11(s, d):
    return A.reserved_names(*_named(s, d)).select("table_schema", "object")


@query("a12_id_mismatch", f"WITH {SQL} SELECT database_id, string_agg(DISTINCT col, ',' ORDER BY col) AS message FROM cons WHERE kind = 'foreign_key' GROUP BY database_id, fk_table HAVING count(DISTINCT col) > 1")
def a12(s, d):
    return A.id_mismatch(catalog(s, d)["constraint"]).select("database_id", "message")


@query("a13_no_comment", f"WITH {SQL} SELECT database_id, table_name, NULL AS object FROM tabs WHERE n_columns >= 5 AND comment IS NULL UNION ALL SELECT database_id, table_name, CAST(count(*) FILTER (comment IS NULL) AS VARCHAR) FROM cols GROUP BY 1, 2 HAVING count(*) >= 5 AND count(*) FILTER (comment IS NULL) > 0")
def a13(s, d):
    c = catalog(s, d)
    return A.no_comment(c["table"], c["column"]).select("database_id", "table_name", "object")


@query("a14_large_table_defaults", f"WITH {SQL} SELECT database_id, table_name FROM tabs WHERE reltuples >= 1000000 AND table_name <> 'tags'")
def a14(s, d):
    c = catalog(s, d)
    return A.large_table_defaults(c["table"], c["stat_table"]).select("database_id", "table_name")


FOUND = f"""SELECT 'naming/reserved' AS rule, count(*) AS n FROM cols WHERE column_name = 'order'
 UNION ALL SELECT 'naming/reserved', count(*) FROM tabs WHERE table_name IN ('order', 'group') UNION ALL SELECT 'pk/non_sequential', count(*) FROM cols WHERE type_name = 'uuid' AND {PKC}
 UNION ALL SELECT 'indexes/wide_columns', count(*) FROM idx i JOIN cols c ON c.database_id = i.database_id AND c.table_name = i.table_name AND c.column_name = i.col WHERE type_name IN ('text', 'varchar(20)')
 UNION ALL SELECT 'indexes/bloated', count(*) FROM r WHERE relpages / expected_pages::DOUBLE > 1.5
 UNION ALL SELECT 'indexes/too_many', count(*) FROM (SELECT 1 FROM idx GROUP BY database_id, table_name HAVING count(*) > 10)
 UNION ALL SELECT 'indexes/duplicate', count(*) FROM idx a JOIN idx b ON a.database_id = b.database_id AND a.table_name = b.table_name AND a.col = b.col AND a.index_type = b.index_type AND a.pos < b.pos WHERE NOT a.is_primary AND NOT b.is_primary
 UNION ALL SELECT 'fk/type_mismatch', count(*) FROM cons x JOIN cols a ON a.database_id = x.database_id AND a.table_name = x.table_name AND a.column_name = x.col JOIN cols b ON b.database_id = x.database_id AND 'public.' || b.table_name = x.fk_table AND b.column_name = x.col WHERE kind = 'foreign_key' AND a.type_name <> b.type_name
 UNION ALL SELECT 'fk/orphan', count(*) FROM tabs t WHERE NOT EXISTS (SELECT 1 FROM cons c WHERE kind = 'foreign_key' AND c.database_id = t.database_id AND (c.table_name = t.table_name OR c.fk_table = 'public.' || t.table_name))
 UNION ALL SELECT 'fk/circular', count(*) FROM (SELECT DISTINCT database_id, table_name FROM cons WHERE kind = 'foreign_key' AND fk_table = 'public.' || table_name)
 UNION ALL SELECT 'fk/circular', count(*) FROM (SELECT DISTINCT database_id FROM cons a WHERE kind = 'foreign_key' AND table_name = 'item' AND fk_table = 'public.orders' AND EXISTS (SELECT 1 FROM cons b WHERE b.kind = 'foreign_key' AND b.database_id = a.database_id AND b.table_name = 'orders' AND b.fk_table = 'public.item'))
 UNION ALL SELECT 'naming/bool_prefix', count(*) FROM cols WHERE type_name = 'boolean' AND column_name NOT LIKE 'is!_%' ESCAPE '!'
 UNION ALL SELECT 'naming/id_mismatch', count(*) FROM (SELECT 1 FROM cons WHERE kind = 'foreign_key' GROUP BY database_id, fk_table HAVING count(DISTINCT col) > 1)
 UNION ALL SELECT 'docs/no_comment', count(*) FROM tabs WHERE n_columns >= 5 AND comment IS NULL
 UNION ALL SELECT 'docs/no_comment', count(*) FROM (SELECT 1 FROM cols GROUP BY database_id, table_name HAVING count(*) >= 5 AND count(*) FILTER (comment IS NULL) > 0)
 UNION ALL SELECT 'vacuum/large_table_defaults', count(*) FROM tabs WHERE reltuples >= 1000000 AND table_name <> 'tags'"""


@query("a15_audit_summary", f"{BLOAT} SELECT rule, sum(n)::BIGINT AS n FROM ({FOUND}) GROUP BY rule HAVING sum(n) > 0")
def a15(s, d):
    return A.audit(catalog(s, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("a16_lint_schema", f"{BLOAT} SELECT 'audit' AS scope, rule, sum(n)::BIGINT AS n FROM ({FOUND}) WHERE rule IN ('pk/non_sequential', 'naming/bool_prefix') GROUP BY rule HAVING sum(n) > 0 UNION ALL SELECT 'conventions', 'pk/exists', count(*) FROM tabs WHERE (database_id, 'log_all', table_name) NOT IN (SELECT database_id, parent_name, child_name FROM kids) AND (database_id, table_name) NOT IN (SELECT database_id, table_name FROM cons WHERE kind = 'primary_key') HAVING count(*) > 0")
def a16(s, d):
    """Two audits and one convention under one roof."""
    c = catalog(s, d)
    audits = A.audit(c, disabled=[r for r in A.RULES if r not in ("pk/non_sequential", "naming/bool_prefix")])
    conventions = L.lint(c, L.LintConfig(min_severity="error", disabled=("constraints/fk_has_index",)))
    return A.lint_schema(conventions, audits).groupBy("scope", "rule").agg(F.count(F.lit(1)).alias("n"))
