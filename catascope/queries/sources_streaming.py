"""Queries of sources, reshaping, text functions and streaming ingest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catascope.adapters import CAPTURES, COLUMNS, captures, catalog_columns, table
from catascope.functions import names as N
from catascope import schemas
from catascope.operators import history as H
from catascope.operators.history import STREAM
from catascope.sources import snapshots as S
from catascope.sources.scratch import shared_folder
from catascope.streaming import ingest as I

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _documents(s, d):
    """Schema snapshot files written from the derived columns: one document per version."""
    c = catalog_columns(s, d)
    cols = c.groupBy("schema_hash", "table_schema", "table_name").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.col("column_name").alias("name"), "type_name", "nullable", "default", "comment"))).alias("columns"))
    tables = cols.groupBy("schema_hash").agg(F.collect_list(F.struct(F.col("table_schema").alias("schema"), F.col("table_name").alias("name"), "columns")).alias("tables"))
    path = shared_folder(s, "snapshots")
    tables.select(F.lit("p").alias("project_id"), F.lit("db").alias("database"), F.col("schema_hash").alias("content_hash"), "tables").write.option("maxRecordsPerFile", 1).json(path)
    return path


@query("s1_s2_read_and_explode", f"WITH {COLUMNS} SELECT 'db' AS database_id, schema_hash, table_name, column_name, CAST(ordinal AS SMALLINT) AS ordinal, type_name, nullable, \"default\" AS dflt FROM cols")
def s1(s, d):
    cat = S.explode_catalog(S.read_schema_snapshots(s, _documents(s, d)))
    return cat["column"].select("database_id", "schema_hash", "table_name", "column_name", "ordinal", "type_name", "nullable", F.col("default").alias("dflt"))


@query("h1_structural_hash", f"WITH {COLUMNS}, v AS (SELECT DISTINCT schema_hash FROM cols) SELECT what, count(DISTINCT schema_hash) AS versions, CASE what WHEN 'structure' THEN 2 WHEN 'settings' THEN 2 ELSE 4 END AS hashes FROM v, (VALUES ('structure'), ('settings'), ('index'), ('view'), ('enum')) t(what) GROUP BY what")
def h1(s, d):
    """Hashes of both versions and of a changed copy of each: a setting does not count, an index, view or enum does."""
    docs = S.read_schema_snapshots(s, _documents(s, d))
    tables = lambda index: F.transform("tables", lambda t: t.withField("indexes", F.array(index.cast(t_index))))
    t_index = s.createDataFrame([], f"x {schemas.INDEX}").schema["x"].dataType
    new = F.from_json(F.lit('{"name":"i","columns":["c"],"index_type":"btree"}'), schemas.INDEX)
    changed = {
        "structure": docs, "settings": docs.withColumn("settings", F.from_json(F.lit('[{"name":"a","setting":"b"}]'), docs.schema["settings"].dataType)),
        "index": docs.withColumn("tables", tables(new)), "view": docs.withColumn("views", F.from_json(F.lit('[{"name":"v","definition":"d"}]'), docs.schema["views"].dataType)),
        "enum": docs.withColumn("enums", F.from_json(F.lit('[{"name":"e","labels":["a"]}]'), docs.schema["enums"].dataType)),
    }
    out = None
    for what, other in changed.items():
        both = H.structural_hash(docs).unionByName(H.structural_hash(other)).select(F.lit(what).alias("what"), "schema_hash", "content_hash")
        out = both if out is None else out.unionByName(both)
    return out.groupBy("what").agg(F.countDistinct("schema_hash").alias("versions"), F.countDistinct("content_hash").alias("hashes"))


@query("s3_assemble_tables", f"WITH {COLUMNS} SELECT schema_hash, table_name, string_agg(column_name || coalesce(' ' || comment, ''), ',' ORDER BY ordinal) AS columns, count(*) FILTER (p_partkey % 5 < 3) AS n_constraints, 'about ' || table_name AS comment, string_agg(column_name || CASE p_partkey % 2 WHEN 0 THEN ' INSERT' ELSE ' ALL' END, ',' ORDER BY column_name) FILTER (p_partkey % 9 = 0) AS policies, count(*) FILTER (p_partkey % 4 = 0) AS n_triggers FROM cols GROUP BY 1, 2")
def s3(s, d):
    c = catalog_columns(s, d).withColumn("oid", F.concat_ws(".", "schema_hash", "table_name"))
    key = ["project_id", "database_id", "schema_hash", "oid"]
    tables, name = c.select(*key, "table_name").distinct(), F.col("column_name").alias("name")
    codes = F.when(F.col("p_partkey") % 5 == 0, "p").when(F.col("p_partkey") % 5 == 1, "f").when(F.col("p_partkey") % 5 == 2, "c").otherwise("z")
    comments = c.where("comment is not null").select(*key, "column_name", "comment").unionByName(tables.select(*key, F.lit(None).cast("string").alias("column_name"), F.concat(F.lit("about "), "table_name").alias("comment")))
    out = S.assemble_tables(
        tables, c.select(*key, "ordinal", "column_name"), c.select(*key, name, codes.alias("contype")), c.where("p_partkey % 2 = 0").select(*key, name, "type_name"),
        policies=c.where("p_partkey % 9 = 0").select(*key, name, F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("*").alias("polcmd")), triggers=c.where("p_partkey % 4 = 0").select(*key, name, F.col("type_name").alias("definition")), comments=comments,
    )
    n = lambda x: F.coalesce(F.when(F.size(x) > 0, F.size(x)), F.lit(0)).cast("long")
    line = lambda x, a, b: F.when(F.size(x) > 0, F.array_join(F.transform(x, lambda y: F.concat_ws(" ", y[a], y[b])), ","))
    return out.select("schema_hash", "table_name", line("columns", "column_name", "comment").alias("columns"), n("constraints").alias("n_constraints"), "comment", line("policies", "name", "command").alias("policies"), n("triggers").alias("n_triggers"))


@query("s3b_assemble_types", "SELECT p_brand AS name, string_agg(p_name || p_partkey, ',' ORDER BY p_partkey DESC) AS labels FROM part GROUP BY 1")
def s3b(s, d):
    p = table(s, d, "part").select(F.lit("p").alias("project_id"), F.lit("db").alias("database_id"), F.lit("v1").alias("schema_hash"), F.lit("public").alias("schema"), F.col("p_brand").alias("name"), (-F.col("p_partkey")).alias("sort_order"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("label"))
    out = S.assemble_types(p.select("*", F.col("sort_order").alias("attnum"), F.col("label").alias("field")), p, p.select("*", F.col("label").alias("check_name"), F.col("label").alias("check")))
    return out["enum"].select("name", F.array_join("labels", ",").alias("labels"))


@query("s3b_composites_and_domains", "SELECT 'composite' AS frame, p_brand AS name, string_agg('f' || p_partkey || ' ' || p_type, ',' ORDER BY p_size, p_partkey) AS parts FROM part GROUP BY p_brand UNION ALL SELECT 'domain', p_brand, string_agg('check ' || p_partkey, ',' ORDER BY 'k' || p_partkey) FROM part GROUP BY p_brand")
def s3b_all(s, d):
    k = F.col("p_partkey").cast("string")
    p = table(s, d, "part").select(F.lit("p").alias("project_id"), F.lit("db").alias("database_id"), F.lit("v1").alias("schema_hash"), F.lit("public").alias("schema"), F.col("p_brand").alias("name"), "p_size", "p_partkey", "p_type", k.alias("k"))
    fields = p.withColumns({"attnum": F.struct("p_size", "p_partkey"), "field": F.concat(F.lit("f"), "k", F.lit(" "), "p_type")})
    checks = p.withColumns({"check_name": F.concat(F.lit("k"), "k"), "check": F.concat(F.lit("check "), "k")})
    out = S.assemble_types(fields, p.withColumns({"sort_order": F.col("p_size"), "label": F.col("k")}), checks)
    show = lambda frame, c: out[frame].select(F.lit(frame).alias("frame"), "name", F.array_join(c, ",").alias("parts"))
    return show("composite", "fields").unionByName(show("domain", "checks"))


@query("s5_relations_and_indexes", "SELECT 'relation' AS what, p_partkey AS id FROM part WHERE p_size % 4 <> 0 AND p_partkey % 5 IN (0, 1) UNION ALL SELECT 'index', p_partkey FROM part WHERE p_size % 4 <> 0 AND NOT (p_partkey % 3 = 0 AND p_size < 30)")
def s5_capture(s, d):
    """Relations of five kinds, and indexes of which some came from a parent table's."""
    schema = F.when(F.col("p_size") % 8 == 0, "pg_catalog").when(F.col("p_size") % 4 == 0, "pg_temp_3").otherwise("public")
    kind = F.element_at(F.array(*[F.lit(x) for x in "rpvmi"]), (F.col("p_partkey") % 5).cast("int") + 1)
    rows = table(s, d, "part").select(F.lit("p").alias("project_id"), F.lit("db").alias("database_id"), F.lit("v1").alias("schema_hash"), schema.alias("schema"), kind.alias("relkind"), "p_partkey", "p_size")
    inherits = rows.where("p_partkey % 3 = 0 and p_size < 30").withColumn("inhrelid", F.col("p_partkey"))
    own = S.own_indexes(rows.withColumn("indexrelid", F.col("p_partkey")), inherits)
    return S.user_relations(rows).select(F.lit("relation").alias("what"), F.col("p_partkey").alias("id")).unionByName(own.select(F.lit("index").alias("what"), F.col("p_partkey").alias("id")))


def _groups(s, d, **lists):
    """A document per twentieth of ``part`` with the given lists of structs, one entry per part, written as JSON."""
    rows = table(s, d, "part").groupBy((F.col("p_partkey") % 20).alias("g")).agg(*[F.collect_list(x).alias(k) for k, x in lists.items()])
    return rows.select(F.lit("p").alias("project_id"), F.concat(F.lit("db"), F.col("g").cast("string")).alias("database_id"), "*")


def _written(s, docs, name):
    path = shared_folder(s, name)
    docs.drop("g").write.option("maxRecordsPerFile", 1).json(path)
    return path


def _s(**fields):
    return F.struct(*[(F.lit(v) if not isinstance(v, Column) else v).alias(k) for k, v in fields.items()])


def _rows(frames, shown):
    """(frame, database_id, object, detail) of several frames."""
    out = None
    for name, (obj, detail) in shown.items():
        part = frames[name].select(F.lit(name).alias("frame"), "database_id", F.expr(obj).cast("string").alias("object"), F.expr(detail).cast("string").alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out


P = "'db' || (p_partkey % 20) AS database_id"
ALL_FRAMES = {
    "table": ("'t' || p_partkey", "'range false'"), "column": ("'c' || p_partkey", "p_type"), "constraint": ("'k' || p_partkey", "'primary_key c'"), "index": ("'i' || p_partkey", "'true false'"),
    "partition_child": ("'x' || p_partkey", "'t' || p_partkey"), "policy": ("'p' || p_partkey", "'SELECT'"), "trigger": ("'g' || p_partkey", "p_brand"), "enum": ("'e' || p_partkey", "p_type || ',' || p_brand"),
    "domain": ("'d' || p_partkey", "p_type"), "composite": ("'m' || p_partkey", "'f ' || p_brand"), "view": ("'v' || p_partkey", "p_name"), "function": ("'f' || p_partkey", "p_brand || ' false'"),
    "extension": ("'n' || p_partkey", "p_brand"), "setting": ("'s' || p_partkey", "p_type"),
}


@query("s2_explode_every_frame", " UNION ALL ".join(f"SELECT '{k}' AS frame, {P}, {o} AS object, {x} AS detail FROM part" for k, (o, x) in ALL_FRAMES.items()))
def s2(s, d):
    k = F.col("p_partkey").cast("string")
    n = lambda letter: F.concat(F.lit(letter), k)
    one = lambda **f: F.array(_s(**f))
    tables = _s(
        oid=F.col("p_partkey"), schema="public", name=n("t"), columns=one(name=n("c"), ordinal=F.lit(1), type_name=F.col("p_type"), nullable=F.lit(True)),
        constraints=one(name=n("k"), kind="primary_key", columns=F.array(F.lit("c"))), indexes=one(name=n("i"), columns=F.array(F.lit("c")), index_type="btree"),
        partition_info=_s(strategy="range", key="c", children=one(schema="public", name=n("x"), bound="b")), policies=one(name=n("p"), command="SELECT"), triggers=one(name=n("g"), definition=F.col("p_brand")),
    )
    own = {"schema": "public"}
    docs = _groups(
        s, d, tables=tables, enums=_s(**own, name=n("e"), labels=F.array("p_type", "p_brand")), domains=_s(**own, name=n("d"), base_type=F.col("p_type")), composites=_s(**own, name=n("m"), fields=one(name="f", type_name=F.col("p_brand"))),
        views=_s(**own, name=n("v"), definition=F.col("p_name")), functions=_s(**own, name=n("f"), return_type=F.col("p_brand"), security_definer=F.lit(False)), extensions=_s(name=n("n"), version=F.col("p_brand")), settings=_s(name=n("s"), setting=F.col("p_type")),
    )
    cat = S.explode_catalog(S.read_schema_snapshots(s, _written(s, docs, "snapshots")))
    return _rows(cat, {
        "table": ("table_name", "partition_strategy || ' ' || rls_enabled"), "column": ("column_name", "type_name"), "constraint": ("name", "kind || ' ' || columns[0]"), "index": ("name", "is_valid || ' ' || backs_constraint"),
        "partition_child": ("child_name", "parent_name"), "policy": ("name", "command"), "trigger": ("name", "definition"), "enum": ("name", "array_join(labels, ',')"), "domain": ("name", "base_type"),
        "composite": ("name", "fields[0].name || ' ' || fields[0].type_name"), "view": ("name", "definition"), "function": ("name", "return_type || ' ' || security_definer"), "extension": ("name", "version"), "setting": ("name", "setting"),
    })


@query("s7_read_planner_stats", f"SELECT 'stat_table' AS frame, {P}, 't' || p_partkey AS object, CAST(p_size * 8192 AS VARCHAR) AS detail FROM part UNION ALL SELECT 'stat_index', {P}, 'i' || p_partkey, CAST(p_partkey AS VARCHAR) FROM part UNION ALL SELECT 'stat_column', {P}, 'c' || p_partkey, p_brand || '|x, ' || p_size || ' 2 0.75 9' FROM part")
def s7(s, d):
    k = F.col("p_partkey").cast("string")
    n = lambda letter: F.concat(F.lit(letter), k)
    own = {"schema": "public"}
    docs = _groups(
        s, d, tables=_s(**own, name=n("t"), reltuples=F.lit(5.0), relpages=F.col("p_size"), table_size=F.col("p_size") * 8192), indexes=_s(**own, name=n("i"), reltuples=F.lit(5.0), relpages=F.lit(1), size=F.col("p_partkey")),
        columns=_s(**own, table=n("t"), name=n("c"), most_common_vals=F.concat(F.lit("{"), "p_brand", F.lit(',"x, '), F.col("p_size").cast("string"), F.lit('"}')), most_common_freqs="{0.5,0.25}", histogram_bounds="{1,5,9}", null_frac=F.lit(0.0)),
    )
    stats = S.read_planner_stats(s, _written(s, docs, "planner"))
    return _rows(stats, {"stat_table": ("table_name", "table_size"), "stat_index": ("index_name", "size"), "stat_column": ("column_name", "array_join(mcv, '|') || ' ' || size(mcv) || ' ' || (mcf[0] + mcf[1]) || ' ' || bounds[2]")})


@query("s8_read_activity_stats", f"SELECT DISTINCT 'act_node' AS frame, {P}, 'n' || (p_partkey % 20) AS object, CASE WHEN p_partkey % 2 = 0 THEN '77' ELSE 'none' END AS detail FROM part UNION ALL SELECT 'act_table', {P}, 't' || p_partkey, p_size || ' 0 0 none' FROM part UNION ALL SELECT 'act_index', {P}, 'i' || p_partkey, p_partkey || ' 0' FROM part")
def s8(s, d):
    k = F.col("p_partkey").cast("string")
    n = lambda letter: F.concat(F.lit(letter), k)
    docs = _groups(s, d, tables=_s(schema="public", name=n("t"), seq_scan=F.col("p_size")), indexes=_s(schema="public", name=n("i"), idx_scan=F.col("p_partkey")))
    node = _s(label=F.concat(F.lit("n"), F.col("g").cast("string")), host="h", is_standby=F.col("g") % 2 == 0, replication_lag_bytes=F.lit(77))
    stats = S.read_activity_stats(s, _written(s, docs.withColumns({"node": node, "timestamp": F.lit("2024-01-01T00:00:00Z"), "content_hash": F.lit("h")}), "activity"))
    return _rows(stats, {"act_node": ("node_label", "coalesce(CAST(lag_bytes AS STRING), 'none')"), "act_table": ("table_name", "seq_scan || ' ' || idx_scan || ' ' || n_dead_tup || ' ' || coalesce(CAST(last_vacuum AS STRING), 'none')"), "act_index": ("index_name", "idx_scan || ' ' || idx_tup_read")})


CODES = "pfucxz"


@query("s4_decode_codes", "SELECT p_partkey, CASE substr('pfucxz', p_partkey % 6 + 1, 1) WHEN 'p' THEN 'primary_key' WHEN 'f' THEN 'foreign_key' WHEN 'u' THEN 'unique' WHEN 'c' THEN 'check' WHEN 'x' THEN 'exclusion' END AS kind, CASE substr('isvz', p_partkey % 4 + 1, 1) WHEN 'i' THEN 'immutable' WHEN 's' THEN 'stable' ELSE 'volatile' END AS vol, CASE substr('rlhz', p_partkey % 4 + 1, 1) WHEN 'r' THEN 'range' WHEN 'l' THEN 'list' WHEN 'h' THEN 'hash' END AS strat, nullif(CAST(p_size % 5 AS INT) - 1, -1) AS target, ['SELECT', 'INSERT', 'UPDATE', 'DELETE', 'ALL', 'ALL'][p_partkey % 6 + 1] AS command, ['always', 'by default', NULL][p_partkey % 3 + 1] AS identity, CASE WHEN p_partkey % 2 = 0 THEN 'stored' END AS generated FROM part")
def s4(s, d):
    k = F.col("p_partkey")
    pick = lambda letters: F.substring(F.lit(letters), (k % len(letters)).cast("int") + 1, F.lit(1))
    return table(s, d, "part").select(
        "p_partkey", N.constraint_kind(pick(CODES)).alias("kind"), N.volatility(pick("isvz")).alias("vol"), N.partition_strategy(pick("rlhz")).alias("strat"), N.statistics_target(F.col("p_size") % 5 - 1).alias("target"),
        N.policy_command(pick("rawd*z")).alias("command"), N.identity(pick("adz")).alias("identity"), N.generated(pick("sz")).alias("generated"),
    )


@query("s5_s6_user_objects_and_keys", "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 AND p_partkey % 3 > 0 THEN 'a' WHEN p_partkey % 3 = 2 THEN 'a,b' ELSE 'a,b,c' END AS keys, CASE WHEN p_partkey % 3 = 1 THEN 'b,c' WHEN p_partkey % 3 = 2 THEN 'c' ELSE '' END AS incl FROM part WHERE p_size % 4 <> 0")
def s5(s, d):
    schema = F.when(F.col("p_size") % 8 == 0, "pg_catalog").when(F.col("p_size") % 4 == 0, "pg_temp_3").otherwise("public")
    cols, n = F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("p_partkey") % 3).cast("int")
    return table(s, d, "part").where(N.is_user_object(schema)).select("p_partkey", F.array_join(N.key_columns(cols, n), ",").alias("keys"), F.array_join(N.include_columns(cols, n), ",").alias("incl"))


@query("s7_s12_planner_arrays", "SELECT p_partkey, p_name AS first, 'x, ' || p_size AS second, 3 AS n FROM part")
def s12(s, d):
    text = F.concat(F.lit("{"), "p_name", F.lit(',"x, '), F.col("p_size").cast("string"), F.lit('","a\\"b"}'))
    items = N.parse_pg_array(text)
    return table(s, d, "part").select("p_partkey", F.get(items, F.lit(0)).alias("first"), F.get(items, F.lit(1)).alias("second"), F.size(items).alias("n"))


@query("s13_parse_version", "SELECT p_partkey, CAST(p_size AS INT) AS major, CAST(p_partkey % 7 AS INT) AS minor FROM part")
def s13(s, d):
    v = N.parse_version(F.concat(F.lit("Server "), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit("rc1 (build)")))
    return table(s, d, "part").select("p_partkey", v["major"].alias("major"), v["minor"].alias("minor"))


@query("s14_formats", "SELECT o_orderkey, format('{:,}', CAST(o_orderkey * 7919 AS BIGINT)) AS number, CASE WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.1f KB', b / 1024.0) ELSE b || ' bytes' END AS text FROM (SELECT o_orderkey, o_orderkey * 7919 AS b FROM orders)")
def s14(s, d):
    n = F.col("o_orderkey") * 7919
    return table(s, d, "orders").select("o_orderkey", N.format_bytes(n).alias("text"), N.format_number(n).alias("number"))


def _capture_files(s, d):
    c = captures(s, d)
    path = shared_folder(s, "captures")
    rows = c.select(*STREAM, F.lit("activity_stats").alias("kind"), "node_label", "content_hash", F.col("captured_at").cast("timestamp").alias("captured_at"), F.col("event_id").cast("string").alias("payload"))
    closing = rows.groupBy().agg((F.max("captured_at") + F.expr("interval 1 day")).alias("captured_at"))  # settles all before it
    rows = rows.unionByName(closing.withColumns({"project_id": F.lit("closing"), "database_id": F.lit("db0"), "kind": F.lit("activity_stats")}), allowMissingColumns=True)
    rows.repartition(4, "database_id").write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    return path


ROW = "project_id, database_id, node_label, captured_at, content_hash"


@query("s9_s10_history_export", f"WITH {CAPTURES} SELECT project_id, database_id, count(*) AS n FROM captures WHERE event_id % 2 = 0 GROUP BY 1, 2")
def s9(s, d):
    rows = captures(s, d).withColumn("kind", F.when(F.col("event_id") % 2 == 0, "schema").otherwise("activity_stats"))
    path = shared_folder(s, "history")
    S.write_history(rows, path)
    S.export_snapshots(s.read.parquet(path), f"{path}-export")
    return s.read.parquet(f"{path}-export").groupBy("project_id", "database_id").agg(F.count(F.lit(1)).alias("n"))


@query("h14_stream_ingest", f"WITH {CAPTURES} SELECT {ROW} FROM (SELECT *, lag(content_hash) OVER (PARTITION BY project_id, database_id, node_label ORDER BY captured_at) AS b FROM captures) WHERE content_hash IS DISTINCT FROM b")
def h14(s, d):
    out = shared_folder(s, "ingested")
    I.ingest(I.read_captures(s, _capture_files(s, d)), out, f"{out}-checkpoint").awaitTermination()
    return s.read.parquet(out).where("project_id = 'p'").select("project_id", "database_id", "node_label", "captured_at", "content_hash")


@query("h15_stream_latest_activity", f"WITH {CAPTURES} SELECT {ROW} FROM captures QUALIFY row_number() OVER (PARTITION BY project_id, database_id, node_label ORDER BY captured_at DESC) = 1")
def h15(s, d):
    out = shared_folder(s, "latest")
    I.latest_activity(I.read_captures(s, _capture_files(s, d), 2), out, f"{out}-checkpoint").awaitTermination()
    return I.read_latest(s, out).where("project_id = 'p'").select("project_id", "database_id", "node_label", "captured_at", "content_hash")
