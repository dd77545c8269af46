"""Queries of the history and activity groups over captures derived from ``events``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catascope.adapters import CAPTURES, COLUMNS, LATEST, captures, catalog_columns, latest_activity
from catascope.operators import activity as A
from catascope.operators import history as H
from catascope.operators import storage as S
from catascope.operators.stored_history import StoredHistory
from catascope.queries._catalog import catalog
from catascope.queries.storage_audit import BLOAT
from catascope.sources.scratch import shared_folder

QUERIES, ORACLES = {}, {}
MID = "2024-01-15 00:00:00"
ROW = ["project_id", "database_id", "node_label", "captured_at", "content_hash"]
COLS = ", ".join(ROW)
SERIES = ["project_id", "database_id", "node_label"]
ts = lambda text: F.lit(text).cast("timestamp")


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _schemas(s, d):
    return captures(s, d).where("event_id % 8 = 0")


INCLUDED = ["table_name", "column_name", "ordinal", "type_name", "nullable", "default", "comment"]


@query("h1_schema_content_hash", f"WITH {COLUMNS} SELECT schema_hash, sha256(string_agg(table_name || chr(31) || column_name || chr(31) || ordinal || chr(31) || type_name || chr(31) || nullable || chr(31) || coalesce(\"default\", 'none') || chr(31) || coalesce(comment, 'none'), chr(10) ORDER BY table_name, ordinal)) AS content_hash FROM cols GROUP BY schema_hash")
def h1(s, d):
    rows = catalog_columns(s, d).fillna("none", ["default", "comment"])
    return H.content_hash(rows, ["schema_hash"], INCLUDED, ["table_name", "ordinal"])


@query("h2_payload_hash", f"WITH {CAPTURES} SELECT event_id, sha256(CAST(seq_scan AS VARCHAR)) AS payload_hash FROM captures")
def h2(s, d):
    return captures(s, d).select("event_id", H.payload_hash(F.col("seq_scan").cast("string"), F.col("captured_at"), False).alias("payload_hash"))


@query("h3_collapse_unchanged", f"WITH {CAPTURES} SELECT {COLS} FROM (SELECT *, lag(content_hash) OVER (PARTITION BY project_id, database_id, node_label ORDER BY captured_at) AS b FROM captures) WHERE content_hash IS DISTINCT FROM b")
def h3(s, d):
    return H.collapse_unchanged(captures(s, d), SERIES).select(*ROW)


@query("h4_snapshot_latest", f"WITH {CAPTURES} SELECT {COLS} FROM captures QUALIFY row_number() OVER (PARTITION BY project_id, database_id, node_label ORDER BY captured_at DESC) = 1")
def h4(s, d):
    return H.latest(captures(s, d), SERIES).select(*ROW)


@query("h5_snapshot_at", f"WITH {CAPTURES} SELECT {COLS} FROM captures WHERE captured_at <= TIMESTAMP '{MID}' QUALIFY row_number() OVER (PARTITION BY project_id, database_id, node_label ORDER BY captured_at DESC) = 1")
def h5(s, d):
    return H.latest_at(captures(s, d), SERIES, ts(MID)).select(*ROW)


@query("h5_as_of_batch", f"WITH {CAPTURES} SELECT p.event_id, p.captured_at, r.content_hash AS seen_hash, r.node_label AS seen_node FROM (SELECT * FROM captures WHERE event_id % 2 = 1) p ASOF LEFT JOIN (SELECT * FROM captures WHERE event_id % 2 = 0) r ON p.project_id = r.project_id AND p.database_id = r.database_id AND p.captured_at >= r.captured_at")
def h5b(s, d):
    c = captures(s, d)
    right = c.where("event_id % 2 = 0").select(*H.STREAM, F.col("captured_at").alias("at"), F.col("content_hash").alias("seen_hash"), F.col("node_label").alias("seen_node"))
    left = c.where("event_id % 2 = 1").select(*H.STREAM, "event_id", "captured_at")
    return H.as_of(left, right, H.STREAM, "captured_at", "at", ["seen_hash", "seen_node"]).select("event_id", "captured_at", "seen_hash", "seen_node")


@query("h6_snapshot_by_hash", f"WITH {CAPTURES} SELECT {COLS} FROM captures WHERE project_id = 'p' AND database_id = 'db1' AND content_hash = '2'")
def h6(s, d):
    return H.by_hash(captures(s, d), "p", "db1", "2").select(*ROW)


@query("h7_list_snapshots", f"WITH {CAPTURES} SELECT {COLS} FROM captures WHERE captured_at >= TIMESTAMP '2024-01-10' AND captured_at < TIMESTAMP '{MID}'")
def h7(s, d):
    return H.list_snapshots(captures(s, d), ts("2024-01-10"), ts(MID)).select(*ROW)


@query("h8_delete_before", f"WITH {CAPTURES} SELECT CASE WHEN event_id % 2 = 0 THEN 'schema' ELSE 'activity_stats' END AS kind, count(*) AS kept, (SELECT count(*) FROM captures WHERE event_id % 2 = 0 AND captured_at < TIMESTAMP '{MID}') AS deleted FROM captures WHERE NOT (event_id % 2 = 0 AND captured_at < TIMESTAMP '{MID}') GROUP BY 1")
def h8(s, d):
    rows = captures(s, d).withColumn("kind", F.when(F.col("event_id") % 2 == 0, "schema").otherwise("activity_stats"))
    kept, gone = H.delete_before(rows, ts(MID))
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("kept")).join(F.broadcast(gone.agg(F.count(F.lit(1)).alias("deleted"))))  # one row


def _stored(s, d):
    """All captures put in three batches by time, the second of them twice; half are schema captures."""
    rows = captures(s, d).withColumns({"kind": F.when(F.col("event_id") % 2 == 0, "schema").otherwise("activity_stats"), "payload": F.col("event_id").cast("string")})
    store, out = StoredHistory(s, shared_folder(s, "stored")), []
    spans = [("1970-01-01", "2024-01-10"), ("2024-01-10", MID), ("2024-01-10", MID), (MID, "2100-01-01")]
    for batch, (start, stop) in zip((1, 2, 2, 3), spans, strict=True):
        out.append(store.put(rows.where((F.col("captured_at") >= ts(start)) & (F.col("captured_at") < ts(stop))), batch))
    return store, out[0].unionByName(out[2]).unionByName(out[3])


PUT = "put AS (SELECT project_id, database_id, CASE WHEN event_id % 2 = 0 THEN 'schema' ELSE 'activity_stats' END AS kind, node_label, captured_at, content_hash, lag(content_hash) OVER (PARTITION BY database_id, event_id % 2, node_label ORDER BY captured_at, content_hash) AS b FROM captures)"


@query("h3_put_history", f"WITH {CAPTURES}, {PUT} SELECT project_id, database_id, kind, node_label, captured_at, content_hash, CASE WHEN content_hash IS NOT DISTINCT FROM b THEN 'deduped' ELSE 'inserted' END AS outcome FROM put")
def h3_put(s, d):
    return _stored(s, d)[1]


@query("h8_delete_stored", f"WITH {CAPTURES}, {PUT}, kept AS (SELECT * FROM put WHERE content_hash IS DISTINCT FROM b) SELECT kind, node_label, count(*) AS n, (SELECT count(*) FROM kept WHERE kind = 'schema' AND captured_at < TIMESTAMP '2024-01-12') AS deleted FROM kept WHERE NOT (kind = 'schema' AND captured_at < TIMESTAMP '2024-01-12') GROUP BY 1, 2")
def h8_stored(s, d):
    store, _ = _stored(s, d)
    gone = store.delete_before(dt.datetime(2024, 1, 12))
    return store.read().groupBy("kind", "node_label").agg(F.count(F.lit(1)).alias("n")).withColumn("deleted", F.lit(gone).cast("long"))


@query("h9_list_keys", f"WITH {CAPTURES} SELECT DISTINCT project_id, database_id FROM captures")
def h9(s, d):
    return H.list_keys(captures(s, d))


@query("h10_attach_schema_ref", f"WITH {CAPTURES} SELECT a.event_id, coalesce(r.content_hash, '') AS schema_ref_hash FROM (SELECT * FROM captures WHERE event_id % 8 <> 0) a ASOF LEFT JOIN (SELECT * FROM captures WHERE event_id % 8 = 0) r ON a.project_id = r.project_id AND a.database_id = r.database_id AND a.captured_at >= r.captured_at")
def h10(s, d):
    attached, _ = H.attach_schema_ref(captures(s, d).where("event_id % 8 <> 0"), _schemas(s, d), allow_orphan=True)
    return attached.select("event_id", "schema_ref_hash")


@query("h11_annotate", f"WITH {CAPTURES}, s AS (SELECT * FROM captures WHERE event_id % 8 = 0 AND captured_at <= TIMESTAMP '{MID}' QUALIFY row_number() OVER (PARTITION BY database_id ORDER BY captured_at DESC) = 1), p AS (SELECT database_id, content_hash, max(captured_at) AS planner_at FROM captures WHERE event_id % 8 = 1 GROUP BY 1, 2), a AS (SELECT database_id, content_hash, node_label, max(captured_at) AS activity_at FROM captures WHERE event_id % 8 > 1 GROUP BY 1, 2, 3) SELECT s.project_id, s.database_id, s.content_hash, s.captured_at AS schema_at, planner_at, a.node_label, activity_at FROM s LEFT JOIN p USING (database_id, content_hash) LEFT JOIN a USING (database_id, content_hash)")
def h11(s, d):
    c = captures(s, d).withColumn("schema_ref_hash", F.col("content_hash"))
    return H.annotate(c.where("event_id % 8 = 0"), c.where("event_id % 8 = 1"), c.where("event_id % 8 > 1"), ts(MID))


@query("h12_role_guard", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'planner statistics need a primary' ELSE 'replica activity needs a standby' END AS reason FROM events WHERE (event_id % 2 = 0 AND event_id % 3 = 0) OR (event_id % 2 = 1 AND event_id % 3 <> 0)")
def h12(s, d):
    rows = captures(s, d).withColumns({"kind": F.when(F.col("event_id") % 2 == 0, "planner_stats").otherwise("activity_stats"), "is_standby": F.col("event_id") % 3 == 0})
    return H.role_guard(rows)[1].select("event_id", "reason")


@query("h13_snapshot_key_default", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'named' ELSE event_type END AS database_id FROM events")
def h13(s, d):
    rows = captures(s, d).select("event_id", F.when(F.col("event_id") % 2 == 0, "named").alias("database_id"), F.col("table_name").alias("database"))
    return H.key_default(rows).select("event_id", "database_id")


TK = "project_id, database_id, schema_hash, table_schema, table_name"
IK = "project_id, database_id, schema_hash, index_schema, index_name"
INDEXES = LATEST + ", ai AS (SELECT project_id, database_id, schema_hash, node_label, 'public' AS index_schema, 'ix_' || table_name AS index_name, CASE WHEN table_name = 'view' THEN 0 ELSE idx_scan END AS idx_scan FROM act WHERE NOT (table_name = 'click' AND node_label = 'node2'))"


def _indexes(s, d):
    idle = F.when(F.col("table_name") == "view", 0).otherwise(F.col("idx_scan"))
    rows = latest_activity(s, d).where("not (table_name = 'click' and node_label = 'node2')")
    return rows.select(*A.K, "node_label", F.lit("public").alias("index_schema"), F.concat(F.lit("ix_"), "table_name").alias("index_name"), idle.alias("idx_scan"))


@query("m1_idx_scan_sum", f"WITH {INDEXES} SELECT {IK}, sum(idx_scan)::BIGINT AS idx_scan_sum FROM ai GROUP BY ALL")
def m1(s, d):
    return A.index_scan_sum(_indexes(s, d))


@query("m2_idx_scan_per_node", f"WITH {INDEXES} SELECT i.*, n.node_label, coalesce(sum(ai.idx_scan), 0)::BIGINT AS idx_scan FROM (SELECT DISTINCT {IK} FROM ai) i JOIN (SELECT DISTINCT database_id, node_label FROM act) n USING (database_id) LEFT JOIN ai USING ({IK}, node_label) GROUP BY ALL")
def m2(s, d):
    return A.per_node(_indexes(s, d), latest_activity(s, d), A.INDEX, "idx_scan")


@query("m4_seq_scan_per_node", f"WITH {LATEST} SELECT i.*, n.node_label, coalesce(sum(act.seq_scan), 0)::BIGINT AS seq_scan FROM (SELECT DISTINCT {TK} FROM act) i JOIN (SELECT DISTINCT database_id, node_label FROM act) n USING (database_id) LEFT JOIN act USING ({TK}, node_label) GROUP BY ALL")
def m4(s, d):
    return A.per_node(latest_activity(s, d), latest_activity(s, d), A.TABLE, "seq_scan")


@query("m3_m5_m8_merged_tables", f"WITH {LATEST} SELECT {TK}, sum(seq_scan)::BIGINT AS seq_scan_sum, sum(n_dead_tup)::BIGINT AS n_dead_tup_sum, max(greatest(last_vacuum, last_autovacuum)) AS last_vacuum_max, max(greatest(last_analyze, last_autoanalyze)) AS last_analyze_max, sum(vacuum_count + autovacuum_count)::BIGINT AS vacuum_count_sum FROM act GROUP BY ALL")
def m3(s, d):
    return A.merge_tables(latest_activity(s, d))


@query("m9_merge_window", f"WITH {LATEST} SELECT project_id, database_id, schema_hash, min(coalesce(stats_reset, captured_at)) AS window_start, bool_or(stats_reset IS NULL) AS partial, array_to_string(list_sort(list(DISTINCT node_label)), ',') AS nodes FROM act GROUP BY ALL")
def m9(s, d):
    return A.merge_window(latest_activity(s, d)).withColumn("nodes", F.array_join("nodes", ","))


def _stat_table(s, d):
    return latest_activity(s, d).groupBy(*A.TABLE).agg((F.max("event_id") * 10).cast("double").alias("reltuples"), F.max("event_id").alias("relpages")).where("table_name <> 'error'")


STAT = f"st AS (SELECT {TK}, CAST(max(event_id) * 10 AS DOUBLE) AS reltuples, max(event_id) AS relpages FROM act WHERE table_name <> 'error' GROUP BY ALL)"


@query("m10_planner_lookup", f"WITH {LATEST}, {STAT} SELECT {TK}, node_label, reltuples, relpages FROM act LEFT JOIN st USING ({TK})")
def m10(s, d):
    return A.with_planner(latest_activity(s, d), _stat_table(s, d), A.TABLE).select(*A.TABLE, "node_label", "reltuples", "relpages")


def _catalog_indexes(s, d):
    t = latest_activity(s, d).select(*A.K, "table_schema", "table_name").distinct()
    name = F.concat(F.lit("ix_"), "table_name")
    cat = t.where("table_name <> 'signup'").select("*", name.alias("name"), F.concat(F.lit("on "), "table_name").alias("definition"), (F.col("table_name") == "click").alias("is_primary"))
    size = t.select(*A.K, F.lit("public").alias("index_schema"), name.alias("index_name"), F.length("table_name").cast("long").alias("size"))
    return cat, size


@query("m11_unused_indexes", f"WITH {INDEXES}, z AS (SELECT {IK} FROM ai GROUP BY ALL HAVING sum(idx_scan) = 0) SELECT {IK}, CASE WHEN index_name <> 'ix_signup' THEN substr(index_name, 4) ELSE '' END AS table_name, CASE WHEN index_name <> 'ix_signup' THEN 'on ' || substr(index_name, 4) ELSE '' END AS definition, length(index_name)::BIGINT - 3 AS size FROM z WHERE index_name <> 'ix_click'")
def m11(s, d):
    return A.unused_indexes(_indexes(s, d), *_catalog_indexes(s, d))


@query("m12_stale_stats", f"WITH {LATEST} SELECT {TK}, node_label, last_analyze AS last_analyzed, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_analyze)) // 86400000000 AS days_since FROM act WHERE last_analyze IS NULL OR epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_analyze) > 7 * 86400000000")
def m12(s, d):
    return A.stale_stats(latest_activity(s, d), ts("2024-02-01"))


@query("m13_seq_scan_imbalance", f"WITH {LATEST}, g AS (SELECT {TK}, count(*) AS n, count(*) FILTER (seq_scan > 0) AS busy, arg_max(node_label, (seq_scan, node_label)) AS hot_node, max(seq_scan) // min(seq_scan) FILTER (seq_scan > 0) AS multiplier FROM act GROUP BY ALL) SELECT {TK}, hot_node, multiplier FROM g WHERE n >= 2 AND busy >= 2 AND multiplier >= 5")
def m13(s, d):
    return A.seq_scan_imbalance(latest_activity(s, d))


IMBALANCE = f"SELECT {TK}, hot_node, multiplier FROM (SELECT {TK}, count(*) AS n, count(*) FILTER (seq_scan > 0) AS busy, arg_max(node_label, (seq_scan, node_label)) AS hot_node, max(seq_scan) // min(seq_scan) FILTER (seq_scan > 0) AS multiplier FROM act GROUP BY ALL) WHERE n >= 2 AND busy >= 2 AND multiplier >= 5"


@query("m14_compare_nodes", f"WITH {LATEST}, {STAT}, im AS ({IMBALANCE}), seen AS (SELECT *, max(captured_at) OVER (PARTITION BY database_id) - captured_at > INTERVAL 7 DAY AS stale, true AS has_data FROM act WHERE NOT (table_name = 'click' AND node_label = 'node2')), every AS (SELECT * FROM (SELECT DISTINCT project_id, database_id, schema_hash, node_label FROM act) JOIN (SELECT DISTINCT {TK} FROM seen) USING (project_id, database_id, schema_hash)) SELECT {TK}, node_label, reltuples, seq_scan, idx_scan, captured_at, stale, coalesce(has_data, false) AS has_data, CASE WHEN table_name = 'view' THEN 'ix_view' END AS unused, hot_node, multiplier FROM every LEFT JOIN seen USING ({TK}, node_label) LEFT JOIN st USING ({TK}) LEFT JOIN im USING ({TK})")
def m14(s, d):
    a = latest_activity(s, d)
    some = a.where("not (table_name = 'click' and node_label = 'node2')")
    out = A.compare_nodes(some, _stat_table(s, d), a, A.unused_indexes(_indexes(s, d), *_catalog_indexes(s, d)), A.seq_scan_imbalance(a))
    return out.withColumn("unused", F.array_join("unused_indexes", ",")).drop("unused_indexes")


DETECT = f"SELECT {TK}, 'stale_stats' AS kind, table_schema || '.' || table_name || '@' || node_label AS object, ((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_analyze)) // 86400000000)::DOUBLE AS measure FROM act WHERE last_analyze IS NULL OR epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_analyze) > 7 * 86400000000 UNION ALL SELECT {TK}, 'seq_imbalance', hot_node, multiplier::DOUBLE FROM ({IMBALANCE}) UNION ALL SELECT project_id, database_id, schema_hash, 'public', 'view', 'unused_indexes', 'ix_view', 4.0 FROM act GROUP BY ALL UNION ALL SELECT 'p', database_id, 'v1', 'public', table_name, 'bloated_indexes', name, relpages / expected_pages::DOUBLE FROM r WHERE relpages / expected_pages::DOUBLE > 1.5"


def _detect(s, d, **narrowed):
    a, c = latest_activity(s, d), catalog(s, d)
    bloated = S.bloated_indexes(S.index_bloat(c["index"], c["column"], c["stat_index"]))
    return A.detect(A.unused_indexes(_indexes(s, d), *_catalog_indexes(s, d)), A.stale_stats(a, ts("2024-02-01")), A.seq_scan_imbalance(a), bloated, **narrowed)


@query("m15_detect", f"{BLOAT}, {LATEST} {DETECT}")
def m15(s, d):
    return _detect(s, d)


@query("m15_detect_one_table", f"{BLOAT}, {LATEST}, u AS ({DETECT}) SELECT * FROM u WHERE table_name = 'view'")
def m15_one(s, d):
    return _detect(s, d, table="view")
