"""Put against what is stored, deletion in place, as-of over slices, keyed streams."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from catascope import schemas
from catascope.operators import history
from catascope.operators.stored_history import StoredHistory
from catascope.sources.manifest import Manifest
from catascope.streaming import ingest

T0 = dt.datetime(2024, 1, 1)


def captures(spark, rows):
    """(series, minute, hash) as captures."""
    data = [("p", "d", s.split("/")[0], s.split("/")[1], h, T0 + dt.timedelta(minutes=m), f"{h}{m}") for s, m, h in rows]
    return spark.createDataFrame(data, schemas.CAPTURE)


def outcomes(df):
    return sorted((r["kind"], r["node_label"], r["captured_at"], r["content_hash"], r["outcome"]) for r in df.collect())


def stored(h):
    return sorted((r["kind"], r["node_label"], r["captured_at"], r["content_hash"], r["payload"]) for r in h.read().collect())


def test_batches_cut_by_time_equal_one_batch(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"{k}/{n}", m, r.choice("aab")) for k in ("schema", "activity_stats") for n in ("", "x") for m in r.sample(range(200), 40)]
    rows += [(s, m, "tie") for s, m, _ in rows[:5]]  # equal times
    whole = StoredHistory(spark, f"{tmp_path}/whole")
    one = outcomes(whole.put(captures(spark, rows), 1))
    parts, cuts = StoredHistory(spark, f"{tmp_path}/parts"), [0, 37, 120, 121, 300]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        parts.put(captures(spark, [x for x in rows if a <= x[1] < b]), i)
    assert stored(parts) == stored(whole)
    assert len(stored(whole)) == sum(x[4] == "inserted" for x in one) < len(one) == len(rows)


def test_a_batch_put_again_changes_nothing(spark, tmp_path):
    h = StoredHistory(spark, str(tmp_path))
    h.put(captures(spark, [("schema/", 1, "a"), ("schema/", 2, "a")]), 5)
    first = outcomes(h.put(captures(spark, [("schema/", 3, "b"), ("schema/", 4, "a")]), 6))
    rows = stored(h)
    assert outcomes(h.put(captures(spark, [("schema/", 3, "b"), ("schema/", 4, "a")]), 6)) == first
    assert stored(h) == rows and [x[4] for x in first] == ["inserted"] * 2
    with pytest.raises(ValueError):
        h.put(captures(spark, []), 4)


def test_a_writer_that_stops_before_its_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    h = StoredHistory(spark, str(tmp_path))
    h.put(captures(spark, [("schema/", 1, "a")]), 1)
    with monkeypatch.context() as m:
        m.setattr(Manifest, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            h.put(captures(spark, [("schema/", 2, "b")]), 2)
    assert len(stored(h)) == 1
    assert outcomes(h.put(captures(spark, [("schema/", 2, "b")]), 2))[0][4] == "inserted" and len(stored(h)) == 2


def test_late_null_and_no_rows(spark, tmp_path):
    h = StoredHistory(spark, str(tmp_path))
    assert h.put(captures(spark, []), 0).count() == 0 and h.read().count() == 0
    h.put(captures(spark, [("schema/", 10, "a")]).withColumn("node_label", F.lit(None).cast("string")).withColumn("extra", F.lit(1)), 1)
    got = outcomes(h.put(captures(spark, [("schema/", 5, "a"), ("schema/", 6, "b"), ("schema/", 11, "a")]), 2))
    assert [x[4] for x in got] == ["deduped", "inserted", "deduped"]
    assert outcomes(h.put(captures(spark, [("schema/", 12, "a")]), 3))[0][4] == "deduped"


def test_second_writer_of_a_version_fails(spark, tmp_path):
    m = Manifest(spark, str(tmp_path))
    m.commit(1, {"parts": {}})
    with pytest.raises(Exception, match="(?i)exist"):
        m.commit(1, {"parts": {"x": {"folder": "y"}}})
    assert m.read() == (1, {"parts": {}})


def files(path):
    return {f"{d}/{f}" for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_deletion_rewrites_only_parts_that_hold_both(spark, tmp_path):
    h = StoredHistory(spark, str(tmp_path))
    for i in range(3):
        h.put(captures(spark, [(f"{k}/", 10 * i + j, f"{i}{j}") for k in ("schema", "activity_stats") for j in range(10)]), i)
    parts = h.table.read()[1]["parts"]
    assert h.delete_before(T0 + dt.timedelta(minutes=15)) == 15
    after = h.table.read()[1]["parts"]
    assert "r0-schema" not in after and after["r1-schema"]["n"] == 5 and after["r1-schema"]["folder"] != parts["r1-schema"]["folder"]
    assert all(after[k] == parts[k] for k in after if k != "r1-schema")
    left = stored(h)
    assert len(left) == 45 and min(x[2] for x in left if x[0] == "schema") == T0 + dt.timedelta(minutes=15)
    assert h.delete_before(T0 + dt.timedelta(minutes=15)) == 0
    assert outcomes(h.put(captures(spark, [("schema/", 99, "29")]), 9))[0][4] == "deduped"


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_as_of_over_slices(spark, width):
    r = random.Random(width)
    rows = [("p", f"d{r.randrange(2)}", r.randrange(100), f"v{i}") for i in range(40)]
    probes = [("p", f"d{r.randrange(3)}", r.randrange(-5, 110), i) for i in range(80)] + [("p", None, 5, 80), ("p", "d0", None, 81)]
    left = spark.createDataFrame(probes, "project_id string, database_id string, at int, id int")
    right = spark.createDataFrame([*rows, ("p", None, 4, "null"), ("p", "d0", None, "never")], "project_id string, database_id string, ts int, v string")
    got = {x["id"]: x["v"] for x in history.as_of(left, right, ["project_id", "database_id"], "at", "ts", ["v"], lambda c: F.floor(c / width)).collect()}
    want = {i: max(((t, v) for _, k, t, v in rows if k == d and t <= at), default=(0, None))[1] for _, d, at, i in probes[:80]}
    assert got == want | {80: "null", 81: None}


def test_orphans_are_rejected_or_kept(spark):
    key = "project_id string, database_id string, captured_at int, content_hash string"
    activity = spark.createDataFrame([("p", "d", 3, "x"), ("p", "d", 9, "y"), ("p", "e", 9, "z")], key)
    schema = spark.createDataFrame([("p", "d", 5, "s")], key)
    attached, rejected = history.attach_schema_ref(activity, schema)
    assert [r["content_hash"] for r in attached.collect()] == ["y"]
    assert sorted(r["content_hash"] for r in rejected.collect()) == ["x", "z"]
    assert history.attach_schema_ref(activity, schema, allow_orphan=True)[1].count() == 0


def drop_files(spark, path, rows, name):
    captures(spark, rows).coalesce(1).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").mode("append").json(path)


def test_stream_orders_rows_and_drops_what_comes_too_late(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    drop_files(spark, src, [("schema/", 30, "a"), ("schema/", 10, "a"), ("schema/", 20, "b"), ("end/", 40, "x")], 0)
    run = lambda: ingest.ingest(ingest.read_captures(spark, src), out, f"{tmp_path}/cp", "5 minutes").awaitTermination()
    run()
    read = lambda: sorted((r["captured_at"], r["content_hash"]) for r in spark.read.parquet(out).where("kind = 'schema'").collect())
    at = lambda m: T0 + dt.timedelta(minutes=m)
    assert read() == [(at(10), "a"), (at(20), "b"), (at(30), "a")]
    # 25 lies before what is settled; 36 and 38 come out of order but within the delay, 38 repeats 36
    drop_files(spark, src, [("schema/", 25, "late"), ("schema/", 38, "c"), ("schema/", 36, "c"), ("end/", 60, "y")], 1)
    run()
    assert read() == [(at(10), "a"), (at(20), "b"), (at(30), "a"), (at(36), "c")]


def test_latest_rewrites_touched_buckets_only(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    run = lambda cp: ingest.latest_activity(ingest.read_captures(spark, src), out, f"{tmp_path}/{cp}", 16).awaitTermination()
    drop_files(spark, src, [(f"k{i}/", i, "a") for i in range(60)], 0)
    run("cp")
    before = Manifest(spark, out).read()[1]["parts"]
    drop_files(spark, src, [("k1/", 100, "b"), ("k1/", 50, "old"), ("k2/", 0, "older")], 1)
    run("cp")
    version, content = Manifest(spark, out).read()
    assert 1 <= sum(before[b] != content["parts"][b] for b in before) <= 2
    got = {r["kind"]: r["content_hash"] for r in ingest.read_latest(spark, out).collect()}
    assert got["k1"] == "b" and got["k2"] == "a" and len(got) == 60
    run("other-checkpoint")  # the same batches again, from number 0
    assert Manifest(spark, out).read() == (version, content)
