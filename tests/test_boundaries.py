"""Boundary values of operators on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from catascope.functions import names as N
from catascope.operators import activity as A
from catascope.operators import audit, colstats, history, lint, storage

K = ("p", "d", "h")
KEY = "project_id string, database_id string, schema_hash string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_collapse_keeps_a_b_a(spark):
    rows = [("p", "d", "n", i, h) for i, h in enumerate("aabba")]
    df = spark.createDataFrame(rows, "project_id string, database_id string, node_label string, captured_at int, content_hash string")
    kept = history.collapse_unchanged(df, ["project_id", "database_id", "node_label"])
    assert sorted(r["captured_at"] for r in kept.collect()) == [0, 2, 4]
    again = history.collapse_unchanged(kept, ["project_id", "database_id", "node_label"])
    assert again.count() == 3


def test_as_of_is_inclusive(spark):
    rows = spark.createDataFrame([("p", "d", 5, "x"), ("p", "d", 9, "y")], "project_id string, database_id string, ts int, v string")
    probes = spark.createDataFrame([("p", "d", t) for t in (4, 5, 8, 9)], "project_id string, database_id string, at int")
    got = history.as_of(probes, rows, ["project_id", "database_id"], "at", "ts", ["v"])
    assert {r["at"]: r["v"] for r in got.collect()} == {4: None, 5: "x", 8: "x", 9: "y"}


def test_stale_after_seven_days_exactly(spark):
    now = dt.datetime(2024, 1, 9)
    rows = [(*K, "s", f"t{i}", "n", last, None) for i, last in enumerate((now - dt.timedelta(days=7), now - dt.timedelta(days=7, seconds=1), None))]
    df = spark.createDataFrame(rows, f"{KEY}, table_schema string, table_name string, node_label string, last_analyze timestamp, last_autoanalyze timestamp")
    got = {r["table_name"]: r["days_since"] for r in A.stale_stats(df, F.lit(now)).collect()}
    assert got == {"t1": 7, "t2": None}


def test_imbalance_needs_two_busy_nodes_and_a_ratio_of_five(spark):
    rows = [(*K, "s", t, n, c) for t, counts in {"a": (499, 100), "b": (500, 100), "c": (9, 0), "d": (5,), "e": (7, 7, 1)}.items() for n, c in zip("xyz", counts)]
    df = spark.createDataFrame(rows, f"{KEY}, table_schema string, table_name string, node_label string, seq_scan long")
    assert {r["table_name"]: (r["hot_node"], r["multiplier"]) for r in A.seq_scan_imbalance(df).collect()} == {"b": ("x", 5), "e": ("y", 7)}


def test_selector(spark):
    df = spark.createDataFrame([("a",), ("b",)], "node_label string")
    assert A.select_nodes(df, None).count() == 2
    assert A.select_nodes(df, ["a", "?"]).count() == 1
    assert A.select_nodes(df, []).count() == 0


def cycles(spark, edges, **kw):
    df = spark.createDataFrame([(*K, a, b) for a, b in edges], f"{KEY}, a string, b string")
    return sorted("".join(r["path"]) for r in audit.fk_cycles(df, **kw).collect())


def test_cycles(spark):
    assert cycles(spark, [("a", "a")]) == ["a"]
    assert cycles(spark, [("b", "a"), ("a", "b")]) == ["ab"]
    assert cycles(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("x", "a")]) == ["ab", "bc"]
    assert cycles(spark, [("a", "b"), ("b", "c"), ("a", "c")]) == []
    assert cycles(spark, [("a", "b"), ("b", "c"), ("c", "a")], max_len=2) == []


def test_cardinality_and_order(spark):
    c = lambda n, rows=1000.0: one(spark, colstats.profile_cardinality(F.lit(n).cast("double"), F.lit(rows)))
    assert [c(1), c(-1), c(-0.95), c(None), c(500), c(100), c(10), c(9)] == ["constant", "unique", "unique", "unknown", "high", "medium", "low", "very low"]
    o = lambda x: one(spark, colstats.profile_order(F.lit(x)))
    assert [o(0.991), o(-0.91), o(0.51), o(0.5)] == ["perfectly ordered", "well ordered", "partially ordered", "random"]


def test_distribution(spark):
    d = lambda *f: one(spark, colstats.profile_distribution(F.array(*[F.lit(x) for x in f])))
    assert [d(0.6, 0.1), d(0.3, 0.1), d(0.2, 0.1), d(0.5, 0.1), d(0.0, 0.5)] == ["heavily skewed", "skewed", "uniform", "skewed", "uniform"]


def test_names(spark):
    plural = lambda x: one(spark, N.looks_plural(F.lit(x)))
    assert [plural(x) for x in ("users", "class", "status", "axis", "stories", "series", "user")] == [True, False, False, False, True, False, False]
    assert one(spark, N.parse_pg_array(F.lit('{a,"b, \\"q\\"",c}'))) == ["a", 'b, "q"', "c"]
    assert one(spark, N.parse_pg_array(F.lit("{}"))) == []
    assert one(spark, N.parse_pg_array(F.lit("x,y "))) == ["x", "y"]
    assert tuple(one(spark, N.parse_version(F.lit("Server 17.2beta on x 1.0")))) == (17, 2, 0)
    assert one(spark, N.parse_version(F.lit("none"))) is None
    assert one(spark, N.filter_column(F.lit("((t.name = 'x'))"))) == "name"


def test_table_style_needs_five_names(spark):
    df = lambda names: spark.createDataFrame([(*K, "s", n) for n in names], f"{KEY}, table_schema string, table_name string")
    style = lambda names: lint.table_style(df(names)).first()["style"]
    assert style(["users", "tags", "posts", "logs"]) == "snake_singular"
    assert style(["users", "tags", "posts", "item", "log"]) == "snake_plural"
    assert style(["users", "tags", "posts", "item", "log", "row"]) == "snake_singular"


def test_suppression(spark):
    rows = [(*K, "s", "t", "created_at", r, "warning", "m") for r in ("timestamps/correct_type", "types/timestamptz")] + [(*K, "s", "t", "other", "types/timestamptz", "warning", "m")]
    df = spark.createDataFrame(rows, f"{KEY}, table_schema string, table_name string, column_name string, rule string, severity string, message string")
    left = sorted((r["column_name"], r["rule"]) for r in lint.suppress(df).collect())
    assert left == [("created_at", "timestamps/correct_type"), ("other", "types/timestamptz")]
    alone = df.where("rule = 'types/timestamptz'")
    assert lint.suppress(alone).count() == 2


def test_tuned_settings(spark):
    t = storage.tuned(F.lit(1_000_000.0))
    assert [float(one(spark, t[k])) for k in ("scale_factor", "analyze_scale_factor", "threshold", "analyze_threshold")] == [0.1, 0.05, 5000, 2500]


def test_reloptions_split_at_first_equals(spark):
    got = one(spark, storage.parse_reloptions(F.array(F.lit("a=b=c"), F.lit("k=1"), F.lit("k=2"), F.lit("bare"))))
    assert got == {"a": "b=c", "k": "2"}
