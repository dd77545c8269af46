"""Advice of plans and logs is found per plan and per query, without joins that could send a growing side to every task."""

from catascope.operators import querylog as Q
from catascope.plans import plan_corpus as P

KEYS = "project_id string, database_id string, schema_hash string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sort_advice_without_a_join(spark):
    node = lambda path, kind, relation=None, key=None, rows=20_000.0: ("p", "d", "v", 1, path, kind, relation, key, rows)
    rows = [
        node([], "Nested Loop"), node([0], "Sort", None, ["a"]), node([0, 0], "Nested Loop"), node([0, 0, 0], "Seq Scan", "x"), node([0, 0, 1], "Seq Scan", "y"),
        node([1], "Sort", None, ["b"]), node([1, 0], "Result"), node([2], "Seq Scan", "z"), node([3], "Sort", None, ["c"]), node([3, 0], "Sort", None, ["d"]), node([3, 0, 0], "Seq Scan", "u"),
    ]
    nodes = spark.createDataFrame(rows, f"{KEYS}, plan_id long, path array<int>, node_type string, relation string, sort_key array<string>, plan_rows double")
    out = P.sort_advice(nodes)
    assert "Join" not in plan(out)
    assert sorted((r["sort_key"][0], r["table_name"]) for r in out.collect()) == [("a", "x"), ("c", "u"), ("d", "u")]


def test_filters_meet_references_in_their_row(spark):
    ref, col = "struct<schema: string, name: string, alias: string, context: string>", "struct<qualifier: string, column: string>"
    facts = [
        ("p", "d", "v", 1, [(None, "t", "a", "select"), ("s", "u", None, "select")], [("a", "x"), ("t", "y"), ("u", "z"), (None, "w"), ("q", "v")]),
        ("p", "d", "v", 2, [(None, "t", None, "select")], [(None, "x"), (None, "x"), ("t", "x")]),
    ]
    facts = spark.createDataFrame(facts, f"{KEYS}, query_id long, tables array<{ref}>, filter_columns array<{col}>")
    stats = spark.createDataFrame([("p", "d", "v", "public", "t", 2000.0), ("p", "d", "v", "s", "u", 2000.0)], f"{KEYS}, table_schema string, table_name string, reltuples double")
    none = spark.createDataFrame([], f"{KEYS}, table_schema string, table_name string, columns array<string>")
    out = Q.suggest_from_filters(facts, stats, none)
    assert plan(out).count("Join") == 2  # sizes of tables and leading columns: both belong to the catalog
    assert sorted((r["query_id"], r["table_name"], r["column_name"]) for r in out.collect()) == [(1, "t", "x"), (1, "t", "y"), (1, "u", "z"), (2, "t", "x")]


def test_advise_keeps_what_no_plan_gives(spark):
    schema = f"{KEYS}, query_id long, table_name string, column_name string"
    row = lambda q, c: ("p", "d", "v", q, "t", c)
    out = Q.advise(spark.createDataFrame([row(1, "a"), row(1, "b"), row(2, "a"), row(2, None)], schema), spark.createDataFrame([row(1, "a"), row(2, None), row(3, "c")], schema))
    assert "Join" not in plan(out)
    got = sorted((r["query_id"], r["column_name"] or "", r["origin"]) for r in out.collect())
    assert got == [(1, "a", "plan"), (1, "b", "query"), (2, "", "plan"), (2, "", "query"), (2, "a", "query"), (3, "c", "plan")]
