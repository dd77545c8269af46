"""Joins of a graph's rounds: large rounds are merged, none of them goes through the driver."""

from catascope.operators import cycles
from catascope.sources.scratch import Rounds

EDGE = "project_id string, database_id string, schema_hash string, a string, b string"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_are_broadcast_by_their_rows(spark):
    joined = lambda few: planned((r := Rounds(spark, "test", few).put(spark.range(50), "r")).join(r.selectExpr("id", "id + 1 as next"), "id"))
    assert "BroadcastHashJoin" in joined(50)
    assert "SortMergeJoin" in joined(49)
    assert "BroadcastHashJoin" not in joined(49)


def test_no_large_round_of_cycles_is_broadcast(spark, monkeypatch):
    plans, put = [], Rounds.put
    monkeypatch.setattr(cycles, "FEW", 0, raising=False)
    monkeypatch.setattr(Rounds, "put", lambda self, df, name: plans.append(planned(df)) or put(self, df, name))
    rows = [("p", "d", "h", a, b) for a, b in ("ab", "ba", "bc")]
    found = cycles.elementary_cycles(spark.createDataFrame(rows, EDGE), 2)
    assert [r["path"] for r in found.collect()] == [["a", "b"]]
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("BroadcastHashJoin" in p for p in plans)
