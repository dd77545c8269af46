"""Joins of rows that Spark sizes too low are not sent through the driver."""

import random

from catascope.llm.common import stored
from catascope.llm.near_copies import alike_pairs, hub_pairs, open_pairs, simhash_pairs
from catascope.llm.simhash import links


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_variants_of_fingerprints_are_merged(spark):
    r = random.Random(3)
    fps = stored(spark.createDataFrame([(r.getrandbits(63),) for _ in range(500)], "fp long"), "fps")
    plan = planned(links(fps))
    assert "SortMergeJoin" in plan
    assert "BroadcastHashJoin" not in plan


def test_open_members_and_nodes_are_merged(spark):
    r = random.Random(4)
    bits = "1L, " * 15 + "1L"
    shared = stored(spark.createDataFrame([(k, (100 * k + i, 9, 0)) for k in range(20) for i in range(5)], "key long, x struct<node: long, n: int, pos: int>"), "shared")
    labels = stored(spark.range(5).selectExpr("id as node", "id as label"), "labels")
    marks = stored(shared.selectExpr("x.node as node", "x.n as n", f"array({bits}) as bits"), "marks")
    nodes = stored(spark.createDataFrame([(i, r.getrandbits(63)) for i in range(100)], "node long, fp long"), "nodes")
    for df in (open_pairs(shared, labels, marks, 80), hub_pairs(shared, 80), alike_pairs(shared.selectExpr("x.node as a", "x.node as b"), marks, 80), simhash_pairs(nodes)):
        plan = planned(df)
        assert "SortMergeJoin" in plan
        assert "BroadcastHashJoin" not in plan
