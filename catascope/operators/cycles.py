"""Directed graphs of many catalogs at once: strongly connected components and elementary cycles.

Every round is written to the shared folder and read back, so plans keep their size however many rounds run. Joins
send no round of more than ``FEW`` rows through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catascope.sources.scratch import Rounds

K = ["project_id", "database_id", "schema_hash"]
FEW = 100_000  # rows of a round that is broadcast


def _labels(edges: DataFrame, rounds: Rounds, seed: int, most: int) -> DataFrame:
    """(K, n, fore, back, moved): smallest label that reaches a node, and that it reaches, after at most ``most`` rounds.

    Labels are seeded hashes of names. Each round takes the neighbours' labels and those of the node whose label one has.
    """
    ends = edges.select(*K, F.explode(F.array("a", "b")).alias("n")).distinct()
    own = F.xxhash64("n", F.lit(seed))
    labels = rounds.put(ends.select(*K, "n", own.alias("h"), own.alias("fore"), own.alias("back"), F.lit(True).alias("moved")), "labels-0")
    none = F.lit(None).cast("long")
    for i in range(most):
        ahead = edges.join(labels.select(*K, F.col("n").alias("a"), "fore"), [*K, "a"]).select(*K, F.col("b").alias("n"), "fore", none.alias("back"))
        behind = edges.join(labels.select(*K, F.col("n").alias("b"), "back"), [*K, "b"]).select(*K, F.col("a").alias("n"), none.alias("fore"), "back")
        jump = labels.select(*K, "n", F.col("fore").alias("h")).join(labels.select(*K, "h", "fore"), [*K, "h"]).select(*K, "n", "fore", none.alias("back"))
        hop = labels.select(*K, "n", F.col("back").alias("h")).join(labels.select(*K, "h", "back"), [*K, "h"]).select(*K, "n", none.alias("fore"), "back")
        had = labels.select(*K, "n", "fore", "back", "h", F.col("fore").alias("fore0"), F.col("back").alias("back0"))
        for more in (ahead, behind, jump, hop):
            had = had.unionByName(more, allowMissingColumns=True)
        new = had.groupBy(*K, "n").agg(F.max("h").alias("h"), F.min("fore").alias("fore"), F.min("back").alias("back"), F.max("fore0").alias("fore0"), F.max("back0").alias("back0"))
        moved = (F.col("fore") < F.col("fore0")) | (F.col("back") < F.col("back0"))
        labels = rounds.put(new.select(*K, "n", "h", "fore", "back", moved.alias("moved")), f"labels-{i + 1}")
        rounds.drop(f"labels-{i}")
        if labels.where("moved").isEmpty():
            break
    return labels


def component_edges(edges: DataFrame, rounds: Rounds, most: int = 24) -> DataFrame:
    """The edges of ``edges`` (K, a, b) whose two ends lie in one strongly connected component.

    Two nodes of one component have the same smallest label before and behind them, so an edge between different labels
    goes; passes with other labels follow for what stays. A graph whose labels still move after ``most`` rounds (it is
    very deep) keeps the edges it has: the result is then a superset, never a part.
    """
    live, done = rounds.put(edges.select(*K, "a", "b").where("a is not null and b is not null").distinct(), "edges-0"), []
    for i in range(most):
        if live.isEmpty():
            break
        labels = _labels(live, rounds, i, most)
        deep = labels.where("moved").select(*K, F.lit(True).alias("deep")).distinct()
        side = lambda c, s: labels.select(*K, F.col("n").alias(c), F.struct("fore", "back").alias(s))  # noqa: E731, B023
        both = live.join(side("a", "la"), [*K, "a"]).join(side("b", "lb"), [*K, "b"]).join(deep, K, "left").where("la = lb or coalesce(deep, false)")
        # one label on both sides belongs to a node that leads to both ends and back: a component
        kept = rounds.put(both.select(*K, "a", "b", F.expr("la.fore = la.back or coalesce(deep, false)").alias("settled")), f"kept-{i}")
        rounds.drop(f"edges-{i}", *(f"labels-{k}" for k in range(most + 1)))
        done.append(kept.where("settled").select(*K, "a", "b"))
        live = rounds.put(kept.where("not settled").select(*K, "a", "b"), f"edges-{i + 1}")
    for part in done:
        live = live.unionByName(part)
    return rounds.put(live, "edges")


def elementary_cycles(edges: DataFrame, max_len: int = 10) -> DataFrame:
    """Every elementary cycle of at most ``max_len`` nodes once, as (K, path) from its smallest node.

    Inside the components, each node ``s`` takes the larger nodes that lead back to it, by breadth, with their distance;
    paths grow from ``s`` only over nodes from which it is still within reach. Both take at most ``max_len`` rounds.
    """
    rounds = Rounds(edges.sparkSession, "cycles", FEW)
    live = component_edges(edges, rounds)
    keys = [*K, "s"]
    back = live.where("a >= b").select(*K, F.col("b").alias("s"), F.col("a").alias("n"), F.lit(1).alias("d"))
    last = rounds.put(back, "back-1")
    levels = ["back-1"]
    schema = last.schema
    for d in range(2, max_len):
        known = rounds.get(schema, *levels)
        more = last.where("n <> s").withColumnRenamed("n", "b").join(live, [*K, "b"]).where("a > s").select(*keys, F.col("a").alias("n"), F.lit(d).alias("d")).distinct()
        last = rounds.put(more.join(known.select(*keys, "n"), [*keys, "n"], "left_anti").select(*keys, "n", "d"), f"back-{d}")
        if last.isEmpty():
            break
        levels.append(f"back-{d}")
    near = rounds.get(schema, *levels)
    # (s, a, b, d): steps of cycles from s, with what b still needs to get back (0: b is s)
    to = live.join(near.where("n <> s").withColumnRenamed("n", "b"), [*K, "b"]).select(*keys, "a", "b", "d")
    closing = near.where("d = 1").select(*keys, F.col("n").alias("a"), F.col("s").alias("b"), F.lit(0).alias("d"))
    steps = rounds.put(to.where("a >= s").unionByName(closing), "steps")
    ways = steps.select(*keys, F.col("a").alias("at"), F.col("b").alias("next"), "d")
    paths = near.where("d = 1").select(*keys, F.array("s").alias("path"), F.col("s").alias("at")).distinct()
    closed = []
    for k in range(1, max_len + 1):
        grown = paths.join(ways, [*keys, "at"]).where((F.col("d") + k <= max_len) & ((F.col("next") == F.col("s")) | ~F.array_contains("path", F.col("next"))))
        grown = rounds.put(grown.select(*keys, "path", "next"), f"paths-{k}")
        closed.append(f"paths-{k}")
        paths = grown.where("next <> s").select(*keys, F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("at"))
        if paths.isEmpty():
            break
    rounds.drop("steps", *(f"back-{d}" for d in range(1, max_len + 1)), "edges")
    return rounds.get(grown.schema, *closed).where("next = s").select(*K, "path")
