"""Connected components by minimum labels with pointer jumping, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catascope.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label: the smallest node reachable.

    Each round takes the least label among a node's neighbours and then follows that label's own label,
    so labels travel exponentially along chains. Every round is checkpointed; the loop ends when no
    label changes. Self loops and repeated edges are harmless, an empty input gives no rows.
    """
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = e.union(e.select("b", "a"))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = cut(step)
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = cut(step.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")))
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
