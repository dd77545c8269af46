"""Balanced sharding by label propagation over groups of equal texts.

Documents start at the shard of their doc_id's hash. Linked documents (equal texts) then move, round by
round, to the shard that already holds most bytes of their group, within each shard's quota: a join gives
every group its target, another the room left there, and where the demand is larger than the room the
groups of the lowest hashes get in. A group larger than a share of the quota is cut into parts of about
that share first, so a text that a third of all rows repeat is still spread evenly. Leftover differences
in size are settled on one line, on which surpluses and deficits (prefix sums per shard and hash bucket) are
matched: unlinked documents move first, which cuts no edge, then parts of groups, one after another, so only
those at the ends of a surplus are cut.

The law is ``bytes``: shard sizes end up equal to within about one document, however many rows are linked.
Everything but per-shard and per-bucket sums stays distributed, and no window spans a whole shard.

Defined cases: a null text has no bytes (size 8) and belongs to the group of null texts; rows that repeat
doc_id and text keep a shard each and get slots of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catascope.llm.common import partitions, stored
from catascope.llm.packing import ranked


def _hash_shard(shards: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(shards)).cast("int")


def _loads(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, load) of every shard, empty ones included: ``shards`` rows."""
    every = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    return every.join(rows.groupBy("shard").agg(F.sum("size").alias("load")), "shard", "left").select("shard", F.coalesce("load", F.lit(0)).alias("load"))


def base_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, size, text_crc32, g): g identifies the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.unhex(F.md5(F.encode(text, "UTF-8")))).otherwise(F.lit(b"")).alias("g"),
    )


def propagate(rows: DataFrame, shards: int, rounds: int = 6, part: float = 0.125, slack: float = 1.1) -> DataFrame:
    """``rows`` (doc_id, size, g, ...) with linked flag and shard after label propagation."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    quota = max(1, int(total / shards))
    groups = stored(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where("n > 1"), "text-groups")
    parts = F.ceil(F.col("bytes") / F.lit(max(1.0, part * quota))).cast("long")
    linked = rows.join(groups.select("g", parts.alias("parts")), "g", "left")
    # a member of a large group belongs to one of its parts
    piece = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id", "g"), F.col("parts")))
    now = stored(
        linked.withColumn("piece", piece).drop("parts").withColumn("shard", _hash_shard(shards, "doc_id", "g")),
        "labels",
    )
    for k in range(rounds):
        held = stored(now.where("piece is not null").groupBy("g", "piece", "shard").agg(F.sum("size").alias("bytes")), "held")
        loads = _loads(now, shards)
        # full shards attract nobody, so their members follow the rest of the group; ``shards`` rows
        open_ = F.broadcast(loads.select("shard", (F.col("load") < slack * quota).alias("open")))
        score = F.struct("open", "bytes", F.xxhash64("g", "piece", "shard"), "shard")
        best = held.join(open_, "shard").groupBy("g", "piece").agg(F.max_by("shard", score).alias("target"))
        moving = held.join(best, ["g", "piece"]).where("shard <> target")
        if moving.isEmpty():
            break
        demand = moving.groupBy("g", "piece", "target").agg(F.sum("bytes").alias("bytes"))
        leaving = moving.groupBy("shard").agg(F.sum("bytes").alias("out"))
        room = loads.join(leaving, "shard", "left").select(
            F.col("shard").alias("target"), F.greatest(F.lit(slack * quota) - F.col("load") + F.coalesce("out", F.lit(0)), F.lit(0.0)).alias("room")
        )
        wanted = demand.groupBy("target").agg(F.sum("bytes").alias("wanted"))
        share = room.join(wanted, "target").select("target", F.least(F.col("room") / F.col("wanted"), F.lit(1.0)).alias("share"))
        lot = F.pmod(F.xxhash64("g", "piece", F.lit(k)), F.lit(1_000_003)) / 1_000_003
        # ``shards`` rows
        admitted = demand.join(F.broadcast(share), "target").where(lot < F.col("share")).select("g", "piece", "target")
        moved = now.join(admitted, ["g", "piece"], "left").withColumn("shard", F.coalesce("target", "shard")).drop("target")
        now = stored(moved, "labels")
    return now


def settle(rows: DataFrame, shards: int, lots: int = 16) -> DataFrame:
    """Move documents from the larger shards to the smaller until all sizes are about equal."""
    spark = rows.sparkSession
    loads = {r["shard"]: int(r["load"]) for r in _loads(rows, shards).collect()}  # a row per shard
    mean = sum(loads.values()) / shards
    # surpluses and deficits on one line, as intervals of equal total length
    givers, line, up, at = [], [], 0.0, 0.0
    for s in sorted(loads):
        if loads[s] > mean:
            givers.append((s, up, loads[s] - mean))
            up += loads[s] - mean
        elif loads[s] < mean:
            line.append((s, at, at + mean - loads[s]))
            at += mean - loads[s]
    if not line or not givers:
        return rows
    buckets = max(16, partitions(spark))
    lot = F.pmod(F.xxhash64("doc_id", "g", F.lit(1)), F.lit(buckets))
    # unlinked documents come before all parts of groups, and a part is not mixed with others of its lot's bucket order
    place = F.when(F.col("piece").isNull(), lot).otherwise((F.pmod(F.xxhash64("g", "piece"), F.lit(lots)) + 1) * buckets + lot).cast("int")
    # both tables have a row per shard
    donors = F.broadcast(spark.createDataFrame(givers, "shard int, begin double, surplus double"))
    takers = F.broadcast(spark.createDataFrame(line, "taker int, lo double, hi double"))
    give = rows.join(donors, "shard").withColumn("b", place)
    sums = give.groupBy("shard", "b").agg(F.sum("size").alias("s"))
    before = F.sum("s").over(W.partitionBy("shard").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("shard", "b", F.coalesce(before, F.lit(0)).alias("before"))
    inner = F.sum("size").over(W.partitionBy("shard", "b").orderBy("g", "piece", "doc_id", "row").rowsBetween(W.unboundedPreceding, -1))
    mid = F.coalesce("i", F.lit(0)) + F.col("before") + F.col("size") / 2
    placed = give.withColumn("i", inner).join(sums, ["shard", "b"]).withColumn("point", F.when(mid < F.col("surplus"), F.col("begin") + mid))
    moved = placed.join(takers, (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")), "left").withColumn("shard", F.coalesce("taker", "shard"))
    return rows.join(donors, "shard", "left_anti").select(*rows.columns).unionByName(moved.select(*rows.columns))


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    rows = stored(base_rows(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    placed = stored(settle(propagate(rows, shards), shards), "placed")
    slots = ranked(placed, "shard", partitions(docs.sparkSession), "doc_id", "g", "size")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
