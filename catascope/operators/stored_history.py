"""A stored history of captures: change-only put with its outcome, and deletion that rewrites only what it must.

Series are (project_id, database_id, kind, node_label). Parts of the table hold one batch and kind each and list the
number and the first and last time of their rows; the last hash of every series is a small part of its own.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catascope import schemas
from catascope.sources.manifest import Manifest
from catascope.sources.scratch import remove

SERIES = ["project_id", "database_id", "kind", "node_label"]
HEAD = "project_id string, database_id string, kind string, node_label string, content_hash string, captured_at timestamp"
OUTCOME = "project_id string, database_id string, kind string, node_label string, captured_at timestamp, content_hash string, outcome string"


class StoredHistory:
    """Captures under ``path``. Batches have growing numbers; one that was put before changes nothing and returns its outcomes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, Manifest(spark, path)

    def read(self, kind: str | None = None) -> DataFrame:
        content = self.table.read()[1]
        return self.table.load(content, schemas.CAPTURE, [n for n, p in content["parts"].items() if n[0] == "r" and kind in (None, p["kind"])])

    def put(self, captures: DataFrame, batch: int) -> DataFrame:
        """Store what differs from the capture before it in its series; (keys, time, hash, outcome) of every row.

        The rows of a series follow each other by time, then hash; the first is compared with the newest stored one, as
        is a capture that is older than that: it is stored if its hash differs, and the newest stays the newest. A null
        node counts as ''. So a batch and the same rows cut by time into several leave the same history.
        """
        version, content = self.table.read()
        name = f"o{batch}"
        if batch <= content.get("last", -1):
            if name not in content["parts"]:
                raise ValueError(f"batch {batch} is not after {content['last']} and was never put")
            return self.table.load(content, OUTCOME, [name])
        rows = captures.select(*[F.coalesce(c, F.lit("")).alias(c) if c == "node_label" else F.col(c) for c in self.spark.createDataFrame([], schemas.CAPTURE).columns])
        heads = self.table.load(content, HEAD, ["heads"])
        head = heads.select(*SERIES, F.col("content_hash").alias("head_hash"), F.col("captured_at").alias("head_at"))
        both = rows.join(head, SERIES, "left").withColumn("late", F.coalesce(F.col("captured_at") < F.col("head_at"), F.lit(False)).cast("int"))
        run = Window.partitionBy(*SERIES, "late").orderBy("captured_at", "content_hash")
        first = (F.col("late") == 1) | (F.row_number().over(run) == 1)
        judged = both.withColumn("before", F.when(first, F.col("head_hash")).otherwise(F.lag("content_hash").over(run)))
        judged = judged.withColumn("outcome", F.when(F.col("content_hash").eqNullSafe(F.col("before")), "deduped").otherwise("inserted"))
        staged = self.table.folder(f"batch-{batch}")
        judged.select(*rows.columns, "late", "outcome").write.parquet(f"{self.table.path}/{staged}/judged")
        judged = self.spark.read.parquet(f"{self.table.path}/{staged}/judged")
        judged.where("outcome = 'inserted'").select("*", F.col("kind").alias("part")).drop("late", "outcome").write.partitionBy("part").parquet(f"{self.table.path}/{staged}/rows")
        judged.select(*SERIES, "captured_at", "content_hash", "outcome").write.parquet(f"{self.table.path}/{staged}/outcomes")
        last = judged.where("late = 0").select(*SERIES, "content_hash", "captured_at").unionByName(heads)
        last = last.groupBy(*SERIES).agg(F.max(F.struct("captured_at", "content_hash")).alias("x")).select(*SERIES, "x.content_hash", "x.captured_at")
        last.write.parquet(f"{self.table.path}/{staged}/heads")
        parts = dict(content["parts"])
        # one row per kind
        for k in judged.where("outcome = 'inserted'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("captured_at").cast("string").alias("first"), F.max("captured_at").cast("string").alias("last")).collect():
            parts[f"r{batch}-{k['kind']}"] = {"folder": f"{staged}/rows/part={k['kind']}", "kind": k["kind"], "n": k["n"], "first": k["first"], "last": k["last"]}
        parts |= {name: {"folder": f"{staged}/outcomes"}, "heads": {"folder": f"{staged}/heads"}}
        self.table.commit(version + 1, {"last": batch, "parts": parts})
        remove(self.spark, f"{self.table.path}/{staged}/judged")
        return self.table.load({"parts": parts}, OUTCOME, [name])

    def delete_before(self, cutoff: dt.datetime, kind: str = "schema") -> int:
        """Remove rows of ``kind`` strictly older than ``cutoff`` (in the session's time zone); how many they were.

        Parts that end before the cutoff leave the list unread, parts that hold both are written anew, all others keep
        their files. The last hash of a series stays known, so an unchanged capture is still recognised.
        """
        version, content = self.table.read()
        at = cutoff.isoformat(sep=" ")
        parts, gone = dict(content["parts"]), 0
        for name, part in content["parts"].items():
            if name[0] != "r" or part["kind"] != kind or part["first"] >= at:
                continue
            del parts[name]
            if part["last"] < at:
                gone += part["n"]
                continue
            folder = self.table.folder(f"kept-{name}")
            self.table.load(content, schemas.CAPTURE, [name]).where(F.col("captured_at") >= F.lit(at).cast("timestamp")).write.parquet(f"{self.table.path}/{folder}")
            kept = self.spark.read.schema(schemas.CAPTURE).parquet(f"{self.table.path}/{folder}").agg(F.count(F.lit(1)).alias("n"), F.min("captured_at").cast("string").alias("first")).first()
            gone += part["n"] - kept["n"]
            parts[name] = part | {"folder": folder, "n": kept["n"], "first": kept["first"]}
        if gone:
            self.table.commit(version + 1, content | {"parts": parts})
        return gone
