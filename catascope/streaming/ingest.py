"""Structured Streaming over capture files: change-only ingest with keyed state, and running latest rows in buckets."""

from __future__ import annotations

import heapq
import pickle
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from catascope import schemas
from catascope.sources.manifest import Manifest

SERIES = ["project_id", "database_id", "kind", "node_label"]


def read_captures(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schemas.CAPTURE).option("maxFilesPerTrigger", files_per_trigger).json(path)


def _order(row: tuple) -> tuple:
    """By time, then hash, then payload; nulls first."""
    return row[0], row[1] is not None, row[1] or "", row[2] or ""


class ChangedOnly(StatefulProcessor):
    """Captures of one series in order of time, and those of them that differ from the one before.

    State: the last hash and time that were settled, and the captures that wait for the watermark, as sorted runs of
    about ``run_bytes``, each in pages of about ``page_bytes``. A timer at the earliest of a run settles all up to the
    watermark, in order of time, then hash: the runs are merged with one page of each in memory, and what changed leaves
    in frames of a page, so a task's memory does not follow the size of a series or of a micro-batch. A capture that is
    not newer than what is settled comes too late and is dropped, whatever its hash.
    """

    def __init__(self, run_bytes: int = 1 << 24, page_bytes: int = 1 << 18):
        self.run_bytes, self.page_bytes = run_bytes, page_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "content_hash string, micros long")
        self.count = handle.getValueState("count", "n long")  # of runs so far, which numbers them
        self.runs = handle.getMapState("runs", "run long", "first int, stop int, micros long")  # pages left, their earliest time
        self.pages = handle.getMapState("pages", "run long, page int", "rows binary")

    def _cut(self, rows, most: int) -> Iterator[list[tuple]]:
        """Lists of about ``most`` bytes."""
        held, size = [], 0
        for r in rows:
            held.append(r)
            size += 200 + len(r[1] or "") + len(r[2] or "")  # what the objects take besides their letters
            if size >= most:
                yield held
                held, size = [], 0
        if held:
            yield held

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        settled = self.last.get()[1] if self.last.exists() else None
        each = (r for pdf in rows for r in zip(pdf["micros"].tolist(), pdf["content_hash"].tolist(), pdf["payload"].tolist(), strict=True))
        n = self.count.get()[0] if self.count.exists() else 0
        for run in self._cut((r for r in each if settled is None or r[0] > settled), self.run_bytes):
            run.sort(key=_order)
            page = 0
            for page, part in enumerate(self._cut(run, self.page_bytes), 1):
                self.pages.updateValue((n, page - 1), (pickle.dumps(part),))
            self.runs.updateValue((n,), (0, page, run[0][0]))
            self.handle.registerTimer(run[0][0] // 1000 + 1)
            n += 1
            self.count.update((n,))
        return iter(())

    def _due(self, run: int, first: int, stop: int, until: int) -> Iterator[tuple]:
        """A run's captures before ``until``; they leave the state."""
        for page in range(first, stop):
            rows = pickle.loads(bytes(self.pages.getValue((run, page))[0]))
            for i, r in enumerate(rows):
                if r[0] >= until:
                    self.pages.updateValue((run, page), (pickle.dumps(rows[i:]),))
                    self.runs.updateValue((run,), (page, stop, r[0]))
                    self.handle.registerTimer(r[0] // 1000 + 1)
                    return
                yield r
            self.pages.removeKey((run, page))
        self.runs.removeKey((run,))

    def _changed(self, until: int, runs: list[tuple]) -> Iterator[tuple]:
        first = not self.last.exists()
        last, at = (None, None) if first else self.last.get()
        for r in heapq.merge(*[self._due(run, a, b, until) for run, a, b in runs], key=_order):
            at, value, _ = r
            if first or value != last:
                yield r
            last, first = value, False
        self.last.update((last, at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        runs = [(k[0], first, stop) for k, (first, stop, micros) in list(self.runs.iterator()) if micros < until]
        for rows in self._cut(self._changed(until, runs), self.page_bytes) if runs else ():
            at, values, payloads = zip(*rows, strict=True)
            named = {c: [k] * len(rows) for c, k in zip(SERIES, key, strict=True)}
            yield pd.DataFrame(named | {"content_hash": pd.Series(values, dtype=object), "micros": at, "payload": pd.Series(payloads, dtype=object)})

    def close(self) -> None:
        pass


def changed_only(captures: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Captures that differ from the one before in their series, in order of time, as late as ``delay`` behind the newest."""
    captures.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = captures.withColumns({"node_label": F.coalesce("node_label", F.lit("")), "micros": F.unix_micros("captured_at")}).withWatermark("captured_at", delay)
    schema = ", ".join([*(f"{c} string" for c in SERIES), "content_hash string, micros long, payload string"])
    out = keyed.groupBy(*SERIES).transformWithStateInPandas(ChangedOnly(), schema, "append", "eventTime")
    return out.withColumn("captured_at", F.timestamp_micros("micros")).select(*captures.columns)


def ingest(captures: DataFrame, path: str, checkpoint: str, delay: str = "0 seconds") -> StreamingQuery:
    """Append changed captures to the history table until the source is exhausted.

    What is not older than the watermark waits in the state, the newest capture of all at least. A backfill that is to be
    settled whole ends with a later capture of another series.
    """
    out = changed_only(captures, delay).writeStream.format("parquet").partitionBy("project_id", "database_id", "kind")
    return out.option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


def latest_activity(captures: DataFrame, path: str, checkpoint: str, buckets: int = 32) -> StreamingQuery:
    """Keep the newest row of every series under ``path``, dealt to ``buckets`` by series; ``read_latest`` reads it.

    A micro-batch rewrites the buckets that it touches and commits a new list of buckets; its number is part of the
    list, so a batch that runs again changes nothing. Rows of equal time count by hash. The version before is kept for
    readers that hold it; older ones are removed.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        table = Manifest(batch.sparkSession, path)
        version, content = table.read()
        if batch_id <= content.get("last", -1):
            return
        dealt = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(*SERIES), F.lit(buckets)).cast("int"))
        touched = [str(r["bucket"]) for r in dealt(batch).select("bucket").distinct().collect()]  # at most ``buckets``
        both = dealt(table.load(content, batch.schema, touched).unionByName(batch))
        newest = both.groupBy("bucket", *SERIES).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in SERIES]), F.struct("captured_at", "content_hash")).alias("r"))
        folder = table.folder(f"v{version + 1}")
        newest.select("bucket", *SERIES, "r.*").repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
        table.commit(version + 1, {"last": batch_id, "parts": content["parts"] | {b: {"folder": f"{folder}/bucket={b}"} for b in touched}})
        table.clean()

    return captures.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every series, as of the last committed micro-batch."""
    table = Manifest(spark, path)
    return table.load(table.read()[1], schemas.CAPTURE)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
