"""Best-fit packing planned on the histogram of lengths.

Documents are tokenised once into pieces of at most ``capacity`` tokens. Only the count of each length
(at most ``capacity`` rows, whatever the corpus) reaches the driver, where best-fit decreasing runs over
counts: equal lengths are placed together and bins of equal free space are kept as intervals of bin
numbers. The plan is a list of segments (length, first rank, number, first bin, offset). Pieces then take
their slots by joining on their rank within their length. The rank is counted inside (length, bucket) and
shifted by the counts of the buckets before, so a length that most documents share is ranked by many tasks.

Defined cases: a null text counts as empty (its only token is the end mark); repeated rows are packed as
rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catascope.llm.common import by_value, partitions, stored
from catascope.llm.tokens import WordEncoder, default_path

END_ID = 0
PLAN_SCHEMA = "length long, first long, n long, bin long, offset long"


def pieces(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole texts tokenised, ended by END_ID and cut."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder, step = WordEncoder(path), 4 * capacity
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py()) + END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, value in zip(out, (key.as_py(), k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_plan(counts: dict[int, int], capacity: int = 2048) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths; segments (length, first rank, n, first bin, offset)."""
    free: dict[int, list[list[int]]] = {}  # free space -> intervals [first bin, number]
    sizes: list[int] = []  # sorted keys of free
    plan, bins = [], 0

    def release(space: int, first: int, n: int) -> None:
        if space:
            if space not in free:
                free[space] = []
                bisect.insort(sizes, space)
            free[space].append([first, n])

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(sizes, length)
            if k < len(sizes):  # the fullest bins that still take it
                space = sizes[k]
                first, n = free[space][-1]
                n = min(n, left)
                plan.append((length, rank, n, first, capacity - space))
                if n == free[space][-1][1]:
                    free[space].pop()
                    if not free[space]:
                        del free[space], sizes[k]
                else:
                    free[space][-1][0] += n
                    free[space][-1][1] -= n
                release(space - length, first, n)
                rank, left = rank + n, left - n
            else:  # new bins, each filled with as many as it takes
                per = capacity // length
                full, rest = divmod(left, per)
                for n, of, at in ((full, per, bins), (1, rest, bins + full)):
                    if n and of:
                        for layer in range(of):
                            plan.append((length, rank, n, at, layer * length))
                            rank += n
                        release(capacity - of * length, at, n)
                        bins += n
                left = 0
    return plan


def ranked(rows: DataFrame, key: str, buckets: int, *order: str) -> DataFrame:
    """``rank``: 0, 1, ... within ``key``, counted by (key, bucket) so that no key is ranked by one task."""
    rows = rows.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = F.sum("__n").over(W.partitionBy(key).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    offsets = rows.groupBy(key, "__b").agg(F.count(F.lit(1)).alias("__n")).select(key, "__b", F.coalesce(before, F.lit(0)).alias("__before"))
    inner = F.row_number().over(W.partitionBy(key, "__b").orderBy(*order)) - 1
    return rows.withColumn("__r", inner).join(offsets, [key, "__b"]).withColumn("rank", F.col("__r") + F.col("__before")).drop("__b", "__r", "__before")


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048) -> DataFrame:
    """One row per piece with its sequence and offset; sequences hold at most ``capacity`` tokens."""
    spark = docs.sparkSession
    cut_up = stored(pieces(docs, path or default_path(), capacity), "pieces")
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame(best_fit_plan(counts, capacity), PLAN_SCHEMA).withColumnRenamed("offset", "at").withColumnRenamed("length", "l")
    slots = ranked(cut_up, "length", partitions(spark), "doc_id", "piece", "start", "ids_crc32")
    # the plan is bounded by the number of lengths, not by the corpus
    taken = slots.join(F.broadcast(plan), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    return taken.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("at").alias("offset"),
    )


by_value(__name__)
