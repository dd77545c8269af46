"""Differences between catalog versions, for every pair of versions of every stream at once.

``pairs`` (stream, from_hash, to_hash) names what to compare; each object grain is one full outer join. For all versions
of all streams, one after the other, pass a ``Timeline`` instead: each grain becomes validity intervals, made in one
pass over the rows of all versions, and changes are where intervals begin and end.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STREAM = ["project_id", "database_id"]
PAIR = [*STREAM, "from_hash", "to_hash"]


@dataclass(frozen=True)
class Timeline:
    """Versions of streams in order: (stream, seq from 1, content_hash, from_hash: the one before, last: their number)."""

    versions: DataFrame

    @classmethod
    def of(cls, versions: DataFrame, ts: str = "captured_at") -> Timeline:
        """From (stream, content_hash, ``ts``); equal times follow by hash, a hash that comes again is a version of its own."""
        order = Window.partitionBy(*STREAM).orderBy(ts, "content_hash")
        rows = versions.select(*STREAM, "content_hash", F.row_number().over(order).alias("seq"), F.lag("content_hash").over(order).alias("from_hash"), F.count(F.lit(1)).over(Window.partitionBy(*STREAM)).alias("last"))
        return cls(rows)

    def pairs(self) -> DataFrame:
        return self.versions.where("seq > 1").select(*STREAM, "from_hash", F.col("content_hash").alias("to_hash"))


#: Rows of all versions that one shuffle partition of ``intervals`` is dealt.
PARTITION_ROWS = 500_000


def intervals(rows: DataFrame, timeline: Timeline, key: Sequence[str], values: Sequence[str], partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """(stream, key, start, stop, body): every stretch of versions in which an object stays the same, ``stop`` exclusive.

    ``key`` identifies a row within its version. A window holds one object, and all windows share one sort. The rows are
    counted first, so that a task sorts about ``partition_rows`` of them however many versions there are.
    """
    return _dealt_intervals(rows, timeline, key, values, partition_rows).drop("deal")


def _dealt_intervals(rows: DataFrame, timeline: Timeline, key: Sequence[str], values: Sequence[str], partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """The intervals with ``deal``, a hash of their object, by which they lie in partitions; unlike a key it is never folded as a constant."""
    body = F.struct(*[F.col(v) for v in values]) if values else F.struct(F.lit(1).alias("one"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // partition_rows))
    at = timeline.versions.select(*STREAM, "seq", "content_hash").join(rows.withColumnRenamed("schema_hash", "content_hash"), [*STREAM, "content_hash"]).select(*STREAM, *key, "seq", body.alias("body"))
    order = Window.partitionBy("deal", *STREAM, *key).orderBy("seq")
    goes_on = (F.lag("seq").over(order) == F.col("seq") - 1) & F.lag("body").over(order).eqNullSafe(F.col("body"))
    marked = at.withColumn("deal", F.xxhash64(*STREAM, *key)).repartition(parts, "deal").withColumn("new", ~F.coalesce(goes_on, F.lit(False)))
    # of a stretch only its first and last row are left, the stop of the first is behind the last
    ends = marked.withColumn("end", F.coalesce(F.lead("new").over(order), F.lit(True))).where("new or end")
    stop = F.when(F.col("end"), F.col("seq")).otherwise(F.lead("seq").over(order)) + 1
    return ends.withColumn("stop", stop).where("new").select("deal", *STREAM, *key, F.col("seq").alias("start"), "stop", "body")


def version_at(spans: DataFrame, seq: int) -> DataFrame:
    """The objects of one version, by number, from their intervals."""
    return spans.where((F.col("start") <= seq) & (F.col("stop") > seq))


def _interval_sides(spans: DataFrame, timeline: Timeline, key: Sequence[str]) -> DataFrame:
    """(pair, key, old, new) of every object at every version where it appears, changes or goes, from dealt intervals."""
    order = Window.partitionBy("deal", *STREAM, *key).orderBy("start")
    before = F.lag("stop").over(order) == F.col("start")
    begins = F.struct(F.col("start").alias("seq"), F.when(before, F.lag("body").over(order)).alias("old"), F.col("body").alias("new"))
    kind = spans.schema["body"].dataType
    ends = F.when(~F.coalesce(F.lead("start").over(order) == F.col("stop"), F.lit(False)), F.struct(F.col("stop").alias("seq"), F.col("body").alias("old"), F.lit(None).cast(kind).alias("new")))
    both = spans.select(*STREAM, *key, begins.alias("begins"), ends.alias("ends"))
    events = both.select(*STREAM, *key, F.explode(F.array_compact(F.array("begins", "ends"))).alias("e")).select(*STREAM, *key, "e.*")
    # the first version has none before it, the last none after it
    at = timeline.versions.where("seq > 1").select(*STREAM, "seq", "from_hash", F.col("content_hash").alias("to_hash"))
    return events.join(at, [*STREAM, "seq"]).select(*PAIR, *key, "old", "new")


def consecutive_pairs(versions: DataFrame, ts: str = "captured_at") -> DataFrame:
    """Each version with the one before it in its stream."""
    return Timeline.of(versions, ts).pairs()


def choose_pair(versions: DataFrame, from_hash: str | None, current: DataFrame) -> DataFrame:
    """From a named version, or each stream's latest, to its current capture."""
    base = versions if from_hash is None else versions.where(F.col("content_hash") == from_hash)
    start = base.groupBy(*STREAM).agg(F.max_by("content_hash", "captured_at").alias("from_hash"))
    return start.join(current.select(*STREAM, F.col("content_hash").alias("to_hash")), STREAM)


def _sides(rows: DataFrame, pairs: DataFrame | Timeline, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(pair, key, struct ``old``, struct ``new``), null where absent: a full outer join of both versions' rows.

    For a timeline, from intervals, and only what differs.
    """
    if isinstance(pairs, Timeline):
        return _interval_sides(_dealt_intervals(rows, pairs, key, values), pairs, key)
    body = F.struct(*[F.col(v) for v in values]) if values else F.struct(F.lit(1).alias("one"))
    old = pairs.join(rows.withColumnRenamed("schema_hash", "from_hash"), [*STREAM, "from_hash"]).select(*PAIR, *key, body.alias("old"))
    new = pairs.join(rows.withColumnRenamed("schema_hash", "to_hash"), [*STREAM, "to_hash"]).select(*PAIR, *key, body.alias("new"))
    return old.join(new, [*PAIR, *key], "full_outer")


def _change(old: Column, new: Column) -> Column:
    return F.when(old.isNull(), "added").when(new.isNull(), "removed").otherwise("modified")


def column_details(columns: DataFrame, pairs: DataFrame | Timeline) -> DataFrame:
    """(pair, table, column, detail): added, removed, type, nullability, default, comment."""
    key = ["table_schema", "table_name", "column_name"]
    both = _sides(columns, pairs, key, ["type_name", "nullable", "default", "comment"])
    o, n = F.col("old"), F.col("new")
    kept = o.isNotNull() & n.isNotNull()
    details = {
        "added": o.isNull(), "removed": n.isNull(), "type changed": kept & (o["type_name"] != n["type_name"]),
        "not null added": kept & o["nullable"] & ~n["nullable"], "not null removed": kept & ~o["nullable"] & n["nullable"],
        "default changed": kept & ~o["default"].eqNullSafe(n["default"]), "comment changed": kept & ~o["comment"].eqNullSafe(n["comment"]),
    }
    each = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(d)) for d, c in details.items()]))).alias("detail")
    return both.select(*PAIR, *key, each)


def member_details(rows: DataFrame, pairs: DataFrame | Timeline, kind: str, name: str = "name") -> DataFrame:
    """Constraint or index names added and removed; changed definitions do not count."""
    both = _sides(rows, pairs, ["table_schema", "table_name", name], []).where("old is null or new is null")
    return both.select(*PAIR, "table_schema", "table_name", F.col(name).alias("object"), F.concat_ws(" ", F.lit(kind), _change(F.col("old"), F.col("new"))).alias("detail"))


def table_details(tables: DataFrame, pairs: DataFrame | Timeline) -> DataFrame:
    both = _sides(tables, pairs, ["table_schema", "table_name"], ["comment", "rls_enabled"]).where("old is not null and new is not null")
    o, n = F.col("old"), F.col("new")
    each = F.array_compact(F.array(
        F.when(~o["comment"].eqNullSafe(n["comment"]), F.lit("comment changed")),
        F.when(~o["rls_enabled"] & n["rls_enabled"], F.lit("row security enabled")), F.when(o["rls_enabled"] & ~n["rls_enabled"], F.lit("row security disabled")),
    ))
    return both.select(*PAIR, "table_schema", "table_name", F.explode(each).alias("detail"))


def diff_tables(tables: DataFrame, columns: DataFrame, pairs: DataFrame | Timeline, constraints: DataFrame | None = None, indexes: DataFrame | None = None) -> DataFrame:
    """(pair, table, change, n_details): added (with its columns), removed, or modified where anything differs."""
    key = ["table_schema", "table_name"]
    came = _sides(tables, pairs, key, []).where("old is null or new is null").withColumn("change", _change(F.col("old"), F.col("new")))
    details = column_details(columns, pairs).select(*PAIR, "table_schema", "table_name", "detail").unionByName(table_details(tables, pairs))
    for rows, kind in ((constraints, "constraint"), (indexes, "index")):
        if rows is not None:
            details = details.unionByName(member_details(rows, pairs, kind).select(*PAIR, "table_schema", "table_name", "detail"))
    counts = details.groupBy(*PAIR, "table_schema", "table_name").agg(F.count(F.lit(1)).alias("n_details"))
    out = came.join(counts, [*PAIR, *key], "full_outer").withColumn("change", F.coalesce("change", F.lit("modified")))
    return out.select(*PAIR, F.lit("table").alias("kind"), F.concat_ws(".", *key).alias("object"), "change", F.coalesce("n_details", F.lit(0)).alias("n_details"))


def diff_objects(rows: DataFrame, pairs: DataFrame | Timeline, kind: str, key: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """Views, functions, enums, domains, composites, extensions: added, removed, or any compared field changed."""
    both = _sides(rows, pairs, key, compared)
    differs = F.col("old").isNull() | F.col("new").isNull() | ~F.col("old").eqNullSafe(F.col("new"))
    changed = F.array_compact(F.array(*[F.when(F.col("old").isNotNull() & F.col("new").isNotNull() & ~F.col("old")[c].eqNullSafe(F.col("new")[c]), F.lit(c)) for c in compared])) if compared else F.array().cast("array<string>")
    return both.where(differs).select(*PAIR, F.lit(kind).alias("kind"), F.concat_ws(".", *key).alias("object"), _change(F.col("old"), F.col("new")).alias("change"), F.size(changed).cast("long").alias("n_details"))


def diff_header(pairs: DataFrame, changes: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Per pair how many objects changed; with ``versions`` (stream, content_hash, captured_at) also both times."""
    counts = changes.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_changes"))
    out = pairs.join(counts, PAIR, "left").select(*PAIR, F.coalesce("n_changes", F.lit(0)).alias("n_changes"), F.col("n_changes").isNull().alias("is_empty"))
    for side in () if versions is None else ("from", "to"):
        at = versions.groupBy(*STREAM, F.col("content_hash").alias(f"{side}_hash")).agg(F.max("captured_at").alias(f"{side}_at"))
        out = out.join(at, [*STREAM, f"{side}_hash"], "left")
    return out


def drift(changes: DataFrame) -> DataFrame:
    """Ahead, behind and diverged objects per pair."""
    n = lambda c: F.count_if(F.col("change") == c)
    return changes.groupBy(*PAIR).agg(n("added").alias("ahead"), n("removed").alias("behind"), n("modified").alias("diverged"))
