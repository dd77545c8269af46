"""Snapshot history per stream: change-only storage, as-of lookups, attachment of statistics to versions.

A stream is (project_id, database_id). Every operator works on all streams at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STREAM = ["project_id", "database_id"]


def content_hash(rows: DataFrame, by: Sequence[str], included: Sequence[str], order: Sequence[str]) -> DataFrame:
    """SHA-256 per ``by`` over the ``included`` columns of its rows, in ``order``; other columns do not count."""
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in included])
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), 256).alias("content_hash"))


#: What of a table and of its parts counts as structure; object ids, storage options and validity do not.
STRUCTURE = {
    "columns": ("name", "ordinal", "type_name", "nullable", "default", "identity", "comment"),
    "constraints": ("name", "kind", "columns", "definition", "fk_table", "fk_columns", "backing_index", "comment"),
    "indexes": ("name", "columns", "include_columns", "index_type", "is_unique", "is_primary", "predicate", "definition"),
    "policies": None, "triggers": None,
}


def structural_hash(docs: DataFrame) -> DataFrame:
    """``docs`` (snapshot documents) with the SHA-256 of their structure, in which the order of objects does not count.

    Version, tables with all their parts, enums, domains, composites, views, functions and extensions count; settings,
    source, times and the database's name do not.
    """
    by_name = lambda items: F.array_sort(F.transform(F.coalesce(items, F.array()), lambda x: F.to_json(x)))

    def part(t: Column, field: str, kept: Sequence[str] | None) -> Column:
        if kept is None:
            return by_name(t[field])
        return by_name(F.transform(F.coalesce(t[field], F.array()), lambda x: F.struct(*[x[k].alias(k) for k in kept])))

    def table(t: Column) -> Column:
        own = [t[k].alias(k) for k in ("schema", "name", "comment", "partition_info")] + [F.coalesce(t["rls_enabled"], F.lit(False)).alias("rls_enabled")]
        return F.struct(*own, *[part(t, f, kept).alias(f) for f, kept in STRUCTURE.items()])

    others = ("enums", "domains", "composites", "views", "functions", "extensions")
    body = F.struct("version", by_name(F.transform("tables", table)).alias("tables"), *[by_name(F.col(k)).alias(k) for k in others])
    return docs.withColumn("content_hash", F.sha2(F.to_json(body), 256))


def payload_hash(payload: Column, captured_at: Column, include_timestamp: bool = True) -> Column:
    """Hash of a capture; with its time, a later capture of the same counters differs."""
    return F.sha2(F.concat_ws("|", payload, captured_at.cast("string")) if include_timestamp else payload, 256)


def collapse_unchanged(rows: DataFrame, by: Sequence[str], ts: str = "captured_at") -> DataFrame:
    """Rows whose hash differs from the one just before in the same series (A, B, A keeps all three); equal times follow by hash."""
    before = F.lag("content_hash").over(Window.partitionBy(*by).orderBy(ts, "content_hash"))
    return rows.withColumn("__before", before).where(~F.col("content_hash").eqNullSafe(F.col("__before"))).drop("__before")


def latest(rows: DataFrame, by: Sequence[str], ts: str = "captured_at") -> DataFrame:
    """The newest row of each series; an aggregate, so map-side combined."""
    newest = rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in by]), ts).alias("__row"))
    return newest.select(*by, "__row.*").select(*rows.columns)


def latest_at(rows: DataFrame, by: Sequence[str], at: Column, ts: str = "captured_at") -> DataFrame:
    """The newest row of each series that is not later than ``at``."""
    return latest(rows.where(F.col(ts) <= at), by, ts)


def as_of(probes: DataFrame, rows: DataFrame, by: Sequence[str], probe_ts: str, ts: str, values: Sequence[str], slice_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """``probes`` with the ``values`` of the newest row not later than each probe (null if none).

    No window holds a whole series: probes and rows are cut into time slices (days, or ``slice_of`` the time, which must
    not fall as time grows), a running last value covers one slice, and what a slice ends with is carried to later
    slices by a window over the ends of slices, one row each. Of rows with equal times, the greatest ``values`` count.
    """
    cut = slice_of or (lambda c: F.to_date(c) if probes.schema[probe_ts].dataType.typeName().startswith("timestamp") else F.floor(c / 86400))
    kind = rows.select(F.struct(*values).alias("s")).schema["s"].dataType
    left = probes.withColumns({"__ts": F.col(probe_ts), "__probe": F.lit(1), "__v": F.lit(None).cast(kind)})
    right = rows.select(*by, F.col(ts).alias("__ts"), F.lit(0).alias("__probe"), F.struct(*values).alias("__v")).where("__ts is not null")
    both = left.unionByName(right, allowMissingColumns=True).withColumn("__slice", cut(F.col("__ts")))
    run = Window.partitionBy(*by, "__slice").orderBy("__ts", "__probe", "__v").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__v", F.last("__v", ignorenulls=True).over(run)).where("__probe = 1")
    # every slice with its last row, if any; then the last of the slices before
    ends = both.groupBy(*by, "__slice").agg(F.max(F.when(F.col("__probe") == 0, F.struct("__ts", "__v"))).alias("__end"))
    earlier = F.last("__end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.withColumn("__carry", earlier["__v"]).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__slice").alias("__at"), "__carry")
    same = F.col("__slice").eqNullSafe(F.col("__at"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    found = F.coalesce("__v", "__carry")
    return seen.join(carried, same, "left").select(*probes.columns, *[found[v].alias(v) for v in values])


def by_hash(rows: DataFrame, project_id: str, database_id: str, value: str) -> DataFrame:
    return rows.where((F.col("project_id") == project_id) & (F.col("database_id") == database_id) & (F.col("content_hash") == value))


def list_snapshots(rows: DataFrame, start: Column | None = None, stop: Column | None = None, ts: str = "captured_at") -> DataFrame:
    """Half-open [start, stop), newest first."""
    out = rows if start is None else rows.where(F.col(ts) >= start)
    out = out if stop is None else out.where(F.col(ts) < stop)
    return out.orderBy(F.col(ts).desc())


def delete_before(rows: DataFrame, cutoff: Column, kind: str = "schema", ts: str = "captured_at") -> tuple[DataFrame, DataFrame]:
    """(kept, deleted): rows of ``kind`` strictly older than the cutoff go."""
    old = F.coalesce((F.col("kind") == kind) & (F.col(ts) < cutoff), F.lit(False))
    return rows.where(~old), rows.where(old)


def list_keys(rows: DataFrame) -> DataFrame:
    return rows.where("project_id is not null and database_id is not null").select(*STREAM).distinct().orderBy(*STREAM)


def attach_schema_ref(activity: DataFrame, schemas: DataFrame, allow_orphan: bool = False) -> tuple[DataFrame, DataFrame]:
    """(attached, rejected): each capture takes its stream's latest schema hash at its time."""
    refs = schemas.select(*STREAM, F.col("captured_at").alias("__at"), F.col("content_hash").alias("schema_ref_hash"))
    seen = as_of(activity, refs, STREAM, "captured_at", "__at", ["schema_ref_hash"])
    orphan = F.col("schema_ref_hash").isNull()
    if allow_orphan:
        return seen.withColumn("schema_ref_hash", F.coalesce("schema_ref_hash", F.lit(""))), seen.where(F.lit(False))
    return seen.where(~orphan), seen.where(orphan)


def annotate(schemas: DataFrame, planner: DataFrame, activity: DataFrame, at: Column) -> DataFrame:
    """Each stream's schema version at a time, with its latest planner row and per node its latest activity."""
    s = latest_at(schemas, STREAM, at).select(*STREAM, "content_hash", F.col("captured_at").alias("schema_at"))
    p = latest(planner, [*STREAM, "schema_ref_hash"]).select(*STREAM, F.col("schema_ref_hash").alias("content_hash"), F.col("captured_at").alias("planner_at"))
    a = latest(activity, [*STREAM, "schema_ref_hash", "node_label"]).select(
        *STREAM, F.col("schema_ref_hash").alias("content_hash"), "node_label", F.col("captured_at").alias("activity_at")
    )
    keys = [*STREAM, "content_hash"]
    return s.join(p, keys, "left").join(a, keys, "left")


def role_guard(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): planner captures come from a primary, replica activity from a standby."""
    reason = F.when((F.col("kind") == "planner_stats") & F.col("is_standby"), F.lit("planner statistics need a primary")).when(
        (F.col("kind") == "activity_stats") & ~F.col("is_standby"), F.lit("replica activity needs a standby")
    )
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def key_default(rows: DataFrame) -> DataFrame:
    return rows.withColumn("database_id", F.coalesce("database_id", "database"))
