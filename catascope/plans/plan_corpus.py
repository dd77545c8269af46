"""Analytics over a corpus of EXPLAIN documents: flattening, warnings, advice, index suggestions."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catascope.functions.names import filter_column, index_method
from catascope.sources.scratch import Rounds

K = ["project_id", "database_id", "schema_hash"]
TABLE = [*K, "table_schema", "table_name"]
#: column -> (key of the document, type, value where the document has none)
FIELDS = {
    "node_type": ("Node Type", "string", None), "relation": ("Relation Name", "string", None), "rel_schema": ("Schema", "string", None), "alias": ("Alias", "string", None),
    "index_name": ("Index Name", "string", None), "join_type": ("Join Type", "string", None), "startup_cost": ("Startup Cost", "double", 0.0), "total_cost": ("Total Cost", "double", 0.0),
    "plan_rows": ("Plan Rows", "double", 0.0), "plan_width": ("Plan Width", "bigint", 0), "actual_rows": ("Actual Rows", "double", None), "actual_loops": ("Actual Loops", "double", None),
    "actual_startup_time": ("Actual Startup Time", "double", None), "actual_total_time": ("Actual Total Time", "double", None), "rows_removed": ("Rows Removed by Filter", "double", None),
    "filter": ("Filter", "string", None), "index_cond": ("Index Cond", "string", None), "hash_cond": ("Hash Cond", "string", None), "recheck_cond": ("Recheck Cond", "string", None),
    "sort_key": ("Sort Key", "array<string>", None), "sort_method": ("Sort Method", "string", None), "cte_name": ("CTE Name", "string", None),
    "subplans_removed": ("Subplans Removed", "bigint", None), "shared_hit": ("Shared Hit Blocks", "bigint", None), "shared_read": ("Shared Read Blocks", "bigint", None),
}
APPENDS = ("Append", "Merge Append")


def read_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with ``plan`` and the times of an analysed one, rejected): a list of one plan or a plan by itself."""
    listed = F.col("plan_json").rlike(r"^\s*\[")  # each document is searched once
    either = lambda key: F.when(listed, F.get_json_object("plan_json", f"$[0]{key}")).otherwise(F.get_json_object("plan_json", f"${key}"))
    rows = docs.withColumns({
        "plan": either(".Plan"), "planning_time": either("['Planning Time']").cast("double"), "execution_time": either("['Execution Time']").cast("double"),
    })
    return rows.where("plan is not null"), rows.where("plan is null").drop("plan", "planning_time", "execution_time")


def parse_plans(docs: DataFrame) -> DataFrame:
    """(K, plan_id, problem, path, parent_path, child_no, depth, parent_type, fields): a row per node, in document order.

    A plan nests to any depth, which no column expression follows, so each document is parsed once in a task. Numbers may
    be written as texts. A document with any value that cannot be read as its field's type, a node that is no object or
    children that are no list gives one row with its ``problem`` instead, and does not end the job.
    """
    keys, fields = [*K, "plan_id"], FIELDS

    def run(batches: Iterator) -> Iterator:
        import json

        import pyarrow as pa

        kinds = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}
        places = {"path": pa.list_(pa.int32()), "parent_path": pa.list_(pa.int32()), "child_no": pa.int32(), "depth": pa.int32(), "parent_type": pa.string()}

        def value(node: dict, key: str, kind: str, default):
            v = node.get(key)
            if v is None:
                return default
            try:
                if kind.startswith("array"):
                    if not isinstance(v, list):
                        raise TypeError
                    return [None if x is None else str(x) for x in v]
                if kind == "string":
                    return str(v)
                if isinstance(v, bool):
                    raise TypeError
                number = float(v)
                if kind == "double":
                    return number
                if number != int(number) or abs(number) >= 1 << 63:
                    raise ValueError
                return int(v) if isinstance(v, int) else int(number)
            except (TypeError, ValueError, OverflowError):
                raise ValueError(f"{key}: {json.dumps(v)[:100]}") from None

        slots = {key: (1 + len(places) + i, kind, default) for i, (key, kind, default) in enumerate(fields.values())}
        blank = [None] * (1 + len(places)) + [default for _, _, default in fields.values()]

        def nodes(text: str) -> list[list]:
            stack, rows = [(json.loads(text), (), None)], []
            while stack:
                node, path, above = stack.pop()
                if not isinstance(node, dict):
                    raise ValueError(f"node is no object: {json.dumps(node)[:100]}")
                below = node.get("Plans") or []
                if not isinstance(below, list):
                    raise ValueError(f"Plans: {json.dumps(below)[:100]}")
                row = blank.copy()
                row[1], row[4], row[5] = path, len(path), above
                if path:
                    row[2], row[3] = path[:-1], path[-1]
                try:
                    for key in node:  # a node has few of the fields
                        if (slot := slots.get(key)) is not None:
                            row[slot[0]] = value(node, key, *slot[1:])
                except ValueError:  # the first problem in the order of the fields
                    for f in fields.values():
                        value(node, *f)
                    raise
                rows.append(row)
                kind = node.get("Node Type")
                stack += [(child, (*path, k), None if kind is None else str(kind)) for k, child in reversed(list(enumerate(below)))]
            return rows

        for batch in batches:
            own, rows = [], []
            for i, plan in enumerate(batch.column(len(keys))):
                try:
                    found = nodes(plan.as_py())
                except (ValueError, RecursionError) as e:  # also JSON that does not parse
                    found = [(str(e) or type(e).__name__, *[None] * (len(places) + len(fields)))]
                own += [i] * len(found)
                rows += found
            columns = zip(*rows, strict=True) if rows else [()] * (1 + len(places) + len(fields))
            types = [pa.string(), *places.values(), *(kinds[t] for _, t, _ in fields.values())]
            found = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(own, pa.int64())) for c in batch.columns[:-1]] + found, names=[*keys, "problem", *places, *fields])

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "problem string, path array<int>, parent_path array<int>, child_no int, depth int, parent_type string", *(f"{c} {t}" for c, (_, t, _) in FIELDS.items())])
    return docs.select(*keys, "plan").mapInArrow(run, schema)


def flatten_plans(docs: DataFrame) -> DataFrame:
    """The nodes of all documents that can be read."""
    return parse_plans(docs).where("problem is null").drop("problem")


def unreadable_plans(docs: DataFrame) -> DataFrame:
    """(K, plan_id, problem) of the documents that ``flatten_plans`` leaves out."""
    return parse_plans(docs).where("problem is not null").select(*K, "plan_id", "problem")


def summary(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Root of every plan, with the times of analysed plans."""
    roots = nodes.where("depth = 0").select(*K, "plan_id", "node_type", "total_cost", F.col("plan_rows").alias("estimated_rows"))
    return roots.join(docs.select(*K, "plan_id", "planning_time", "execution_time"), [*K, "plan_id"], "left")


def _path(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ".")


def _note(when: Column, rule: str, severity: str, table: Column, measure: Column, path: Column | None = None) -> Column:
    """A warning where ``when`` holds, else null."""
    fields = F.struct(
        _path(F.col("path") if path is None else path).alias("path"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
        table.cast("string").alias("table"), measure.cast("double").alias("measure"),
    )
    return F.when(when, fields)


def _own(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"table_schema": F.coalesce("rel_schema", F.lit("public")), "table_name": F.col("relation")})


def _inner_scan(least: float) -> Column:
    """True for the second child of a nested loop if it is a larger sequential scan."""
    return (F.col("parent_type") == "Nested Loop") & (F.col("child_no") == 1) & (F.col("node_type") == "Seq Scan") & (F.col("plan_rows") > least)


def partition_scans(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """(K, plan_id, path, parent, scanned, total): Appends over partitions, by the first parent that owns a scanned name."""
    owner = children.groupBy(*K, F.col("child_name").alias("relation")).agg(F.min("parent_name").alias("parent"))
    totals = children.groupBy(*K, F.col("parent_name").alias("parent")).agg(F.count(F.lit(1)).alias("total"))
    scans = nodes.where(F.col("relation").isNotNull() & F.col("parent_type").isin(*APPENDS)).select(*K, "plan_id", "relation", F.col("parent_path").alias("path"))
    scans = scans.join(owner, [*K, "relation"]).groupBy(*K, "plan_id", "path").agg(F.count(F.lit(1)).alias("scanned"), F.min("parent").alias("parent"))
    return scans.join(totals, [*K, "parent"])


def warnings(nodes: DataFrame, stat_table: DataFrame, children: DataFrame) -> DataFrame:
    """(K, plan_id, path, rule, severity, table, measure): each node emits all its warnings in one pass."""
    appends = partition_scans(nodes, children)
    # a CTE's own Append is its first or a later child: one step up from the Append
    below = appends.where("size(path) > 0").groupBy(*K, "plan_id", F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(F.min("parent").alias("over"))
    n = _own(nodes).join(stat_table.select(*TABLE, "reltuples"), TABLE, "left")
    n = n.join(appends, [*K, "plan_id", "path"], "left").join(below, [*K, "plan_id", "path"], "left")
    rows = F.when(F.col("plan_rows") > 0, F.col("plan_rows")).otherwise(F.coalesce("reltuples", F.lit(0.0)))
    removed = F.col("rows_removed") / (F.col("rows_removed") + F.col("actual_rows"))
    kind, relation, none = F.col("node_type"), F.col("relation"), F.lit(None)
    cte = (kind == "CTE Scan") & F.col("cte_name").isNotNull() & (F.col("plan_rows") >= 1000)
    each = F.array(
        _note((kind == "Seq Scan") & (rows >= 5000), "seq_scan", "warning", relation, rows),
        _note(_inner_scan(100), "nested_loop_seq_scan", "warning", relation, F.col("plan_rows"), F.col("parent_path")),
        _note((kind == "Sort") & (F.col("plan_rows") > 10_000), "large_sort", "info", none, F.col("plan_rows")),
        _note((F.col("rows_removed") > 0) & (F.col("actual_rows") > 0) & (removed > 0.9), "filter_removes_most", "warning", relation, removed),
        _note(kind.isin(*APPENDS) & (F.col("scanned") >= F.col("total")), "no_pruning", "warning", F.col("parent"), F.col("scanned")),
        _note(kind.isin(*APPENDS) & (F.col("scanned") < F.col("total")) & (F.col("scanned") > F.expr("total div 2")), "weak_pruning", "info", F.col("parent"), F.col("scanned")),
        _note(cte & F.col("over").isNull(), "large_cte", "warning", F.col("cte_name"), F.col("plan_rows")),
        _note(cte & F.col("over").isNotNull(), "cte_over_partitions", "warning", F.col("over"), F.col("plan_rows")),
    )
    return n.select(*K, "plan_id", F.explode(F.array_compact(each)).alias("w")).select(*K, "plan_id", "w.*")


def _leading(indexes: DataFrame) -> DataFrame:
    return indexes.select(*TABLE, F.get("columns", F.lit(0)).alias("column_name")).distinct().withColumn("indexed", F.lit(True))


def scan_advice(nodes: DataFrame, indexes: DataFrame, columns: DataFrame, stat_column: DataFrame, stat_table: DataFrame, least: float = 10_000, activity: DataFrame | None = None) -> DataFrame:
    """Advice for large sequential scans: analyse where an index leads on the column, else the index to create.

    ``nodes``: the table's scans per node of ``activity`` (nodes of a database are few), where two or more report.
    """
    n = _own(nodes).where((F.col("node_type") == "Seq Scan") & (F.col("plan_rows") >= least)).withColumn("column_name", filter_column(F.col("filter")))
    key = [*TABLE, "column_name"]
    rows = n.join(_leading(indexes), key, "left").join(columns.select(*key, "type_name"), key, "left").join(stat_column.select(*key, "null_frac", "n_distinct", "mcv", "mcf", "correlation"), key, "left")
    rows = rows.join(stat_table.select(*TABLE, "reltuples"), TABLE, "left")
    method = index_method(F.coalesce("type_name", F.lit("")))
    common = F.get(F.filter(F.arrays_zip(F.col("mcv").alias("v"), F.col("mcf").alias("f")), lambda x: x["f"] > 0.5), F.lit(0))["v"]
    where = F.when(F.col("null_frac") > 0.5, F.concat(F.lit(" WHERE "), "column_name", F.lit(" IS NOT NULL"))).when(common.isNotNull(), F.concat(F.lit(" WHERE "), "column_name", F.lit(" <> '"), common, F.lit("'"))).otherwise("")
    ddl = F.concat(F.lit("CREATE INDEX ON "), "table_schema", F.lit("."), "table_name", F.lit(" USING "), method, F.lit(" ("), "column_name", F.lit(")"), where)
    size = F.greatest("plan_rows", F.coalesce("reltuples", F.lit(0.0)))
    hints = {
        "few_values": F.col("n_distinct").between(1, 5), "low_cardinality": F.col("n_distinct").between(6, 20), "dominant_value": common.isNotNull(),
        "mostly_null": F.col("null_frac") > 0.5, "unordered": (F.abs("correlation") < 0.3) & (size > 10_000),
    }
    indexed = F.coalesce("indexed", F.lit(False))
    if activity is not None:
        each = F.array_sort(F.collect_list(F.struct("node_label", "seq_scan")))
        per = activity.groupBy(*TABLE).agg(each.alias("each")).where(F.size("each") > 1)
        rows = rows.join(per.select(*TABLE, F.array_join(F.transform("each", lambda x: F.concat_ws(": ", x["node_label"], x["seq_scan"])), ", ").alias("nodes")), TABLE, "left")
    return rows.select(
        *K, "plan_id", "table_name", "column_name", *(["nodes"] if activity is not None else []), F.when(indexed, "info").otherwise("warning").alias("severity"),
        F.when(F.col("column_name").isNotNull(), F.when(indexed, F.concat(F.lit("ANALYZE "), "table_schema", F.lit("."), "table_name")).otherwise(ddl)).alias("ddl"),
        F.array_compact(F.array(*[F.when(c, F.lit(h)) for h, c in hints.items()])).alias("hints"),
    )


def nested_loop_advice(nodes: DataFrame, least: float = 100) -> DataFrame:
    """Inner sequential scans of nested loops: the index on the filtered column that would spare them, if one is named."""
    n = _own(nodes).where(_inner_scan(least)).withColumn("column_name", filter_column(F.col("filter")))
    ddl = F.concat(F.lit("CREATE INDEX ON "), "table_schema", F.lit("."), "table_name", F.lit(" ("), "column_name", F.lit(")"))
    return n.select(*K, "plan_id", "table_name", "column_name", F.lit("warning").alias("severity"), F.col("plan_rows").alias("rows_per_loop"), ddl.alias("ddl"))


def sort_advice(nodes: DataFrame, least: float = 10_000) -> DataFrame:
    """Large sorts with keys over a base table: the first table below in document order.

    In that order a node's subtree follows it at once: the next table after a sort is the one below it, if the sort's
    path leads there. So one window over each plan does it, without a join.
    """
    large = (F.col("node_type") == "Sort") & (F.col("plan_rows") >= least) & (F.size("sort_key") > 0)
    rows = nodes.withColumn("large", F.coalesce(large, F.lit(False))).where("large or relation is not null")
    after = Window.partitionBy(*K, "plan_id").orderBy(F.col("path").desc()).rowsBetween(Window.unboundedPreceding, 0)
    table = F.last(F.when(F.col("relation").isNotNull(), F.struct("path", "relation")), ignorenulls=True).over(after)
    rows = rows.select(*K, "plan_id", "path", "large", "sort_key", "plan_rows", table.alias("t"))
    below = F.col("large") & (F.slice("t.path", F.lit(1), F.size("path")) == F.col("path"))
    rows = rows.where(below).groupBy(*K, "plan_id", "path")
    return rows.agg(F.min_by("t.relation", "t.path").alias("table_name"), F.first("sort_key").alias("sort_key"), F.first("plan_rows").alias("plan_rows"))


def cte_advice(nodes: DataFrame, least: float = 1000) -> DataFrame:
    return nodes.where((F.col("node_type") == "CTE Scan") & (F.col("plan_rows") >= least)).select(*K, "plan_id", "cte_name", "plan_rows")


def version_note(version: Column) -> Column:
    return F.when(version["major"] >= 13, "B-tree deduplication").when(version["major"] >= 11, "INCLUDE columns")


def impact(rows: Column) -> Column:
    return F.when(rows >= 1_000_000, "high").when(rows >= 10_000, "medium").otherwise("low")


def suggest_indexes(nodes: DataFrame, indexes: DataFrame, scan_rows: float = 1000, sort_rows: float = 5000) -> DataFrame:
    """Suggestions of all plans: (plan, table, columns, impact) from unindexed filters and from sorts.

    What they need of the nodes is written once: filters, sorts and the tables below sorts each read it, and documents
    are parsed once.
    """
    used = nodes.where("relation is not null or node_type in ('Seq Scan', 'Sort')")
    nodes = Rounds(nodes.sparkSession, "plan-nodes").put(used.select(*K, "plan_id", "path", "node_type", "relation", "rel_schema", "plan_rows", "filter", "sort_key"), "nodes")
    n = _own(nodes)
    scans = n.where((F.col("node_type") == "Seq Scan") & (F.col("plan_rows") >= scan_rows)).withColumn("column_name", filter_column(F.col("filter"))).where("column_name is not null")
    scans = scans.join(_leading(indexes), [*TABLE, "column_name"], "left_anti").select(*K, "plan_id", "table_name", F.col("column_name").alias("columns"), "plan_rows", F.lit(0).alias("place"))
    sorts = sort_advice(nodes, sort_rows).select(*K, "plan_id", "table_name", F.array_join("sort_key", ",").alias("columns"), "plan_rows", F.lit(1).alias("place"))
    return scans.unionByName(sorts).withColumn("impact", impact(F.col("plan_rows")))


def with_query_suggestions(plan_rows: DataFrame, query_rows: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Suggestions of plans and those of query filters (K, table, query_id, column_name) as one frame, plans first.

    Plans and queries of one statement share their id. With ``columns`` (K, table, column_name, type_name) each
    suggestion of a single column names the index method of the column's type; others take a B-tree.
    """
    queries = query_rows.select(*K, F.col("query_id").alias("plan_id"), "table_name", F.col("column_name").alias("columns"), F.lit(0.0).alias("plan_rows"), F.lit(2).alias("place"), F.lit(None).cast("string").alias("impact"))
    both = plan_rows.select(*queries.columns).unionByName(queries)
    if columns is None:
        return both
    types = columns.groupBy(*K, "table_name", F.col("column_name").alias("columns")).agg(F.min("type_name").alias("type_name"))
    return both.join(types, [*K, "table_name", "columns"], "left").withColumn("method", F.coalesce(index_method(F.col("type_name")), F.lit("btree"))).drop("type_name")


def dedupe_suggestions(rows: DataFrame) -> DataFrame:
    """First suggestion per plan, table and columns: from scans, then sorts, then query filters; the larger of equals."""
    first = F.row_number().over(Window.partitionBy(*K, "plan_id", "table_name", "columns").orderBy("place", F.col("plan_rows").desc()))
    return rows.withColumn("__n", first).where("__n = 1").drop("__n")


def rollup_suggestions(rows: DataFrame, *more: str) -> DataFrame:
    """Over the corpus: how many plans support each suggestion; by ``more`` columns too, such as the index method."""
    return rows.groupBy(*K, "table_name", "columns", *more).agg(F.countDistinct("plan_id").alias("n_plans"), F.max("plan_rows").alias("max_rows"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
