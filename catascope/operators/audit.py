"""Structural audits: duplicate and redundant indexes, foreign-key graph, keys, names, comments.

Foreign keys of one catalog form a digraph over its tables; every audit handles all catalogs in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catascope.functions.names import canonical_type
from catascope.operators.cycles import elementary_cycles
from catascope.operators.storage import index_bloat, tuned

K = ["project_id", "database_id", "schema_hash"]
TABLE = [*K, "table_schema", "table_name"]
FINDING = [*TABLE, "object", "rule", "severity", "message"]
WIDE = ("text", "varchar", "bytea", "jsonb", "json", "xml")
BOOL_PREFIXES = "^(?:is_|has_|can_|should_|was_|will_)"
# --- fixed values: reserved words ---
RESERVED = (
    "all alter and any as asc between by case check column constraint create cross current default delete desc distinct drop else end "
    "exists false fetch for foreign from full grant group having in index inner insert into is join key left like limit not null offset "
    "on or order outer primary references right select set table then to true union unique update user using values when where with"
).split()


#: Every audit that ``audit`` runs unless it is disabled.
RULES = (
    "indexes/duplicate", "indexes/redundant", "indexes/too_many", "indexes/wide_columns", "indexes/bloated", "fk/type_mismatch", "fk/circular",
    "fk/orphan", "pk/non_sequential", "naming/bool_prefix", "naming/reserved", "naming/id_mismatch", "docs/no_comment", "vacuum/large_table_defaults",
)


def _finding(rows: DataFrame, rule: str, severity, obj, message) -> DataFrame:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(*TABLE, obj.alias("object"), F.lit(rule).alias("rule"), as_col(severity).alias("severity"), as_col(message).alias("message"))


def duplicate_indexes(indexes: DataFrame) -> DataFrame:
    """Pairs of non-primary indexes over the same columns, method, predicate and included columns."""
    same = ["columns", "index_type", "include_columns"]
    rows = indexes.where("not is_primary").select(*TABLE, "name", "pos", *same, F.coalesce("predicate", F.lit("")).alias("predicate"), "is_unique", "backs_constraint")
    a, b = (rows.withColumnsRenamed({c: f"{c}_{s}" for c in ("name", "pos", "is_unique", "backs_constraint")}) for s in "ab")
    pairs = a.join(b, [*TABLE, *same, "predicate"]).where("pos_a < pos_b")
    alike = F.col("is_unique_a") == F.col("is_unique_b")
    both = F.col("backs_constraint_a") & F.col("backs_constraint_b")
    drop = F.when(alike, F.when(~both, F.when(F.col("backs_constraint_b") & ~F.col("backs_constraint_a"), F.col("name_a")).otherwise(F.col("name_b")))).otherwise(
        F.when(F.col("is_unique_a"), F.col("name_b")).otherwise(F.col("name_a"))
    )
    severity = F.when(alike & ~both, "error").otherwise("warning")
    return _finding(pairs, "indexes/duplicate", severity, F.concat_ws(",", "name_a", "name_b"), F.coalesce(F.concat(F.lit("drop "), drop), F.lit("both back constraints")))


def duplicate_index_classes(indexes: DataFrame) -> DataFrame:
    """One finding per index that another of its class makes superfluous; as many rows as indexes, however many are alike.

    The class keeps a unique index before others, then one that backs a constraint, then the first. Every other member
    forms a pair with it; the severity and the advice are those of that pair in ``duplicate_indexes``.
    """
    same = [*TABLE, "columns", "index_type", "include_columns", "predicate"]
    rows = indexes.where("not is_primary").select(*TABLE, "name", "pos", "columns", "index_type", "include_columns", F.coalesce("predicate", F.lit("")).alias("predicate"), "is_unique", "backs_constraint")
    best = F.max_by(F.struct("name", "pos", "is_unique", "backs_constraint"), F.struct("is_unique", "backs_constraint", -F.col("pos"), "name"))
    kept = rows.groupBy(*same).agg(best.alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = rows.join(kept, same).where("name <> keep.name or pos <> keep.pos")
    alike = F.col("is_unique") == F.col("keep.is_unique")
    both = F.col("backs_constraint") & F.col("keep.backs_constraint")
    message = F.when(alike & both, "both back constraints").otherwise(F.concat(F.lit("drop "), "name"))
    return _finding(pairs, "indexes/duplicate", F.when(alike & ~both, "error").otherwise("warning"), F.concat_ws(",", "name", "keep.name"), message)


def redundant_index_classes(indexes: DataFrame) -> DataFrame:
    """One finding per redundant index: the cover with the fewest columns (then by name), and how many there are.

    Every index hands its proper prefixes to an aggregate by prefix, combined before the shuffle: linear in indexes
    times columns, with no join of indexes that share a first column.
    """
    rows = indexes.where("index_type = 'btree' and predicate is null and not is_primary").select(*TABLE, "name", "columns", "is_unique")
    sizes = F.when(F.size("columns") > 1, F.sequence(F.lit(1), F.size("columns") - 1))
    prefixes = rows.withColumn("n", F.explode(sizes)).select(*TABLE, F.slice("columns", F.lit(1), F.col("n")).alias("columns"), F.struct(F.size("columns").alias("size"), "name").alias("cover"))
    covers = prefixes.groupBy(*TABLE, "columns").agg(F.min("cover").alias("cover"), F.count(F.lit(1)).alias("n"))
    out = rows.where("not is_unique").join(covers, [*TABLE, "columns"])
    return _finding(out, "indexes/redundant", "warning", F.concat_ws(",", "name", "cover.name"), F.concat(F.lit("covered by "), F.col("n").cast("string")))


def redundant_indexes(indexes: DataFrame) -> DataFrame:
    """Plain non-unique B-trees whose columns begin another plain B-tree's."""
    rows = indexes.where("index_type = 'btree' and predicate is null").select(*TABLE, "name", "columns", F.get("columns", F.lit(0)).alias("c0"), "is_unique", "is_primary")
    a = rows.where("not is_unique and not is_primary").withColumnsRenamed({"name": "short", "columns": "cs"}).drop("is_unique", "is_primary")
    b = rows.where("not is_primary").withColumnsRenamed({"name": "long", "columns": "cl"}).drop("is_unique", "is_primary")
    pairs = a.join(b, [*TABLE, "c0"]).where((F.size("cs") < F.size("cl")) & (F.slice("cl", F.lit(1), F.size("cs")) == F.col("cs")))
    return _finding(pairs, "indexes/redundant", "warning", F.concat_ws(",", "short", "long"), "covered by a longer index")


def too_many_indexes(indexes: DataFrame, most: int = 10) -> DataFrame:
    rows = indexes.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return _finding(rows, "indexes/too_many", "info", F.lit(None).cast("string"), F.concat(F.col("n").cast("string"), F.lit(" indexes")))


def wide_columns(indexes: DataFrame, columns: DataFrame) -> DataFrame:
    keys = indexes.select(*TABLE, "name", F.explode("columns").alias("column_name")).join(columns.select(*TABLE, "column_name", "type_name"), [*TABLE, "column_name"])
    wide = keys.where(F.col("type_name").rlike(f"^(?:{'|'.join(WIDE)})"))
    rows = wide.groupBy(*TABLE, "name").agg(F.array_join(F.array_sort(F.collect_set("column_name")), ",").alias("wide"))
    return _finding(rows, "indexes/wide_columns", "warning", F.col("name"), F.col("wide"))


def bloated(indexes: DataFrame, columns: DataFrame, stat_index: DataFrame, threshold: float = 1.5) -> DataFrame:
    rows = index_bloat(indexes, columns, stat_index).where(F.col("ratio") > threshold)
    return _finding(rows, "indexes/bloated", "warning", F.col("name"), F.format_string("%.2f times the expected pages", "ratio"))


def fk_edges(constraints: DataFrame) -> DataFrame:
    """(K, a, b): distinct edges from referencing to referenced table, as schema.table."""
    return constraints.where("kind = 'foreign_key' and fk_table is not null").select(*K, F.concat_ws(".", "table_schema", "table_name").alias("a"), F.col("fk_table").alias("b")).distinct()


def fk_type_mismatch(constraints: DataFrame, columns: DataFrame) -> DataFrame:
    pairs = F.explode(F.arrays_zip(F.col("columns").alias("c"), F.col("fk_columns").alias("r"))).alias("z")
    rows = constraints.where("kind = 'foreign_key'").select(*TABLE, "name", "fk_table", pairs).select(*TABLE, "name", "fk_table", F.col("z.c").alias("column_name"), F.col("z.r").alias("ref"))
    own = columns.select(*TABLE, "column_name", F.col("type_name").alias("own_type"))
    other = columns.select(*K, F.concat_ws(".", "table_schema", "table_name").alias("fk_table"), F.col("column_name").alias("ref"), F.col("type_name").alias("ref_type"))
    out = rows.join(own, [*TABLE, "column_name"]).join(other, [*K, "fk_table", "ref"]).where(canonical_type(F.col("own_type")) != canonical_type(F.col("ref_type")))
    return _finding(out, "fk/type_mismatch", "error", F.col("column_name"), F.concat_ws(" references ", "own_type", "ref_type"))


def fk_cycles(edges: DataFrame, max_len: int = 10) -> DataFrame:
    """Every elementary cycle of at most ``max_len`` tables once, as (K, path) from its smallest table."""
    return elementary_cycles(edges, max_len)


def fk_orphans(tables: DataFrame, edges: DataFrame) -> DataFrame:
    name = F.concat_ws(".", "table_schema", "table_name")
    ends = edges.select(*K, F.explode(F.array("a", "b")).alias("n")).distinct()
    rows = tables.withColumn("n", name).join(ends, [*K, "n"], "left_anti")
    return _finding(rows, "fk/orphan", "info", F.lit(None).cast("string"), "no foreign key in or out")


def non_sequential_pk(constraints: DataFrame, columns: DataFrame) -> DataFrame:
    keys = constraints.where("kind = 'primary_key'").select(*TABLE, F.explode("columns").alias("column_name"))
    rows = keys.join(columns.select(*TABLE, "column_name", "type_name"), [*TABLE, "column_name"]).where(F.lower("type_name").contains("uuid"))
    return _finding(rows, "pk/non_sequential", "info", F.col("column_name"), "random primary key")


def bool_prefix(columns: DataFrame) -> DataFrame:
    rows = columns.where(F.lower("type_name").isin("boolean", "bool") & ~F.col("column_name").rlike(BOOL_PREFIXES))
    return _finding(rows, "naming/bool_prefix", "info", F.col("column_name"), "boolean without a telling prefix")


def reserved_names(tables: DataFrame, columns: DataFrame) -> DataFrame:
    t = tables.where(F.lower("table_name").isin(*RESERVED))
    c = columns.where(F.lower("column_name").isin(*RESERVED))
    return _finding(t, "naming/reserved", "error", F.lit(None).cast("string"), "reserved word").unionByName(_finding(c, "naming/reserved", "error", F.col("column_name"), "reserved word"))


def id_mismatch(constraints: DataFrame) -> DataFrame:
    one = constraints.where("kind = 'foreign_key' and size(columns) = 1 and fk_table is not null")
    rows = one.groupBy(*K, "fk_table").agg(F.array_sort(F.collect_set(F.get("columns", F.lit(0)))).alias("names")).where(F.size("names") > 1)
    rows = rows.withColumns({"table_schema": F.substring_index("fk_table", ".", 1), "table_name": F.substring_index("fk_table", ".", -1)})
    return _finding(rows, "naming/id_mismatch", "warning", F.lit(None).cast("string"), F.array_join("names", ","))


def no_comment(tables: DataFrame, columns: DataFrame, least: int = 5) -> DataFrame:
    bare = F.transform(F.array_sort(F.collect_list(F.when(F.col("comment").isNull(), F.struct("ordinal", "column_name")))), lambda x: x["column_name"])
    per = columns.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("n"), bare.alias("bare")).where(F.col("n") >= least)
    t = tables.select(*TABLE, "comment").join(per.select(*TABLE), TABLE, "left_semi").where("comment is null")
    some = per.where(F.size("bare") > 0)
    names = F.when(F.size("bare") <= 5, F.array_join("bare", ", ")).otherwise(F.concat(F.array_join(F.slice("bare", 1, 3), ", "), F.lit(", "), (F.size("bare") - 3).cast("string"), F.lit(" more")))
    return _finding(t, "docs/no_comment", "info", F.lit(None).cast("string"), "no table comment").unionByName(_finding(some, "docs/no_comment", "info", F.size("bare").cast("string"), names))


def large_table_defaults(tables: DataFrame, stats: DataFrame, least: float = 1_000_000) -> DataFrame:
    rows = tables.where(~F.exists("reloptions", lambda x: x.startswith("autovacuum_"))).select(*TABLE).join(stats.where(F.col("reltuples") >= least).select(*TABLE, "reltuples"), TABLE)
    t = tuned(F.col("reltuples"))
    return _finding(rows, "vacuum/large_table_defaults", "info", F.lit(None).cast("string"), F.concat_ws("/", *[v.cast("string") for v in t.values()]))


def audit(cat: dict[str, DataFrame], disabled: Sequence[str] = (), max_len: int = 10, classes: bool = False) -> DataFrame:
    """All audits that are not disabled, as one frame; with ``classes``, alike indexes by representative instead of all pairs."""
    t, c, k, i = cat["table"], cat["column"], cat["constraint"], cat["index"]
    edges = fk_edges(k)

    def circular() -> DataFrame:
        rows = fk_cycles(edges, max_len).withColumns({"table_schema": F.substring_index(F.get("path", F.lit(0)), ".", 1), "table_name": F.substring_index(F.get("path", F.lit(0)), ".", -1)})
        return _finding(rows, "fk/circular", "warning", F.lit(None).cast("string"), F.array_join("path", " -> "))

    parts = {
        "indexes/duplicate": lambda: (duplicate_index_classes if classes else duplicate_indexes)(i),
        "indexes/redundant": lambda: (redundant_index_classes if classes else redundant_indexes)(i), "indexes/too_many": lambda: too_many_indexes(i),
        "indexes/wide_columns": lambda: wide_columns(i, c), "indexes/bloated": lambda: bloated(i, c, cat["stat_index"]), "fk/type_mismatch": lambda: fk_type_mismatch(k, c),
        "fk/circular": circular, "fk/orphan": lambda: fk_orphans(t, edges), "pk/non_sequential": lambda: non_sequential_pk(k, c), "naming/bool_prefix": lambda: bool_prefix(c),
        "naming/reserved": lambda: reserved_names(t, c), "naming/id_mismatch": lambda: id_mismatch(k), "docs/no_comment": lambda: no_comment(t, c),
        "vacuum/large_table_defaults": lambda: large_table_defaults(t, cat["stat_table"]),
    }
    out = None
    for rule, make in parts.items():
        if rule not in disabled:
            out = make() if out is None else out.unionByName(make())
    return out


def lint_schema(lint_findings: DataFrame, audit_findings: DataFrame, scope: str = "all", schema: str | None = None, table: str | None = None) -> DataFrame:
    """Conventions and audits under one roof, narrowed to a schema or table."""
    cols = [*TABLE, "rule", "severity", "message"]
    out = lint_findings.select(*cols).withColumn("scope", F.lit("conventions")).unionByName(audit_findings.select(*cols).withColumn("scope", F.lit("audit")))
    out = out if scope == "all" else out.where(F.col("scope") == scope)
    for c, v in (("table_schema", schema), ("table_name", table)):
        out = out if v is None else out.where(F.col(c) == v)
    return out
