"""Index classes, range partitions with typed bounds, parents without partitions, type aliases, version intervals."""

import random
import time

import pytest
from pyspark.sql import functions as F

from catascope.functions.names import canonical_type
from catascope.operators import audit, diff, lint

K = ("p", "d", "h")
KEY = "project_id string, database_id string, schema_hash string"
TABLE = f"{KEY}, table_schema string, table_name string"


def ranges(spark, spans, **kw):
    tables = spark.createDataFrame([(*K, "s", "t", "range")], f"{TABLE}, partition_strategy string")
    kids = spark.createDataFrame([(*K, "s", "t", "s", f"t{i}", f"FOR VALUES FROM ('{a}') TO ('{b}')") for i, (a, b) in enumerate(spans)], f"{KEY}, parent_schema string, parent_name string, child_schema string, child_name string, bound string")
    none = spark.createDataFrame([], f"{KEY}, name string, setting string")
    found = lint.partition_rules(tables, kids, none, lint.LintConfig(disabled=("partition/no_default",), **kw))
    return sorted(r["message"] for r in found.collect())


@pytest.mark.parametrize(
    ("spans", "typed", "text"),
    [
        ([(1, 5), (5, 10), (10, 20)], [], ["20 -> 5", "5 -> 10"]),
        ([(1, 5), (6, 10), (8, 30), (12, 13)], ["gap: 5 -> 6", "overlap: 10 -> 8", "overlap: 30 -> 12"], None),
        ([("2024-01-01", "2024-02-01"), ("2024-02-01 00:00:00", "2024-03-01"), ("2024-04-01", "2024-05-01")], ["gap: 2024-03-01 -> 2024-04-01"], None),
        ([("a", "c"), ("c", "k"), ("m", "z"), ("1", "9")], ["gap: 9 -> a", "gap: k -> m"], ["9 -> a", "k -> m"]),
        ([(1, 5), (1, 5)], ["overlap: 5 -> 1"], ["5 -> 1"]),
        ([], [], []),
    ],
)
def test_range_breaks(spark, spans, typed, text):
    assert ranges(spark, spans, typed_bounds=True) == typed
    if text is not None:
        assert ranges(spark, spans) == text


def test_parents_without_partitions(spark):
    tables = spark.createDataFrame([(*K, "s", "t", "list")], f"{TABLE}, partition_strategy string")
    kids = spark.createDataFrame([], f"{KEY}, parent_schema string, parent_name string, child_schema string, child_name string, bound string")
    settings = spark.createDataFrame([(*K, "enable_partitionwise_join", "off")], f"{KEY}, name string, setting string")
    found = {r["rule"] for r in lint.partition_rules(tables, kids, settings, lint.LintConfig()).collect()}
    assert found == {"partition/no_default", "partition/gucs"}


INDEX = f"{TABLE}, name string, pos int, columns array<string>, index_type string, include_columns array<string>, predicate string, is_unique boolean, is_primary boolean, backs_constraint boolean"


def index(name, columns, pos=0, unique=False, backs=False, kind="btree", predicate=None, primary=False):
    return (*K, "s", "t", name, pos, list(columns), kind, [], predicate, unique, primary, backs)


def test_index_classes_agree_with_all_pairs(spark):
    r = random.Random(2)
    rows = [index(f"i{i}", r.sample("abc", r.randrange(1, 4)), i, r.random() < 0.3, r.random() < 0.3, r.choice(["btree"] * 4 + ["gin"]), r.choice([None] * 4 + ["x > 0"]), r.random() < 0.1) for i in range(60)]
    df = spark.createDataFrame(rows, INDEX)
    pairs = {r["object"] for r in audit.redundant_indexes(df).collect()}
    classes = audit.redundant_index_classes(df).collect()
    assert {x["object"] for x in classes} <= pairs and {p.split(",")[0] for p in pairs} == {x["object"].split(",")[0] for x in classes}
    assert sum(int(x["message"].split()[-1]) for x in classes) == len(pairs)
    alike = {frozenset(x["object"].split(",")): (x["severity"], x["message"]) for x in audit.duplicate_indexes(df).collect()}
    kept = audit.duplicate_index_classes(df).collect()
    assert kept and all(alike[frozenset(x["object"].split(","))] == (x["severity"], x["message"]) for x in kept)
    joined = {n for p in alike for n in p}
    keepers = {x["object"].split(",")[1] for x in kept}
    assert joined == keepers | {x["object"].split(",")[0] for x in kept} and len(kept) == len(joined) - len(keepers)


def test_ten_thousand_indexes_on_one_leading_column(spark):
    df = spark.range(10_000).select(*[F.lit(x).alias(c) for x, c in zip((*K, "s", "t"), "project_id database_id schema_hash table_schema table_name".split(), strict=True)], F.concat(F.lit("i"), "id").alias("name"), F.col("id").cast("int").alias("pos"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.col("id").cast("string"))).alias("columns"), F.lit("btree").alias("index_type"), F.array().cast("array<string>").alias("include_columns"),
        F.lit(None).cast("string").alias("predicate"), F.lit(False).alias("is_unique"), F.lit(False).alias("is_primary"), F.lit(False).alias("backs_constraint"))
    began = time.time()
    assert audit.redundant_index_classes(df).where("message = 'covered by 5000'").count() == 5000
    assert audit.duplicate_index_classes(df).count() == 4999
    assert time.time() - began < 60


def test_only_the_eight_aliases_are_folded(spark):
    same = lambda a, b: spark.range(1).select((canonical_type(F.lit(a)) == canonical_type(F.lit(b))).alias("x")).first()["x"]
    assert same("int8", "bigint") and same("INT", "integer") and same("timestamptz", "timestamp with time zone")
    assert not same("varchar", "character varying") and not same("decimal", "numeric")


def test_intervals_of_versions_that_come_back(spark):
    versions = spark.createDataFrame([("p", "d", h, t) for t, h in enumerate("ABAC")] + [("p", "e", "A", 0)], "project_id string, database_id string, content_hash string, captured_at int")
    rows = [("A", "x", 1), ("A", "y", 1), ("B", "x", 1), ("B", "y", None), ("C", "y", 1)]
    rows = spark.createDataFrame([("p", s, h, n, v) for s in "de" for h, n, v in rows], f"{KEY}, name string, v int")
    timeline = diff.Timeline.of(versions)
    spans = diff.intervals(rows, timeline, ["name"], ["v"])
    got = sorted((r["name"], r["start"], r["stop"], r["body"]["v"]) for r in spans.where("database_id = 'd'").collect())
    assert got == [("x", 1, 4, 1), ("y", 1, 2, 1), ("y", 2, 3, None), ("y", 3, 5, 1)]
    assert {r["name"] for r in diff.version_at(spans, 4).collect()} == {"y"}
    changes = sorted((r["from_hash"], r["to_hash"], r["object"], r["change"]) for r in diff.diff_objects(rows, timeline, "thing", ["name"], ["v"]).collect())
    assert changes == [("A", "B", "y", "modified"), ("A", "C", "x", "removed"), ("B", "A", "y", "modified")]
    pairwise = diff.diff_objects(rows, diff.consecutive_pairs(versions), "thing", ["name"], ["v"])
    assert sorted((r["from_hash"], r["to_hash"], r["object"], r["change"]) for r in pairwise.collect()) == changes
