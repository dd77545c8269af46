"""Validity intervals: dealt by the number of rows, and right where versions are left out or come again."""

from pyspark.sql import functions as F

from catascope.operators.diff import Timeline, intervals

STATES = {"a": "xxyy.xx", "b": "x.x.x.x", "c": ".......", "d": "xyxyxyx", "e": "......x", "f": "nnxnn.n"}


def _rows(spark, copies):
    rows = [(f"{k}{i}", seq, None if s == "n" else s) for k, states in STATES.items() for i in range(copies) for seq, s in enumerate(states, 1) if s != "."]
    each = spark.createDataFrame(rows, "name string, at int, value string").select(F.lit("p").alias("project_id"), F.lit("db").alias("database_id"), F.concat(F.lit("h"), "at").alias("schema_hash"), "name", "at", "value")
    return each, Timeline.of(each.select("project_id", "database_id", F.col("schema_hash").alias("content_hash"), F.col("at").alias("captured_at")).distinct())


def _expected(copies):
    out = set()
    for k, states in STATES.items():
        start = 0
        for at in range(1, len(states) + 1):
            if at == len(states) or states[at] != states[start]:
                if states[start] != ".":
                    out |= {(f"{k}{i}", start + 1, at + 1, None if states[start] == "n" else states[start]) for i in range(copies)}
                start = at
    return out


def test_intervals_of_gaps_and_returns(spark):
    rows, timeline = _rows(spark, 3)
    got = intervals(rows, timeline, ["name"], ["value"]).select("name", "start", "stop", "body.value").collect()
    assert {tuple(r) for r in got} == _expected(3) and len(got) == len(_expected(3))


def test_partitions_follow_the_rows(spark):
    rows, timeline = _rows(spark, 40)
    spans = intervals(rows, timeline, ["name"], ["value"], partition_rows=50)
    assert spans.rdd.getNumPartitions() >= rows.count() // 50 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {tuple(r) for r in spans.select("name", "start", "stop", "body.value").collect()} == _expected(40)
