"""Stored sketches against exact statistics: whole, merged from parts, and after a part is replaced or dropped."""

import random

import pytest
from pyspark.sql import functions as F

from catascope.operators.colsketch import StoredStatistics, merge_sketches, sketch_columns, stats_from_sketches
from catascope.operators.colstats import compute_column_stats

COLUMNS = ["num", "skewed", "word", "nothing", "day"]


def data(spark, rows):
    return spark.createDataFrame(rows, "pos int, num double, skewed int, word string, nothing string").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("pos") % 400))


def rows(seed, n, first=0):
    r = random.Random(seed)
    return [(first + i, r.gauss(0, 1), min(int(r.expovariate(0.5)), 30), r.choice("abcdefgh") * r.randrange(1, 4) + str(r.randrange(2000)) if r.random() < 0.9 else None, None) for i in range(n)]


def by_column(df):
    return {r["column_name"]: r for r in df.collect()}


def check(got, exact, values):
    for c in COLUMNS:
        g, e = got[c], exact[c]
        assert g["reltuples"] == e["reltuples"] and g["null_frac"] == pytest.approx(e["null_frac"])
        size = lambda x: abs(x["n_distinct"]) * (x["reltuples"] if x["n_distinct"] < 0 else 1)
        assert size(g) == pytest.approx(size(e), rel=0.06, abs=1), c
    for v, f in zip(exact["skewed"]["mcv"], exact["skewed"]["mcf"]):
        assert dict(zip(got["skewed"]["mcv"], got["skewed"]["mcf"]))[v] == pytest.approx(f, abs=0.002)
    xs = sorted(values)
    for i, b in enumerate(got["num"]["bounds"]):
        rank = sum(x <= b for x in xs) / len(xs)
        assert abs(rank - i / 10) < 0.02
    assert got["nothing"]["bounds"] is None and got["nothing"]["text_bounds"] is None and got["nothing"]["mcv"] == []


def test_whole_and_merged(spark):
    parts = [rows(k, 3000, 3000 * k) for k in range(4)]
    whole = sum(parts, [])
    exact = by_column(compute_column_stats(data(spark, whole), COLUMNS, "pos"))
    values = [x[1] for x in whole]
    check(by_column(stats_from_sketches(sketch_columns(data(spark, whole), COLUMNS, "pos"))), exact, values)
    sketches = sketch_columns(data(spark, parts[0]), COLUMNS, "pos")
    for p in parts[1:]:
        sketches = sketches.unionByName(sketch_columns(data(spark, p), COLUMNS, "pos"))
    got = by_column(stats_from_sketches(merge_sketches(sketches, 2)))
    check(got, exact, values)
    words = sorted(x[3] for x in whole if x[3] is not None)
    for i, b in enumerate(got["word"]["text_bounds"]):
        at = sum(w[:6] <= b for w in words) / len(words)
        assert abs(at - i / 10) < 0.03, (i, b)


def test_stored_parts(spark, tmp_path):
    store = StoredStatistics(spark, str(tmp_path))
    with pytest.raises(ValueError):
        store.stats()
    for name, seed in (("a", 1), ("b", 2), ("b", 3)):
        store.add(name, data(spark, rows(seed, 500)), COLUMNS, "pos")
    both = by_column(store.stats())
    assert both["num"]["reltuples"] == 1000
    want = by_column(compute_column_stats(data(spark, rows(1, 500) + rows(3, 500)), COLUMNS, "pos"))
    assert both["word"]["null_frac"] == pytest.approx(want["word"]["null_frac"])
    store.drop("a")
    assert by_column(store.stats())["num"]["reltuples"] == 500
