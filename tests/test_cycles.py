"""Components and elementary cycles of directed graphs against brute force."""

import random
import subprocess
import sys
from pathlib import Path

from catascope.operators.cycles import component_edges, elementary_cycles
from catascope.sources.scratch import Rounds

EDGE = "project_id string, database_id string, schema_hash string, a string, b string"


def brute_cycles(edges, most):
    out = {}
    for k, a, b in edges:
        out.setdefault((k, a), set()).update({b} - {None})
    found = set()

    def walk(k, path):
        for n in out.get((k, path[-1]), ()):
            if n == path[0]:
                found.add((k, tuple(path)))
            elif n > path[0] and n not in path and len(path) < most:
                walk(k, [*path, n])

    for k, a in list(out):
        walk(k, [a])
    return found


def graphs():
    r = random.Random(5)
    dense = [("dense", f"t{i:02d}", f"t{j:02d}") for i in range(12) for j in range(12) if r.random() < 0.3]
    sparse = [(f"g{g}", f"t{r.randrange(20)}", f"t{r.randrange(20)}") for g in range(20) for _ in range(24)]
    acyclic = [("dag", f"t{i:03d}", f"t{i + k:03d}") for i in range(60) for k in (1, 2, 7)]
    return dense + sparse + acyclic + sparse[:5] + [("nulls", "a", None)]


def test_cycles_of_dense_and_sparse_graphs(spark):
    edges = graphs()
    df = spark.createDataFrame([("p", k, "h", a, b) for k, a, b in edges], EDGE)
    got = [(r["database_id"], tuple(r["path"])) for r in elementary_cycles(df, 6).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_cycles(edges, 6)


def test_components_drop_what_lies_between_them(spark):
    rows = [("p", "d", "h", a, b) for a, b in ("ab", "ba", "bc", "cd", "dc", "ee", "xa")]
    kept = component_edges(spark.createDataFrame(rows, EDGE), Rounds(spark, "test"))
    assert sorted(r["a"] + r["b"] for r in kept.collect()) == ["ab", "ba", "cd", "dc", "ee"]


def test_no_edges(spark):
    assert elementary_cycles(spark.createDataFrame([], EDGE)).count() == 0


CHAIN = """
from pyspark.sql import SparkSession
from catascope.operators.cycles import elementary_cycles
s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false").getOrCreate()
rows = [("p", "d", "h", f"t{i:05d}", f"t{i + 1:05d}") for i in range(5000)] + [("p", "d", "h", "t03003", "t03000")]
found = elementary_cycles(s.createDataFrame(rows, "project_id string, database_id string, schema_hash string, a string, b string"))
print("found", [r["path"] for r in found.collect()], max(len(found._jdf.queryExecution().toString()) // 20000, 0))
"""


def test_chain_of_5000_tables_in_a_small_driver():
    root = Path(__file__).resolve().parent.parent
    run = subprocess.run([sys.executable, "-c", CHAIN], cwd=root, capture_output=True, text=True, timeout=400)
    assert "found [['t03000', 't03001', 't03002', 't03003']] 0" in run.stdout, run.stderr[-2000:]
