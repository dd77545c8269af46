"""Periodic runs against every period of every place."""

import hashlib
import random
import zlib

import numpy as np

from catascope.llm.periodic import periodic_runs, run_report, runs


def brute(w):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def words(r):
    kind, n = r.randrange(5), r.randrange(130)
    if kind == 0:
        return [r.randrange(2) for _ in range(n)]
    if kind == 1:  # repeated stretches of several lengths
        out = []
        while len(out) < n:
            out += [r.randrange(3) for _ in range(r.randrange(1, 20))] * r.randrange(1, 5)
        return out
    if kind == 2:  # Fibonacci words: many nested runs
        a, b = [0, 1], [0]
        for _ in range(r.randrange(3, 9)):
            a, b = a + b, a
        return a[:150]
    if kind == 3:  # progressions that meet out of step
        unit = [0, 1] if r.random() < 0.5 else [0, 0, 1]
        return sum(((unit * 40)[: r.randrange(5, 60)] for _ in range(3)), [])
    unit = [r.randrange(2) for _ in range(r.randrange(6, 40))]
    return unit * 2 + [r.randrange(2) for _ in range(5)] + unit[::-1] * 2


def test_runs_of_random_words():
    r = random.Random(7)
    for _ in range(2000):
        w = words(r)
        assert list(map(tuple, np.stack(runs(np.array([*w, -1])), 1).tolist())) == brute(w), w


def expected(doc_id, text, plant=True):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    top = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (len(found), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 6000").select("doc_id", "text").limit(120).collect()
    texts = [(r["doc_id"], r["text"]) for r in rows]
    texts += [(-1, None), (-2, ""), (-3, " \t\n"), (-4, "x " * 2000), (-5, "a b " * 9), (-6, "a b c d e f " * 2), (-6, "a b c d e f " * 2), (None, "one two " * 30)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, key string")
    got = sorted(repr((r["doc_id"], *tuple(r)[1:8])) for r in run_report(docs).collect())
    assert got == sorted(repr((i, *expected(i, t))) for i, t in texts)


def test_details_and_no_rows(spark):
    docs = spark.createDataFrame([(7, "start " + "a b c " * 6 + "end")], "doc_id long, text string")
    row = periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 18, 3)] and row["collapsed"] == "start a b c end" and row["n_dropped"] == 15
    assert periodic_runs(docs.where("false")).count() == 0
