"""Suffix-array dedup on awkward tables: one anchor in very many contexts, crowded anchors, repeated and null ids, long texts."""

import random

import pytest
from test_operators import brute_removed

SCHEMA = "doc_id long, text string"


def report(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def brute(rows_, span=50):
    """``brute_removed`` for rows whose doc_id may repeat or be null (larger than all)."""
    import hashlib

    key = lambda d: 1 << 62 if d is None else d
    least = {}
    for d, t in rows_:
        b = (t or "").encode()
        for i in range(len(b) - span + 1):
            s = b[i : i + span]
            least[s] = min(least.get(s, 1 << 63), key(d))
    out = []
    for d, t in rows_:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if least[b[i : i + span]] < key(d):
                gone[i : i + span] = b"\1" * span
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d is None, d or 0, len(b), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowd", [2, 100_000])
def test_awkward_rows(spark, crowd):
    from catascope.llm.suffix_dedup import dedup_report

    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared, other = text(400), text(300)
    rows_ = [(1, shared), (1, shared), (1, other + "x"), (2, shared), (None, shared + "z" * 60), (None, other), (None, other), (3, None), (4, ""), (5, "short"), (6, "short")]
    rows_ += [(7, "a" * 500), (8, "a" * 120), (9, text(30) + shared[100:149] + text(30)), (10, text(30) + shared[100:150] + text(9)), (11, shared[:200] + text(40) + other)]
    docs = spark.createDataFrame(rows_, SCHEMA).repartition(3)
    assert report(dedup_report(docs, crowd=crowd, batch_bytes=700, group_bytes=2000)) == brute(rows_)


def test_kept_bytes(spark):
    from catascope.llm.suffix_dedup import dedup_report

    shared = "0123456789" * 8
    docs = spark.createDataFrame([(1, shared), (2, "ab" + shared + "é")], SCHEMA)
    assert {r["doc_id"]: bytes(r["kept"]) for r in dedup_report(docs, with_text=True).collect()} == {1: shared.encode(), 2: "abé".encode()}


def test_one_anchor_in_many_contexts(spark):
    """A phrase of 60 bytes in 100,000 documents that share nothing else."""
    from pyspark.sql import functions as F

    from catascope.llm.suffix_dedup import dedup_report

    phrase = "the quick brown foxes jump over 13 lazy dogs, as they say it"
    n = 100_000
    own = lambda k: F.sha2(F.concat(F.col("id").cast("string"), F.lit(k)), 256)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(own("a"), F.lit(phrase), own("b")).alias("text"))
    got = dedup_report(docs).agg(F.count(F.lit(1)), F.min(F.when(F.col("doc_id") > 0, F.col("n_removed"))), F.max("n_removed"), F.sum(F.when(F.col("doc_id") == 0, F.col("n_removed")))).first()
    # letters around the phrase may agree by chance, as hexadecimal digits do
    assert got[0] == n and got[1] >= 60 and got[2] < 90 and got[3] == 0


def test_long_text(spark):
    """A text over several stretches of positions, with a far repetition in another document."""
    from catascope.llm.suffix_dedup import POSITION, dedup_report

    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range((1 << POSITION) + 5000))
    cut = (1 << POSITION) - 80
    docs = spark.createDataFrame([(1, long), (2, "#" + long[cut : cut + 200] + "#" + long[10:59])], SCHEMA)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in dedup_report(docs).collect()}
    assert got == {1: (len(long), 0, 0), 2: (251, 200, 1)}


def test_brute_force_agrees():
    assert brute_removed([(0, "x" * 60), (1, "x" * 60)])[1][:3] == (60, 60, 1)


def test_anchors_work_in_short_stretches():
    """Anchors of long bytes hold little beside what they return, and equal strings have equal anchors across stretches."""
    import tracemalloc

    import numpy as np
    from catascope.llm.suffix_dedup import anchors

    part = np.random.default_rng(5).integers(97, 123, 1 << 20).astype(np.uint8)
    data = np.concatenate([part, part[12_345:]])
    anchors(part[:1000], np.array([1000]), 50)
    tracemalloc.start()
    h, first, last, row = anchors(data, np.array([len(part), len(data)]), 50)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 * len(data)
    of = lambda r: dict(x for a, b, k in zip(first[row == r], last[row == r], h[row == r]) for x in ((i, k) for i in range(a, b + 1)))
    one, two = of(0), of(1)
    assert len(one) == len(part) - 49 and all(two[i - 12_345 + len(part)] == one[i] for i in range(12_345, len(part) - 49))
