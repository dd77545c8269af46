"""One row stays of each group, whatever rows repeat."""

import random

SCHEMA = "doc_id long, text string, n_chars long"


def test_one_row_of_each_group(spark):
    from catascope.llm import near_copies, simhash

    rng = random.Random(11)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (1, a), (1, a), (None, b), (None, b), (2, b), (3, a), (3, c), (None, d), (None, d), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA).repartition(3)
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = sorted([(1, a), (2, b), (3, c), (None, d), (None, None)], key=order)
    for keep in (near_copies.keep_one, simhash.keep_one):
        assert sorted([(r["doc_id"], r["text"]) for r in keep(docs).collect()], key=order) == want
