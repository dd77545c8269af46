"""Counts of shingles that order the keys: added up in the tasks, the same as of all memberships."""

from collections import Counter

import numpy as np

from catascope.llm.near_copies import entries, shingle_counts, shingle_set, words_of


def test_counts_are_those_of_all_texts(spark):
    texts = [f"w{i % 7} a b c d e w{i}" for i in range(60)] + ["", None, "one two"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    expected = Counter(k for t in texts for k in shingle_set(words_of(t), 5).tolist())
    for batch_keys in (1, 50, 1 << 19):
        assert {r["key"]: r["n"] for r in shingle_counts(docs, 5, batch_keys).collect()} == expected
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))
    rows = entries(docs, 5, 80, none, batch_keys=2).collect()
    assert len({(r["key"], r["node"]) for r in rows}) == len(rows) and {r["key"] for r in rows} <= set(expected)
    assert len({r["node"] for r in rows}) == 61
