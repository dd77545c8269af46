"""Shard sizes where most or all rows are linked, whatever the groups."""

import collections

import pytest
from test_operators import make


def texts(kind):
    if kind == "pairs":
        return [f"text number {i // 2} " * 3 for i in range(800)]
    if kind == "hot":  # a third one text, the rest in groups of 40
        return ["hot " * 10] * 300 + [f"group {i // 40} " * 4 for i in range(600)]
    return ["same"] * 500


@pytest.mark.parametrize("kind", ["pairs", "hot", "one"])
def test_sizes(spark, kind):
    from catascope.llm.sharding import shard

    docs = make(spark, texts(kind)).repartition(3)
    got = shard(docs, 6).collect()
    sizes, held = collections.Counter(), collections.defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        held[r["shard"]].append(r["slot"])
    assert len(got) == len(texts(kind)) and len(sizes) == 6
    assert max(sizes.values()) - min(sizes.values()) <= 3 * max(r["size"] for r in got)
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    if kind == "pairs":  # most pairs stay together
        where = collections.defaultdict(set)
        for r in got:
            where[r["doc_id"] // 2].add(r["shard"])
        assert sum(len(v) == 1 for v in where.values()) >= 0.9 * len(where)
