"""Training-data queries that SQL can express, against their SQL on DuckDB."""

import os

import duckdb
import pytest

from catascope import llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_sql(name, spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, r = llm.queries()[name](spark, sf_dir), c.sql(llm.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(r.columns)
    ours = sorted((tuple(x[k] for k in order) for x in df.collect()), key=repr)
    theirs = sorted((tuple(x[r.columns.index(k)] for k in order) for x in r.fetchall()), key=repr)
    assert len(ours) == len(theirs) and ours == theirs


def test_names():
    assert set(llm.oracle_sql()) <= set(llm.queries()) and os.path.basename(llm.__file__) == "__init__.py"


def test_decontamination_mixed_lengths(spark):
    """Items of 1 to 40 words against many documents and a long one, in several blocks, by the same SQL."""
    import random

    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(0, 200))) for i in range(150)] + [(150, text(30_000)), (None, text(50)), (151, None)]
    items = [(k, text(rng.randint(1, 40))) for k in range(30)] + [(30 + k, " ".join(docs[k][1].split()[3 : 5 + k])) for k in range(40)] + [(99, None)]
    c = duckdb.connect()
    c.sql("create table documents(doc_id bigint, text varchar)")
    c.sql("create table benchmark(item_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", docs)
    c.executemany("insert into benchmark values (?, ?)", items)
    from catascope.llm.decontaminate import decontaminate

    r = c.sql(llm.oracle_sql()["op8_decontamination"])
    df = decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), block_rows=600)
    assert sorted((tuple(x[k] for k in r.columns) for x in df.collect()), key=repr) == sorted(r.fetchall(), key=repr)
