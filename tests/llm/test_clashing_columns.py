"""Stages and operators on documents whose extra columns are named like helpers."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from catascope.llm import alignment, periodic, secret_scan

NAMES = "__c __fold __digest __doc __h __kept __id __tk __b __n __r __node h label key node x n n_words words lines tk fp rank at block seed hits t piece length".split()


def test_pipeline_stages_keep_them(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(3))
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in NAMES if c not in docs.columns})
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in NAMES), name
    assert P.STAGES[-1][1](spark, docs, sf_dir).count() > 0


def test_operators_on_key_and_text_only(spark):
    docs = spark.createDataFrame([(1, "a b c " * 8 + "token=abcdefghijklmnop", *["y"] * len(NAMES))], ", ".join(["doc_id long, text string", *(f"{c} string" for c in NAMES)]))
    assert periodic.run_report(docs).first()["n_runs"] == 1
    assert secret_scan.secret_report(docs).first()["n_assign"] == 1
    assert alignment.alignment_report(docs).first()["n_links"] > 0
