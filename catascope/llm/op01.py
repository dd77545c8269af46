"""op1: token totals of the whole documents table through committed batches.

Batch 1 inserts every document with an estimate from its characters and batch 2 revises every document to
its exact token count; batch 2 is delivered a second time, which must change nothing. Batch 3 deletes the
documents whose doc_id is divisible by 50, the batches are compacted, and batch 4 inserts those documents
again, so the totals are those of the whole table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catascope.llm.common import shared_dir, table
from catascope.llm.token_counts import TokenLedger, count_tokens, deleted, inserted, revised
from catascope.llm.tokens import default_path

VERSION = "word_bpe_49k"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = TokenLedger(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    estimate = F.floor(F.coalesce(F.col("n_chars"), F.lit(0)) / 4)
    ledger.commit("1", inserted(docs.withColumn("tokenizer_version", F.lit(VERSION)).withColumn("estimate", estimate), "estimate"))
    exact = count_tokens(docs, default_path(), VERSION).withColumn("estimate", estimate)
    for _ in range(2):
        ledger.commit("2", revised(exact, "estimate", "n_tokens"))
    some = count_tokens(docs.where("doc_id % 50 = 0"), default_path(), VERSION)
    ledger.commit("3", deleted(some))
    ledger.compact()
    ledger.commit("4", inserted(some))
    return ledger.totals()


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLES: dict[str, str] = {}
