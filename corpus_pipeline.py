"""Corpus preparation in five stages over the documents table.

Each stage works on all that its predecessor kept and is written as Parquet in the shared folder before
the next one reads it: quality rules (rejected documents go, failing lines are removed), near-dedup (of each
group linked by a verified similarity of 0.8 on five-word shingles, found by SimHash balls and by rare
shingles, one document stays), benchmark decontamination (contaminated documents go), PII (spans are
replaced by their kind) and best-fit packing (one row per piece and slot).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catascope.llm.common import stored, table
from catascope.llm.decontaminate import drop_contaminated
from catascope.llm.near_copies import keep_one
from catascope.llm.packing import pack
from catascope.llm.pii import redact
from catascope.llm.quality import clean_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: SQL has neither the fingerprints' components nor the tokenizer; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
