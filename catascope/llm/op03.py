"""op3: SimHash components of the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catascope.llm.common import table
from catascope.llm.simhash import near_duplicates


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_neardup": op3_simhash_neardup}
ORACLES: dict[str, str] = {}
