"""op10: balanced sharding of the whole documents table into 24 shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catascope.llm.common import table
from catascope.llm.sharding import shard


def op10_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op10_balanced_sharding": op10_balanced_sharding}
ORACLES: dict[str, str] = {}
