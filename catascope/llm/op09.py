"""op9: personal data in every whole document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catascope.llm.common import table
from catascope.llm.pii import detect


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))


QUERIES = {"op9_pii": op9_pii}
ORACLES: dict[str, str] = {}
