"""op12: secrets in every whole document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catascope.llm.common import table
from catascope.llm.secret_scan import secret_report


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


QUERIES = {"op12_secret_scan": op12_secret_scan}
ORACLES: dict[str, str] = {}
