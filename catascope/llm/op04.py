"""op4: best-fit packing of the whole documents table into 2048-token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catascope.llm.common import table
from catascope.llm.packing import pack


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLES: dict[str, str] = {}
