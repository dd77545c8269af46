"""op13: a byte-level and a piece tokenizer aligned on every whole document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catascope.llm.alignment import alignment_report
from catascope.llm.common import table


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_report(table(spark, sf_dir, "documents"))


QUERIES = {"op13_tokenizer_alignment": op13_tokenizer_alignment}
ORACLES: dict[str, str] = {}
