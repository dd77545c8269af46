"""Working folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; where that is unset, a local one in local mode, else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Rounds:
    """Frames of an iterative job, each written once and read back, so that no plan refers to more than one round.

    Rounds compress far below their size in memory, and Spark broadcasts by file size. With ``few``, joins broadcast rounds
    of at most that many rows and merge larger ones.
    """

    def __init__(self, spark: SparkSession, name: str, few: int | None = None):
        self.spark, self.root, self.few = spark, shared_folder(spark, name), few

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.get(df.schema, name)

    def get(self, schema: StructType, *names: str) -> DataFrame:
        """The written rounds ``names`` together."""
        df = self.spark.read.schema(schema).parquet(*map(self.path, names))
        if self.few is None:
            return df
        return df.hint("broadcast" if df.count() <= self.few else "merge")  # the count reads file footers only

    def drop(self, *names: str) -> None:
        """Remove rounds that nothing reads any more."""
        for name in names:
            remove(self.spark, self.path(name))
