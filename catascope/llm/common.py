"""Helpers shared by the training-data operators: reading, lineage cuts, row keys, word arrays."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in the quality and near-duplicate operators (space, tab to carriage return).
SPACES = r"[\x20\x09-\x0D]+"


def by_value(module: str) -> None:
    """Ship what tasks use of ``module`` with the task, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Spark's reader resolves the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, a fresh local one in local mode, else an error."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-"))
        at = sc.getCheckpointDir()
    return at


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: a lost executor does not recompute the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back (lineage cut, pruned reads)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` for one side of a join by sort and merge.

    Spark sizes rows that an explode makes, or that a compressed file unfolds to, by what they come from, and would gather
    them in the driver and send them to every task.
    """
    return df.hint("merge")


def apart(docs: DataFrame, helpers: Sequence[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step(docs)`` where columns of ``docs`` that are named like its ``helpers`` keep their names and values."""
    taken, names = {c.lower() for c in (*docs.columns, *helpers)}, {}
    for c in docs.columns:
        if c.lower() in helpers:
            names[c] = next(f"{c}_{i}" for i in range(len(taken) + 1) if f"{c}_{i}".lower() not in taken)
            taken.add(names[c].lower())
    return step(docs.withColumnsRenamed(names)).withColumnsRenamed({new: old for old, new in names.items()})


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session; deployments size it with the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also touch other letters)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text: Column) -> Column:
    """Array of the words between SPACES; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it.

    Higher-order functions are evaluated expression by expression, without elimination of common
    subexpressions; a one-element ``transform`` holds the value in its lambda variable.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def window_hashes(hashes: Column, width: int) -> Column:
    """Order-sensitive 64-bit hash of every run of ``width`` elements of an array of longs.

    Built by doubling (pairs, then pairs of pairs), so a width of w costs about 2 log2(w)
    array passes instead of w. Fewer than ``width`` elements give an empty array.
    """

    def join(a: Column, b: Column, shift: int) -> Column:
        n = F.greatest(F.least(F.size(a), F.size(b) - F.lit(shift)), F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + shift), n), lambda x, y: F.xxhash64(x, y))

    def grow(have: Column, power: int, out: Column | None, covered: int) -> Column:
        if width & power:
            if out is None:
                out, covered = have, power
            else:
                return bind(join(out, have, covered), lambda o: step(have, power, o, covered + power))
        return step(have, power, out, covered)

    def step(have: Column, power: int, out: Column | None, covered: int) -> Column:
        if covered == width:
            return out
        return bind(join(have, have, power), lambda h: grow(h, power * 2, out, covered))

    return bind(hashes, lambda h: grow(h, 1, None, 0))
