"""Column statistics from sketches that are stored per part of a table and merged: new data does not reread old.

Per part and column: counts, a HyperLogLog of the values, a KLL summary of the numbers, one of the texts by their first
bytes, the most frequent values, and the moments of value and position. Each is a bounded number of bytes.

Errors: distinct values about 1.6 % (one standard deviation, 2^12 registers), ranks of bounds about 1 %, frequencies at
most n / ``TRACKED`` below or above the true ones for a part. Text bounds are the first ``PREFIX`` bytes of values. The
correlation is that of the values themselves, not of their ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catascope.operators.colstats import _unpivot, signed_distinct
from catascope.sources.manifest import Manifest

#: Items that the summary of frequent values follows; a power of two times 0.75 at most.
TRACKED = 6000
REGISTERS, KLL_K = 12, 400
#: Bytes of a text that its bounds show: six fit a double exactly.
PREFIX = 6


def _as_number(text: Column) -> Column:
    """The first bytes of a text as a number that orders like them."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "utf-8"), 1, PREFIX)), 2 * PREFIX, "0"), 16, 10).cast("double")


def _as_text(number: Column) -> Column:
    """The readable part of those bytes; a character that was cut in two goes."""
    raw = F.unhex(F.lpad(F.hex(number.cast("long")), 2 * PREFIX, "0"))
    return F.regexp_replace(F.decode(raw, "utf-8"), "[\\x00�]+$", "")


def sketch_columns(df: DataFrame, columns: Sequence[str], position: str) -> DataFrame:
    """One row per column; partial sketches are made where the rows are, only those are shuffled."""
    rows = _unpivot(df, columns, position).withColumn("prefix", F.when(F.col("num").isNull(), _as_number(F.col("v"))))
    both = F.col("num").isNotNull() & F.col("pos").isNotNull()
    x, p = F.when(both, F.col("num")), F.when(both, F.col("pos"))
    return rows.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("known"), F.hll_sketch_agg("v", REGISTERS).alias("hll"), F.kll_sketch_agg_double("num", F.lit(KLL_K)).alias("kll"),
        F.kll_sketch_agg_double("prefix", F.lit(KLL_K)).alias("text_kll"), F.expr(f"approx_top_k_accumulate(v, {TRACKED})").alias("frequent"),
        F.count(x).alias("m"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(p).alias("sp"), F.sum(p * p).alias("spp"), F.sum(x * p).alias("sxp"),
    )


def merge_sketches(parts: DataFrame, fan_in: int = 256) -> DataFrame:
    """One row per column from any number of parts: in groups of about ``fan_in`` first, so no task holds all of them."""
    sums = ("n", "known", "m", "sx", "sxx", "sp", "spp", "sxp")

    def together(rows: DataFrame, *by: str) -> DataFrame:
        # KLL summaries merge two by two; a group's list is bounded by its number of parts
        join = lambda c: F.reduce(F.slice(c, F.lit(2), F.greatest(F.size(c), F.lit(1))), F.get(c, F.lit(0)), lambda a, b: F.kll_sketch_merge_double(a, b))
        merged = rows.groupBy(*by).agg(
            *[F.sum(c).alias(c) for c in sums], F.hll_union_agg("hll").alias("hll"), F.collect_list("kll").alias("klls"), F.collect_list("text_kll").alias("text_klls"),
            F.expr("approx_top_k_combine(frequent)").alias("frequent"),
        )
        return merged.withColumns({"kll": join("klls"), "text_kll": join("text_klls")}).drop("klls", "text_klls")

    dealt = parts.withColumn("of", F.pmod(F.xxhash64("kll", "hll", "n"), F.lit(fan_in)))
    return together(together(dealt, "column_name", "of"), "column_name").drop("of")


def stats_from_sketches(merged: DataFrame, top: int = 10, bins: int = 10) -> DataFrame:
    """The columns of ``compute_column_stats``; most common are values seen more than once."""
    n, m = F.col("n"), F.col("m").cast("double")
    spread = lambda x, xx: m * F.col(xx) - F.col(x) * F.col(x)
    both = F.sqrt(F.greatest(spread("sx", "sxx"), F.lit(0.0))) * F.sqrt(F.greatest(spread("sp", "spp"), F.lit(0.0)))
    cuts = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    rows = merged.withColumn("top", F.expr(f"approx_top_k_estimate(frequent, {top})")).withColumn("top", F.filter("top", lambda x: x["item"].isNotNull()))
    some = lambda c, x: F.when(F.kll_sketch_get_n_double(c) > 0, x)
    return rows.select(
        "column_name", n.alias("reltuples"), ((n - F.col("known")) / n).alias("null_frac"), signed_distinct(F.hll_sketch_estimate("hll"), n).alias("n_distinct"),
        F.transform("top", lambda x: x["item"]).alias("mcv"), F.transform("top", lambda x: x["count"] / n).alias("mcf"),
        some("kll", F.kll_sketch_get_quantile_double("kll", cuts)).alias("bounds"), some("text_kll", F.transform(F.kll_sketch_get_quantile_double("text_kll", cuts), _as_text)).alias("text_bounds"),
        F.when(both > 0, (m * F.col("sxp") - F.col("sx") * F.col("sp")) / both).alias("correlation"),
    )


class StoredStatistics:
    """Sketches of a growing table under ``path``, one set per named part; adding a part again replaces it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, Manifest(spark, path)

    def add(self, name: str, df: DataFrame, columns: Sequence[str], position: str) -> None:
        folder = self.table.folder("part")
        sketch_columns(df, columns, position).write.parquet(f"{self.table.path}/{folder}")
        version, content = self.table.read()
        self.table.commit(version + 1, {"parts": content["parts"] | {name: {"folder": folder}}})

    def drop(self, name: str) -> None:
        version, content = self.table.read()
        self.table.commit(version + 1, {"parts": {k: p for k, p in content["parts"].items() if k != name}})

    def stats(self, top: int = 10, bins: int = 10) -> DataFrame:
        parts = self.table.read()[1]["parts"]
        if not parts:
            raise ValueError("no part has been added")
        return stats_from_sketches(merge_sketches(self.spark.read.parquet(*[f"{self.table.path}/{p['folder']}" for p in parts.values()])), top, bins)
