"""Column statistics of data tables and the profiles drawn from them.

``compute_column_stats`` unpivots the asked columns and aggregates once per (column, value); everything
else works on those counts: distinct values, most common values, histogram bounds over the rest, and the
correlation of value rank with a physical position that the caller names. The exact mode ranks the distinct
values in ranges that are written once, so a column of very many values is ranked by many tasks; the approximate mode keeps only mergeable sketches (HyperLogLog, quantile summaries)
and needs one pass without a shuffle of values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catascope.sources.scratch import shared_folder

TEXT_TYPES = ("text", "varchar", "character varying")


def _unpivot(df: DataFrame, columns: Sequence[str], position: str) -> DataFrame:
    """(column_name, v, num, pos): the value as text, and as a number where its type orders so."""
    kinds = dict(df.dtypes)

    def number(c: str) -> Column:
        if kinds[c] in ("timestamp", "timestamp_ntz", "date"):
            return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
        return F.lit(None).cast("double") if kinds[c] == "string" else F.col(c).cast("double")

    each = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"), number(c).alias("num")) for c in columns]
    return df.select(F.explode(F.array(*each)).alias("x"), F.col(position).cast("double").alias("pos")).select("x.*", "pos")


def signed_distinct(distinct: Column, rows: Column) -> Column:
    """Minus the fraction of rows when over a tenth of them are distinct, else the count."""
    return F.when(distinct > 0.1 * rows, -distinct / rows).otherwise(distinct.cast("double"))


def compute_column_stats(df: DataFrame, columns: Sequence[str], position: str, top: int = 10, bins: int = 10, approximate: bool = False) -> DataFrame:
    """(column_name, reltuples, null_frac, n_distinct, mcv, mcf, bounds, text_bounds, correlation) per column."""
    rows = _unpivot(df, columns, position)
    if approximate:
        cuts = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
        n, d = F.count(F.lit(1)), F.approx_count_distinct("v", 0.01)
        return rows.groupBy("column_name").agg(
            n.alias("reltuples"), (F.count_if(F.col("v").isNull()) / n).alias("null_frac"), signed_distinct(d, n).alias("n_distinct"),
            F.percentile_approx("num", cuts, 1000).alias("bounds"), F.corr("num", "pos").alias("correlation"),
        )
    counts = rows.groupBy("column_name", "v", "num").agg(F.count(F.lit(1)).alias("cnt"), F.sum("pos").alias("sp"), F.sum(F.col("pos") * F.col("pos")).alias("spp"))
    # values in ranges: no window and no list spans all distinct values of a column
    path = shared_folder(df.sparkSession, "value-counts")
    counts.repartitionByRange("column_name", "num", "v").withColumn("part", F.spark_partition_id()).write.parquet(path)
    counts = df.sparkSession.read.parquet(path)
    known = F.col("v").isNotNull()
    whole = counts.groupBy("column_name").agg(F.sum("cnt").alias("reltuples"), F.sum(F.when(known, F.col("cnt"))).alias("n"), F.count_if(known).alias("d"))
    values = counts.where(known)
    common = _most_common(values, top)
    # as many rows as columns times ``top``
    ranked = values.join(F.broadcast(common.select("column_name", "v", "place")), ["column_name", "v"], "left")
    ranked = _cumulated(ranked.withColumn("other", F.when(F.col("place").isNull(), F.col("cnt")).otherwise(0)), {"r": "cnt", "o": "other"})
    lists = F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "v", "cnt"))))
    r = F.col("r").cast("double")
    sums = ranked.groupBy("column_name").agg(
        lists.alias("top"),
        *[F.sum(e).alias(a) for a, e in {
            "m": F.col("cnt"), "sr": r * F.col("cnt"), "srr": r * r * F.col("cnt"), "srp": r * F.col("sp"), "p": F.col("sp"), "pp": F.col("spp"),
        }.items()],
    )
    spread = lambda n, x, xx: n * F.col(xx) - F.col(x) * F.col(x)
    m = F.col("m").cast("double")
    both = F.sqrt(F.greatest(spread(m, "sr", "srr"), F.lit(0.0))) * F.sqrt(F.greatest(spread(m, "p", "pp"), F.lit(0.0)))
    corr = F.when(both > 0, (m * F.col("srp") - F.col("sr") * F.col("p")) / both)
    n = F.col("reltuples")
    return whole.join(sums, "column_name", "left").join(_bounds(ranked, bins), "column_name", "left").select(
        "column_name", "reltuples", ((n - F.coalesce("n", F.lit(0))) / n).alias("null_frac"), signed_distinct(F.col("d"), n).alias("n_distinct"),
        F.transform("top", lambda x: x["v"]).alias("mcv"), F.transform("top", lambda x: x["cnt"] / n).alias("mcf"), "bounds", "text_bounds", corr.alias("correlation"),
    )


def _most_common(values: DataFrame, top: int) -> DataFrame:
    """The ``top`` values of each column, picked within the ranges first."""
    order = [F.col("cnt").desc(), "num", "v"]
    for by in (["column_name", "part"], ["column_name"]):
        values = values.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= top)
    return values


def _cumulated(values: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Running sums of columns over each column's values in order: inside the ranges, plus what the ranges before hold."""
    inside = Window.partitionBy("column_name", "part").orderBy("num", "v").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = values.groupBy("column_name", "part").agg(*[F.sum(c).alias(f"__{a}") for a, c in sums.items()])
    parts = parts.select("column_name", "part", *[F.coalesce(F.sum(f"__{a}").over(earlier), F.lit(0)).alias(f"__{a}") for a in sums])
    out = values.withColumns({a: F.sum(c).over(inside) for a, c in sums.items()}).join(parts, ["column_name", "part"])
    return out.withColumns({a: F.col(a) + F.col(f"__{a}") for a in sums}).drop(*[f"__{a}" for a in sums])


def _bounds(ranked: DataFrame, bins: int) -> DataFrame:
    """(column_name, bounds, text_bounds): equal-frequency bounds of the values that are not most common.

    Numbers are interpolated between the values beside a position; a column without numbers has the values themselves.
    """
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.struct(i.alias("i"), ((F.col("total") - 1) * (i / bins)).alias("at"))))
    cuts = ranked.groupBy("column_name").agg(F.max("o").alias("total")).where("total > 0").select("column_name", at.alias("c")).select("column_name", "c.i", "c.at")
    # as many rows as columns times ``bins``
    hit = ranked.where("other > 0").join(F.broadcast(cuts), "column_name")
    before, o = F.col("o") - F.col("other"), F.col("o")
    inside = lambda x: (before <= x) & (x < o)
    low, high = F.floor("at"), F.ceil("at")
    hit = hit.where(inside(low) | inside(high))
    pick = lambda x, c: F.max(F.when(inside(x), F.col(c)))
    each = hit.groupBy("column_name", "i", "at").agg(pick(low, "num").alias("a"), pick(high, "num").alias("b"), pick(low, "v").alias("v"))
    mixed = F.when(low == high, F.col("a")).otherwise((high - F.col("at")) * F.col("a") + (F.col("at") - low) * F.col("b"))
    listed = F.array_sort(F.collect_list(F.struct("i", mixed.alias("x"), "v")))
    out = each.groupBy("column_name").agg(listed.alias("l"))
    numbers = F.exists("l", lambda e: e["x"].isNotNull())
    return out.select("column_name", F.when(numbers, F.transform("l", lambda e: e["x"])).alias("bounds"), F.when(~numbers, F.transform("l", lambda e: e["v"])).alias("text_bounds"))


def profile_nulls(frac: Column, rows: Column) -> Column:
    return F.struct(F.when(frac <= 0, 0.0).otherwise(frac * 100).alias("null_pct"), F.when(frac <= 0, 0).otherwise(F.round(frac * rows)).cast("long").alias("null_rows"))


def distinct_count(n_distinct: Column, rows: Column) -> Column:
    return F.when(n_distinct < 0, F.round(-n_distinct * rows)).otherwise(n_distinct)


def profile_cardinality(n_distinct: Column, rows: Column) -> Column:
    share = F.when(rows > 0, distinct_count(n_distinct, rows) / rows).otherwise(0.0)
    steps = F.when(n_distinct.isNull(), "unknown").when(n_distinct == 1, "constant").when((n_distinct == -1) | (share >= 0.95), "unique")
    return steps.when(share >= 0.5, "high").when(share >= 0.1, "medium").when(share >= 0.01, "low").otherwise("very low")


def profile_distribution(mcf: Column) -> Column:
    low, high = F.array_min(mcf), F.array_max(mcf)
    ratio = F.when(low > 0, high / low)
    return (
        F.when(mcf.isNull() | (F.size(mcf) == 0) | (low <= 0), "uniform")
        .when((ratio > 3) & (high > 0.5), "heavily skewed").when(ratio > 2, "skewed").otherwise("uniform")
    )


def profile_order(correlation: Column) -> Column:
    a = F.abs(correlation)
    return F.when(a.isNotNull(), F.when(a > 0.99, "perfectly ordered").when(a > 0.9, "well ordered").when(a > 0.5, "partially ordered").otherwise("random"))


def profile_range(bounds: Column) -> Column:
    return F.when(F.size(bounds) >= 2, F.struct(F.element_at(bounds, 1).alias("low"), F.element_at(bounds, -1).alias("high")))


def top_values(mcv: Column, mcf: Column, limit: int = 5) -> Column:
    """First ``limit`` values whose frequency is known, with their percentage."""
    pairs = F.filter(F.arrays_zip(mcv.alias("v"), mcf.alias("f")), lambda x: x["f"].isNotNull())
    return F.transform(F.slice(pairs, 1, limit), lambda x: F.struct(x["v"].alias("value"), (x["f"] * 100).alias("pct")))


def profile_note(type_name: Column, n_distinct: Column, null_frac: Column, correlation: Column, rows: Column) -> Column:
    low = F.lower(type_name)
    text = low.isin(*TEXT_TYPES) | low.startswith("varchar") | low.startswith("character varying")
    return F.coalesce(
        F.when((n_distinct > 0) & (n_distinct <= 10) & text, "few distinct texts: an enum would fit"),
        F.when(null_frac > 0.8, "mostly null: consider a partial index"),
        F.when((F.abs(correlation) < 0.3) & (rows > 100_000), "unordered: a BRIN index would not help"),
    )


def equality_selectivity(n_distinct: Column, rows: Column) -> Column:
    """Share of rows that one value selects; a half when nothing is known."""
    return F.when(n_distinct.isNull() | (n_distinct == 0), 0.5).when(n_distinct > 0, 1 / n_distinct).otherwise(1 / F.greatest(F.lit(1.0), -n_distinct * rows))


def fixed_text(x: Column, places: int) -> Column:
    """A number from 0 on with so many decimals, rounded by its exact binary value as C and SQL engines do, a tie to even.

    Java's formats round the shortest decimal text instead: 1.5e-6 lies just below the tie, and they round it up. The
    product with the power of ten is split without error, so what its rounding lost decides where it seems a tie.
    """
    unit = float(10**places)
    p = x * unit
    high = x * 134217729.0 - (x * 134217729.0 - x)
    lost = (high * unit - p) + (x - high) * unit
    whole = F.floor(p)
    over = p - whole - 0.5
    up = (over > 0) | ((over == 0) & ((lost > 0) | ((lost == 0) & (whole % 2 == 1))))
    n = whole + up.cast("long")
    return F.format_string(f"%d.%0{places}d", F.floor(n / unit), n % 10**places)


def dominant_value(mcv: Column, mcf: Column, threshold: float) -> Column:
    return F.get(F.transform(F.filter(F.arrays_zip(mcv.alias("v"), mcf.alias("f")), lambda x: x["f"] > threshold), lambda x: x["v"]), F.lit(0))


def profile_columns(columns: DataFrame, stats: DataFrame, on: Sequence[str]) -> DataFrame:
    """A profile row per column that has statistics (``columns``: type_name; ``stats``: the planner's fields)."""
    c = F.col
    return columns.join(stats, list(on)).select(
        *on, profile_nulls(c("null_frac"), c("reltuples"))["null_pct"].alias("null_pct"), profile_nulls(c("null_frac"), c("reltuples"))["null_rows"].alias("null_rows"),
        profile_cardinality(c("n_distinct"), c("reltuples")).alias("cardinality"), profile_distribution(c("mcf")).alias("distribution"),
        profile_order(c("correlation")).alias("physical_order"), profile_range(c("bounds"))["low"].alias("low"), profile_range(c("bounds"))["high"].alias("high"),
        top_values(c("mcv"), c("mcf")).alias("top"), profile_note(c("type_name"), c("n_distinct"), c("null_frac"), c("correlation"), c("reltuples")).alias("note"),
        equality_selectivity(c("n_distinct"), c("reltuples")).alias("selectivity"), dominant_value(c("mcv"), c("mcf"), 0.3).alias("dominant"),
    )


def not_null_precheck(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact number of nulls per column that would block NOT NULL, in one aggregate."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_nulls")) for c in columns])
    return one.select(F.inline(each)).withColumn("blocked", F.col("n_nulls") > 0)


def not_null_estimate(stats: DataFrame) -> DataFrame:
    return stats.withColumn("estimated_nulls", F.round(F.col("null_frac") * F.col("reltuples")).cast("long"))
