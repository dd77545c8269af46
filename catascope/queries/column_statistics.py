"""Queries of column statistics and profiles over the fact tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catascope.adapters import table
from catascope.operators import colstats as C
from catascope.operators.colsketch import StoredStatistics
from catascope.sources.scratch import shared_folder

QUERIES, ORACLES = {}, {}
COLUMNS = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_extendedprice", "l_linenumber", "tax", "note"]


def _lines(s, d):
    """lineitem with a nullable column and a physical position."""
    return table(s, d, "lineitem").withColumns({"tax": F.when(F.col("l_tax") > 0.02, F.col("l_tax")), "pos": F.col("l_orderkey") * 8 + F.col("l_linenumber"), "note": F.concat(F.lit("n"), F.col("l_partkey").cast("string"))})


def _sql_column(c: str) -> str:
    num = "CAST(NULL AS DOUBLE)" if c in ("l_returnflag", "l_linestatus", "note") else f"CAST({c} AS DOUBLE)"
    return f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v, {num} AS num, CAST(pos AS DOUBLE) AS pos FROM l"


CUTS = ", ".join(str(i / 10) for i in range(11))
STATS = f"""WITH l AS (SELECT *, CASE WHEN l_tax > 0.02 THEN l_tax END AS tax, l_orderkey * 8 + l_linenumber AS pos, 'n' || l_partkey AS note FROM lineitem),
u AS ({" UNION ALL ".join(map(_sql_column, COLUMNS))}),
c AS (SELECT column_name, v, num, count(*) AS cnt FROM u GROUP BY ALL),
w AS (SELECT column_name, sum(cnt) AS reltuples, sum(cnt) FILTER (v IS NOT NULL) AS n, count(*) FILTER (v IS NOT NULL) AS d FROM c GROUP BY 1),
r AS (SELECT *, sum(cnt) OVER (PARTITION BY column_name ORDER BY num, v ROWS UNBOUNDED PRECEDING) AS r,
 row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, num, v) AS place FROM c WHERE v IS NOT NULL),
x AS (SELECT u.*, r.r, r.place FROM u JOIN r ON u.column_name = r.column_name AND u.v = r.v),
s AS (SELECT column_name, corr(CAST(r AS DOUBLE), pos) AS correlation,
 quantile_cont(num, [{CUTS}]) FILTER (place > 10) AS bounds, list(v ORDER BY v) FILTER (place > 10 AND num IS NULL) AS vs FROM x GROUP BY 1),
t AS (SELECT r.column_name, list(v ORDER BY place) AS mcv, list(cnt / reltuples ORDER BY place) AS mcf FROM r JOIN w USING (column_name) WHERE place <= 10 GROUP BY 1),
stat AS (SELECT w.column_name, CAST(reltuples AS BIGINT) AS reltuples, (reltuples - n) / reltuples AS null_frac,
 CASE WHEN d > 0.1 * reltuples THEN -d / reltuples ELSE CAST(d AS DOUBLE) END AS n_distinct, mcv, mcf, bounds, vs, round(correlation, 6) AS correlation
 FROM w JOIN s USING (column_name) JOIN t USING (column_name))"""


def c1(s, d):
    return C.compute_column_stats(_lines(s, d), COLUMNS, "pos").select(
        "column_name", "reltuples", "null_frac", "n_distinct", F.array_join("mcv", ",").alias("mcv"),
        F.array_join(F.transform("mcf", lambda x: C.fixed_text(x, 6)), ",").alias("mcf"),
        F.element_at("bounds", 1).alias("b0"), F.element_at("bounds", 6).alias("b5"), F.element_at("bounds", 11).alias("b10"), F.round("correlation", 6).alias("correlation"),
        F.concat_ws(" ", *[F.element_at("text_bounds", i) for i in (1, 6, 11)]).alias("texts"),
    )


def _profile(s, d):
    types = F.when(F.col("column_name").isin("l_returnflag", "l_linestatus"), "text").otherwise("double precision")
    stats = C.compute_column_stats(_lines(s, d), COLUMNS, "pos")
    return C.profile_columns(stats.select("column_name", types.alias("type_name")), stats, ["column_name"])


def c11(s, d):
    return _profile(s, d).withColumn("top", F.array_join(F.transform("top", lambda x: F.concat_ws("=", x["value"], C.fixed_text(x["pct"], 4))), ","))


def c12(s, d):
    return C.not_null_precheck(_lines(s, d), ["tax", "l_quantity", "l_shipdate"])


def c12_estimate(s, d):
    return C.not_null_estimate(C.compute_column_stats(_lines(s, d), COLUMNS, "pos")).select("column_name", "estimated_nulls")


def c1_approximate(s, d):
    return C.compute_column_stats(_lines(s, d), COLUMNS, "pos", approximate=True).select("column_name", "reltuples", "null_frac")


def c1_sketches(s, d):
    """Statistics of ``lineitem`` from stored sketches of seven parts, one of them added twice; what sketches keep exactly."""
    store = StoredStatistics(s, shared_folder(s, "sketches"))
    lines = _lines(s, d)
    for part in (1, 2, 3, 4, 5, 6, 7, 2):
        store.add(f"line-{part}", lines.where(F.col("l_linenumber") == part), COLUMNS, "pos")
    few = F.col("column_name").isin("l_returnflag", "l_linestatus", "l_linenumber")
    return store.stats(top=8).select(
        "column_name", "reltuples", "null_frac", F.get("bounds", F.lit(0)).alias("least"), F.get("bounds", F.lit(10)).alias("greatest"),
        F.when(few, F.array_join(F.array_sort(F.transform(F.arrays_zip("mcv", "mcf"), lambda x: F.concat(x["mcv"], F.lit(":"), F.round(x["mcf"] * F.col("reltuples")).cast("long").cast("string")))), ",")).alias("common"),
    )


QUERIES |= {"c1_stored_sketches": c1_sketches}
ORACLES |= {
    "c1_stored_sketches": f"{STATS}, e AS (SELECT column_name, min(num) AS least, max(num) AS greatest FROM u WHERE v IS NOT NULL GROUP BY 1), k AS (SELECT column_name, string_agg(v || ':' || cnt, ',' ORDER BY v || ':' || cnt) AS common FROM c WHERE column_name IN ('l_returnflag', 'l_linestatus', 'l_linenumber') GROUP BY 1) SELECT column_name, reltuples, null_frac, least, greatest, common FROM stat LEFT JOIN e USING (column_name) LEFT JOIN k USING (column_name)",
}
QUERIES |= {"c1_column_stats": c1, "c1_column_stats_approximate": c1_approximate, "c2_c11_profile_columns": c11, "c12_not_null_precheck": c12, "c12_not_null_estimate": c12_estimate}
ORACLES |= {
    "c1_column_stats": f"{STATS} SELECT column_name, reltuples, null_frac, n_distinct, array_to_string(mcv, ',') AS mcv, array_to_string(list_transform(mcf, lambda x: printf('%.6f', x)), ',') AS mcf, bounds[1] AS b0, bounds[6] AS b5, bounds[11] AS b10, correlation, concat_ws(' ', vs[1], vs[1 + CAST(floor((len(vs) - 1) * 0.5) AS INT)], vs[len(vs)]) AS texts FROM stat",
    "c1_column_stats_approximate": f"{STATS} SELECT column_name, reltuples, null_frac FROM stat",
    "c12_not_null_precheck": "SELECT * FROM (SELECT 'tax' AS column_name, count(*) FILTER (NOT (l_tax > 0.02)) AS n_nulls, count(*) FILTER (NOT (l_tax > 0.02)) > 0 AS blocked FROM lineitem UNION ALL SELECT 'l_quantity', count(*) FILTER (l_quantity IS NULL), count(*) FILTER (l_quantity IS NULL) > 0 FROM lineitem UNION ALL SELECT 'l_shipdate', count(*) FILTER (l_shipdate IS NULL), count(*) FILTER (l_shipdate IS NULL) > 0 FROM lineitem)",
    "c12_not_null_estimate": f"{STATS} SELECT column_name, CAST(round(null_frac * reltuples) AS BIGINT) AS estimated_nulls FROM stat",
    "c2_c11_profile_columns": f"""{STATS}, q AS (SELECT *, list_min(mcf) AS lo, list_max(mcf) AS hi, CASE WHEN n_distinct < 0 THEN round(-n_distinct * reltuples) ELSE n_distinct END / reltuples AS share,
 column_name IN ('l_returnflag', 'l_linestatus') AS is_text FROM stat)
 SELECT column_name, CASE WHEN null_frac <= 0 THEN 0.0 ELSE null_frac * 100 END AS null_pct, CAST(CASE WHEN null_frac <= 0 THEN 0 ELSE round(null_frac * reltuples) END AS BIGINT) AS null_rows,
 CASE WHEN n_distinct = 1 THEN 'constant' WHEN n_distinct = -1 OR share >= .95 THEN 'unique' WHEN share >= .5 THEN 'high' WHEN share >= .1 THEN 'medium' WHEN share >= .01 THEN 'low' ELSE 'very low' END AS cardinality,
 CASE WHEN lo <= 0 THEN 'uniform' WHEN hi / lo > 3 AND hi > .5 THEN 'heavily skewed' WHEN hi / lo > 2 THEN 'skewed' ELSE 'uniform' END AS distribution,
 CASE WHEN abs(correlation) > .99 THEN 'perfectly ordered' WHEN abs(correlation) > .9 THEN 'well ordered' WHEN abs(correlation) > .5 THEN 'partially ordered' WHEN correlation IS NOT NULL THEN 'random' END AS physical_order,
 bounds[1] AS low, bounds[11] AS high, array_to_string(list_transform(list_zip(mcv, mcf)[1:5], lambda x: x[1] || '=' || printf('%.4f', x[2] * 100)), ',') AS top,
 CASE WHEN n_distinct > 0 AND n_distinct <= 10 AND is_text THEN 'few distinct texts: an enum would fit' WHEN null_frac > .8 THEN 'mostly null: consider a partial index' WHEN abs(correlation) < .3 AND reltuples > 100000 THEN 'unordered: a BRIN index would not help' END AS note,
 CASE WHEN n_distinct = 0 THEN .5 WHEN n_distinct > 0 THEN 1 / n_distinct ELSE 1 / greatest(1.0, -n_distinct * reltuples) END AS selectivity,
 list_filter(list_zip(mcv, mcf), lambda x: x[2] > .3)[1][1] AS dominant FROM q""",
}
