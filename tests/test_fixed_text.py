"""Fixed decimals: as C's printf, also at what seem to be ties."""

from pyspark.sql import functions as F

from catascope.operators.colstats import fixed_text


def test_fixed_text_rounds_the_binary_value(spark):
    values = [c / n for n in (600_000, 3_600_000, 36_000_000) for c in (*range(1, 200), 599_999)] + [0.0, 0.5, 1.0, 99.99995, 100.0, 1.5e-6, 0.00015, 0.999999999]
    pairs = [(v, f"{v:.6f}", f"{v * 100:.4f}") for v in values]
    rows = spark.createDataFrame(pairs, "v double, six string, four string").withColumns({"a": fixed_text(F.col("v"), 6), "b": fixed_text(F.col("v") * 100, 4), "java": F.format_string("%.6f", "v")})
    assert rows.where("a <> six or b <> four").collect() == []
    assert rows.where("java <> six").count() > 0
