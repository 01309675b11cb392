"""Stored sketches against exact quantiles and counts."""

from pyspark.sql import functions as F

from millrace.operators import sketches as sk


def test_merged_sketches_are_near_the_exact_ones(spark, tmp_path):
    """Two captures sketched apart, stored, merged; ranks within the stated error, nulls, NaN and infinities left out."""
    rows = spark.range(60_000).select(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("capture"), (F.col("id") % 7_000).alias("seed"), F.when(F.col("id") % 11 == 0, float("nan")).when(F.col("id") % 13 == 0, None).when(F.col("id") % 17 == 0, float("inf")).otherwise(F.pow(F.pmod(F.hash("id"), F.lit(1000)), F.lit(2.0))).alias("x"))
    for c in ("c0", "c1", "c2"):
        sk.sketched(rows.where(F.col("capture") == c), ["capture"], ["x"], ["seed"]).write.mode("append").parquet(str(tmp_path / "s"))
    ranks = [0.01, 0.25, 0.5, 0.9, 0.99]
    whole = sk.merged(spark.read.parquet(str(tmp_path / "s")), []).select("n_rows", sk.quantiles("q_x", ranks).alias("q"), sk.distinct_count("d_seed").alias("d")).first()
    xs = sorted(r.x for r in rows.where("x IS NOT NULL AND NOT isnan(x) AND x < 1e300").select("x").collect())
    assert whole.n_rows == 60_000 and abs(whole.d / 7_000 - 1) < 0.05
    for rank, value in zip(ranks, whole.q, strict=True):
        below, upto = sum(x < value for x in xs) / len(xs), sum(x <= value for x in xs) / len(xs)
        assert below - 0.014 <= rank <= upto + 0.014


def test_groups_without_values(spark):
    rows = spark.createDataFrame([("a", None, None), ("b", 2.0, "s"), ("b", float("nan"), None)], "g string, x double, s string")
    got = {r.g: (r.q, r.d) for r in sk.sketched(rows, ["g"], ["x"], ["s"]).select("g", sk.quantiles("q_x", [0.5]).alias("q"), sk.distinct_count("d_s").alias("d")).collect()}
    assert got == {"a": (None, 0), "b": ([2.0], 1)}
    assert sk.sketched(rows.limit(0), ["g"], ["x"]).count() == 0
