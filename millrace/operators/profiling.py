"""Counts, ratios, pivots and distribution distances over flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.flow import finite, relative_error, unidirectional_rows
from millrace.operators.ranges import exact_quantiles, running_sums, stored


def flow_counts(flows: DataFrame, tools: list[str], reference: str) -> DataFrame:
    """Flows of each capture by tool, and their ratio to the reference tool, or to the first present one; null where absent."""
    wide = flows.groupBy("capture").pivot("tool", tools).count()
    base = F.coalesce(F.col(reference), *[F.col(t) for t in tools])
    return wide.select("capture", *[F.col(t) for t in tools], *[(F.col(t) / base).alias(f"ratio_{t}") for t in tools])


def class_matrix(flows: DataFrame, tools: list[str], order: list[str]) -> DataFrame:
    """Flows of each class by tool, 0 where missing; known classes first, in order, then others."""
    wide = flows.groupBy("label").pivot("tool", tools).count().na.fill(0, tools)
    known = flows.sparkSession.createDataFrame([(c, i) for i, c in enumerate(order)], "label string, place int")
    full = known.join(wide, "label", "full_outer").na.fill(0, tools)
    return full.select("label", *tools, F.coalesce("place", F.lit(len(order))).alias("place")).orderBy("place", "label")


def expected_vs_observed(flows: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (label, expected) beside observed counts and their ratio to 3 digits."""
    seen = flows.groupBy("label").agg(F.count(F.lit(1)).alias("observed"))
    out = expected.join(seen, "label", "left").na.fill(0, ["observed"])
    return out.select("label", "expected", "observed", F.round(F.col("observed") / F.nullif(F.col("expected"), F.lit(0)), 3).alias("ratio"))


def timeout_sensitivity(counts: DataFrame, timeouts: list[int]) -> DataFrame:
    """Mean flows by tool and measure (rows) and timeout (columns) of (tool, day, timeout, measure, n)."""
    return counts.groupBy("tool", "measure").pivot("timeout", timeouts).agg(F.avg("n"))


def directionality(flows: DataFrame) -> DataFrame:
    """A10, P25: flows, one-way equivalent, its ratio, and the share of flows without packets back."""
    two_way = F.col("pkts_bwd")
    out = flows.groupBy("tool").agg(F.count(F.lit(1)).alias("n_bi"), F.sum(unidirectional_rows(two_way)).alias("n_uni"), F.count_if(F.coalesce(two_way, F.lit(0)) == 0).alias("n_one_way"))
    return out.select("tool", "n_bi", "n_uni", (F.col("n_uni") / F.col("n_bi")).alias("ratio"), (F.col("n_one_way") / F.col("n_bi")).alias("one_way_share"))


def ablation_delta(runs: DataFrame, baseline: DataFrame, score: str = "macro_f1") -> DataFrame:
    """Per ablation, task and split: runs, mean and median of score minus the baseline's."""
    keys = ["tool", "model", "task", "split", "seed"]
    joined = runs.join(baseline.select(*keys, F.col(score).alias("_base")), keys).withColumn("delta", F.col(score) - F.col("_base"))
    return joined.groupBy("ablation", "task", "split").agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean_delta"), F.median("delta").alias("median_delta"))


def ks_statistic(values: DataFrame, group: list[str], value: str = "value", side: str = "side") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of ``side`` a and b by group; null where one side has no finite value.

    Values are counted, then summed over sorted ranges, so a group is not one task.
    """
    clean = values.withColumn(value, finite(F.col(value).cast("double"))).where(F.col(value).isNotNull())
    counts = clean.groupBy(*group, value).agg(F.count_if(F.col(side) == "a").alias("na"), F.count_if(F.col(side) == "b").alias("nb"))
    runs = running_sums(counts, group, [value], ["na", "nb"])
    gap = F.abs(F.col("run_na") / F.nullif("all_na", F.lit(0)) - F.col("run_nb") / F.nullif("all_nb", F.lit(0)))
    return runs.groupBy(*group).agg(F.max(gap).alias("ks"))


def feature_divergence(pairs: DataFrame, features: list[str]) -> DataFrame:
    """For matched pairs with a_x and b_x of each feature: pairs, median and mean error, share within 5 %, KS distance."""
    long = pairs.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"a_{f}").cast("double").alias("a"), F.col(f"b_{f}").cast("double").alias("b")) for f in features])).alias("r")).select("r.*")
    ok = stored(long.withColumn("err", relative_error(F.col("a"), F.col("b"))).where("err IS NOT NULL"))
    stats = ok.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("err")).alias("mean_abs_err"), F.avg((F.abs("err") < 0.05).cast("double")).alias("within_5"))
    middle = exact_quantiles(ok, ["feature"], "err", [0.5]).select("feature", F.col("quantiles")[0].alias("median_err"))
    sides = ok.select("feature", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("value")), F.struct(F.lit("b").alias("side"), F.col("b").alias("value")))).alias("v")).select("feature", "v.*")
    return stats.join(middle, "feature").join(ks_statistic(sides, ["feature"]), "feature").select("feature", "n", "median_err", "mean_abs_err", "within_5", "ks")


def generalisation_gap(runs: DataFrame) -> DataFrame:
    """Mean of (score within the training set's data - score across) by direction and model; NaN counts as missing."""
    s = F.nanvl("score", F.lit(None).cast("double"))
    best = runs.groupBy("model", "source", "target", "seed").agg(F.max(F.when(F.col("kind") == "in", s)).alias("inside"), F.max(F.when(F.col("kind") == "cross", s)).alias("across"))
    return best.groupBy("model", "source", "target").agg(F.avg(F.col("inside") - F.col("across")).alias("collapse"))


def transfer_summary(cells: DataFrame) -> DataFrame:
    """Mean score on the diagonal (source = target), off it, and the drop."""
    same = F.col("source") == F.col("target")
    out = cells.agg(F.avg(F.when(same, F.col("score"))).alias("diagonal"), F.avg(F.when(~same, F.col("score"))).alias("off_diagonal"))
    return out.withColumn("drop", F.col("diagonal") - F.col("off_diagonal"))


def recall_pivot(per_class: DataFrame, classes: list[str]) -> DataFrame:
    """Mean recall by tool (rows) and class (columns)."""
    return per_class.groupBy("tool").pivot("class", classes).agg(F.avg("recall"))
