"""Classifier metrics as aggregates: confusion matrix, report, average precision, ROC area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranges import running_sums

UNSEEN = "<unseen>"


def confusion(rows: DataFrame, classes: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(truth, predicted, n) over all pairs of train classes (class) and ``<unseen>``; others count there."""
    known = F.broadcast(classes.select(F.col("class").cast("string").alias("class")).distinct())  # the labels of one model
    seen = rows.select(F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p"))
    seen = seen.join(known.withColumnRenamed("class", "_t"), F.col("t") == F.col("_t"), "left").join(known.withColumnRenamed("class", "_p"), F.col("p") == F.col("_p"), "left")
    counts = seen.groupBy(F.coalesce("_t", F.lit(UNSEEN)).alias("truth"), F.coalesce("_p", F.lit(UNSEEN)).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    every = classes.select(F.col("class").cast("string").alias("class")).distinct().union(classes.sparkSession.createDataFrame([(UNSEEN,)], "class string"))
    grid = every.select(F.col("class").alias("truth")).join(F.broadcast(every.select(F.col("class").alias("predicted"))), F.lit(True))
    return grid.join(counts, ["truth", "predicted"], "left").na.fill(0, ["n"])


def _div(a, b):
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class of a confusion matrix; 0 where undefined."""
    both = matrix.select(F.explode(F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))).alias("r")).select("r.*")
    sums = both.groupBy("class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    p, r = _div(F.col("hit"), F.col("predicted")), _div(F.col("hit"), F.col("support"))
    return sums.select("class", p.alias("precision"), r.alias("recall"), _div(2 * p * r, p + r).alias("f1"), "support", "predicted")


def summary(report: DataFrame, labels: str = "train") -> DataFrame:
    """Macro-F1 over train classes (``train``) or over classes that truth or prediction has (``union``), weighted F1, balanced accuracy."""
    counted = F.col("class") != UNSEEN if labels == "train" else (F.col("support") + F.col("predicted")) > 0
    return report.agg(F.avg(F.when(counted, F.col("f1"))).alias("macro_f1"), _div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))


def binary_rates(rows: DataFrame, truth: str = "truth", predicted: str = "predicted", positive: str = "ATTACK") -> DataFrame:
    """False positive rate, attack recall, attack precision."""
    t, p = F.col(truth) == positive, F.col(predicted) == positive
    n = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    return n.select(_div(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"), _div(F.col("tp"), F.col("tp") + F.col("fn")).alias("attack_recall"), _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("attack_precision"))


def ranking_metrics(scored: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Average precision (steps at distinct scores) and ROC area (ties count half) of label 1 by group.

    Rows are counted by score, then summed over sorted ranges, so a group is not one task. Rows without score come last.
    """
    counts = scored.groupBy(*group, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    up = running_sums(counts, group, [score], ["pos", "n"])
    runs = up.select(*group, "pos", "n", (F.col("all_pos") - F.col("run_pos") + F.col("pos")).alias("tp"), (F.col("all_n") - F.col("run_n") + F.col("n")).alias("k"), "all_pos", "all_n")
    neg_here, neg_above = F.col("n") - F.col("pos"), (F.col("k") - F.col("n")) - (F.col("tp") - F.col("pos"))
    below = (F.col("all_n") - F.col("all_pos")) - neg_above - neg_here
    return runs.groupBy(*group).agg(
        F.sum(F.col("pos") / F.nullif(F.col("all_pos"), F.lit(0)) * F.col("tp") / F.col("k")).alias("average_precision"),
        (F.sum(F.col("pos") * (below + neg_here / 2)) / F.nullif(F.max("all_pos") * (F.max("all_n") - F.max("all_pos")), F.lit(0))).alias("roc_auc"),
    )
