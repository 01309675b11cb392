"""Queries that fit and score models on the ``embeddings`` table; ``tests/test_models.py`` holds the operators against plain versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import evaluation as ev
from millrace.operators import models as mo
from millrace.operators import sampling as sa
from millrace.operators.ranges import scratch, stored
from millrace.plans.common import table


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("label"))


def _split(spark, d):
    e = sa.stratified_split(mo.with_features(_vectors(spark, d), None, "embedding"), "label", "vec_id")
    return e.where("split = 'train'"), e.where("split = 'test'")


def knn_score(spark, d):
    e = _vectors(spark, d)
    return mo.knn_score(e, e.where("label = '0'")).select("vec_id", F.round("score", 6).alias("score"))


def mahalanobis_score(spark, d):
    e = _vectors(spark, d)
    return mo.mahalanobis(e, e.where("label = '0'")).select("vec_id", F.round("score", 6).alias("score"))


def pca_scores(spark, d):
    e = _vectors(spark, d)
    return mo.pca_scores(e, e.where("label = '0'"), 8).select("vec_id", F.transform("components", lambda x: F.round(x, 6)).alias("components"))


def novelty_report(spark, d):
    """Detectors fitted to benign training rows alone, on 32 components; how well each ranks the attacks of the test rows."""
    e = sa.stratified_split(_vectors(spark, d), "label", "vec_id", 999)
    benign, test = (F.col("label") == "0") & (F.col("split") == "train"), F.col("split") == "test"
    parts = stored(mo.pca_scores(e.where(benign | test), e.where(benign)).join(e.select("vec_id", "label", "split"), "vec_id"))
    rows, known = parts.where(test), parts.where(benign)
    scores = [mo.knn_score(rows, known, vector="components").withColumn("detector", F.lit("knn")), mo.mahalanobis(rows, known, vector="components").withColumn("detector", F.lit("mahalanobis"))]
    both = scores[0].unionByName(scores[1]).join(rows.select("vec_id", (F.col("label") != "0").cast("int").alias("label")), "vec_id")
    return ev.ranking_metrics(both, ["detector"]).select("detector", F.round("average_precision", 6).alias("auc_pr"), F.round("roc_auc", 6).alias("auc_roc"))


def rf_report(spark, d):
    train, test = _split(spark, d)
    return mo.evaluate(mo.fit(train, "rf"), test)


def logreg_report(spark, d):
    train, test = _split(spark, d)
    return mo.evaluate(mo.fit(train, "logreg"), test)


def kshot_report(spark, d):
    """A logistic head on k rows of each class, on one fixed test set."""
    train, test = _split(spark, d)
    return mo.evaluate(mo.fit(sa.k_shot(train, "label", "vec_id", 5), "logreg"), test, "union")


def kshot_grid(spark, d):
    """The same for k of 1, 5, 10, 50 and 100 and five repeats each: mean and deviation of macro-F1."""
    train, test = (stored(x) for x in _split(spark, d))
    runs = mo.k_shot_grid(train, test, scratch(spark, "runs"))
    return runs.groupBy("k").agg(F.count(F.lit(1)).alias("n_runs"), F.avg("macro_f1").alias("mean"), F.stddev_samp("macro_f1").alias("std"))


def transfer_matrix(spark, d):
    train, test = _split(spark, d)
    halves = {n: (train.where(f"vec_id % 2 = {i}"), test.where(f"vec_id % 2 = {i}")) for i, n in enumerate(("even", "odd"))}
    return mo.transfer_matrix(halves, "logreg")


_KNN = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (
  SELECT q.vec_id, list_distance(q.v, r.v) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, r.v)) AS rn FROM e q, e r WHERE r.label = 0)
SELECT vec_id, round(avg(d), 6) AS score FROM d WHERE rn <= 5 GROUP BY vec_id"""
QUERIES = {"knn_score": (knn_score, _KNN)} | {f.__name__: (f, None) for f in (mahalanobis_score, pca_scores, novelty_report, rf_report, logreg_report, kshot_report, kshot_grid, transfer_matrix)}
