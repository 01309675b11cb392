"""Models and novelty scores against plain numpy versions."""

import hashlib
import math
from itertools import product

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from millrace.operators import models as mo
from millrace.operators import neighbours as nb
from millrace.operators import preprocessing as pp
from millrace.operators import sampling as sa

VECTORS = "vec_id long, embedding array<double>, label string"


@pytest.fixture(scope="module")
def points():
    """Three classes of different sizes in six dimensions, the first two of which tell them apart."""
    r = np.random.default_rng(4)
    y = np.repeat([0, 1, 2], [150, 60, 40])
    x = r.normal(size=(250, 6)) * [1, 1, 3, 0.5, 1, 2]
    x[:, :2] += np.array([[0, 0], [1.5, 1], [-1, 2]])[y]
    return x, y


@pytest.fixture(scope="module")
def vectors(spark, points):
    x, y = points
    return spark.createDataFrame([(i, v.tolist(), f"c{c}") for i, (v, c) in enumerate(zip(x, y, strict=True))], VECTORS).repartition(3).cache()


def test_nearest_neighbours_in_blocks(spark, vectors, points):
    """Several blocks on both sides, repeated and missing references."""
    x, y = points
    ref = x[y == 0]
    d = np.sort(np.sqrt(((x[:, None] - ref[None]) ** 2).sum(axis=2)), axis=1)
    got = {r.vec_id: r.score for r in mo.knn_score(vectors, vectors.where("label = 'c0'"), 7, block_rows=40).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(d[:, :7].mean(axis=1), rel=1e-9, abs=1e-9)
    few = mo.knn_score(vectors.limit(5), vectors.where("vec_id < 3"), 7).collect()
    assert len(few) == 5 and all(r.score == pytest.approx(np.sqrt(((x[r.vec_id] - x[:3]) ** 2).sum(axis=1)).mean()) for r in few)
    assert [r.score for r in mo.knn_score(vectors.limit(2), vectors.limit(0)).collect()] == [None, None]


def shrunk(x):
    """Ledoit and Wolf's estimate, by its definition."""
    n, d = x.shape
    c = x - x.mean(axis=0)
    s = c.T @ c / n
    mu = np.trace(s) / d
    delta = ((s - mu * np.eye(d)) ** 2).sum() / d
    beta = min(delta, sum(((np.outer(v, v) - s) ** 2).sum() / d for v in c) / n**2)
    return (beta / delta) * mu * np.eye(d) + (1 - beta / delta) * s


def test_mahalanobis_and_components(vectors, points):
    """M10, M11."""
    x, y = points
    ref = x[y == 0]
    c = x - ref.mean(axis=0)
    want = np.einsum("ij,jk,ik->i", c, np.linalg.inv(shrunk(ref)), c)
    got = {r.vec_id: r.score for r in mo.mahalanobis(vectors, vectors.where("label = 'c0'")).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(want, rel=1e-6)
    z = (ref - ref.mean(axis=0)) / ref.std(axis=0)
    basis = np.linalg.svd(z, full_matrices=False)[2][:3]
    want = np.abs(((x - ref.mean(axis=0)) / ref.std(axis=0)) @ basis.T)
    got = {r.vec_id: r.components for r in mo.pca_scores(vectors, vectors.where("label = 'c0'"), 3).collect()}
    assert np.abs([got[i] for i in range(len(x))]) == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_weighted_logistic_regression_reaches_the_optimum(vectors, points):
    """M4, M6: class weights, and probabilities of the weighted optimum by Newton's method."""
    x, y = points
    two = mo.with_features(vectors.where("label <> 'c2'"), None, "embedding")
    x, y = x[y < 2], y[y < 2]
    w = {(r.label, round(r.weight, 9)) for r in mo.balanced(two, "label").collect()}
    assert w == {("c0", round(210 / 300, 9)), ("c1", round(210 / 120, 9))}
    one, weight = np.column_stack([x, np.ones(len(x))]), np.where(y == 0, 210 / 300, 210 / 120)
    b = np.zeros(7)
    for _ in range(30):
        p = 1 / (1 + np.exp(-one @ b))
        b += np.linalg.solve((one * (weight * p * (1 - p))[:, None]).T @ one, one.T @ (weight * (y - p)))
    rows = mo.predict(mo.fit(two, "logreg"), two).collect()
    want = 1 / (1 + np.exp(-one @ b))
    assert [r.probability[1] for r in sorted(rows, key=lambda r: r.vec_id)] == pytest.approx(want, abs=1e-3)
    assert all(r.predicted == ("c1" if want[r.vec_id] > 0.5 else "c0") for r in rows if abs(want[r.vec_id] - 0.5) > 0.01)


def plain_f1(truth, predicted, classes):
    out = []
    for c in classes:
        tp = sum(t == p == c for t, p in zip(truth, predicted, strict=True))
        both = sum(t == c for t in truth) + sum(p == c for p in predicted)
        out.append(2 * tp / both if both else 0.0)
    return out


def test_summary_of_a_model(vectors):
    """Macro, weighted F1 and balanced accuracy of predictions, with a class that training never saw."""
    f = mo.with_features(vectors, None, "embedding")
    model = mo.fit(f.where("label <> 'c2'"), "logreg")
    rows = mo.predict(model, f).collect()
    truth, predicted = [r.truth for r in rows], [r.predicted for r in rows]
    each = plain_f1(truth, predicted, ["c0", "c1"])
    got = mo.evaluate(model, f).first()
    assert got.macro_f1 == pytest.approx(np.mean(each)) and got.weighted_f1 == pytest.approx((150 * each[0] + 60 * each[1]) / 250)
    recall = [np.mean([p == c for t, p in zip(truth, predicted, strict=True) if t == c]) for c in ("c0", "c1")]
    assert got.balanced_accuracy == pytest.approx(np.mean([*recall, 0.0]))


def circle(spark, n=600, seed=0):
    """A class inside of another: no line parts them."""
    r = np.random.default_rng(seed)
    x = r.uniform(-2, 2, size=(n, 3))
    y = (np.hypot(x[:, 0], x[:, 1]) < 1.2).astype(int)
    return mo.with_features(spark.createDataFrame([(i, v.tolist(), str(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], VECTORS), None, "embedding")


@pytest.mark.parametrize(("kind", "more"), [("rf", {"numTrees": 20, "maxDepth": 8}), ("gbt", {"maxIter": 15, "maxDepth": 4}), ("mlp", {})])
def test_models_learn_what_no_line_parts(spark, kind, more):
    """Held-out accuracy, and the informative features first."""
    model = mo.fit(circle(spark), kind, **more)
    held = mo.predict(model, circle(spark, 300, 1)).select((F.col("truth") == F.col("predicted")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert held > 0.9
    if kind == "rf":
        assert {n for n, _ in mo.top_features(model, ["x", "y", "noise"], 2)} == {"x", "y"}


def test_boosted_trees_of_several_classes(vectors):
    f = mo.with_features(vectors, None, "embedding")
    rows = mo.predict(mo.fit(f, "gbt", maxIter=5, maxDepth=3), f).select("truth", "predicted").collect()
    assert {r.predicted for r in rows} == {"c0", "c1", "c2"} and np.mean([r.truth == r.predicted for r in rows]) > 0.8


def test_transfer_between_sources(vectors):
    """M8: macro-F1 over the classes of either side, for every source and target."""
    f = mo.with_features(vectors, None, "embedding")
    frames = {"a": (f.where("vec_id % 2 = 0"), f.where("vec_id % 4 = 1")), "b": (f.where("vec_id % 2 = 1 AND label <> 'c2'"), f.where("vec_id % 4 = 2"))}
    got = {(r.source, r.target): r.score for r in mo.transfer_matrix(frames, "logreg").collect()}
    assert len(got) == 4
    for s, t in product("ab", "ab"):
        rows = mo.predict(mo.fit(frames[s][0], "logreg"), frames[t][1]).collect()
        truth, predicted = [r.truth for r in rows], [r.predicted for r in rows]
        assert got[s, t] == pytest.approx(np.mean(plain_f1(truth, predicted, sorted({*truth, *predicted}))))


def test_grid_runs_what_is_not_done():
    """M7."""
    seen = [c for c, _ in mo.grid({"t": 1, "u": 2}, ["rf"], ["binary", "multiclass"], ["temporal", "stratified"], [0, 1], lambda *a: a, {("t", "rf", "binary", "temporal", 0)})]
    assert len(seen) == 2 * 3 * 2 - 1 and not any(c[2:4] == ("multiclass", "temporal") for c in seen) and ("t", "rf", "binary", "temporal", 0) not in seen


def test_hashed_embeddings(spark):
    """Signed counts of hashed byte pairs, of length one; a model of one's own, and its NaN flag."""
    content = {"0": b"abcabc", "1": b"", "2": None, "3": bytes(range(256)) * 3}
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in content.items()], "flow_id string, ip_bytes binary")
    got = {r.flow_id: r for r in mo.embed(df).collect()}
    for k, v in content.items():
        want = np.zeros(128)
        for a, b in zip(v or b"", (v or b"")[1:]):
            h = (((a << 8 | b) + 7) * 0x9E3779B1) % 2**64
            want[(h >> 8) % 128] += 1 if h & 1 else -1
        norm = math.sqrt((want**2).sum())
        assert got[k].embedding == pytest.approx(want / norm if norm else want, abs=1e-6) and not got[k].has_nan
    own = mo.embed(df, lambda: lambda batch: np.array([[len(b), float("nan") if not b else 0.0] for b in batch]), batch=2)
    assert {r.flow_id: (r.embedding[0], r.has_nan) for r in own.collect()} == {"0": (6, False), "1": (0, True), "2": (0, True), "3": (768, False)}


@pytest.mark.parametrize("seed", [0, 3])
def test_samples_equal_plain_ranks(spark, seed):
    """Ranges of hashes give the same rows as sorting whole classes."""
    rows = [(i, ["a", "b", "c", None][0 if i % 3 else i % 4], i % 2) for i in range(900)] + [(5000, "lone", 0)]
    df = spark.createDataFrame(rows, "id long, label string, half int")

    def order(i):
        return int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16), i

    def ranks(keys):
        by = {}
        for r in sorted(rows, key=lambda r: order(r[0])):
            by.setdefault(tuple(r[k] for k in keys), []).append(r[0])
        return by

    train = {i for ids in ranks([1]).values() for i in ids[: len(ids) if len(ids) < 2 else math.floor(0.7 * len(ids) + 0.5)]}
    split = sa.stratified_split(df, "label", "id", seed).collect()
    assert len(split) == len(rows) and {r.id for r in split if r.split == "train"} == train
    sizes = {k[0]: len(v) for k, v in ranks([1]).items() if k[0] is not None}
    want = {i for k, ids in ranks([1]).items() if k[0] is not None for i in ids[: max(1, sizes[k[0]] * 100 // sum(sizes.values()))]}
    assert {r.id for r in sa.cap_rows(df, "label", "id", 100, seed).collect()} == want
    want = {i for k, ids in ranks([2, 1]).items() for i in (ids[:30] if k[1] == "a" else ids[:7] if k[1] == "b" else ids)}
    assert {r.id for r in sa.class_caps(df, "label", "id", {"a": 30, "b": 7}, ("half",), seed).collect()} == want


@pytest.mark.parametrize("kind", ["large", "negative", "text", "generated"])
def test_samples_of_any_id(spark, kind):
    """W6, X2 to X8 on ids beyond 32 bits, below zero and of text: right shares, the same rows in any partitioning."""
    n = 2000
    base = spark.range(n).select({"large": F.lit(10**12) + F.col("id"), "negative": -5 - F.col("id"), "text": F.concat(F.lit("flow-"), F.col("id").cast("string")), "generated": F.monotonically_increasing_id() + 2**40}[kind].alias("id"), F.when(F.col("id") % 4 == 0, "rare").otherwise("often").alias("label"))
    df = spark.createDataFrame(base.collect(), base.schema)
    split = sa.stratified_split(df, "label", "id").groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in split} == {("rare", "train"): 350, ("rare", "test"): 150, ("often", "train"): 1050, ("often", "test"): 450}
    kept = sa.down_sample(df, "label", "often", 0.1, "id").groupBy("label").count().collect()
    kept = {r.label: r["count"] for r in kept}
    assert kept["rare"] == 500 and 110 <= kept["often"] <= 190
    assert sa.cap_rows(df, "label", "id", 200).count() == 200 and sa.uniform_cap(df, "id", 30).count() == 30
    assert sa.class_caps(df, "label", "id", {"often": 9}).count() == 509 and sa.k_shot(df, "label", "id", 5).count() == 10
    picked = sa.aligned_pick({"a": df, "b": df.repartition(5)}, "label", "id", 3)
    assert sorted(map(tuple, picked["a"].collect())) == sorted(map(tuple, picked["b"].collect())) and picked["a"].count() == 6
    assert {r.id for r in sa.k_shot(df.repartition(7), "label", "id", 5).collect()} == {r.id for r in sa.k_shot(df, "label", "id", 5).collect()}


def clustered(n, d, seed, centres=12, apart=40.0):
    """Rows around far centres, one of which has a third of all, and copies of single rows."""
    r = np.random.default_rng(seed)
    at = r.normal(size=(centres, d)) * apart
    x = at[np.where(r.random(n) < 0.33, 0, r.integers(0, centres, n))] + r.normal(size=(n, d))
    x[: n // 10] = x[0]
    return x


def vectors_of(spark, x, first=0):
    return spark.createDataFrame([(first + i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize(("n", "block", "k", "most"), [(1500, 50, 5, 0.35), (40, 7, 3, 1.1), (3, 2, 5, 1.1)])
def test_metric_index_is_exact_and_visits_few_blocks(spark, n, block, k, most):
    x, q = clustered(n, 8, 1), clustered(90, 8, 1)[::-1] + 0.1
    near, compared = nb.nearest(vectors_of(spark, q), vectors_of(spark, x), k, block_rows=block)
    got = {r["id"]: r["near"] for r in near.collect()}
    for i, row in enumerate(q):
        assert got[i] == pytest.approx(np.sort(np.sqrt(((x - row) ** 2).sum(axis=1)))[:k].tolist(), rel=1e-9, abs=1e-9)
    share = sum(r["compared"] for r in compared.collect()) / (len(q) * n)
    assert share <= most, share


def test_metric_index_without_structure_is_still_exact(spark):
    r = np.random.default_rng(5)
    x, q = r.normal(size=(700, 30)) + 1000, r.normal(size=(40, 30)) + 1000
    near, _ = nb.nearest(vectors_of(spark, q), vectors_of(spark, x), 4, block_rows=60)
    for row in near.collect():
        assert row["near"] == pytest.approx(np.sort(np.sqrt(((x - q[row["id"]]) ** 2).sum(axis=1)))[:4].tolist(), rel=1e-9)


def test_neighbours_by_hashing_reach_their_recall(spark):
    x, q = clustered(1200, 8, 2), clustered(60, 8, 2)[::-1] + 0.05
    got = {r["id"]: r["near"] for r in nb.nearest_by_hashing(vectors_of(spark, q), vectors_of(spark, x), 5).collect()}
    hits = total = 0
    for i, row in enumerate(q):
        want = np.sort(np.sqrt(((x - row) ** 2).sum(axis=1)))[:5]
        hits += sum(any(abs(w - g) < 1e-9 for g in (got[i] or [])) for w in want)
        total += 5
    assert hits / total >= 0.9, hits / total
    scores = mo.knn_score(vectors_of(spark, q), vectors_of(spark, x), 5, id_col="id", vector="v", approximate=True)
    assert scores.count() == 60 and scores.where("score is null").count() <= 6


def test_moments_of_far_means_merge_without_loss(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(900, 4)) * [1, 2, 0.5, 3] + [1e6, -1e6, 3e6, 0]
    df = spark.createDataFrame([(row.tolist(),) for row in x] + [(None,)], "v array<double>").repartition(23)
    n, mean, scatter, fourth = mo.moments(df, "v")
    centred = x - x.mean(axis=0)
    assert n == 900 and mean == pytest.approx(x.mean(axis=0), rel=1e-12)
    assert scatter == pytest.approx(centred.T @ centred, rel=1e-8, abs=1e-4)
    assert fourth == pytest.approx(((centred**2).sum(axis=1) ** 2).sum(), rel=1e-8)
    whole = mo.Moments.of(x[:1])
    for row in x[1:]:
        whole = whole.merged(mo.Moments.of(row[None, :]))
    assert whole.scatter == pytest.approx(centred.T @ centred, rel=1e-8, abs=1e-4)


def test_novelty_chain_equals_numpy(spark):
    """The whole chain on the smallest table: split, standardise, components, both detectors, both areas."""
    from millrace.plans import models

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    x, y, ids = np.array([r["embedding"] for r in rows], dtype=float), np.array([r["label"] for r in rows]), [r["vec_id"] for r in rows]
    test = np.zeros(len(rows), bool)
    for label in set(y):
        mine = sorted(np.flatnonzero(y == label), key=lambda i: int(hashlib.md5(f"999:{ids[i]}".encode()).hexdigest()[:8], 16))
        test[mine[len(mine) if len(mine) < 2 else math.floor(0.7 * len(mine) + 0.5) :]] = True
    benign = (y == 0) & ~test
    mean, std = x[benign].mean(axis=0), x[benign].std(axis=0)
    z = (x - mean) / std
    _, basis = np.linalg.eigh(z[benign].T @ z[benign])
    z = z @ basis[:, ::-1][:, :32]
    a, b = z[benign], z[test]
    knn = np.sort(np.sqrt(((b[:, None, :] - a[None]) ** 2).sum(axis=2)), axis=1)[:, :5].mean(axis=1)
    centred = a - a.mean(axis=0)
    n, k = a.shape
    cov = centred.T @ centred / n
    mu = np.trace(cov) / k
    delta = ((cov - mu * np.eye(k)) ** 2).sum() / k
    beta = min(delta, sum(((np.outer(v, v) - cov) ** 2).sum() for v in centred) / n**2 / k)
    inverse = np.linalg.inv((1 - beta / delta) * cov + beta / delta * mu * np.eye(k))
    far = np.einsum("ij,jk,ik->i", b - a.mean(axis=0), inverse, b - a.mean(axis=0))
    truth = y[test] != 0
    for r in models.novelty_report(spark, d).collect():
        score = {"knn": knn, "mahalanobis": far}[r["detector"]]
        order = np.argsort(-score)
        hit = truth[order]
        precision = np.cumsum(hit) / np.arange(1, len(hit) + 1)
        assert r["auc_pr"] == pytest.approx(precision[hit].mean(), abs=2e-5)
        area = (score[truth][:, None] > score[~truth][None]).mean() + (score[truth][:, None] == score[~truth][None]).mean() / 2
        assert r["auc_roc"] == pytest.approx(area, abs=2e-5)


def test_quantile_clipper_is_a_stage(spark, tmp_path):
    """Equal to ``preprocess``; in a pipeline, saved and loaded, copied with other parameters."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    from pyspark.ml.evaluation import RegressionEvaluator

    from millrace.operators import features as fe

    r = np.random.default_rng(3)
    rows = [(i, float(a), None if i % 7 == 0 else float(b), float("nan") if i % 5 == 0 else 3.0, None, float(2 * a + i % 3)) for i, (a, b) in enumerate(r.lognormal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, `b.x` double, c double, none double, y double")
    plain = df.withColumnRenamed("b.x", "b")
    est = pp.QuantileClipper(inputCols=["a", "b", "c"], outputCols=["ca", "cb", "cc"], low=0.05, high=0.9, standardise=True)
    model = est.fit(plain)
    want = {x["id"]: x for x in fe.preprocess(plain, fe.preprocessing(plain, ["a", "b", "c"], 0.05, 0.9), ["id"]).collect()}
    for x in model.transform(plain).collect():
        assert (x["ca"], x["cb"], x["cc"]) == pytest.approx((want[x["id"]]["a"], want[x["id"]]["b"], want[x["id"]]["c"])) and x["a"] is not None
    pipe = Pipeline(stages=[est, VectorAssembler(inputCols=["ca", "cb"], outputCol="features"), LinearRegression(labelCol="y")])
    fitted = pipe.fit(plain)
    fitted.write().overwrite().save(str(tmp_path / "model"))
    pipe.write().overwrite().save(str(tmp_path / "pipe"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert [x["prediction"] for x in again.transform(plain).orderBy("id").collect()] == [x["prediction"] for x in fitted.transform(plain).orderBy("id").collect()]
    assert Pipeline.load(str(tmp_path / "pipe")).getStages()[0].getOrDefault("low") == 0.05
    clip = pp.QuantileClipper(inputCols=["a", "none"])
    assert clip.fit(df, {clip.low: 0.4, clip.high: 0.6}).transform(df).agg(F.count_distinct("a"), F.max("none")).first()[1] == 0.0
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=ParamGridBuilder().addGrid(est.high, [0.5, 0.99]).build(), evaluator=RegressionEvaluator(labelCol="y"), numFolds=2, seed=1)
    best = cv.fit(plain)
    assert len(best.avgMetrics) == 2 and best.avgMetrics[1] < best.avgMetrics[0]
    with pytest.raises(ValueError):
        pp.QuantileClipper(inputCols=["a"], low=0.9, high=0.1).fit(plain)


def test_grid_goes_on_where_it_stopped(spark, tmp_path):
    """M7, K5: what a stopped call recorded isn't run again; half-written runs are; failures don't stop the others."""
    path, ran = str(tmp_path / "runs"), []
    configurations = [{"tool": t, "seed": s} for t in ("a", "b") for s in range(3)]

    def run(c, broken=()):
        ran.append((c["tool"], c["seed"]))
        if (c["tool"], c["seed"]) in broken:
            raise RuntimeError("stopped")
        return spark.createDataFrame([(c["seed"] / 10, 5)], "score double, n_test long")

    columns = "tool string, seed int, score double, n_test bigint"
    with pytest.raises(RuntimeError, match="stopped"):
        mo.run_grid(spark, configurations, lambda c: run(c, {("a", 1), ("b", 2)}), path, columns, 2)
    assert len(ran) == 6 and mo.recorded(spark, path, columns).count() == 4
    (tmp_path / "runs" / "run=half" / "_temporary").mkdir(parents=True)
    ran.clear()
    out = mo.run_grid(spark, configurations, run, path, columns)
    assert sorted(ran) == [("a", 1), ("b", 2)]
    assert sorted((r.tool, r.seed, r.score, r.n_test) for r in out.collect()) == [(t, s, s / 10, 5) for t in "ab" for s in range(3)]
    mo.run_grid(spark, configurations, run, path, columns)
    assert len(ran) == 2


def test_k_shot_over_shots_and_repeats(spark, points, tmp_path):
    """One record for each k and repeat, on classes that may be smaller than k; equal to one run alone."""
    x, y = points[:2]
    e = mo.with_features(spark.createDataFrame([(i, v.tolist(), str(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], VECTORS), None, "embedding")
    train, test = e.where("vec_id % 3 > 0").cache(), e.where("vec_id % 3 = 0").cache()
    got = {(r.k, r.repeat): r for r in mo.k_shot_grid(train, test, str(tmp_path / "k"), (2, 60), 2).collect()}
    assert {k: r.n_train for k, r in got.items()} == {(2, 0): 6, (2, 1): 6, (60, 0): train.where("label = '0'").limit(60).count() + train.where("label <> '0'").count(), (60, 1): 60 + train.where("label <> '0'").count()}
    alone = mo.evaluate(mo.fit(sa.k_shot(train, "label", "vec_id", 2, 1), "logreg"), test, "union").first()
    assert got[2, 1].macro_f1 == pytest.approx(alone.macro_f1) and got[60, 0].macro_f1 > 0.6


def test_neighbours_over_many_packs_meet_in_bundles(spark, monkeypatch):
    """No row of a shuffle is made for a query and a block: without structure every query looks into nearly all blocks (F1)."""
    monkeypatch.setattr(nb, "PACK_NUMBERS", 16 * 120)
    monkeypatch.setattr(nb, "BUNDLE_NUMBERS", 16 * 50)
    asked, visit = [], nb._visit
    monkeypatch.setattr(nb, "_visit", lambda visits, *more: visit(asked.append(visits.count()) or visits, *more))
    r = np.random.default_rng(8)
    x, q = r.normal(size=(900, 16)), r.normal(size=(130, 16))
    near, compared = nb.nearest(vectors_of(spark, q), vectors_of(spark, x), 5, block_rows=10)
    rows = {row["id"]: row["near"] for row in near.collect()}
    assert len(rows) == 130 and all(rows[i] == pytest.approx(np.sort(np.sqrt(((x - v) ** 2).sum(axis=1)))[:5].tolist(), rel=1e-9) for i, v in enumerate(q))
    assert len(asked) == 2 and sum(asked) <= 130 * 9  # packs of 120 rows, where blocks are a hundred
    assert sum(row["compared"] for row in compared.collect()) <= 130 * 900


def test_memory_of_neighbours_is_bounded(spark):
    """Python workers stay small where every query looks into all blocks, as in novelty_report without structure."""
    import threading

    import psutil
    import pyarrow as pa

    r = np.random.default_rng(10)
    x, q = (spark.createDataFrame(pa.table({"id": np.arange(n), "v": pa.array(list(r.normal(size=(n, 32))))})) for n in (8_000, 30_000))
    most, ended, me = [0.0], threading.Event(), psutil.Process()

    def watch():
        while not ended.wait(0.1):
            for p in me.children(recursive=True):
                try:
                    if "python" in p.name():
                        most[0] = max(most[0], p.memory_full_info().uss / 1e6)
                except psutil.Error:
                    pass

    watching = threading.Thread(target=watch)
    watching.start()
    try:
        near, _ = nb.nearest(q, x, 5)
        assert near.where("size(near) = 5").count() == 30_000
    finally:
        ended.set()
        watching.join()
    assert 0 < most[0] < 400, most[0]


def test_groups_of_neighbours_stay_small_over_many_packs(spark, monkeypatch):
    """What a task of novelty_report's neighbours gets at once doesn't grow with the reference, nor with the queries."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    apply = PandasCogroupedOps.applyInArrow

    def held(self, look, schema):
        def looked(q, r):
            assert q.num_rows <= 40 and r.num_rows <= 300 + 10, (q.num_rows, r.num_rows)
            return look(q, r)

        return apply(self, looked, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", held)
    monkeypatch.setattr(nb, "PACK_NUMBERS", 16 * 300)
    monkeypatch.setattr(nb, "BUNDLE_NUMBERS", 16 * 40)
    r = np.random.default_rng(12)
    for n, m in ((600, 90), (2_400, 360)):
        x, q = r.normal(size=(n, 16)), r.normal(size=(m, 16))
        x[: n // 3] = x[0]  # copies fill blocks of their own
        near, compared = nb.nearest(vectors_of(spark, q), vectors_of(spark, x), 5, block_rows=10)
        rows = {row["id"]: row["near"] for row in near.collect()}
        assert len(rows) == m and all(rows[i] == pytest.approx(np.sort(np.sqrt(((x - v) ** 2).sum(axis=1)))[:5].tolist(), rel=1e-9) for i, v in enumerate(q))
        assert max(row["compared"] for row in compared.collect()) > 310  # more than one pack is met


def test_forest_grows_in_groups_on_few_partitions(spark, tmp_path):
    """Nodes' counts aren't held by every partition of the training rows; parts vote as one forest and are kept whole (F2)."""
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 6))
    rows = spark.createDataFrame([(i, v.tolist(), "ab"[int(v[0] * v[1] > 0)]) for i, v in enumerate(x)], "vec_id long, v array<double>, label string").repartition(16)
    rows = mo.with_features(rows, None, "v")
    model = mo.fit(rows.where("vec_id < 300"), "rf", numTrees=40, maxDepth=8)
    forest = model.stages[-1]
    assert [p.getNumTrees for p in forest.parts] == [16, 16, 8] and len({t.toDebugString for p in forest.parts for t in p.trees}) > 30
    assert {n for n, _ in mo.top_features(model, list("abcdef"), 2)} == {"a", "b"} and sum(forest.featureImportances) == pytest.approx(1)
    test = rows.where("vec_id >= 300")
    out = {q.vec_id: q for q in mo.predict(model, test).collect()}
    assert sum(q.truth == q.predicted for q in out.values()) >= 75
    votes = sum(np.array([q.rawPrediction.toArray() for q in p.transform(test.orderBy("vec_id")).orderBy("vec_id").collect()]) for p in forest.parts)
    assert all(out[300 + i].rawPrediction.toArray() == pytest.approx(v) and out[300 + i].prediction == v.argmax() for i, v in enumerate(votes))
    model.write().save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    assert {q.vec_id: q.predicted for q in mo.predict(again, test).collect()} == {i: q.predicted for i, q in out.items()}


@pytest.mark.parametrize("small", [100, 8_192])
def test_a_tree_without_bag_is_that_of_spark(spark, monkeypatch, small):
    """A tree on all rows and features has Spark's splits, whether its nodes are split by counts of blocks or grown in a call (F1)."""
    monkeypatch.setattr(mo.fo, "SMALL", small)
    monkeypatch.setattr(mo.fo, "BLOCK", 128)
    r = np.random.default_rng(8)
    x = r.integers(0, 12, size=(700, 5)).astype(float)
    rows = mo.with_features(spark.createDataFrame([(i, v.tolist(), "abc"[int(v[0] + v[1] + r.integers(0, 9)) % 3]) for i, v in enumerate(x)], VECTORS), None, "embedding")
    model = mo.fit(rows, "rf", numTrees=1, bootstrap=False, maxDepth=5)
    forest = model.stages[-1]
    assert (len(forest.top.feature) > 1) == (small == 100)
    plain = DecisionTreeClassifier(maxDepth=5, labelCol="_index", weightCol="weight").fit(model.stages[0].transform(mo.balanced(rows, "label")))
    want = {q.vec_id: q.probability.toArray() for q in plain.transform(rows).select("vec_id", "probability").collect()}
    got = {q.vec_id: q.probability.toArray() for q in mo.predict(model, rows).select("vec_id", "probability").collect()}
    assert len({tuple(v) for v in want.values()}) > 15 and got.keys() == want.keys() and all(got[i] == pytest.approx(v, abs=1e-6) for i, v in want.items())
    assert forest.featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray(), abs=1e-6)


def test_the_driver_keeps_few_nodes_of_a_forest(spark, monkeypatch):
    """trees on noise have about as many nodes as rows; they stay in a table, and the driver has those of large nodes alone."""
    monkeypatch.setattr(mo.fo, "SMALL", 128)
    monkeypatch.setattr(mo.fo, "BLOCK", 200)
    r = np.random.default_rng(9)
    rows = mo.with_features(spark.createDataFrame([(i, r.normal(size=8).tolist(), str(r.integers(0, 4))) for i in range(800)], VECTORS), None, "embedding")
    train = rows.where("vec_id < 600")
    model = mo.fit(train, "rf", numTrees=20)
    forest = model.stages[-1]
    table = forest.nodes.where("node IS NOT NULL")
    nodes = table.agg(F.sum("size")).first()[0]
    assert nodes > 20 * 300 and 20 < len(forest.top.feature) < nodes / 15
    assert table.count() == (forest.top.feature < 0).sum() and table.agg(F.max("size")).first()[0] <= 2 * 128
    own = [(q.truth == q.predicted) for q in mo.predict(model, train).collect()]
    assert len(own) == 600 and np.mean(own) > 0.95  # each row is in most bags
    held = mo.predict(model, rows.where("vec_id >= 600")).select(F.aggregate(vector_to_array("rawPrediction"), F.lit(0.0), lambda a, v: a + v).alias("votes")).collect()
    assert len(held) == 200 and all(q.votes == pytest.approx(20) for q in held)


def test_forest_of_one_vector_and_of_odd_values(spark):
    """Large nodes that can't be split are leaves; NaN and infinite values and a single row have votes too."""
    same = mo.with_features(spark.range(20_000).selectExpr("id AS vec_id", "array(1D, 2D) AS embedding", "IF(id % 4 = 0, 'a', 'b') AS label"), None, "embedding")
    out = mo.predict(mo.fit(same, "rf", numTrees=3), same.limit(5)).select("probability", "prediction").collect()
    assert len(out) == 5 and all(q.probability.toArray()[:2] == pytest.approx([0.5, 0.5], abs=0.05) for q in out)
    odd = [(i, [v], "a" if v < 1 else "b") for i, v in enumerate([float("-inf"), -1.0, 0.5, 2.0, float("inf"), float("nan")] * 30)]
    rows = mo.with_features(spark.createDataFrame(odd, VECTORS), None, "embedding")
    assert all(q.truth == q.predicted for q in mo.predict(mo.fit(rows, "rf", numTrees=9), rows).collect())
    one = rows.where("vec_id = 1")
    assert mo.predict(mo.fit(one, "rf", numTrees=9), one).first().predicted == "a"
