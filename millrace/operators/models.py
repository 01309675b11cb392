"""Classifiers and novelty scores on Spark ML and DataFrame aggregates."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import evaluation as ev
from millrace.operators import forest as fo
from millrace.operators import neighbours as nb
from millrace.operators import sampling
from millrace.operators.ranges import stored


def classifier(kind: str, n_features: int, n_classes: int, seed: int = 0, **more):
    """M2-M5: random forest, boosted trees, logistic regression or perceptron with the library's settings."""
    if kind == "rf":
        return RandomForestClassifier(**({"numTrees": 200, "maxDepth": 30, "weightCol": "weight", "seed": seed} | more))
    if kind == "gbt":
        tree = GBTClassifier(**({"maxIter": 300, "maxDepth": 8, "stepSize": 0.1, "subsamplingRate": 0.9, "seed": seed} | more))
        return tree if n_classes <= 2 else OneVsRest(classifier=tree)
    if kind == "logreg":
        return LogisticRegression(**({"family": "auto", "weightCol": "weight", "maxIter": 100} | more))
    if kind == "mlp":
        return MultilayerPerceptronClassifier(**({"layers": [n_features, 64, 32, max(2, n_classes)], "maxIter": 80, "seed": seed} | more))
    raise ValueError(kind)


def with_features(df: DataFrame, columns: Sequence[str] | None, array: str | None = None) -> DataFrame:
    """``features`` from numeric columns or from one array column."""
    if array:
        return df.withColumn("features", array_to_vector(F.col(array).cast("array<double>")))
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep").transform(df)


def balanced(train: DataFrame, label: str) -> DataFrame:
    """``weight``: rows / (classes * rows of the class)."""
    sizes = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy()
    weights = sizes.select(label, (F.sum("_n").over(w) / (F.count(F.lit(1)).over(w) * F.col("_n"))).alias("weight"))
    return train.join(F.broadcast(weights), label)


def fit(train: DataFrame, kind: str, label: str = "label", seed: int = 0, **more) -> PipelineModel:
    """M6: labels indexed on the training classes; unseen ones get an index of their own when scored."""
    train = balanced(train.withColumn(label, F.col(label).cast("string")), label)
    indexer = StringIndexer(inputCol=label, outputCol="_index", handleInvalid="keep").fit(train)
    n_features = len(train.select("features").first()[0])
    model = classifier(kind, n_features, len(indexer.labels), seed, **more)
    model.setLabelCol("_index")
    if isinstance(model, OneVsRest):
        model.setFeaturesCol("features")
    if kind == "rf":
        return PipelineModel([indexer, fo.fitted(model, indexer.transform(train), len(indexer.labels) + 1)])
    return Pipeline(stages=[indexer, model]).fit(train)


def predict(model: PipelineModel, rows: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with ``truth`` and ``predicted`` as text."""
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    out = model.transform(rows.withColumn(label, F.col(label).cast("string")))
    return out.withColumn("truth", F.col(label)).withColumn("predicted", F.try_element_at(names, (F.col("prediction") + 1).cast("int")))


def evaluate(model: PipelineModel, test: DataFrame, labels: str = "train", label: str = "label") -> DataFrame:
    """M6: the summary of a model on test rows."""
    classes = test.sparkSession.createDataFrame([(x,) for x in model.stages[0].labels], "class string")
    return ev.summary(ev.class_report(ev.confusion(predict(model, test, label), classes)), labels)


def grid(frames: Mapping[str, DataFrame], kinds: Sequence[str], tasks: Sequence[str], splits: Sequence[str], seeds: Sequence[int], run: Callable, done: set[tuple] = frozenset()) -> Iterator[tuple]:
    """M7: run(tool, frame, kind, task, split, seed) for every combination that is not done; multiclass by time is left out."""
    for tool, frame in frames.items():
        for combo in ((tool, k, t, s, n) for k in kinds for t in tasks for s in splits for n in seeds):
            if combo in done or combo[2:4] == ("multiclass", "temporal"):
                continue
            yield combo, run(tool, frame, *combo[1:])


def _run_id(keys: Mapping[str, object]) -> str:
    return hashlib.sha256(json.dumps(keys, sort_keys=True, default=str).encode()).hexdigest()[:24]


def recorded(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """M7, K5: the records of finished runs below ``path``; what an ended run left half written isn't among them."""
    try:
        return spark.read.schema(f"{columns}, run string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{columns}, run string")


def run_grid(spark: SparkSession, configurations: Sequence[Mapping[str, object]], run: Callable[[Mapping], DataFrame], path: str, columns: str, at_once: int = 4) -> DataFrame:
    """M7, K5, K6: ``run(configuration)`` for every configuration without a record; all records, also those of earlier calls.

    ``run`` returns the metrics of one run; the configuration is put beside them, under ``columns`` (names and types of
    both). A run is recorded when it is done, each in a folder of its own (``run=...``), so concurrent commits don't meet
    and a call after a stop goes on with what is missing. At most ``at_once`` runs at a time, each in a pool of its own
    where the scheduler is fair. A run that fails doesn't stop the others; the first failure is raised at the end.
    """
    names = [f.name for f in recorded(spark, path, columns).schema if f.name != "run"]
    done = {r.run for r in recorded(spark, path, columns).select("run").distinct().collect()}  # a row for each run
    todo = {i: c for c in configurations if (i := _run_id(c)) not in done}

    def one(item: tuple[str, Mapping]) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", item[0])
        made = run(item[1]).withColumns({k: F.lit(v) for k, v in item[1].items()})
        typed = spark.createDataFrame([], columns).schema
        made.select(*[F.col(f"`{c}`").cast(typed[c].dataType).alias(c) for c in names]).coalesce(1).write.mode("overwrite").parquet(f"{path}/run={item[0]}")

    with ThreadPoolExecutor(max(at_once, 1)) as pool:
        waits = [pool.submit(inheritable_thread_target(spark)(one), item) for item in todo.items()]
    for w in waits:
        w.result()
    return recorded(spark, path, columns).drop("run")


def k_shot_grid(train: DataFrame, test: DataFrame, path: str, shots: Sequence[int] = (1, 5, 10, 50, 100), repeats: int = 5, label: str = "label", id_col: str = "vec_id", at_once: int = 4) -> DataFrame:
    """Macro-F1 over the union of classes of a logistic head on k rows of each class, for every k and repeat, on one test set.

    ``train`` and ``test`` should be written tables: each run reads them.
    """

    def run(c: Mapping) -> DataFrame:
        few = stored(sampling.k_shot(train, label, id_col, c["k"], c["repeat"]))
        number = few.count()  # one task for 10,000 rows: an iteration over so few is shorter than a task's start
        return evaluate(fit(few.coalesce(1 + number // 10_000), "logreg", label), test, "union", label).withColumn("n_train", F.lit(number))

    runs = [{"k": k, "repeat": r} for k in shots for r in range(repeats)]
    return run_grid(train.sparkSession, runs, run, path, "k int, repeat int, n_train bigint, macro_f1 double, weighted_f1 double, balanced_accuracy double", at_once)


def transfer_matrix(frames: Mapping[str, tuple[DataFrame, DataFrame]], kind: str, label: str = "label", **more) -> DataFrame:
    """M8: macro-F1 over the union of classes of each source's model on every target's test rows, one pass for each source."""
    targets = None
    for name, (_, test) in frames.items():
        t = test.select("features", label).withColumn("target", F.lit(name))
        targets = t if targets is None else targets.unionByName(t)
    out = None
    for name, (train, _) in frames.items():
        scored = predict(fit(train, kind, label, **more), targets, label).select("target", "truth", "predicted")
        sides = scored.select("target", F.explode(F.array_distinct(F.array("truth", "predicted"))).alias("class"), "truth", "predicted")
        per = sides.groupBy("target", "class").agg(F.count_if((F.col("truth") == F.col("class")) & (F.col("predicted") == F.col("class"))).alias("tp"), F.count(F.lit(1)).alias("either"))
        f1 = per.groupBy("target").agg(F.avg(2 * F.col("tp") / (F.col("either") + F.col("tp"))).alias("score")).withColumn("source", F.lit(name))
        out = f1 if out is None else out.unionByName(f1)
    return out.select("source", "target", "score")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def knn_score(queries: DataFrame, reference: DataFrame, k: int = 5, block_rows: int = nb.BLOCK_ROWS, id_col: str = "vec_id", vector: str = "embedding", approximate: bool = False) -> DataFrame:
    """Mean distance to the k nearest reference vectors; null where there is no reference.

    Exact by the index of ``neighbours``; ``approximate`` takes the nearest among rows that share a hash bucket. Rows
    without a vector have no score and are no reference. Repeated ids count as one query.
    """
    v = F.col(vector).cast("array<double>").alias("v")
    q = queries.dropDuplicates([id_col]).select(F.col(id_col).cast("bigint").alias("id"), v).where("v is not null")
    r = reference.select(v).where("v is not null")
    ids = queries.select(F.col(id_col).cast("bigint").alias(id_col)).distinct()
    if r.isEmpty():
        return ids.withColumn("score", F.lit(None).cast("double"))
    near = nb.nearest_by_hashing(q, r, k) if approximate else nb.nearest(q, r, k, block_rows)[0]
    scored = near.select(F.col("id").alias(id_col), (F.aggregate("near", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("near"), F.lit(0))).alias("score"))
    return ids.join(scored, id_col, "left")


@dataclass
class Moments:
    """Rows, mean, scatter matrix about the mean; two of them merge into that of all their rows."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(v: np.ndarray) -> "Moments":
        mean = v.mean(axis=0)
        return Moments(len(v), mean, (v - mean).T @ (v - mean))

    def merged(self, other: "Moments") -> "Moments":
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n))


#: States that one task merges in a round.
MERGED = 8


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray, float]:
    """Rows, mean, scatter matrix about the mean and the sum of fourth powers of centred lengths.

    Every partition gives a state of its rows about their own mean, so far-off means cost no digits; states are merged in
    tasks, ``MERGED`` at a time, until one is left, which goes to the driver. Rows without a vector don't count.
    """
    kind = "part long, n long, mean array<double>, scatter array<double>"

    def row(m: Moments, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([m.n]), pa.array([m.mean.tolist()]), pa.array([m.scatter.ravel().tolist()])], names=["part", "n", "mean", "scatter"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for b in batches:
            if b.num_rows:
                m = Moments.of(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                whole = whole.merged(m) if whole else m
        if whole:
            yield row(whole, TaskContext.get().partitionId())

    def merge(states: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, part = None, 0
        for b in states:
            for i in range(b.num_rows):
                mean = b.column(2)[i].values.to_numpy()
                m = Moments(b.column(1)[i].as_py(), mean, b.column(3)[i].values.to_numpy().reshape(len(mean), -1))
                whole, part = whole.merged(m) if whole else m, b.column(0)[i].as_py() // MERGED
        if whole:
            yield row(whole, part)

    x = df.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    states = stored(x.mapInArrow(own, kind))
    left = (states.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        left = -(-left // MERGED)
        states = stored(states.groupBy(F.floor(F.col("part") / MERGED).alias("to")).applyInArrow(lambda t: pa.Table.from_batches(merge(iter(t.sort_by("part").to_batches()))), kind))
    (one,) = states.collect()  # a single state
    mean = np.array(one["mean"])
    centre = F.array(*[F.lit(float(m)) for m in mean])
    fourth = x.select(squared_distance(F.col("v"), centre).alias("q")).agg(F.sum(F.col("q") * F.col("q"))).first()[0]
    return one["n"], mean, np.array(one["scatter"]).reshape(len(mean), -1), float(fourth)


def mahalanobis(df: DataFrame, train: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Squared Mahalanobis distance to the training rows, their covariance shrunk by Ledoit and Wolf's rule."""
    n, mean, scatter, fourth = moments(train, vector)
    d = len(mean)
    cov = scatter / n
    mu = np.trace(cov) / d
    beta = (fourth / n - (cov * cov).sum()) / n / d
    delta = ((cov * cov).sum() - d * mu * mu) / d
    share = 0.0 if delta == 0 else min(1.0, max(0.0, beta / delta))
    inverse = np.linalg.inv((1 - share) * cov + share * mu * np.eye(d))
    return _form(df, mean, inverse, id_col, vector)


def _form(df: DataFrame, mean: np.ndarray, matrix: np.ndarray, id_col: str, vector: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((mean, matrix))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, a = shared.value
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) - m
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(((v @ a) * v).sum(axis=1))], names=[id_col, "score"])

    return df.select(id_col, F.col(vector).cast("array<double>")).mapInArrow(score, f"{id_col} bigint, score double")


def pca_scores(df: DataFrame, train: DataFrame, k: int = 32, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Standardised (population deviation) and projected to the ``k`` first components of the training rows."""
    n, mean, scatter, _ = moments(train, vector)
    std = np.sqrt(np.diag(scatter) / n)
    std[std == 0] = 1
    _, vectors = np.linalg.eigh(scatter / n / np.outer(std, std))
    basis = vectors[:, ::-1][:, : min(k, len(mean))]
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), range(basis.shape[1])])  # a fixed sign
    shared = df.sparkSession.sparkContext.broadcast((mean, std, basis))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, s, p = shared.value
        for b in batches:
            v = (b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) - m) / s
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((v @ p).tolist(), pa.list_(pa.float64()))], names=[id_col, "components"])

    return df.select(id_col, F.col(vector).cast("array<double>")).mapInArrow(project, f"{id_col} bigint, components array<double>")


def hashing_embedder(width: int = 128, seed: int = 7) -> Callable[[list[bytes]], np.ndarray]:
    """The default embedder: signed counts of hashed byte pairs, scaled to length one."""

    def embed(batch: list[bytes]) -> np.ndarray:
        out = np.zeros((len(batch), width))
        for i, b in enumerate(batch):
            x = np.frombuffer(b, dtype=np.uint8).astype(np.uint64)
            if len(x) > 1:
                h = ((x[:-1] << np.uint64(8) | x[1:]) + np.uint64(seed)) * np.uint64(0x9E3779B1)
                np.add.at(out[i], (h >> np.uint64(8)) % np.uint64(width), np.where(h & np.uint64(1), 1.0, -1.0))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


EMBEDDERS: dict[str, Callable[[], Callable[[list[bytes]], np.ndarray]]] = {"hashing": hashing_embedder}


def embed(df: DataFrame, make: str | Callable = "hashing", id_col: str = "flow_id", content: str = "ip_bytes", batch: int = 256) -> DataFrame:
    """(id, embedding, has_nan) by an embedder made once for each task; pass a name or a function that makes one."""
    factory = EMBEDDERS[make] if isinstance(make, str) else make

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                v = np.asarray(model([x.as_py() or b"" for x in part.column(1)]), dtype=np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(v.tolist(), pa.list_(pa.float32())), pa.array(np.isnan(v).any(axis=1))], names=[id_col, "embedding", "has_nan"])

    return df.select(F.col(id_col).cast("string"), F.col(content).cast("binary")).mapInArrow(run, f"{id_col} string, embedding array<float>, has_nan boolean")


def top_features(model: PipelineModel, names: Sequence[str], n: int = 20) -> list[tuple[str, float]]:
    """The most important features of a tree ensemble."""
    found = zip(names, model.stages[-1].featureImportances.toArray(), strict=False)
    return sorted(found, key=lambda x: (-x[1], x[0]))[:n]


