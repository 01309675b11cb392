"""M2: random forests whose nodes stay in tables.

Spark's forests keep every tree in the driver, and deep trees on noisy labels have about as many nodes as training rows.
Here a node of more than ``SMALL`` rows is split by counts that all blocks of rows give; the rows of a smaller one meet in
one call, which grows the rest of its tree. The driver has only the nodes above those, some rows * trees / ``SMALL``.
Rows are scored likewise: they meet the rest of each tree at the node they reach.

Bins, bags, features tried at a node, impurities and votes follow the parameters of ``RandomForestClassifier``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ranges import scratch, stored

#: Trees of a part; rows of a block; most rows of a node that one call grows; blocks of scored rows that meet a tree in one call.
TREES_AT_ONCE, BLOCK, SMALL, BLOCKS_AT_ONCE = 16, 16_384, 8_192, 16
#: Gains and impurities up to this are rounding.
LEAST = 1e-10
MASK = (1 << 64) - 1
#: In place of a feature: the rest of the tree is a row of ``nodes``, grown from rows or a single leaf.
GROWN, LEAF = -1, -2
NODES = "node long, tree int, size int, feature binary, cut binary, left binary, value binary, votes binary, importance array<double>"


@dataclass
class Settings:
    """The parameters of a forest, as numbers; ``width`` features of which ``tried`` are looked at in a node."""

    trees: int
    depth: int
    bins: int
    width: int
    tried: int
    classes: int
    least_rows: int
    least_gain: float
    least_weight: float
    impurity: str
    rate: float
    bootstrap: bool
    seed: int

    @property
    def code(self) -> np.dtype:
        return np.dtype(np.uint8 if self.bins <= 256 else np.uint16)


def tried(strategy: str, width: int, trees: int) -> int:
    """The number of features that ``featureSubsetStrategy`` stands for."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt"
    named = {"all": width, "sqrt": np.ceil(np.sqrt(width)), "log2": np.ceil(np.log2(width)), "onethird": np.ceil(width / 3)}
    found = named[strategy] if strategy in named else float(strategy) if strategy.isdigit() else np.ceil(float(strategy) * width)
    return int(min(max(1, found), width))


def impurity(sums: np.ndarray, kind: str) -> np.ndarray:
    whole = sums.sum(axis=-1)
    if kind == "gini":
        return 1 - np.einsum("...c,...c->...", sums, sums) / np.maximum(whole * whole, 1e-300)
    p = np.clip(sums / np.maximum(whole, 1e-300)[..., None], 1e-300, 1)
    return -(p * np.log2(p)).sum(axis=-1)


def gains(left: np.ndarray, left_n: np.ndarray, whole: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """What splits with class weights ``left`` of ``whole`` and ``left_n`` of ``n`` rows on the left gain; -inf where they may not be made."""
    right = whole - left
    lw, rw = left.sum(axis=-1), right.sum(axis=-1)
    gain = impurity(whole, s.impurity) - (lw * impurity(left, s.impurity) + rw * impurity(right, s.impurity)) / np.maximum(lw + rw, 1e-300)
    may = (left_n >= s.least_rows) & (n - left_n >= s.least_rows) & (lw >= s.least_weight) & (rw >= s.least_weight)
    return np.where(may & (gain > LEAST) & (gain >= s.least_gain), gain, -np.inf)


def chosen(random: np.random.Generator, nodes: int, s: Settings) -> np.ndarray:
    """The features tried at each of ``nodes`` nodes."""
    if s.tried == s.width:
        return np.tile(np.arange(s.width), (nodes, 1))
    return np.argpartition(random.random((nodes, s.width)), s.tried - 1, axis=1)[:, : s.tried]


def drawn(rows: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    """How often each row is in the tree's bag; by row number, tree and seed alone."""
    if not s.bootstrap and s.rate >= 1:
        return np.ones(len(rows), dtype=np.int32)

    def mixed(z: np.ndarray) -> np.ndarray:
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))

    z = mixed(mixed(rows.astype(np.uint64) + np.uint64(s.seed * 0x9E3779B97F4A7C15 & MASK)) + np.uint64((tree + 1) * 0xD1B54A32D192ED03 & MASK))
    u = (z >> np.uint64(11)) * 2.0**-53
    if not s.bootstrap:
        return (u < s.rate).astype(np.int32)
    k = np.arange(1, 64)
    poisson = np.exp(-s.rate) * np.cumsum(np.concatenate([[1.0], np.cumprod(s.rate / k)]))
    return np.searchsorted(poisson, u, side="right").astype(np.int32)


def routed(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The node where each row ends that starts at ``at``; the right child is the one after the left."""
    go = np.flatnonzero(feature[at] >= 0)
    while len(go):
        n = at[go]
        at[go] = left[n] + (codes[go, feature[n]] > cut[n])
        go = go[feature[at[go]] >= 0]
    return at


def best_cuts(codes: np.ndarray, label: np.ndarray, weight: np.ndarray, n: np.ndarray, node: np.ndarray, nodes: int, s: Settings, random: np.random.Generator):
    """The best split of each node that has one: (node, feature, cut, gain). Counts go only to bins that hold rows."""
    k, c, tries = s.tried, int(label.max()) + 1, chosen(random, nodes, s)
    key = ((np.arange(k) * nodes + node[:, None]) * s.bins + np.take_along_axis(codes, tries[node], axis=1)).ravel()
    if k * nodes * s.bins <= 8 * len(key):
        held = np.bincount(key, minlength=k * nodes * s.bins) > 0
        cells, cell = np.flatnonzero(held), (np.cumsum(held) - 1)[key]
    else:
        cells, cell = np.unique(key, return_inverse=True)
    sums = np.bincount(cell * c + np.repeat(label, k), np.repeat(weight, k), len(cells) * c).reshape(-1, c)
    rows = np.bincount(cell, np.repeat(n, k), len(cells))
    group = cells // s.bins
    first = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(first, append=len(cells))
    own, whole, all_n = group % nodes, np.add.reduceat(sums, first, axis=0), np.add.reduceat(rows, first)
    run, run_n = np.cumsum(sums, axis=0), np.cumsum(rows)
    left = run - np.repeat(run[first] - sums[first], size, axis=0)
    left_n = run_n - np.repeat(run_n[first] - rows[first], size)
    gain = gains(left, left_n, np.repeat(whole, size, axis=0), np.repeat(all_n, size), s)
    gain[first + size - 1] = -np.inf  # all rows on the left
    best = np.full(nodes, -np.inf)
    np.maximum.at(best, own, gain)
    hit = np.flatnonzero((gain == best[own]) & (gain > -np.inf))
    who, at = np.unique(own[hit], return_index=True)
    at = hit[at]
    return who, tries[who, group[at] // nodes], cells[at] % s.bins, best[who]


def grown_rest(codes: np.ndarray, label: np.ndarray, weight: np.ndarray, n: np.ndarray, depth: int, s: Settings, random: np.random.Generator) -> dict:
    """The tree below a node from its rows, level by level: children, leaves' votes and importance of features."""
    seen, label = np.unique(label, return_inverse=True)
    c, levels, count = len(seen), [], 1
    rows, node, nodes = np.arange(len(label)), np.zeros(len(label), dtype=np.int64), 1
    while nodes:
        sums = np.bincount(node * c + label[rows], weight[rows], nodes * c).reshape(nodes, c)
        feature, cut, left, gained = np.full(nodes, -1), np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=np.int64), np.zeros(nodes)
        levels.append((feature, cut, left, gained, sums))
        mixed = (impurity(sums, s.impurity) > LEAST) & (depth < s.depth)
        on = mixed[node]
        nodes = 0
        if on.any():
            rows, node = rows[on], node[on]
            who, f, at, gain = best_cuts(codes[rows], label[rows], weight[rows], n[rows], (np.cumsum(mixed) - 1)[node], int(mixed.sum()), s, random)
            who = np.flatnonzero(mixed)[who]
            feature[who], cut[who], left[who], gained[who] = f, at, count + 2 * np.arange(len(who)), gain * sums[who].sum(axis=1)
            go = feature[node] >= 0
            rows, node = rows[go], node[go]
            node = left[node] - count + (codes[rows, feature[node]] > cut[node])
            nodes, depth = 2 * len(who), depth + 1
            count += nodes
    starts = np.cumsum([0, *(len(x[0]) for x in levels)])
    feature, cut, left, gained, sums = (np.concatenate(x) for x in zip(*levels, strict=True))
    kind, reached = sums.argmax(axis=1), np.zeros(len(feature), dtype=bool)
    for at, end in zip(starts[-2::-1], starts[:0:-1], strict=True):  # leaves that say the same are one, as Spark has it
        i = at + np.flatnonzero(feature[at:end] >= 0)
        one = left[i]
        feature[i[(feature[one] < 0) & (feature[one + 1] < 0) & (kind[one] == kind[one + 1])]] = -1
    reached[0] = True
    for at, end in zip(starts, starts[1:], strict=False):
        i = at + np.flatnonzero(reached[at:end] & (feature[at:end] >= 0))
        reached[left[i]] = reached[left[i] + 1] = True
    left = np.where(feature >= 0, (np.cumsum(reached) - 1)[left], 0)
    feature, cut, left, gained, sums = (x[reached] for x in (feature, cut, left, gained, sums))
    leaf = feature < 0
    at_leaf = np.zeros((int(leaf.sum()), s.classes))
    at_leaf[:, seen] = sums[leaf] / np.maximum(sums[leaf].sum(axis=1, keepdims=True), 1e-300)
    votes, which = np.unique(at_leaf, axis=0, return_inverse=True)
    value = np.full(len(feature), -1)
    value[leaf] = which.ravel()
    return {"size": len(feature), "feature": feature, "cut": cut, "left": left, "value": value, "votes": votes, "importance": np.bincount(feature[~leaf], gained[~leaf], s.width)}


def packed(tree: dict) -> dict:
    """A tree's arrays as the columns of ``NODES``."""
    return tree | {x: tree[x].astype(np.int32).tobytes() for x in ("feature", "cut", "left", "value")} | {"votes": tree["votes"].astype(float).tobytes(), "importance": tree["importance"].tolist()}


@dataclass
class Top:
    """The nodes above the grown ones, of all trees; the first are the roots. The right child is the one after the left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    tree: np.ndarray

    @staticmethod
    def roots(trees: int) -> Top:
        zero = np.zeros(trees, dtype=np.int64)
        return Top(zero + GROWN, zero, zero, zero, np.arange(trees))

    def routed(self, codes: np.ndarray, tree: int) -> np.ndarray:
        return routed(codes, self.feature, self.cut, self.left, np.full(len(codes), tree))


def edges_of(rows: DataFrame, bins: int) -> list[list[float]]:
    """Upper ends of each feature's bins but the last: midpoints of its values if those are few, else values at even shares of the rows."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                found = found or [np.empty(0)] * x.shape[1]
                found = [v if len(v) > bins else np.unique(np.concatenate([v, x[:, i][~np.isnan(x[:, i])]]))[: bins + 1] for i, v in enumerate(found)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(found))), pa.array([v.tolist() for v in found], pa.list_(pa.float64()))], names=["i", "values"])

    values = rows.select("x").mapInArrow(few, "i long, values array<double>").groupBy("i").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values"))
    known = {r.i: r["values"] for r in values.where(F.size("values") <= bins).collect()}  # a row for each feature
    width = len(rows.select("x").first()[0])
    long = rows.select(F.posexplode("x").alias("i", "v")).where(~F.isnan("v") & ~F.col("i").isin(list(known)))
    shares = [k / bins for k in range(1, bins)]
    many = {r.i: r.edges for r in long.groupBy("i").agg(F.percentile_approx("v", shares, 100 * bins).alias("edges")).collect()} if len(known) < width else {}

    def between(a: float, b: float) -> float:
        return m if a <= (m := (a + b) / 2) < b else a  # infinite values and neighbours have no midpoint

    return [[between(a, b) for a, b in zip(known[i], known[i][1:], strict=False)] if i in known else sorted(set(many[i])) for i in range(width)]


def matrix(column: pa.Array) -> np.ndarray:
    if column.null_count:
        raise ValueError("a row has no features")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def joined(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    """The values of a binary column's rows, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def coded(rows: DataFrame, edges: Sequence[Sequence[float]], code: np.dtype, number: int, *keep: str) -> DataFrame:
    """``x`` as bin numbers, in a few blocks of about ``BLOCK`` rows, with ``row`` where there is none; written."""
    ends = [np.array(e, dtype=float) for e in edges]
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*keep).schema}

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                codes = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(ends)], axis=1).astype(code)
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes]), *b.columns[1:]], names=["codes", *keep])

    made = rows.select("x", *keep).mapInArrow(bins, ", ".join(["codes binary", *[f"{n} {k}" for n, k in kinds.items()]]))
    blocks = made.repartition(1 + number // BLOCK).withColumn("block", F.spark_partition_id())
    return stored(blocks if "row" in keep else blocks.withColumn("row", F.monotonically_increasing_id()))


def by_unit(rows: DataFrame, parts: Sequence[int], blocks: int):
    """``rows`` beside every part of the trees, grouped by block and part."""
    beside = rows.withColumn("part", F.explode(F.array(*[F.lit(p) for p in parts])))
    return beside.repartition(blocks * len(parts), "block", "part").groupBy("block", "part")


def trees_of(part: int, s: Settings) -> range:
    return range(part * TREES_AT_ONCE, min(s.trees, (part + 1) * TREES_AT_ONCE))


def fitted(forest: RandomForestClassifier, train: DataFrame, classes: int) -> ForestModel:
    """``forest`` grown on ``train``, whose labels are numbers below ``classes``."""
    for p in ("thresholds", "leafCol"):
        if forest.isSet(p) and forest.getOrDefault(p):
            raise ValueError(f"{p} is not supported")
    spark = train.sparkSession
    rows = stored(train.select(vector_to_array(forest.getFeaturesCol()).alias("x"), F.col(forest.getLabelCol()).cast("int").alias("label"), F.col(forest.getWeightCol()).cast("double").alias("weight")))
    number, weight = rows.agg(F.count(F.lit(1)), F.sum("weight")).first()
    edges = edges_of(rows, forest.getMaxBins())
    s = Settings(
        trees=forest.getNumTrees(), depth=forest.getMaxDepth(), bins=forest.getMaxBins(), width=len(edges), tried=tried(forest.getFeatureSubsetStrategy(), len(edges), forest.getNumTrees()), classes=classes,
        least_rows=forest.getMinInstancesPerNode(), least_gain=forest.getMinInfoGain(), least_weight=forest.getMinWeightFractionPerNode() * weight, impurity=forest.getImpurity(),
        rate=forest.getSubsamplingRate(), bootstrap=forest.getBootstrap(), seed=forest.getSeed() & MASK,
    )
    blocks = 1 + number // BLOCK
    table = coded(rows, edges, s.code, number, "label", "weight")
    parts = range(-(-s.trees // TREES_AT_ONCE))
    top, leaves, splits = _top(table, blocks, number, s)
    shared = spark.sparkContext.broadcast(top)

    def packs(key: tuple, t: pa.Table) -> pa.Table:
        codes, label, w, row = _unit(t, s)
        out = []
        for tree in trees_of(key[1].as_py(), s):
            n, at = drawn(row, tree, s), shared.value.routed(codes, tree)
            order = np.flatnonzero((n > 0) & (shared.value.feature[at] == GROWN))
            order = order[np.argsort(at[order], kind="stable")]
            out += [(int(at[i[0]]), codes[i].tobytes(), label[i].tobytes(), (w[i] * n[i]).tobytes(), n[i].tobytes()) for i in _runs(order, at)]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [()] * 5, [pa.int64(), *[pa.binary()] * 4], strict=True)], names=["node", "codes", "label", "weight", "n"])

    def grow(key: tuple, t: pa.Table) -> pa.Table:
        node = key[0].as_py()
        codes = joined(t["codes"], s.code).reshape(-1, s.width)
        rest = grown_rest(codes, joined(t["label"], np.dtype(np.int32)), joined(t["weight"], np.dtype(float)), joined(t["n"], np.dtype(np.int32)), int(shared.value.depth[node]), s, np.random.default_rng([s.seed, 2, node]))
        return pa.Table.from_pylist([packed(rest) | {"node": node, "tree": int(shared.value.tree[node])}], schema=_NODES)

    small = int((top.feature == GROWN).sum())
    met = by_unit(table, parts, blocks).applyInArrow(packs, "node long, codes binary, label binary, weight binary, n binary")
    made = met.repartition(max(1, min(small, max(128, small // 32))), "node").groupBy("node").applyInArrow(grow, NODES)
    path = scratch(spark, "tables")
    made.write.parquet(path)
    nodes = spark.read.schema(NODES).parquet(path)
    single = {r.node: int(np.frombuffer(r.votes).argmax()) for r in nodes.where("size = 1").select("node", "votes").collect()} if len(top.feature) > s.trees else {}
    top, leaves, importance = _merged(top, splits, single | {i: int(v.argmax()) for i, v in leaves.items()}, leaves, s)
    one = {"size": 1, "feature": np.array([-1]), "cut": np.array([0]), "left": np.array([0]), "value": np.array([0]), "importance": np.zeros(s.width)}
    rest = [packed(one | {"votes": v / v.sum()}) | {"node": i, "tree": int(top.tree[i])} for i, v in leaves.items()]
    rest += [packed(one | {"size": 0, "votes": np.empty(0), "importance": v}) | {"node": None, "tree": i} for i, v in importance.items()]
    if rest:
        spark.createDataFrame([tuple(r[x] for x in _NODES.names) for r in rest], NODES).write.mode("append").parquet(path)
    return ForestModel(spark.read.schema(NODES).parquet(path), top, edges, s, range(s.trees), forest.getFeaturesCol())


def _merged(top: Top, splits: dict, said: dict[int, int], leaves: dict[int, np.ndarray], s: Settings) -> tuple[Top, dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Large nodes whose children are leaves that ``said`` the same are leaves: the nodes, class weights of leaves, importance by tree."""
    feature, leaves, importance = top.feature.copy(), dict(leaves), {}
    for i, (gain, whole) in sorted(splits.items(), reverse=True):  # children come after their parents
        one, other = said.get(int(top.left[i])), said.get(int(top.left[i]) + 1)
        if one is not None and one == other:
            feature[i], leaves[i], said[i] = LEAF, whole, int(whole.argmax())
        else:
            importance.setdefault(int(top.tree[i]), np.zeros(s.width))[feature[i]] += gain * whole.sum()
    return Top(feature, top.cut, top.left, top.depth, top.tree), leaves, importance


_NODES = pa.schema([("node", pa.int64()), ("tree", pa.int32()), ("size", pa.int32()), *[(x, pa.binary()) for x in ("feature", "cut", "left", "value", "votes")], ("importance", pa.list_(pa.float64()))])


def _unit(t: pa.Table, s: Settings) -> tuple[np.ndarray, ...]:
    return joined(t["codes"], s.code).reshape(-1, s.width), *[t[x].to_numpy() for x in ("label", "weight", "row")]


def _runs(order: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """``order``, sorted by node, cut where the node changes."""
    return np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []


def _top(table: DataFrame, blocks: int, number: int, s: Settings) -> tuple[Top, dict[int, np.ndarray], dict[int, tuple[float, np.ndarray]]]:
    """Splits nodes of more than ``SMALL`` rows, a level at a time: the nodes, class weights of large leaves, gain and class weights of what was split."""
    top, leaves, splits = Top.roots(s.trees), {}, {}
    active = list(range(s.trees)) if number > SMALL else []
    while active:
        found = _best_splits(table, blocks, top, active, s)
        feature, cut, left, depth, tree = (x.tolist() for x in (top.feature, top.cut, top.left, top.depth, top.tree))
        active = []
        for r in found:
            whole = np.array(r.whole)
            if r.feature == LEAF:
                feature[r.node], leaves[r.node] = LEAF, whole
                continue
            feature[r.node], cut[r.node], left[r.node] = r.feature, r.cut, len(feature)
            splits[r.node] = r.gain, whole
            for n, sums in ((r.left_n, np.array(r.left)), (r.n - r.left_n, whole - np.array(r.left))):
                node, end = len(feature), depth[r.node] + 1 >= s.depth or impurity(sums, s.impurity) <= LEAST
                for column, x in zip((feature, cut, left, depth, tree), (LEAF if n > SMALL and end else GROWN, 0, 0, depth[r.node] + 1, tree[r.node]), strict=True):
                    column.append(x)
                if n > SMALL and end:
                    leaves[node] = sums
                elif n > SMALL:
                    active.append(node)
        top = Top(*(np.array(x, dtype=np.int64) for x in (feature, cut, left, depth, tree)))
    return top, leaves, splits


def _best_splits(table: DataFrame, blocks: int, top: Top, active: Sequence[int], s: Settings) -> list:
    """A row for each of the ``active`` nodes, in their order: its best split, class weights in all and on the left."""
    shared = table.sparkSession.sparkContext.broadcast((top, np.isin(np.arange(len(top.feature)), active)))
    cells, trees = s.tried * s.bins, set(top.tree[active].tolist())
    parts = sorted({i // TREES_AT_ONCE for i in trees})

    def counts(key: tuple, t: pa.Table) -> pa.Table:
        nodes, on = shared.value
        codes, label, weight, row = _unit(t, s)
        ids, found = [], []
        for tree in (i for i in trees_of(key[1].as_py(), s) if i in trees):
            n, at = drawn(row, tree, s), nodes.routed(codes, tree)
            rows = np.flatnonzero((n > 0) & on[at])
            own, which = np.unique(at[rows], return_inverse=True)
            tries = np.array([_tries(i, s) for i in own], dtype=np.int64).reshape(-1, s.tried)
            cell = ((which[:, None] * s.tried + np.arange(s.tried)) * s.bins + np.take_along_axis(codes[rows], tries[which], axis=1)).ravel()
            sums = np.bincount(cell * s.classes + np.repeat(label[rows], s.tried), np.repeat(weight[rows] * n[rows], s.tried), len(own) * cells * s.classes)
            bag = np.bincount(cell, np.repeat(n[rows], s.tried), len(own) * cells)
            ids += own.tolist()
            found += [x.tobytes() for x in np.concatenate([sums.reshape(len(own), cells, s.classes), bag.reshape(len(own), cells, 1)], axis=2)]
        return pa.table({"node": pa.array(ids, pa.int64()), "counts": pa.array(found, pa.binary())})

    def best(key: tuple, t: pa.Table) -> pa.Table:
        node = key[0].as_py()
        run = np.cumsum(sum(np.frombuffer(x.as_py()).reshape(s.tried, s.bins, s.classes + 1) for x in t["counts"]), axis=1)
        left, left_n, whole, n = run[..., :-1], run[..., -1], run[0, -1, :-1], run[0, -1, -1]
        gain = gains(left, left_n, whole, n, s)
        i, j = np.unravel_index(gain.argmax(), gain.shape)
        feature = int(_tries(node, s)[i]) if gain[i, j] > -np.inf else LEAF
        return pa.table({"node": [node], "feature": [feature], "cut": [int(j)], "gain": [float(gain[i, j])], "n": [float(n)], "left_n": [float(left_n[i, j])], "whole": [whole.tolist()], "left": [left[i, j].tolist()]})

    made = by_unit(table, parts, blocks).applyInArrow(counts, "node long, counts binary").repartition(min(len(active), max(64, len(active) // 32)), "node")
    found = made.groupBy("node").applyInArrow(best, "node long, feature long, cut long, gain double, n double, left_n double, whole array<double>, left array<double>").collect()
    shared.unpersist()
    return sorted(found, key=lambda r: r.node)


def _tries(node: int, s: Settings) -> np.ndarray:
    return chosen(np.random.default_rng([s.seed, 1, int(node)]), 1, s)[0]


class Tree:
    """One tree of a forest, for the reader: its nodes are collected when they are asked for."""

    def __init__(self, forest: ForestModel, tree: int) -> None:
        self.forest, self.tree = forest, tree

    @property
    def toDebugString(self) -> str:  # noqa: N802, as Spark's trees have it
        top, s = self.forest.top, self.forest.settings
        rest = {r.node: r for r in self.forest.nodes.where((F.col("tree") == self.tree) & F.col("node").isNotNull()).collect()}
        lines = []

        def told(deep: int, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, at: int, leaf) -> None:
            if feature[at] < 0:
                leaf(deep, at)
                return
            for sign, child in (("<=", left[at]), (">", left[at] + 1)):
                lines.append(f"{' ' * deep}{'If' if sign == '<=' else 'Else'} (feature {feature[at]} {sign} {self.forest.edges[feature[at]][cut[at]]})")
                told(deep + 1, feature, cut, left, child, leaf)

        def below(deep: int, node: int) -> None:
            if node in rest:
                feature, cut, left, value, votes = opened(rest[node].asDict(), s)
                told(deep, feature, cut, left, 0, lambda d, at: lines.append(f"{' ' * d}Predict: {float(votes[value[at]].argmax())}"))

        told(1, top.feature, top.cut, top.left, self.tree, below)
        return "\n".join([f"Tree {self.tree}", *lines])


def opened(row: dict, s: Settings) -> tuple[np.ndarray, ...]:
    """Feature, cut, left child and value of each node, and the votes that values stand for."""
    return *[np.frombuffer(row[x], dtype=np.int32).astype(np.int64) for x in ("feature", "cut", "left", "value")], np.frombuffer(row["votes"]).reshape(-1, s.classes)


class ForestModel(Model, MLWritable, MLReadable):
    """A fitted forest, or some trees of it: large nodes here, the rest of the trees in the table ``nodes``."""

    def __init__(self, nodes: DataFrame | None = None, top: Top | None = None, edges: Sequence[Sequence[float]] = (), settings: Settings | None = None, trees: range = range(0), features: str = "features") -> None:
        super().__init__()
        self.nodes, self.top, self.edges, self.settings, self._trees, self.features = nodes, top, edges, settings, trees, features

    @property
    def getNumTrees(self) -> int:  # noqa: N802, as Spark's forests have it
        return len(self._trees)

    @property
    def trees(self) -> list[Tree]:
        return [Tree(self, t) for t in self._trees]

    @property
    def parts(self) -> list[ForestModel]:
        """The forest in parts of ``TREES_AT_ONCE`` trees: a row's votes are the sum of theirs."""
        own = [self._trees[i : i + TREES_AT_ONCE] for i in range(0, len(self._trees), TREES_AT_ONCE)]
        return [ForestModel(self.nodes, self.top, self.edges, self.settings, t, self.features) for t in own]

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """The mean of the trees' shares of gain in each feature."""
        own = self.nodes.where(F.col("tree").isin(list(self._trees))).select("tree", F.posexplode("importance").alias("i", "gain"))
        by_tree = own.groupBy("tree", "i").agg(F.sum("gain").alias("gain"))
        whole = by_tree.groupBy("tree").agg(F.sum("gain").alias("whole"))
        shares = np.zeros(self.settings.width)
        for r in by_tree.join(whole.where("whole > 0"), "tree").groupBy("i").agg(F.sum(F.col("gain") / F.col("whole")).alias("share")).collect():  # a row for each feature
            shares[r.i] = r.share
        return DenseVector(shares / (shares.sum() or 1.0))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Numbers and writes the rows, and joins their votes to them."""
        s, shared = self.settings, dataset.sparkSession.sparkContext.broadcast(self.top)
        parts = sorted({t // TREES_AT_ONCE for t in self._trees})
        rows = stored(dataset.withColumn("_row", F.monotonically_increasing_id()))
        number = rows.count()
        blocks = 1 + number // BLOCK
        table = coded(rows.select(vector_to_array(self.features).alias("x"), F.col("_row").alias("row")), self.edges, s.code, number, "row")
        own = set(self._trees)

        def packs(key: tuple, t: pa.Table) -> pa.Table:
            codes, row = joined(t["codes"], s.code).reshape(-1, s.width), t["row"].to_numpy()
            out = []
            for tree in trees_of(key[1].as_py(), s):
                if tree in own:
                    at = shared.value.routed(codes, tree)
                    out += [(int(at[i[0]]), key[0].as_py() // BLOCKS_AT_ONCE, row[i].tobytes(), codes[i].tobytes()) for i in _runs(np.argsort(at, kind="stable"), at)]
            return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [()] * 4, [pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], names=["node", "bundle", "row", "codes"])

        def votes(mine: pa.Table, tree: pa.Table) -> pa.Table:
            ids, kinds, shares = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0)]
            if tree.num_rows:
                feature, cut, left, value, leaf = opened(tree.to_pylist()[0], s)
                for row, codes in zip(mine["row"].to_pylist(), mine["codes"].to_pylist(), strict=True):
                    row, codes = np.frombuffer(row, dtype=np.int64), np.frombuffer(codes, dtype=s.code).reshape(-1, s.width)
                    found = leaf[value[routed(codes, feature, cut, left, np.zeros(len(row), dtype=np.int64))]]
                    i, kind = np.nonzero(found)
                    ids.append(row[i]), kinds.append(kind), shares.append(found[i, kind])
            return pa.table({"_row": np.concatenate(ids), "class": np.concatenate(kinds), "vote": np.concatenate(shares)})

        ends = int((self.top.feature < 0).sum())
        n = min(ends, max(128, ends // 32))
        met = by_unit(table, parts, blocks).applyInArrow(packs, "node long, bundle int, row binary, codes binary").repartition(n, "node", "bundle")
        bundles = F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // BLOCKS_AT_ONCE)))
        trees = self.nodes.where(F.col("node").isNotNull()).drop("importance").withColumn("bundle", bundles).repartition(n, "node", "bundle")
        cast = met.groupBy("node", "bundle").cogroup(trees.groupBy("node", "bundle")).applyInArrow(votes, "_row long, class long, vote double")
        sums = cast.groupBy("_row", "class").agg(F.sum("vote").alias("vote")).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("class", F.round("vote", 9)))).alias("_by"))
        out = rows.join(sums, "_row", "left").withColumn("_votes", F.transform(F.sequence(F.lit(0), F.lit(s.classes - 1)), lambda i: F.coalesce(F.try_element_at("_by", i.cast("long")), F.lit(0.0))))
        whole = F.nullif(F.aggregate("_votes", F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
        out = out.withColumns({"rawPrediction": array_to_vector("_votes"), "probability": array_to_vector(F.transform("_votes", lambda x: F.coalesce(x / whole, F.lit(0.0)))), "prediction": (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")})
        return out.drop("_row", "_by", "_votes")

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, forest: ForestModel) -> None:
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:  # noqa: N802
        f = self.forest
        more = {"settings": json.dumps(asdict(f.settings)), "edges": json.dumps(f.edges), "trees": [f._trees.start, f._trees.stop], "features": f.features}
        DefaultParamsWriter.saveMetadata(f, path, self.sparkSession, more)
        f.nodes.write.parquet(f"{path}/nodes")
        top = zip(range(len(f.top.feature)), *(x.tolist() for x in (f.top.feature, f.top.cut, f.top.left, f.top.depth, f.top.tree)), strict=True)
        self.sparkSession.createDataFrame(list(top), "node long, feature long, cut long, left long, depth long, tree long").write.parquet(f"{path}/top")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        spark: SparkSession = self.sparkSession
        found = DefaultParamsReader.loadMetadata(path, spark)
        rows = spark.read.parquet(f"{path}/top").orderBy("node").collect()
        top = Top(*(np.array([r[x] for r in rows], dtype=np.int64) for x in ("feature", "cut", "left", "depth", "tree")))
        out = ForestModel(spark.read.schema(NODES).parquet(f"{path}/nodes"), top, json.loads(found["edges"]), Settings(**json.loads(found["settings"])), range(*found["trees"]), found["features"])
        return out._resetUid(found["uid"])
