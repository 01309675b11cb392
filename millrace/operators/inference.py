"""Reporting statistics: seeds, argmax rows, variance shares, rank tests, cost and quality frontier."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Studentised range quantiles at 0.05 over sqrt(2), for 2 to 10 treatments.
NEMENYI_Q = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}


def metric_cells(runs: DataFrame, **fixed) -> DataFrame:
    """runs of one cell, such as task="binary", split="temporal"."""
    for c, v in fixed.items():
        runs = runs.where(F.col(c) == v)
    return runs


def explode_metrics(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics documents (config, metrics with a per_class map) as a summary and a per-class table."""
    summary = docs.select("config.*", *[F.col(f"metrics.{m}").alias(m) for m in ("macro_f1", "weighted_f1", "balanced_accuracy")])
    rows = docs.select("config.*", F.explode(F.map_entries("metrics.per_class")).alias("e"))
    per_class = rows.where(~F.col("e.key").isin("accuracy", "macro avg", "weighted avg", "<unseen>")).select(*[c for c in rows.columns if c != "e"], F.col("e.key").alias("class"), "e.value.*")
    return summary, per_class


def seed_summary(runs: DataFrame, by: list[str], score: str = "score", seed: str = "seed") -> DataFrame:
    """Mean, sample deviation and distinct seeds."""
    return runs.groupBy(*by).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.count_distinct(seed).alias("n_seeds"))


def spread(summary: DataFrame, by: list[str], value: str = "mean") -> DataFrame:
    """Greatest minus least mean."""
    return summary.groupBy(*by).agg((F.max(value) - F.min(value)).alias("spread"))


def best_per_group(df: DataFrame, by: list[str], score: str, name: str) -> DataFrame:
    """Best and worst ``name`` of each group by score (names break ties), their scores and the spread."""
    best = F.max(F.struct(F.col(score).alias("s"), F.col(name).alias("n")))
    worst = F.min(F.struct(F.col(score).alias("s"), F.col(name).alias("n")))
    return df.groupBy(*by).agg(best.alias("b"), worst.alias("w")).select(*by, F.col("b.n").alias("best"), F.col("b.s").alias("best_score"), F.col("w.n").alias("worst"), (F.col("b.s") - F.col("w.s")).alias("spread"))


def rank_of(df: DataFrame, score: str, name: str, wanted: str) -> DataFrame:
    """Place of one entity by descending score."""
    return df.withColumn("place", F.row_number().over(W.orderBy(F.desc(score), name))).where(F.col(name) == wanted).select(name, "place")


def cost_rollup(runs: DataFrame, by: str = "extractor") -> DataFrame:
    """Flows, wall seconds, storage, peak memory and rate."""
    return runs.groupBy(by).agg(F.sum("flows").alias("flows"), F.sum("wall_s").alias("wall_s"), F.sum("storage_mb").alias("storage_mb"), F.max("memory_gb").alias("memory_gb")).withColumn("flows_per_s", F.col("flows") / F.nullif(F.col("wall_s"), F.lit(0)))


def chained_rate(*rates: Column) -> Column:
    """Rate of steps run one after another."""
    return 1 / sum(1 / r for r in rates)


def pareto(points: DataFrame, rate: str, quality: str, name: str) -> DataFrame:
    """``optimal`` marks points whose quality is above that of all faster ones (names break ties of rate)."""
    before = W.orderBy(F.desc(rate), name).rowsBetween(W.unboundedPreceding, -1)
    return points.withColumn("optimal", F.coalesce(F.col(quality) > F.max(quality).over(before), F.lit(True)))


def average_rank(value: Column, by: list[str], descending: bool = True) -> Column:
    """Rank with ties averaged."""
    order = value.desc() if descending else value.asc()
    return F.rank().over(W.partitionBy(*by).orderBy(order)) + (F.count(F.lit(1)).over(W.partitionBy(*by, value)) - 1) / 2


def complete_blocks(scores: DataFrame, treatment: str = "tool", block: str = "block") -> DataFrame:
    """F8: blocks in which every treatment has a score."""
    k = scores.select(treatment).distinct().agg(F.count(F.lit(1)).alias("_k"))
    whole = scores.groupBy(block).agg(F.count_distinct(treatment).alias("_n")).join(F.broadcast(k), F.col("_n") == F.col("_k")).select(block)
    return scores.join(whole, block, "left_semi")


def friedman(scores: DataFrame, treatment: str = "tool", block: str = "block", score: str = "score") -> DataFrame:
    """Chi-square with tie correction and its upper tail ``p``, treatments and blocks, over complete blocks; higher scores rank first."""
    full = complete_blocks(scores, treatment, block).withColumn("rank", average_rank(F.col(score), [block]))
    ties = full.groupBy(block, score).agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    sums = full.groupBy(treatment).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    s = sums.agg(F.sum(F.col("r") * F.col("r")).alias("ssr"), F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).join(F.broadcast(ties), F.lit(True))
    k, n = F.col("k"), F.col("n")
    raw = 12 / (n * k * (k + 1)) * F.col("ssr") - 3 * n * (k + 1)
    out = s.select(k, n, (raw / (1 - F.col("ties") / (n * k * (k * k - 1)))).alias("chi_square"))
    return out.withColumn("p", F.udf(chi_square_tail, "double")("chi_square", (F.col("k") - 1).cast("int")))


def chi_square_tail(x: float | None, df: int | None) -> float | None:
    """Upper tail of chi-square with ``df`` degrees of freedom: an exponential or normal tail and a finite sum."""
    if x is None or df is None or df < 1 or math.isnan(x):
        return None
    if x <= 0:
        return 1.0
    half, a = x / 2, 0.5 if df % 2 else 1.0
    tail = math.erfc(math.sqrt(half)) if df % 2 else math.exp(-half)
    while a < df / 2:
        tail += math.exp(a * math.log(half) - half - math.lgamma(a + 1))
        a += 1
    return min(1.0, tail)


def nemenyi_quantile(k: int | None, alpha: float = 0.05) -> float | None:
    """The studentised range quantile over sqrt(2) for ``k`` treatments: the table's value, or found by bisection beyond it."""
    if k is None or k < 2:
        return None
    return NEMENYI_Q.get(k) or studentised_range(k, alpha)


def studentised_range(k: int, alpha: float = 0.05) -> float:
    def above(q: float) -> float:
        step, total = 0.02, 0.0
        for i in range(-400, 401 + int(q / step)):
            z = i * step
            inside = max(0.0, 0.5 * (math.erf(z / math.sqrt(2)) - math.erf((z - q) / math.sqrt(2))))
            total += step * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) * inside ** (k - 1)
        return 1 - k * total

    lo, hi = 0.0, 20.0
    while hi - lo > 1e-6:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if above(mid) > alpha else (lo, mid)
    return lo / math.sqrt(2)


def mean_ranks(scores: DataFrame, treatment: str = "tool", block: str = "block", score: str = "score") -> DataFrame:
    full = complete_blocks(scores, treatment, block).withColumn("rank", average_rank(F.col(score), [block]))
    return full.groupBy(treatment).agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("n_blocks"))


def nemenyi(scores: DataFrame, treatment: str = "tool", block: str = "block", score: str = "score") -> DataFrame:
    """Rank gaps of all pairs of treatments (a few names) and whether they exceed the critical difference."""
    r = mean_ranks(scores, treatment, block, score)
    k = F.count(F.lit(1)).over(W.partitionBy())
    r = r.withColumn("k", k)
    a, b = r.select(F.col(treatment).alias("a"), F.col("mean_rank").alias("ra"), "k", "n_blocks"), r.select(F.col(treatment).alias("b"), F.col("mean_rank").alias("rb"))
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b")).withColumn("gap", F.abs(F.col("ra") - F.col("rb")))
    q = F.lit(nemenyi_quantile(r.count())).cast("double")
    cd = q * F.sqrt(F.col("k") * (F.col("k") + 1) / (6 * F.col("n_blocks")))
    return pairs.select("a", "b", "gap", cd.alias("critical"), (F.col("gap") > cd).alias("differs"))


def wilcoxon(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Paired signed-rank test: pairs without zeros, W, normal p with tie correction, median difference, wins of b.

    Fewer than five pairs give null W and p.
    """
    d = pairs.select((F.col(b) - F.col(a)).alias("d"))
    overall = d.agg(F.count("d").alias("n_pairs"), F.median("d").alias("median_delta"), F.count_if(F.col("d") > 0).alias("wins"))
    nz = d.where("d <> 0").withColumn("size", F.abs("d"))
    sizes = nz.groupBy("size").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    w = W.orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    ranked = sizes.withColumn("rank", F.sum("t").over(w) - (F.col("t") - 1) / 2)
    s = ranked.agg(F.sum(F.col("rank") * F.col("up")).alias("plus"), F.sum(F.col("rank") * (F.col("t") - F.col("up"))).alias("minus"), F.sum("t").alias("n"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n = F.col("n")
    stat = F.least("plus", "minus")
    z = (stat - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    p = F.least(F.lit(1.0), 2 * normal_tail(F.abs(z)))
    return overall.join(F.broadcast(s), F.lit(True)).select("n_pairs", "median_delta", "wins", F.when(n >= 5, stat).alias("w"), F.when(n >= 5, p).alias("p"))


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0, as a continued fraction beyond 3 and a power series below."""
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    fraction = z
    for k in range(60, 0, -1):
        fraction = z + k / fraction if k < 60 else z + 60 / (z + 1)
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(z.alias("t"), z.alias("s")), lambda a, k: F.struct((a["t"] * z * z / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * z * z / (2 * k + 1)).alias("s")))
    return F.when(z > 3, density / fraction).otherwise(0.5 - density * terms["s"])


def kendall_tau(scores: DataFrame, tool: str = "tool", model: str = "model", score: str = "score") -> DataFrame:
    """Tau-b of the models' order for each pair of tools."""
    s = scores.select(F.col(tool).alias("tool"), F.col(model).alias("model"), F.col(score).alias("score"))
    x = s.join(s.select("tool", F.col("model").alias("other"), F.col("score").alias("other_score")), "tool").where("model < other")
    d = x.select("tool", "model", "other", F.sign(F.col("score") - F.col("other_score")).alias("d"))
    pairs = d.select(F.col("tool").alias("a"), "model", "other", F.col("d").alias("da")).join(d.select(F.col("tool").alias("b"), "model", "other", F.col("d").alias("db")), ["model", "other"]).where("a < b")
    return pairs.groupBy("a", "b").agg((F.sum(F.col("da") * F.col("db")) / F.sqrt(F.sum(F.col("da") * F.col("da")) * F.sum(F.col("db") * F.col("db")))).alias("tau"))


def kendall_summary(taus: DataFrame) -> DataFrame:
    return taus.agg(F.avg("tau").alias("mean_tau"), F.min("tau").alias("min_tau"))


def variance_shares(cells: DataFrame, factors: list[str], score: str = "score", most_pairs: int = 1_000_000) -> DataFrame:
    """Type-II sum of squares of each factor, of the residual, and percent of their sum.

    A factor's sum is what the residual of the fit to all factors grows by without it; cells may be of any size. Only
    counts and sums of levels and of pairs of levels come to the driver, ``most_pairs`` of them or an error. Factors of
    one level are left out; fewer than ten scores give no result, null scores don't count.
    """
    scored = cells.where(F.col(score).isNotNull())
    grand = scored.agg(F.avg(F.col(score).cast("double"))).first()[0] or 0.0
    level = [F.col(f).cast("string") for f in factors]
    pairs = [F.struct(F.lit(i).alias("i"), level[i].alias("a"), F.lit(j).alias("j"), level[j].alias("b")) for i in range(len(factors)) for j in range(i, len(factors))]
    d = scored.select((F.col(score).cast("double") - F.lit(grand)).alias("d"), F.explode(F.array(*pairs)).alias("p"))
    sums = d.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss")).limit(most_pairs + 1).collect()
    if len(sums) > most_pairs:
        raise ValueError(f"more than {most_pairs} pairs of levels")
    own = [r for r in sums if r["p"]["i"] == r["p"]["j"]]
    first = [r for r in own if r["p"]["i"] == 0]
    rows = sum(r["n"] for r in first)
    at = {(r["p"]["i"], r["p"]["a"]): k for k, r in enumerate(sorted(own, key=lambda r: (r["p"]["i"], r["p"]["a"] or "")), 1)}
    normal, right = np.zeros((len(at) + 1, len(at) + 1)), np.zeros(len(at) + 1)
    normal[0, 0], right[0] = rows, sum(r["s"] for r in first)
    for r in sums:
        x, y = at[r["p"]["i"], r["p"]["a"]], at[r["p"]["j"], r["p"]["b"]]
        normal[x, y] = normal[y, x] = r["n"]
        if x == y:
            normal[0, x] = normal[x, 0] = r["n"]
            right[x] = r["s"]
    used = [i for i in range(len(factors)) if sum(k == i for k, _ in at) > 1]

    def residual(chosen: list[int]) -> float:
        c = [0] + [k for (i, _), k in at.items() if i in chosen]
        return sum(r["ss"] for r in first) - float(right[c] @ np.linalg.lstsq(normal[np.ix_(c, c)], right[c], rcond=None)[0])

    out = []
    if rows >= 10:
        rest = max(0.0, residual(used))
        out = [(factors[i], max(0.0, residual([k for k in used if k != i]) - rest)) for i in used] + [("residual", rest)]
    whole = sum(x for _, x in out)
    return cells.sparkSession.createDataFrame([(f, x, 100 * x / whole if whole else None) for f, x in out], "factor string, sum_sq double, percent double")
