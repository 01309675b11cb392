"""Queries on reporting statistics, evaluation metrics and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import evaluation as ev
from millrace.operators import features as fe
from millrace.operators import inference as inf
from millrace.operators import profiling as pr
from millrace.operators import sampling as sa
from millrace.plans.common import table


def _cells(spark, d):
    """Mean order price by market segment (tool), priority (model) and region (seed)."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.groupBy(F.col("c_mktsegment").alias("tool"), F.col("o_orderpriority").alias("model"), F.col("n_regionkey").alias("seed")).agg(F.expr("(sum(CAST(round(o_totalprice * 100) AS BIGINT)) div count(*)) / 100.0D").alias("score"))


def seed_summary(spark, d):
    s = inf.seed_summary(_cells(spark, d), ["tool", "model"])
    return s.select("tool", "model", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n_seeds")


def seed_spread(spark, d):
    return inf.spread(inf.seed_summary(_cells(spark, d), ["tool", "model"]), ["model"]).select("model", F.round("spread", 6).alias("spread"))


def best_per_group(spark, d):
    s = inf.seed_summary(_cells(spark, d), ["tool", "model"]).withColumn("mean", F.round("mean", 4))
    return inf.best_per_group(s, ["tool"], "mean", "model").withColumn("spread", F.round("spread", 4))


def rank_of(spark, d):
    s = inf.seed_summary(_cells(spark, d), ["tool"]).withColumn("mean", F.round("mean", 4))
    return inf.rank_of(s, "mean", "tool", "BUILDING")


def _blocks(spark, d):
    return _cells(spark, d).withColumn("block", F.concat_ws("/", "model", F.col("seed").cast("string")))


def friedman_ranks(spark, d):
    return inf.friedman(_blocks(spark, d)).select("k", "n", F.round("chi_square", 6).alias("chi_square"))


def mean_ranks(spark, d):
    return inf.mean_ranks(_blocks(spark, d)).select("tool", F.round("mean_rank", 6).alias("mean_rank"), "n_blocks")


def nemenyi_cd(spark, d):
    return inf.nemenyi(_blocks(spark, d)).select("a", "b", F.round("gap", 6).alias("gap"), F.round("critical", 6).alias("critical"), "differs")


def _variants(spark, d):
    """The same configuration in two variants, joined on its full key."""
    c = _cells(spark, d)
    a = c.where("tool = 'BUILDING'").select("model", "seed", F.col("score").alias("a"))
    b = c.where("tool = 'MACHINERY'").select("model", "seed", F.col("score").alias("b"))
    return a.join(b, ["model", "seed"])


def wilcoxon(spark, d):
    w = inf.wilcoxon(_variants(spark, d))
    return w.select("n_pairs", F.round("median_delta", 4).alias("median_delta"), "wins", F.col("w").cast("double").alias("w"))


def kendall_tau(spark, d):
    s = inf.seed_summary(_cells(spark, d), ["tool", "model"]).select("tool", "model", F.round("mean", 4).alias("score"))
    return inf.kendall_tau(s).select("a", "b", F.round("tau", 6).alias("tau"))


def kendall_mean(spark, d):
    s = inf.seed_summary(_cells(spark, d), ["tool", "model"]).select("tool", "model", F.round("mean", 4).alias("score"))
    return inf.kendall_summary(inf.kendall_tau(s)).select(F.round("mean_tau", 6).alias("mean_tau"), F.round("min_tau", 6).alias("min_tau"))


def anova_share(spark, d):
    v = inf.variance_shares(_cells(spark, d), ["tool", "model", "seed"])
    return v.select("factor", F.round(F.col("sum_sq") / 1e6, 3).alias("sum_sq"), F.round("percent", 4).alias("percent"))


def _parts(spark, d):
    p = table(spark, d, "part")
    return p.groupBy(F.col("p_brand").alias("extractor")).agg(F.count(F.lit(1)).alias("flows"), F.sum("p_size").cast("double").alias("wall_s"), F.round(F.avg("p_retailprice"), 2).alias("quality"), F.max("p_size").cast("double").alias("memory_gb"), F.sum("p_size").cast("double").alias("storage_mb"))


def pareto(spark, d):
    c = inf.cost_rollup(_parts(spark, d)).withColumn("rate", F.round(inf.chained_rate(F.col("flows_per_s"), F.lit(50.0)), 6))
    out = inf.pareto(c.join(_parts(spark, d).select("extractor", "quality"), "extractor"), "rate", "quality", "extractor")
    return out.select("extractor", "rate", "quality", "optimal")


def cost_rollup(spark, d):
    return inf.cost_rollup(_parts(spark, d)).withColumn("flows_per_s", F.round("flows_per_s", 6))


def _scored(spark, d):
    lab, doc = table(spark, d, "labels"), table(spark, d, "documents")
    j = lab.join(doc.select("doc_id", "lang", "n_chars"), "doc_id")
    return j.select("doc_id", "lang", F.col("quality").alias("label"), F.round((F.col("n_chars") % 97) / 97.0 + F.col("quality") * 0.3, 2).alias("score"))


def average_precision(spark, d):
    m = ev.ranking_metrics(_scored(spark, d), ["lang"])
    return m.select("lang", F.round("average_precision", 9).alias("average_precision"), F.round("roc_auc", 9).alias("roc_auc"))


def _predicted(spark, d):
    s = _scored(spark, d)
    return s.select(F.col("lang").alias("truth"), F.when(F.col("doc_id") % 5 == 0, "en").when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")).alias("predicted"))


def _classes(spark, d):
    return table(spark, d, "documents").where("lang <> 'es'").select(F.col("lang").alias("class")).distinct()


def confusion(spark, d):
    return ev.confusion(_predicted(spark, d), _classes(spark, d))


def class_report(spark, d):
    r = ev.class_report(ev.confusion(_predicted(spark, d), _classes(spark, d)))
    return r.select("class", "support", "predicted", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def report_summary(spark, d):
    r = ev.class_report(ev.confusion(_predicted(spark, d), _classes(spark, d)))
    parts = [ev.summary(r, kind).select(F.lit(kind).alias("labels"), *[F.round(c, 9).alias(c) for c in ("macro_f1", "weighted_f1", "balanced_accuracy")]) for kind in ("train", "union")]
    return parts[0].union(parts[1])


def binary_rates(spark, d):
    s = _scored(spark, d).select(F.when(F.col("label") == 1, "ATTACK").otherwise("BENIGN").alias("truth"), F.when(F.col("score") > 0.6, "ATTACK").otherwise("BENIGN").alias("predicted"))
    return ev.binary_rates(s).select(*[F.round(c, 9).alias(c) for c in ("fpr", "attack_recall", "attack_precision")])


def stratified_split(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return sa.stratified_split(e, "label", "vec_id")


def class_cap(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), (F.col("vec_id") % 2).alias("half"))
    return sa.class_caps(e, "label", "vec_id", {"0": 5, "3": 7}, ("half",))


def proportional_cap(spark, d):
    return sa.cap_rows(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 60)


def k_shot(spark, d):
    return sa.k_shot(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 5, 2)


def down_sample(spark, d):
    return sa.down_sample(table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label")), "label", "0", 0.25, "vec_id")


def uniform_cap(spark, d):
    return sa.uniform_cap(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 100)


def temporal_split(spark, d):
    caps = spark.createDataFrame([("O", "train"), ("F", "test")], "capture string, split string")
    o = sa.temporal_split(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "capture"), caps)
    return o.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def aligned_pick(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    t = sa.aligned_pick({"even": e.where("vec_id % 2 = 0"), "third": e.where("vec_id % 3 = 0")}, "label", "vec_id", 4)
    return t["even"].withColumn("view", F.lit("even")).union(t["third"].withColumn("view", F.lit("third")))


LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def robust_scale(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LINE_COLUMNS)
    fitted = fe.preprocessing(li.where("l_orderkey % 3 <> 0"), LINE_COLUMNS)
    out = fe.preprocess(li, fitted, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in LINE_COLUMNS])


#: Native names, and the expressions over ``lineitem`` they stand for, in Spark and in DuckDB alike.
NATIVE = {
    "tool_order_id": "l_orderkey", "tool_qty": "l_quantity", "tool_const": "1", "tool_mode": "l_linestatus", "tool_tax": "CAST(l_tax AS STRING)", "tool_flag": "l_returnflag",
    "tool_src": "l_partkey", "tool_dport": "l_suppkey", "tool_Flow_Start": "l_discount", "tool_ts": "l_partkey % 7", "tool_name_len": "length(l_returnflag)", "tool_portal": "l_linenumber",
    "tool_rare": "CASE WHEN l_linenumber = 1 THEN l_quantity END", "tool_half": "CASE WHEN l_linenumber < 5 THEN CAST(l_discount AS STRING) ELSE 'x' END",
}


def native_feature_filter(spark, d):
    """P15 over all rows of lineitem: (name, kept)."""
    li = table(spark, d, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in NATIVE.items()])
    kept = fe.native_columns(li)
    n = li.agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(c in kept).alias("kept")) for c in NATIVE])).alias("x"), "n").select("x.*", "n")


_NATIVE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS name, NOT regexp_matches('{c[5:]}', '{fe.ID_LIKE.pattern}', 'i') AND count(TRY_CAST(x AS DOUBLE)) >= 0.5 * count(*) AND coalesce(min(TRY_CAST(x AS DOUBLE)) <> max(TRY_CAST(x AS DOUBLE)), false) AS kept, count(*) AS n FROM (SELECT {e} AS x FROM lineitem)"
    for c, e in NATIVE.items()
)


def transfer_summary(spark, d):
    c = _cells(spark, d).select(F.col("tool").alias("source"), F.col("model"), "score").withColumn("target", F.when(F.col("model").startswith("1"), F.col("source")).otherwise(F.col("model")))
    return pr.transfer_summary(c).select(*[F.round(x, 4).alias(x) for x in ("diagonal", "off_diagonal", "drop")])


def ablation_delta(spark, d):
    c = _cells(spark, d).select(F.lit("t").alias("tool"), "model", F.col("tool").alias("ablation"), F.lit("binary").alias("task"), F.lit("s").alias("split"), "seed", F.col("score").alias("macro_f1"))
    base = c.where("ablation = 'BUILDING'")
    return pr.ablation_delta(c.where("ablation <> 'BUILDING'"), base).select("ablation", "task", "split", "n", F.round("mean_delta", 4).alias("mean_delta"), F.round("median_delta", 4).alias("median_delta"))


def recall_pivot(spark, d):
    c = _cells(spark, d).select("tool", F.substring("model", 1, 1).alias("class"), F.col("score").alias("recall"))
    return pr.recall_pivot(c, ["1", "2", "3"]).select("tool", *[F.round(x, 4).alias(f"class_{x}") for x in ("1", "2", "3")])


def generalisation_gap(spark, d):
    c = _cells(spark, d).select("model", F.col("tool").alias("source"), F.lit("all").alias("target"), "seed", F.when(F.col("seed") % 2 == 0, "in").otherwise("cross").alias("kind"), F.when(F.col("seed") == 4, float("nan")).otherwise(F.col("score")).alias("score")).withColumn("seed", F.floor(F.col("seed") / 2))
    return pr.generalisation_gap(c).select("model", "source", "target", F.round("collapse", 4).alias("collapse"))


_C = "cells AS (SELECT c_mktsegment AS tool, o_orderpriority AS model, n_regionkey AS seed, CAST(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) // count(*) AS DOUBLE) / 100.0 AS score FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"
_S = f"{_C}, sm AS (SELECT tool, model, avg(score) AS mean, stddev_samp(score) AS std, count(DISTINCT seed) AS n_seeds FROM cells GROUP BY ALL)"
_B = f"""{_C}, bl AS (SELECT *, model || '/' || seed AS block FROM cells), ok AS (SELECT block FROM bl GROUP BY block HAVING count(DISTINCT tool) = (SELECT count(DISTINCT tool) FROM bl)
), rk AS (SELECT *, rank() OVER (PARTITION BY block ORDER BY score DESC) + (count(*) OVER (PARTITION BY block, score) - 1) / 2 AS rank FROM bl WHERE block IN (SELECT block FROM ok)
), mr AS (SELECT tool, avg(rank) AS mean_rank, sum(rank) AS r, count(*) AS n_blocks FROM rk GROUP BY tool)"""
_SC = "sc AS (SELECT l.doc_id, lang, quality AS label, round((n_chars % 97) / 97.0 + quality * 0.3, 2) AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
_PR = f"""{_SC}, pd AS (SELECT lang AS t, CASE WHEN doc_id % 5 = 0 THEN 'en' WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS p FROM sc
), kc AS (SELECT DISTINCT lang AS class FROM documents WHERE lang <> 'es'), allc AS (SELECT class FROM kc UNION ALL SELECT '<unseen>'
), m AS (SELECT CASE WHEN t IN (SELECT class FROM kc) THEN t ELSE '<unseen>' END AS truth, CASE WHEN p IN (SELECT class FROM kc) THEN p ELSE '<unseen>' END AS predicted, count(*) AS n FROM pd GROUP BY ALL
), cm AS (SELECT a.class AS truth, b.class AS predicted, coalesce(n, 0) AS n FROM allc a CROSS JOIN allc b LEFT JOIN m ON m.truth = a.class AND m.predicted = b.class
), rp AS (SELECT c.class, CAST(sum(n) FILTER (WHERE truth = c.class) AS BIGINT) AS support, CAST(sum(n) FILTER (WHERE predicted = c.class) AS BIGINT) AS predicted, CAST(sum(n) FILTER (WHERE truth = c.class AND predicted = c.class) AS BIGINT) AS hit FROM cm, allc c GROUP BY c.class
), rr AS (SELECT class, support, predicted, coalesce(hit / nullif(predicted, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall FROM rp
), rf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM rr)"""
_E = "e AS (SELECT vec_id, label, vec_id % 2 AS half FROM embeddings)"


def _h(seed: int, c: str = "vec_id") -> str:
    """The order of sampling: the first 32 bits of the MD5 of seed and id, then the id."""
    return f"{_bits(seed, c)}, {c}"


def _bits(seed: int, c: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({c} AS VARCHAR)), 1, 8) AS BIGINT)"


_P = "pt AS (SELECT p_brand AS extractor, count(*) AS flows, CAST(sum(p_size) AS DOUBLE) AS wall_s, CAST(sum(p_size) AS DOUBLE) AS storage_mb, CAST(max(p_size) AS DOUBLE) AS memory_gb, round(avg(p_retailprice), 2) AS quality FROM part GROUP BY 1)"

QUERIES = {
    "seed_summary": (seed_summary, f"WITH {_S} SELECT tool, model, round(mean, 6) AS mean, round(std, 6) AS std, n_seeds FROM sm"),
    "seed_spread": (seed_spread, f"WITH {_S} SELECT model, round(max(mean) - min(mean), 6) AS spread FROM sm GROUP BY model"),
    "best_per_group": (best_per_group, f"WITH {_S}, r AS (SELECT tool, model, round(mean, 4) AS mean FROM sm) SELECT tool, arg_max(model, (mean, model)) AS best, max(mean) AS best_score, arg_min(model, (mean, model)) AS worst, round(max(mean) - min(mean), 4) AS spread FROM r GROUP BY tool"),
    "rank_of": (rank_of, f"WITH {_C}, t AS (SELECT tool, round(avg(score), 4) AS mean FROM cells GROUP BY tool), r AS (SELECT tool, row_number() OVER (ORDER BY mean DESC, tool) AS place FROM t) SELECT tool, place FROM r WHERE tool = 'BUILDING'"),
    "friedman_ranks": (friedman_ranks, f"WITH {_B}, ti AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*) AS t FROM rk GROUP BY block, score)), s AS (SELECT sum(r * r) AS ssr, count(*) AS k, max(n_blocks) AS n FROM mr) SELECT k, n, round((12 / (n * k * (k + 1)) * ssr - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))), 6) AS chi_square FROM s, ti"),
    "mean_ranks": (mean_ranks, f"WITH {_B} SELECT tool, round(mean_rank, 6) AS mean_rank, n_blocks FROM mr"),
    "nemenyi_cd": (nemenyi_cd, f"WITH {_B}, q(k, q) AS (VALUES {', '.join(f'({k}, {v})' for k, v in inf.NEMENYI_Q.items())}), n AS (SELECT count(*) AS k, max(n_blocks) AS n FROM mr), p AS (SELECT a.tool AS a, b.tool AS b, abs(a.mean_rank - b.mean_rank) AS gap, CAST(q AS DOUBLE) * sqrt(n.k * (n.k + 1) / (6 * n.n)) AS cd FROM mr a JOIN mr b ON a.tool < b.tool, n JOIN q ON q.k = n.k) SELECT a, b, round(gap, 6) AS gap, round(cd, 6) AS critical, gap > cd AS differs FROM p"),
    "wilcoxon": (wilcoxon, f"WITH {_C}, d AS (SELECT b.score - a.score AS d FROM cells a JOIN cells b USING (model, seed) WHERE a.tool = 'BUILDING' AND b.tool = 'MACHINERY'), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS rk FROM d WHERE d <> 0), s AS (SELECT count(*) AS n, coalesce(sum(rk) FILTER (WHERE d > 0), 0) AS up, coalesce(sum(rk) FILTER (WHERE d < 0), 0) AS dn FROM r) SELECT (SELECT count(*) FROM d) AS n_pairs, (SELECT round(median(d), 4) FROM d) AS median_delta, (SELECT count(*) FROM d WHERE d > 0) AS wins, CASE WHEN n >= 5 THEN least(up, dn) END AS w FROM s"),
    "kendall_tau": (kendall_tau, f"WITH {_S}, r AS (SELECT tool, model, round(mean, 4) AS s FROM sm), d AS (SELECT x.tool, x.model AS m1, y.model AS m2, sign(x.s - y.s) AS d FROM r x JOIN r y ON x.tool = y.tool AND x.model < y.model) SELECT p.tool AS a, q.tool AS b, round(sum(p.d * q.d) / sqrt(sum(p.d * p.d) * sum(q.d * q.d)), 6) AS tau FROM d p JOIN d q ON p.m1 = q.m1 AND p.m2 = q.m2 AND p.tool < q.tool GROUP BY p.tool, q.tool"),
    "kendall_mean": (kendall_mean, f"WITH {_S}, r AS (SELECT tool, model, round(mean, 4) AS s FROM sm), d AS (SELECT x.tool, x.model AS m1, y.model AS m2, sign(x.s - y.s) AS d FROM r x JOIN r y ON x.tool = y.tool AND x.model < y.model), t AS (SELECT sum(p.d * q.d) / sqrt(sum(p.d * p.d) * sum(q.d * q.d)) AS tau FROM d p JOIN d q ON p.m1 = q.m1 AND p.m2 = q.m2 AND p.tool < q.tool GROUP BY p.tool, q.tool) SELECT round(avg(tau), 6) AS mean_tau, round(min(tau), 6) AS min_tau FROM t"),
    "anova_share": (anova_share, f"WITH {_C}, g AS (SELECT avg(score) AS g, count(*) AS n, sum(score * score) AS ss FROM cells), p AS (" + " UNION ALL ".join(f"SELECT '{f}' AS factor, sum(n * (m - (SELECT g FROM g)) ** 2) AS s FROM (SELECT avg(score) AS m, count(*) AS n FROM cells GROUP BY {f})" for f in ("tool", "model", "seed")) + "), a AS (SELECT * FROM p UNION ALL SELECT 'residual', (SELECT ss - n * g * g FROM g) - (SELECT sum(s) FROM p)) SELECT factor, round(s / 1e6, 3) AS sum_sq, round(100 * s / (SELECT sum(s) FROM a), 4) AS percent FROM a"),
    "pareto": (pareto, f"WITH {_P}, r AS (SELECT extractor, round(1 / (1 / (flows / wall_s) + 1 / 50.0), 6) AS rate, quality FROM pt) SELECT *, coalesce(quality > max(quality) OVER (ORDER BY rate DESC, extractor ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS optimal FROM r"),
    "cost_rollup": (cost_rollup, f"WITH {_P} SELECT extractor, flows, wall_s, storage_mb, memory_gb, round(flows / wall_s, 6) AS flows_per_s FROM pt"),
    "average_precision": (average_precision, f"""WITH {_SC}, c AS (SELECT lang, score, sum(label) AS pos, count(*) AS n FROM sc GROUP BY ALL
), r AS (SELECT lang, pos, n, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER p AS ap, sum(n) OVER p AS an FROM c WINDOW w AS (PARTITION BY lang ORDER BY score DESC), p AS (PARTITION BY lang)
), q AS (SELECT *, n - pos AS ng, (an - ap) - ((k - n) - (tp - pos)) - (n - pos) AS below FROM r)
SELECT lang, round(sum(pos / nullif(ap, 0) * tp / k), 9) AS average_precision, round(sum(pos * (below + ng / 2)) / nullif(max(ap) * (max(an) - max(ap)), 0), 9) AS roc_auc FROM q GROUP BY lang"""),
    "confusion": (confusion, f"WITH {_PR} SELECT truth, predicted, n FROM cm"),
    "class_report": (class_report, f"WITH {_PR} SELECT class, support, predicted, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM rf"),
    "report_summary": (report_summary, f"WITH {_PR} SELECT 'train' AS labels, round(avg(f1) FILTER (WHERE class <> '<unseen>'), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1, round(avg(recall) FILTER (WHERE support > 0), 9) AS balanced_accuracy FROM rf UNION ALL SELECT 'union', round(avg(f1) FILTER (WHERE support + predicted > 0), 9), round(sum(f1 * support) / sum(support), 9), round(avg(recall) FILTER (WHERE support > 0), 9) FROM rf"),
    "binary_rates": (binary_rates, f"WITH {_SC} SELECT " + ", ".join(f"round(coalesce(count(*) FILTER (WHERE {a}) / nullif(count(*) FILTER (WHERE {b}), 0), 0), 9) AS {n}" for n, a, b in (("fpr", "label = 0 AND score > 0.6", "label = 0"), ("attack_recall", "label = 1 AND score > 0.6", "label = 1"), ("attack_precision", "label = 1 AND score > 0.6", "score > 0.6"))) + " FROM sc"),
    "stratified_split": (stratified_split, f"WITH {_E}, r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_h(0)}) AS rn, count(*) OVER (PARTITION BY label) AS n FROM e) SELECT vec_id, label, CASE WHEN n < 2 OR rn <= round(0.7 * n) THEN 'train' ELSE 'test' END AS split FROM r"),
    "class_cap": (class_cap, f"WITH {_E}, r AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, half, row_number() OVER (PARTITION BY half, label ORDER BY {_h(0)}) AS rn FROM e) SELECT vec_id, label, half FROM r WHERE (label <> '0' OR rn <= 5) AND (label <> '3' OR rn <= 7)"),
    "proportional_cap": (proportional_cap, f"WITH {_E}, n AS (SELECT label, count(*) AS n FROM e GROUP BY label), q AS (SELECT label, CASE WHEN (SELECT sum(n) FROM n) <= 60 THEN n ELSE greatest(1, floor(n * 60 / (SELECT sum(n) FROM n))) END AS quota FROM n), r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_h(0)}) AS rn FROM e) SELECT vec_id, label FROM r JOIN q USING (label) WHERE rn <= quota"),
    "k_shot": (k_shot, f"WITH {_E}, r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_h(5002)}) AS rn FROM e) SELECT vec_id, label FROM r WHERE rn <= 5"),
    "down_sample": (down_sample, f"WITH {_E} SELECT vec_id, CAST(label AS VARCHAR) AS label FROM e WHERE label <> 0 OR {_bits(0, 'vec_id')} < 1073741824"),
    "uniform_cap": (uniform_cap, f"SELECT o_orderkey, o_orderstatus FROM orders ORDER BY {_h(0, 'o_orderkey')} LIMIT 100"),
    "temporal_split": (temporal_split, "SELECT CASE o_orderstatus WHEN 'O' THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1"),
    "aligned_pick": (aligned_pick, f"WITH {_E}, r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_h(0)}) AS rn FROM e WHERE vec_id % 6 = 0) SELECT vec_id, label, v.view FROM r, (VALUES ('even'), ('third')) v(view) WHERE rn <= 4"),
    "robust_scale": (robust_scale, "WITH t AS (SELECT * FROM lineitem WHERE l_orderkey % 3 <> 0), " + ", ".join(f"q{i} AS (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.01) AS lo, quantile_cont(CAST({c} AS DOUBLE), 0.99) AS hi FROM t), m{i} AS (SELECT lo, hi, avg(least(greatest(CAST({c} AS DOUBLE), lo), hi)) AS m, stddev_pop(least(greatest(CAST({c} AS DOUBLE), lo), hi)) AS s FROM t, q{i} GROUP BY lo, hi)" for i, c in enumerate(LINE_COLUMNS)) + " SELECT l_orderkey, l_linenumber, " + ", ".join(f"round((least(greatest(CAST({c} AS DOUBLE), m{i}.lo), m{i}.hi) - m{i}.m) / m{i}.s, 6) AS {c}" for i, c in enumerate(LINE_COLUMNS)) + " FROM lineitem, " + ", ".join(f"m{i}" for i in range(len(LINE_COLUMNS)))),
    "native_feature_filter": (native_feature_filter, _NATIVE_SQL),
    "transfer_summary": (transfer_summary, f"WITH {_C}, t AS (SELECT avg(score) FILTER (WHERE model[1] = '1') AS a, avg(score) FILTER (WHERE model[1] <> '1') AS b FROM cells) SELECT round(a, 4) AS diagonal, round(b, 4) AS off_diagonal, round(a - b, 4) AS \"drop\" FROM t"),
    "ablation_delta": (ablation_delta, f"WITH {_C} SELECT x.tool AS ablation, 'binary' AS task, 's' AS split, count(*) AS n, round(avg(x.score - y.score), 4) AS mean_delta, round(median(x.score - y.score), 4) AS median_delta FROM cells x JOIN cells y ON x.model = y.model AND x.seed = y.seed AND y.tool = 'BUILDING' WHERE x.tool <> 'BUILDING' GROUP BY x.tool"),
    "recall_pivot": (recall_pivot, f"WITH {_C} SELECT tool, " + ", ".join(f"round(avg(score) FILTER (WHERE model[1] = '{x}'), 4) AS class_{x}" for x in "123") + " FROM cells GROUP BY tool"),
    "generalisation_gap": (generalisation_gap, f"WITH {_C}, b AS (SELECT model, tool AS source, seed // 2 AS sd, max(score) FILTER (WHERE seed % 2 = 0 AND seed <> 4) AS i, max(score) FILTER (WHERE seed % 2 = 1) AS c FROM cells GROUP BY ALL) SELECT model, source, 'all' AS target, round(avg(i - c), 4) AS collapse FROM b GROUP BY model, source"),
}
