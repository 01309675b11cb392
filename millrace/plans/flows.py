"""Queries on assembly, alignment and profiling of flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import alignment as al
from millrace.operators import profiling as pr
from millrace.operators import sessions as se
from millrace.operators.ranges import stored
from millrace.plans.common import ACTIVE, IDLE, SECOND, active_sql, flows, flows_sql, packets, packets_sql, sessions_sql

FLOW_COLUMNS = ["row_id", "src_ip", "src_port", "dst_ip", "dst_port", "t_start_us", "t_end_us", "n_pkts", "n_bytes", "pkts_fwd", "pkts_bwd", "bytes_fwd", "bytes_bwd", "label"]
MID, LONG = IDLE[2], IDLE[3]
TOOLS = {"t15": IDLE[0], "t60": IDLE[1], "t120": IDLE[2]}
CLASSES = ["view", "click", "purchase", "signup", "error"]


def flow_assembly_idle(spark, d):
    return flows(spark, d, MID).select(*FLOW_COLUMNS)


def flow_assembly_idle_active(spark, d):
    return flows(spark, d, LONG, ACTIVE).select(*FLOW_COLUMNS)


def flow_packet_sequence(spark, d):
    return _sequence(spark, d, 8)


def flow_packet_sequence_full(spark, d):
    return _sequence(spark, d, 32)


def _sequence(spark, d, n):
    f = flows(spark, d, MID, sequence=n)
    return f.select("row_id", F.array_join(F.col("dirs").cast("array<string>"), ",").alias("dirs"), F.array_join(F.col("sizes").cast("array<string>"), ",").alias("sizes"), F.array_max("times").alias("last_time"))


def flag_counters(spark, d):
    f = flows(spark, d, MID, extra=se.flag_counters())
    return f.select("row_id", *[f"{x}_{y}" for x in ("syn", "fin", "rst", "psh", "ack", "urg", "ece", "cwr") for y in ("fwd", "bwd")])


def spec_aggregation(spark, d):
    spec = {"keys": ["src_ip", "dst_ip"], "bidirectional": False, "idle": IDLE[1], "active": ACTIVE, "features": {"n": "count(*)", "bytes": "sum(wire_len)", "first_us": "min(ts_us)"}}
    return se.aggregate_by_spec(packets(spark, d), spec).select("src_ip", "dst_ip", "session", "segment", "n", "bytes", "first_us")


def burst_table(spark, d):
    p = packets(spark, d).withColumn("direction", F.when(F.col("src_port") == 443, 1).otherwise(0))
    return se.bursts(p, ["user_id"], "direction", "frame_no", "ts_us", "wire_len")


def gap_windows(spark, d):
    e = packets(spark, d).select("user_id", (F.col("ts_us") / 1e6).alias("t"))
    return se.gap_windows(e, ["user_id"], "t", IDLE[1], 30.0, clamp=True)


def timeout_sensitivity(spark, d):
    parts = None
    for t in IDLE:
        f = flows(spark, d, t).withColumn("day", F.floor(F.col("t_start_us") / (86400 * SECOND)))
        c = f.groupBy("day").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == "error").alias("error"))
        c = c.select(F.lit("idle").alias("tool"), "day", F.lit(t).alias("timeout"), F.explode(F.map_from_arrays(F.array(F.lit("total"), F.lit("error")), F.array("total", "error"))).alias("measure", "n"))
        parts = c if parts is None else parts.union(c)
    return pr.timeout_sensitivity(parts, list(IDLE)).select("tool", "measure", *[F.round(F.col(str(t)), 6).alias(f"idle_{t}") for t in IDLE])


def _tools(spark, d):
    out = None
    for name, idle in TOOLS.items():
        f = flows(spark, d, idle).withColumn("tool", F.lit(name))
        out = f if out is None else out.unionByName(f)
    # Alignment reads the flows several times.
    return stored(out.select("tool", "key", "row_id", "t_start_us", "t_end_us", "label", "n_pkts", "n_bytes", "pkts_bwd", "pkts_fwd", "bytes_fwd", "capture", (F.col("t_end_us") - F.col("t_start_us")).alias("duration_us")))


def align_categories(spark, d):
    f = _tools(spark, d)
    a, b = f.where("tool = 't60'"), f.where("tool = 't120'")
    return al.categories(a, al.overlap_pairs(a, b)).select("row_id", "category")


def align_pairs_11(spark, d):
    f = _tools(spark, d)
    return al.one_to_one(al.overlap_pairs(f.where("tool = 't15'"), f.where("tool = 't60'")))


def _summary(spark, d):
    return al.category_summary(al.align_all(_tools(spark, d)), ("tool_a", "tool_b"))


def align_summary(spark, d):
    return _summary(spark, d)


def agreement_matrix(spark, d):
    return al.agreement_matrix(_summary(spark, d), list(TOOLS))


def class_agreement(spark, d):
    return al.per_class(_summary(spark, d), CLASSES).select("class", "n", *[F.round(f"f_{c}", 6).alias(f"f_{c}") for c in ("1to1", "split", "merge", "unmatched")], "place")


def feature_divergence(spark, d):
    f = _tools(spark, d)
    a, b = f.where("tool = 't60'"), f.where("tool = 't120'")
    pairs = al.one_to_one(al.overlap_pairs(a, b))
    cols = ["n_pkts", "n_bytes", "duration_us"]
    left = a.select(F.col("row_id").alias("ia"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = b.select(F.col("row_id").alias("ib"), *[F.col(c).alias(f"b_{c}") for c in cols])
    out = pr.feature_divergence(pairs.join(left, "ia").join(right, "ib"), cols)
    return out.select("feature", "n", *[F.round(c, 6).alias(c) for c in ("median_err", "mean_abs_err", "within_5", "ks")])


def ks_two_sample(spark, d):
    p = packets(spark, d).where(F.col("event_type").isin("view", "click"))
    v = p.select((F.col("user_id") % 5).alias("grp"), F.when(F.col("event_type") == "view", "a").otherwise("b").alias("side"), F.col("wire_len").cast("double").alias("value"))
    return pr.ks_statistic(v, ["grp"]).select("grp", F.round("ks", 9).alias("ks"))


def flow_counts_ratio(spark, d):
    f = _tools(spark, d).withColumn("capture", F.concat(F.lit("d"), (F.floor(F.col("t_start_us") / (86400 * SECOND)) % 7).cast("string")))
    out = pr.flow_counts(f, list(TOOLS), "t120")
    return out.select("capture", *TOOLS, *[F.round(f"ratio_{t}", 6).alias(f"ratio_{t}") for t in TOOLS])


def attack_matrix(spark, d):
    return pr.class_matrix(_tools(spark, d), list(TOOLS), ["error", "purchase"])


def expected_vs_observed(spark, d):
    want = spark.createDataFrame([("error", 500), ("view", 1000), ("absent", 3), ("click", 0)], "label string, expected int")
    return pr.expected_vs_observed(flows(spark, d, MID), want)


def directionality(spark, d):
    return pr.directionality(_tools(spark, d)).select("tool", "n_bi", "n_uni", F.round("ratio", 6).alias("ratio"), F.round("one_way_share", 6).alias("one_way_share"))


def asof_nearest(spark, d):
    p = packets(spark, d).select("user_id", F.col("ts_us"), F.col("frame_no").alias("row_id"), "event_type")
    out = al.nearest(p.where("event_type = 'error'"), p.where("event_type = 'purchase'"), "user_id", "ts_us", ["event_type"])
    return out.select("row_id", "near_id", "near_t")


def _diff_sides(spark, d):
    f = _tools(spark, d).withColumn("t5", F.round(F.col("t_start_us") / 1e6, 5))
    return f.where("tool = 't60'"), f.where("tool = 't120'"), ["key", "t5"], ["n_pkts"]


def dataset_diff(spark, d):
    return al.set_difference(*_diff_sides(spark, d)).drop("match_rate")


def dataset_mismatches(spark, d):
    return al.mismatches(*_diff_sides(spark, d))


def flow_numbers(spark, d):
    return se.number_flows(flows(spark, d, LONG)).select("row_id", "flow_no")


_PK = packets_sql()
_ALL_TOOLS = ", ".join(f"{sessions_sql(i, 's' + n)}, {flows_sql('s' + n, 'f' + n)}" for n, i in TOOLS.items())
_FLOWS3 = f"{_PK}, {_ALL_TOOLS}, fl AS (" + " UNION ALL ".join(f"SELECT '{n}' AS tool, * FROM f{n}" for n in TOOLS) + ")"
_PAIRS = """pairs AS (
  SELECT a.tool AS tool_a, b.tool AS tool_b, a.row_id AS ia, b.row_id AS ib FROM fl a JOIN fl b ON a.key = b.key AND a.tool <> b.tool AND a.t_start_us <= b.t_end_us AND b.t_start_us <= a.t_end_us
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY tool_a, tool_b, ia) AS n_b, count(*) OVER (PARTITION BY tool_a, tool_b, ib) AS n_a FROM pairs
), per AS (SELECT tool_a, tool_b, ia, max(n_b) AS n_b, max(n_a) AS n_a FROM counted GROUP BY ALL
), cat AS (
  SELECT t.tool_a, t.tool_b, fl.row_id, fl.label, CASE WHEN n_b IS NULL THEN 'unmatched' WHEN n_b > 1 THEN 'split' WHEN n_a = 1 THEN '1:1' ELSE 'merge' END AS category
  FROM (SELECT DISTINCT a.tool AS tool_a, b.tool AS tool_b FROM fl a, (SELECT DISTINCT tool FROM fl) b WHERE a.tool <> b.tool) t JOIN fl ON fl.tool = t.tool_a
  LEFT JOIN per ON per.tool_a = t.tool_a AND per.tool_b = t.tool_b AND per.ia = fl.row_id
), summary AS (
  SELECT tool_a, tool_b, CASE WHEN grouping(label) = 1 THEN 'ALL' ELSE label END AS class, count(*) AS n,
    count(*) FILTER (WHERE category = '1:1') AS c_1to1, count(*) FILTER (WHERE category = 'split') AS c_split, count(*) FILTER (WHERE category = 'merge') AS c_merge, count(*) FILTER (WHERE category = 'unmatched') AS c_unmatched
  FROM cat GROUP BY GROUPING SETS ((tool_a, tool_b), (tool_a, tool_b, label))
)"""
_MID = f"WITH {_PK}, {sessions_sql(MID)}, {flows_sql()}"
_FLOW_LIST = ", ".join(FLOW_COLUMNS)
_FLAG_SQL = "".join(f", count(*) FILTER (WHERE {'fwd' if y == 'fwd' else 'NOT fwd'} AND tcp_flags & {m} <> 0) AS {x}_{y}" for x, m in (("syn", 2), ("fin", 1), ("rst", 4), ("psh", 8), ("ack", 16), ("urg", 32), ("ece", 64), ("cwr", 128)) for y in ("fwd", "bwd"))

QUERIES = {
    "flow_assembly_idle": (flow_assembly_idle, f"{_MID} SELECT {_FLOW_LIST} FROM f"),
    "flow_assembly_idle_active": (flow_assembly_idle_active, f"WITH RECURSIVE {_PK}, {sessions_sql(LONG)}, {active_sql(ACTIVE)}, {flows_sql('g')} SELECT {_FLOW_LIST} FROM f"),
    "flow_packet_sequence": (flow_packet_sequence, f"""WITH {_PK}, {sessions_sql(MID)}, {flows_sql()}, q AS (
  SELECT *, row_number() OVER w AS rn, first_value(ts_us) OVER w AS t0 FROM f_p WINDOW w AS (PARTITION BY user_id, session, segment ORDER BY frame_no)
) SELECT row_id, string_agg(CASE WHEN fwd THEN '0' ELSE '1' END, ',' ORDER BY frame_no) AS dirs, string_agg(CAST(wire_len AS VARCHAR), ',' ORDER BY frame_no) AS sizes, max(round((ts_us - t0) / 1e6, 6)) AS last_time
FROM q JOIN f USING (user_id, session, segment) WHERE rn <= 8 GROUP BY row_id"""),
    "flow_packet_sequence_full": (flow_packet_sequence_full, f"""WITH {_PK}, {sessions_sql(MID)}, {flows_sql()}, q AS (
  SELECT *, row_number() OVER w AS rn, first_value(ts_us) OVER w AS t0 FROM f_p WINDOW w AS (PARTITION BY user_id, session, segment ORDER BY frame_no)
) SELECT row_id, string_agg(CASE WHEN fwd THEN '0' ELSE '1' END, ',' ORDER BY frame_no) AS dirs, string_agg(CAST(wire_len AS VARCHAR), ',' ORDER BY frame_no) AS sizes, max(round((ts_us - t0) / 1e6, 6)) AS last_time
FROM q JOIN f USING (user_id, session, segment) WHERE rn <= 32 GROUP BY row_id"""),
    "flag_counters": (flag_counters, f"WITH {_PK}, {sessions_sql(MID)}, {flows_sql(more=_FLAG_SQL)} SELECT row_id, " + ", ".join(f"{x}_{y}" for x in ("syn", "fin", "rst", "psh", "ack", "urg", "ece", "cwr") for y in ("fwd", "bwd")) + " FROM f"),
    "spec_aggregation": (spec_aggregation, f"""WITH RECURSIVE e AS (SELECT *, CASE WHEN up THEN client ELSE '192.168.10.50' END AS src_ip, CASE WHEN up THEN '192.168.10.50' ELSE client END AS dst_ip FROM pk), {_PK}, x AS (
  SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY src_ip, dst_ip ORDER BY frame_no) > {IDLE[1] * SECOND} THEN 1 ELSE 0 END AS new FROM e
), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY src_ip, dst_ip ORDER BY frame_no) AS BIGINT) AS session FROM x
), r AS (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip, session ORDER BY frame_no) AS rn FROM s
), w AS (
  SELECT src_ip, dst_ip, session, rn, ts_us AS st, 0 AS seg FROM r WHERE rn = 1
  UNION ALL SELECT r.src_ip, r.dst_ip, r.session, r.rn, CASE WHEN r.ts_us - w.st > {ACTIVE * SECOND} THEN r.ts_us ELSE w.st END, w.seg + CASE WHEN r.ts_us - w.st > {ACTIVE * SECOND} THEN 1 ELSE 0 END
  FROM w JOIN r ON r.src_ip = w.src_ip AND r.dst_ip = w.dst_ip AND r.session = w.session AND r.rn = w.rn + 1
) SELECT src_ip, dst_ip, session, CAST(seg AS BIGINT) AS segment, count(*) AS n, CAST(sum(wire_len) AS BIGINT) AS bytes, min(ts_us) AS first_us FROM r JOIN w USING (src_ip, dst_ip, session, rn) GROUP BY src_ip, dst_ip, session, seg""".replace("WITH RECURSIVE e AS", f"WITH RECURSIVE {_PK}, e AS").replace(f"), {_PK}, x AS", "), x AS")),
    "burst_table": (burst_table, f"""WITH {_PK}, d AS (SELECT *, CASE WHEN up THEN 0 ELSE 1 END AS direction FROM pk
), t AS (SELECT *, CASE WHEN direction <> lag(direction) OVER (PARTITION BY user_id ORDER BY frame_no) THEN 1 ELSE 0 END AS turn FROM d
), r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY frame_no) AS run FROM t
), p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY frame_no) - 1) // 6 AS part FROM r
), g AS (SELECT user_id, run, part, min(direction) AS direction, CAST(sum(wire_len) AS BIGINT) AS bytes, count(*) AS packets, min(ts_us) AS a, max(ts_us) AS b FROM p GROUP BY ALL
), n AS (SELECT *, row_number() OVER w AS burst, coalesce((a - lag(b) OVER w) / 1e3, 0.0) AS gap_ms FROM g WINDOW w AS (PARTITION BY user_id ORDER BY run, part))
SELECT user_id, burst, direction, bytes, packets, gap_ms FROM n WHERE burst <= 12"""),
    "gap_windows": (gap_windows, f"""WITH {_PK}, x AS (SELECT user_id, ts_us / 1e6 AS t FROM pk
), y AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > {IDLE[1]} THEN 1 ELSE 0 END AS new FROM x
), z AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t) AS BIGINT) AS window_no FROM y
), w AS (SELECT user_id, window_no, min(t) - 30.0 AS w_start, max(t) + 30.0 AS e, count(*) AS n FROM z GROUP BY ALL)
SELECT user_id, window_no, w_start, least(e, (floor(w_start / 86400) + 1) * 86400 - 1) AS w_end, n FROM w"""),
    "timeout_sensitivity": (timeout_sensitivity, f"WITH {_PK}, " + ", ".join(f"{sessions_sql(t, f's{t}')}, {flows_sql(f's{t}', f'f{t}')}" for t in IDLE) + ", c AS (" + " UNION ALL ".join(f"SELECT t_start_us // {86400 * SECOND} AS day, {t} AS timeout, count(*) AS total, count(*) FILTER (WHERE label = 'error') AS error FROM f{t} GROUP BY 1" for t in IDLE) + "), m AS (SELECT timeout, 'total' AS measure, total AS n FROM c UNION ALL SELECT timeout, 'error', error FROM c) SELECT 'idle' AS tool, measure, " + ", ".join(f"round(avg(n) FILTER (WHERE timeout = {t}), 6) AS idle_{t}" for t in IDLE) + " FROM m GROUP BY measure"),
    "align_categories": (align_categories, f"WITH {_FLOWS3}, {_PAIRS} SELECT row_id, category FROM cat WHERE tool_a = 't60' AND tool_b = 't120'"),
    "align_pairs_11": (align_pairs_11, f"WITH {_FLOWS3}, {_PAIRS} SELECT ia, ib FROM counted WHERE tool_a = 't15' AND tool_b = 't60' AND n_a = 1 AND n_b = 1"),
    "align_summary": (align_summary, f"WITH {_FLOWS3}, {_PAIRS} SELECT *, round(c_1to1 / n, 4) AS f_1to1, round(c_split / n, 4) AS f_split, round(c_merge / n, 4) AS f_merge, round(c_unmatched / n, 4) AS f_unmatched FROM summary"),
    "agreement_matrix": (agreement_matrix, f"WITH {_FLOWS3}, {_PAIRS} SELECT tool_a, " + ", ".join(f"round(sum(c_1to1) FILTER (WHERE tool_b = '{t}') / sum(n) FILTER (WHERE tool_b = '{t}'), 6) AS {t}" for t in TOOLS) + " FROM summary WHERE class = 'ALL' GROUP BY tool_a"),
    "class_agreement": (class_agreement, f"WITH {_FLOWS3}, {_PAIRS} SELECT class, CAST(sum(n) AS BIGINT) AS n, " + ", ".join(f"round(sum(c_{c}) / sum(n), 6) AS f_{c}" for c in ("1to1", "split", "merge", "unmatched")) + ", list_position(['view', 'click', 'purchase', 'signup', 'error'], class) - 1 AS place FROM summary WHERE class <> 'ALL' GROUP BY class"),
    "feature_divergence": (feature_divergence, f"""WITH {_FLOWS3}, {_PAIRS}, m AS (
  SELECT a.n_pkts AS a1, b.n_pkts AS b1, a.n_bytes AS a2, b.n_bytes AS b2, a.t_end_us - a.t_start_us AS a3, b.t_end_us - b.t_start_us AS b3
  FROM counted c JOIN ft60 a ON a.row_id = c.ia JOIN ft120 b ON b.row_id = c.ib WHERE c.tool_a = 't60' AND c.tool_b = 't120' AND c.n_a = 1 AND c.n_b = 1
), l AS (SELECT 'n_pkts' AS feature, CAST(a1 AS DOUBLE) AS a, CAST(b1 AS DOUBLE) AS b FROM m UNION ALL SELECT 'n_bytes', a2, b2 FROM m UNION ALL SELECT 'duration_us', a3, b3 FROM m
), e AS (SELECT *, (b - a) / (abs(a) + 1) AS err FROM l
), v AS (SELECT feature, a AS x, 1 AS na, 0 AS nb FROM l UNION ALL SELECT feature, b, 0, 1 FROM l
), c1 AS (SELECT feature, x, sum(na) AS na, sum(nb) AS nb FROM v GROUP BY ALL
), k AS (SELECT feature, max(g) AS ks FROM (SELECT feature, abs(sum(na) OVER w / sum(na) OVER p - sum(nb) OVER w / sum(nb) OVER p) AS g FROM c1 WINDOW w AS (PARTITION BY feature ORDER BY x), p AS (PARTITION BY feature)) GROUP BY feature)
SELECT e.feature, count(*) AS n, round(median(err), 6) AS median_err, round(avg(abs(err)), 6) AS mean_abs_err, round(avg(CASE WHEN abs(err) < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS within_5, round(any_value(ks), 6) AS ks FROM e JOIN k USING (feature) GROUP BY e.feature"""),
    "ks_two_sample": (ks_two_sample, f"""WITH {_PK}, v AS (SELECT user_id % 5 AS grp, wire_len AS x, count(*) FILTER (WHERE event_type = 'view') AS na, count(*) FILTER (WHERE event_type = 'click') AS nb FROM pk WHERE event_type IN ('view', 'click') GROUP BY ALL
), g AS (SELECT grp, abs(sum(na) OVER w / sum(na) OVER p - sum(nb) OVER w / sum(nb) OVER p) AS g FROM v WINDOW w AS (PARTITION BY grp ORDER BY x), p AS (PARTITION BY grp)) SELECT grp, round(max(g), 9) AS ks FROM g GROUP BY grp"""),
    "flow_counts_ratio": (flow_counts_ratio, f"WITH {_FLOWS3}, c AS (SELECT 'd' || ((t_start_us // {86400 * SECOND}) % 7) AS capture, " + ", ".join(f"nullif(count(*) FILTER (WHERE tool = '{t}'), 0) AS {t}" for t in TOOLS) + " FROM fl GROUP BY 1) SELECT *, " + ", ".join(f"round({t} / coalesce(t120, t15, t60, t120), 6) AS ratio_{t}" for t in TOOLS) + " FROM c"),
    "attack_matrix": (attack_matrix, f"WITH {_FLOWS3} SELECT label, " + ", ".join(f"count(*) FILTER (WHERE tool = '{t}') AS {t}" for t in TOOLS) + ", CASE label WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS place FROM fl GROUP BY label"),
    "expected_vs_observed": (expected_vs_observed, f"{_MID}, w(label, expected) AS (VALUES ('error', 500), ('view', 1000), ('absent', 3), ('click', 0)) SELECT w.label, expected, count(f.row_id) AS observed, round(count(f.row_id) / nullif(expected, 0), 3) AS ratio FROM w LEFT JOIN f ON f.label = w.label GROUP BY w.label, expected"),
    "directionality": (directionality, f"WITH {_FLOWS3} SELECT tool, count(*) AS n_bi, CAST(sum(CASE WHEN pkts_bwd > 0 THEN 2 ELSE 1 END) AS BIGINT) AS n_uni, round(sum(CASE WHEN pkts_bwd > 0 THEN 2 ELSE 1 END) / count(*), 6) AS ratio, round(count(*) FILTER (WHERE pkts_bwd = 0) / count(*), 6) AS one_way_share FROM fl GROUP BY tool"),
    "asof_nearest": (asof_nearest, f"""WITH {_PK}, r AS (
  SELECT e.frame_no AS row_id, p.frame_no AS near_id, p.ts_us AS near_t, row_number() OVER (PARTITION BY e.frame_no ORDER BY abs(e.ts_us - p.ts_us), p.frame_no) AS rn
  FROM pk e LEFT JOIN pk p ON p.user_id = e.user_id AND p.event_type = 'purchase' WHERE e.event_type = 'error') SELECT row_id, near_id, near_t FROM r WHERE rn = 1"""),
    "dataset_diff": (dataset_diff, f"""WITH {_FLOWS3}, a AS (SELECT key, round(t_start_us / 1e6, 5) AS t5, min(n_pkts) AS n FROM ft60 GROUP BY ALL), b AS (SELECT key, round(t_start_us / 1e6, 5) AS t5, min(n_pkts) AS n FROM ft120 GROUP BY ALL)
SELECT count(*) FILTER (WHERE a.n IS NOT NULL AND b.n IS NOT NULL) AS n_both, count(*) FILTER (WHERE b.n IS NULL) AS only_a, count(*) FILTER (WHERE a.n IS NULL) AS only_b, count(*) FILTER (WHERE a.n = b.n) AS n_equal FROM a FULL JOIN b USING (key, t5)"""),
    "dataset_mismatches": (dataset_mismatches, f"""WITH {_FLOWS3}, a AS (SELECT key, round(t_start_us / 1e6, 5) AS t5, min(n_pkts) AS a_n_pkts FROM ft60 GROUP BY ALL), b AS (SELECT key, round(t_start_us / 1e6, 5) AS t5, min(n_pkts) AS b_n_pkts FROM ft120 GROUP BY ALL)
SELECT key, t5, a_n_pkts, b_n_pkts FROM a JOIN b USING (key, t5) WHERE a_n_pkts <> b_n_pkts ORDER BY key, t5 LIMIT 10"""),
    "flow_numbers": (flow_numbers, f"WITH {_PK}, {sessions_sql(LONG)}, {flows_sql()} SELECT row_id, row_number() OVER (ORDER BY t_start_us, least(src_ip, dst_ip), session) AS flow_no FROM f"),
}
