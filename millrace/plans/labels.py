"""Queries on rules, projections, keys, the contract and fidelity."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import flow as fn
from millrace.operators import contract as ct
from millrace.operators import labeling as lb
from millrace.operators import rule_index as ri
from millrace.operators.ranges import stored
from millrace.plans.common import IDLE, SECOND, flows, flows_sql, packets, packets_sql, sessions_sql

DAY0 = 1_704_067_200  # 2024-01-01 UTC
RULES = [
    {"label": "scan", "t_start": DAY0 + 86_400.0, "t_end": DAY0 + 3 * 86_400.0, "attackers": ["10.0.0.8", "10.0.0.46", "10.0.0.7"], "victims": ["192.168.10.50"], "protos": [6]},
    {"label": "flood", "t_start": DAY0 + 2 * 86_400.0, "t_end": DAY0 + 9 * 86_400.0, "attacker_cidrs": ["10.0.0.0/27"], "dst_ports": [443]},
    {"label": "leak", "t_start": DAY0 + 5 * 86_400.0, "t_end": DAY0 + 15 * 86_400.0, "attackers": ["192.168.10.50"], "victim_cidrs": ["10.0.0.64/26"], "dst_ports": [1003, 1004], "directional": True},
]


def _labeled(spark, d):
    return lb.label_flows(flows(spark, d, IDLE[1]).withColumnRenamed("label", "kind"), RULES)


def rule_label(spark, d):
    return _labeled(spark, d).select("row_id", "label", "binary_label", "label_confidence", "n_rule_matches")


def class_distribution(spark, d):
    return lb.class_distribution(_labeled(spark, d))


def rule_label_counts(spark, d):
    return lb.label_audit(_labeled(spark, d))


def window_edge_filter(spark, d):
    return _labeled(spark, d).where("label_confidence <> 'window_edge'").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_pkts").alias("pkts"))


def cidr_match(spark, d):
    p = packets(spark, d).select("frame_no", "src_ip")
    return p.select("frame_no", fn.in_cidrs(F.col("src_ip"), ["10.0.0.13/29", "192.168.0.0/16"]).alias("inside"), fn.is_host(F.col("src_ip")).alias("host"))


def project_nearest(spark, d):
    f = _labeled(spark, d)
    p = packets(spark, d).where("event_type = 'purchase'").select("src_ip", "src_port", "dst_ip", "dst_port", "proto", (F.col("ts_us") / 1e6).alias("t_start"))
    out = lb.project_reference(f, p, "bought", 1800.0, ("src_ip", "src_port", "dst_ip", "dst_port", "proto"))
    return out.select("row_id", "label", "binary_label", "label_confidence")


def _stages(spark, d):
    p = packets(spark, d)
    stage = F.when(F.col("event_type") == "error", "recon").when((F.col("event_type") == "signup") & (F.col("user_id") % 3 == 0), "exfil").otherwise("BENIGN")
    day = (F.floor(F.col("ts_us") / (86_400 * SECOND)) % 4).cast("string")
    client = F.when(F.col("src_port") == 443, F.col("dst_ip")).otherwise(F.col("src_ip"))
    return p.select(F.concat(F.lit("d"), day).alias("capture"), stage.alias("stage"), client.alias("src_ip"), F.lit("192.168.10.50").alias("dst_ip"), (F.col("frame_no") % 15).cast("int").alias("dst_port"), F.lit(6).alias("proto"), (F.col("ts_us") / 1e6).alias("t"), F.lit(1).alias("src_port"), F.col("frame_no"))


def _every_stage(spark, d):
    """All events as stage events; only views are benign, so that some sources of the full table are exclusive."""
    stage = F.when(F.col("event_type") == "error", "recon").when(F.col("event_type") == "click", "probe").when(F.col("event_type") != "view", "exfil").otherwise("BENIGN")
    client = F.when(F.col("src_port") == 443, F.col("dst_ip")).otherwise(F.col("src_ip"))
    day = (F.floor(F.col("ts_us") / (86_400 * SECOND)) % 4).cast("string")
    return packets(spark, d).select(F.concat(F.lit("d"), day).alias("capture"), stage.alias("stage"), client.alias("src_ip"), F.lit("192.168.10.50").alias("dst_ip"), (F.col("frame_no") % 15).cast("int").alias("dst_port"), F.lit(6).alias("proto"), (F.col("ts_us") / 1e6).alias("t"), F.lit(1).alias("src_port"), F.col("frame_no"))


def _by_derived_rules(spark, d):
    """Rules derived from all stage events, put on the same events, which last ten seconds for each port number."""
    e = _every_stage(spark, d)
    rules = ri.numbered_rules(lb.derive_rules(e, gap=1800.0, pad=30.0))
    rows = e.select("frame_no", "capture", "stage", "src_ip", "src_port", "dst_ip", "dst_port", "proto", F.col("t").alias("t_start"), (F.col("t") + 10 * F.col("dst_port")).alias("t_end"))
    return ri.label_by_table(stored(rows), rules, "frame_no", "capture")


def rule_label_many(spark, d):
    return _by_derived_rules(spark, d).select("frame_no", "label", "binary_label", "label_confidence", "n_rule_matches")


def fidelity_derived(spark, d):
    """What the derived rules give on the events that they were made from."""
    out = lb.fidelity(_by_derived_rules(spark, d))
    return out.select("stage", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def exclusive_sources_all(spark, d):
    return lb.exclusive_endpoints(_every_stage(spark, d))


def derive_rules_all(spark, d):
    out = lb.derive_rules(_every_stage(spark, d), gap=86_400.0, pad=30.0)
    return out.select("capture", "stage", "window_no", "t_start", "t_end", F.array_join("attackers", ",").alias("attackers"), F.array_join(F.col("dst_ports").cast("array<string>"), ",").alias("dst_ports"), "n_rows")


def _sensors(spark, d):
    """All events, dealt to 40 sensors; each sensor's day is a capture of its own."""
    return _stages(spark, d).withColumn("capture", F.concat("capture", F.lit("s"), (F.col("frame_no") % 40).cast("string")))


def exclusive_sources(spark, d):
    return lb.exclusive_endpoints(_sensors(spark, d))


def derive_rules(spark, d):
    out = lb.derive_rules(_sensors(spark, d), gap=86_400.0, pad=30.0)
    return out.select("capture", "stage", "window_no", "t_start", "t_end", F.array_join("attackers", ",").alias("attackers"), F.array_join(F.col("dst_ports").cast("array<string>"), ",").alias("dst_ports"), "n_rows")


def rule_coverage(spark, d):
    e = _sensors(spark, d)
    return lb.rule_coverage(e, lb.derive_rules(e, gap=86_400.0)).withColumn("share", F.round("share", 6))


def fidelity(spark, d):
    e = _stages(spark, d)
    predicted = F.when(F.col("frame_no") % 5 == 0, "BENIGN").when(F.col("frame_no") % 7 == 0, "exfil").otherwise(F.col("stage"))
    out = lb.fidelity(e.withColumn("label", predicted))
    return out.select("stage", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def clock_offset(spark, d):
    e = _stages(spark, d)
    local = e.select("capture", (F.col("t") - 3 * 3600 - F.length("capture")).alias("t"))
    return lb.clock_offset(e, local).select("offset_hours", F.round("spread", 6).alias("spread"), "steady")


def stage_events(spark, d):
    return lb.stage_events(_stages(spark, d), "recon").groupBy("capture").agg(F.count(F.lit(1)).alias("n"), F.min("t_start").alias("first_t"))


def undirected_key(spark, d):
    p = packets(spark, d)
    k = fn.endpoint_key()
    return p.select("frame_no", fn.text_key().alias("text_key"), k["lo"]["ip"].alias("lo_ip"), k["hi"]["port"].alias("hi_port"))


def proto_number(spark, d):
    names = F.array(*[F.lit(x) for x in ("tcp", "UDP", "6", "6.0", " icmp ", "nan", "-1", "x", "17.9")])
    p = packets(spark, d).select("frame_no", F.element_at(names, (F.col("frame_no") % 9 + 1).cast("int")).alias("text"))
    return p.select("frame_no", fn.protocol_number(F.col("text")).cast("int").alias("number"), fn.protocol_name(fn.protocol_number(F.col("text"))).alias("name"))


def _contract_rows(spark, d):
    f = flows(spark, d, IDLE[2])
    n = F.crc32(F.col("row_id").cast("binary"))
    return f.select("src_ip", "src_port", "dst_ip", "dst_port", F.lit("tcp").alias("proto"), "t_start", F.when(n % 11 == 0, F.col("t_start") - 5).otherwise(F.col("t_end")).alias("t_end"), "duration", F.when(F.col("n_pkts") % 3 == 0, -F.col("pkts_fwd")).otherwise(F.col("pkts_fwd")).alias("pkts_fwd"), "pkts_bwd", F.col("bytes_fwd").cast("string").alias("bytes_fwd"), "bytes_bwd", F.col("label").alias("tool_kind"), "row_id", "n_pkts")


def validate_contract(spark, d):
    f = _contract_rows(spark, d).withColumn("t_end", F.when(F.col("n_pkts") % 5 == 0, F.col("t_start") - 5).otherwise(F.col("t_start") + F.col("duration")))
    return ct.problems(ct.coerce(f.drop("row_id", "n_pkts")))


def coerce_contract(spark, d):
    out = ct.coerce(ct.prefix_native(_contract_rows(spark, d).drop("n_pkts", "t_end")))
    return out.select("tool_row_id", "proto", "src_port", "bytes_fwd", "pkts_bwd", "syn_fwd", "tool_kind", "t_end")


_F = f"{packets_sql()}, {sessions_sql(IDLE[1])}, {flows_sql()}"


def _rule_sql() -> str:
    def in_net(c: str, cidr: str) -> str:
        lo, hi = fn.cidr_range(cidr)
        p = [f"CAST(split_part({c}, '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5)]
        return f"({' + '.join(p)} BETWEEN {lo} AND {hi})"

    def end(c: str, ips, nets) -> str:
        parts = ([f"{c} IN ({', '.join(repr(i) for i in ips)})"] if ips else []) + [in_net(c, n) for n in nets]
        return f"({' OR '.join(parts)})" if parts else "true"

    out = []
    for i, r in enumerate(RULES):
        a, v = (r.get("attackers", []), r.get("attacker_cidrs", [])), (r.get("victims", []), r.get("victim_cidrs", []))
        ends = f"({end('src_ip', *a)} AND {end('dst_ip', *v)})"
        ports = f"dst_port IN ({', '.join(map(str, r['dst_ports']))})" if r.get("dst_ports") else "true"
        if not r.get("directional"):
            ends = f"({ends} OR ({end('dst_ip', *a)} AND {end('src_ip', *v)}))"
            ports = f"({ports} OR src_port IN ({', '.join(map(str, r['dst_ports']))}))" if r.get("dst_ports") else "true"
        t0, t1 = r["t_start"], r["t_end"]
        out.append(f"SELECT row_id, {i} AS i, '{r['label']}' AS label, t_start_us / 1e6 >= {t0} AND t_end_us / 1e6 <= {t1} AS inside FROM f WHERE t_start_us / 1e6 <= {t1} AND t_end_us / 1e6 >= {t0} AND {ends} AND {ports}")
    return " UNION ALL ".join(out)


_L = f"""{_F}, hit AS ({_rule_sql()}), lab AS (
  SELECT f.* EXCLUDE (label), coalesce(h.label, 'BENIGN') AS label, CASE WHEN h.label IS NULL THEN 'BENIGN' ELSE 'ATTACK' END AS binary_label,
    CASE WHEN h.label IS NULL THEN 'benign' WHEN h.inside THEN 'exact' ELSE 'window_edge' END AS label_confidence, coalesce(h.n, 0) AS n_rule_matches
  FROM f LEFT JOIN (SELECT row_id, arg_min(label, i) AS label, arg_min(inside, i) AS inside, count(*) AS n FROM hit GROUP BY row_id) h USING (row_id))"""
_ST = f"""{packets_sql()}, st AS (
  SELECT 'd' || ((ts_us // {86_400 * SECOND}) % 4) AS capture, CASE WHEN event_type = 'error' THEN 'recon' WHEN event_type = 'signup' AND user_id % 3 = 0 THEN 'exfil' ELSE 'BENIGN' END AS stage,
    client AS src_ip, frame_no % 15 AS dst_port, ts_us / 1e6 AS t, frame_no FROM pk)"""
_SOLE = "sensor AS (SELECT * EXCLUDE (capture), capture || 's' || (frame_no % 40) AS capture FROM st), sole AS (SELECT DISTINCT capture, src_ip FROM sensor WHERE stage <> 'BENIGN' EXCEPT SELECT capture, src_ip FROM sensor WHERE stage = 'BENIGN')"
_ALL = f"""{packets_sql()}, every AS (
  SELECT 'd' || ((ts_us // {86_400 * SECOND}) % 4) AS capture, CASE event_type WHEN 'error' THEN 'recon' WHEN 'click' THEN 'probe' WHEN 'view' THEN 'BENIGN' ELSE 'exfil' END AS stage, client AS src_ip, frame_no % 15 AS dst_port, ts_us / 1e6 AS t, frame_no FROM pk
), sole AS (SELECT DISTINCT capture, src_ip FROM every WHERE stage <> 'BENIGN' EXCEPT SELECT capture, src_ip FROM every WHERE stage = 'BENIGN')"""
_MANY = f"""{_ALL}, a AS (SELECT every.* FROM every JOIN sole USING (capture, src_ip) WHERE stage <> 'BENIGN'
), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY capture, stage ORDER BY t) > 1800.0 THEN 1 ELSE 0 END AS new FROM a
), r AS (SELECT *, sum(new) OVER (PARTITION BY capture, stage ORDER BY t) AS window_no FROM g
), rules AS (
  SELECT capture, stage AS label, row_number() OVER (ORDER BY capture, stage, window_no) AS rule_no, min(t) - 30.0 AS r_start, max(t) + 30.0 AS r_end, list(DISTINCT src_ip) AS attackers,
    CASE WHEN count(DISTINCT dst_port) <= 12 THEN list(DISTINCT dst_port) ELSE [] END AS ports FROM r GROUP BY capture, stage, window_no
), hits AS (
  SELECT frame_no, rule_no, label, t >= r_start AND t + 10 * dst_port <= r_end AS inside FROM every JOIN rules USING (capture)
  WHERE t <= r_end AND t + 10 * dst_port >= r_start AND list_contains(attackers, src_ip) AND (len(ports) = 0 OR list_contains(ports, dst_port))
), first AS (SELECT frame_no, arg_min(label, rule_no) AS label, arg_min(inside, rule_no) AS inside, count(*) AS n FROM hits GROUP BY frame_no
), many AS (
  SELECT e.frame_no, e.stage, coalesce(f.label, 'BENIGN') AS label, CASE WHEN f.label IS NULL THEN 'BENIGN' ELSE 'ATTACK' END AS binary_label,
    CASE WHEN f.label IS NULL THEN 'benign' WHEN f.inside THEN 'exact' ELSE 'window_edge' END AS label_confidence, coalesce(f.n, 0) AS n_rule_matches
  FROM every e LEFT JOIN first f USING (frame_no))"""
_FIDELITY = """b AS (SELECT t, p FROM p UNION ALL SELECT CASE WHEN t = 'BENIGN' THEN t ELSE 'ATTACK' END, CASE WHEN p = 'BENIGN' THEN p ELSE 'ATTACK' END FROM p
), s AS (SELECT DISTINCT t AS stage FROM b WHERE t <> 'BENIGN' UNION SELECT DISTINCT p FROM b WHERE p <> 'BENIGN'
), c AS (SELECT stage, count(*) FILTER (WHERE t = stage AND p = stage) AS tp, count(*) FILTER (WHERE t <> stage AND p = stage) AS fp, count(*) FILTER (WHERE t = stage AND p <> stage) AS fn FROM s JOIN b ON t = stage OR p = stage GROUP BY stage)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c"""

QUERIES = {
    "rule_label_many": (rule_label_many, f"WITH {_MANY} SELECT frame_no, label, binary_label, label_confidence, n_rule_matches FROM many"),
    "fidelity_derived": (fidelity_derived, f"WITH {_MANY}, p AS (SELECT stage AS t, label AS p FROM many), {_FIDELITY}"),
    "rule_label": (rule_label, f"WITH {_L} SELECT row_id, label, binary_label, label_confidence, n_rule_matches FROM lab"),
    "class_distribution": (class_distribution, f"WITH {_L} SELECT label, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE label_confidence = '{k}') AS {k}" for k in ("exact", "window_edge", "benign", "projected")) + " FROM lab GROUP BY label"),
    "rule_label_counts": (rule_label_counts, f"WITH {_L} SELECT count(*) AS n, count(*) FILTER (WHERE binary_label = 'ATTACK') AS n_attack, count(*) FILTER (WHERE n_rule_matches > 1) AS n_multi FROM lab"),
    "window_edge_filter": (window_edge_filter, f"WITH {_L} SELECT label, count(*) AS n, CAST(sum(n_pkts) AS BIGINT) AS pkts FROM lab WHERE label_confidence <> 'window_edge' GROUP BY label"),
    "cidr_match": (cidr_match, f"WITH {packets_sql()} SELECT frame_no, (NOT up) OR (user_id // 250 = 0 AND user_id % 250 BETWEEN 8 AND 15) AS inside, true AS host FROM pk"),
    "project_nearest": (project_nearest, f"""WITH {_L}, h AS (SELECT DISTINCT row_id FROM lab JOIN pk ON event_type = 'purchase' AND lab.dst_ip = pk.client AND lab.dst_port = pk.cport AND abs(lab.t_start_us / 1e6 - pk.ts_us / 1e6) <= 1800.0 WHERE binary_label = 'BENIGN')
SELECT row_id, CASE WHEN h.row_id IS NULL THEN label ELSE 'bought' END AS label, CASE WHEN h.row_id IS NULL THEN binary_label ELSE 'ATTACK' END AS binary_label, CASE WHEN h.row_id IS NULL THEN label_confidence ELSE 'projected' END AS label_confidence FROM lab LEFT JOIN h USING (row_id)"""),
    "exclusive_sources": (exclusive_sources, f"WITH {_ST}, {_SOLE} SELECT * FROM sole"),
    "derive_rules": (derive_rules, f"""WITH {_ST}, {_SOLE}, a AS (SELECT sensor.* FROM sensor JOIN sole USING (capture, src_ip) WHERE stage <> 'BENIGN'
), g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 86400.0 THEN 1 ELSE 0 END AS new FROM a WINDOW w AS (PARTITION BY capture, stage ORDER BY t)
), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY capture, stage ORDER BY t) AS BIGINT) AS window_no FROM g)
SELECT capture, stage, window_no, min(t) - 30.0 AS t_start, max(t) + 30.0 AS t_end, array_to_string(list_sort(list(DISTINCT src_ip)), ',') AS attackers,
  CASE WHEN count(DISTINCT dst_port) <= 12 THEN array_to_string(list_sort(list(DISTINCT dst_port)), ',') ELSE '' END AS dst_ports, count(*) AS n_rows FROM r GROUP BY capture, stage, window_no"""),
    "exclusive_sources_all": (exclusive_sources_all, f"WITH {_ALL} SELECT * FROM sole"),
    "derive_rules_all": (derive_rules_all, f"""WITH {_ALL}, a AS (SELECT every.* FROM every JOIN sole USING (capture, src_ip) WHERE stage <> 'BENIGN'
), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY capture, stage ORDER BY t) > 86400.0 THEN 1 ELSE 0 END AS new FROM a
), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY capture, stage ORDER BY t) AS BIGINT) AS window_no FROM g)
SELECT capture, stage, window_no, min(t) - 30.0 AS t_start, max(t) + 30.0 AS t_end, array_to_string(list_sort(list(DISTINCT src_ip)), ',') AS attackers,
  CASE WHEN count(DISTINCT dst_port) <= 12 THEN array_to_string(list_sort(list(DISTINCT dst_port)), ',') ELSE '' END AS dst_ports, count(*) AS n_rows FROM r GROUP BY capture, stage, window_no"""),
    "rule_coverage": (rule_coverage, f"""WITH {_ST}, {_SOLE}, a AS (SELECT sensor.* FROM sensor JOIN sole USING (capture, src_ip) WHERE stage <> 'BENIGN'
), g AS (SELECT capture, stage, CASE WHEN t - lag(t) OVER (PARTITION BY capture, stage ORDER BY t) > 86400.0 THEN 1 ELSE 0 END AS new FROM a
), r AS (SELECT capture, stage, CAST(1 + sum(new) AS BIGINT) AS n_rules, count(*) AS n_ruled FROM g GROUP BY capture, stage
), s AS (SELECT capture, stage, count(*) AS n_attack FROM sensor WHERE stage <> 'BENIGN' GROUP BY capture, stage)
SELECT capture, stage, n_attack, coalesce(n_rules, 0) AS n_rules, coalesce(n_ruled, 0) AS n_ruled, round(coalesce(n_ruled, 0) / n_attack, 6) AS share FROM s LEFT JOIN r USING (capture, stage)"""),
    "fidelity": (fidelity, f"WITH {_ST}, p AS (SELECT stage AS t, CASE WHEN frame_no % 5 = 0 THEN 'BENIGN' WHEN frame_no % 7 = 0 THEN 'exfil' ELSE stage END AS p FROM st), {_FIDELITY}"),
    "clock_offset": (clock_offset, f"""WITH {_ST}, a AS (SELECT capture, min(t) AS t FROM st GROUP BY capture), h AS (SELECT (t - (t - 3 * 3600 - length(capture))) / 3600 AS h FROM a)
SELECT round_even(avg(h), 0) AS offset_hours, round(max(h) - min(h), 6) AS spread, max(h) - min(h) < 0.05 AS steady FROM h"""),
    "stage_events": (stage_events, f"WITH {_ST} SELECT capture, count(*) AS n, min(t) AS first_t FROM st WHERE stage = 'recon' GROUP BY capture"),
    "undirected_key": (undirected_key, f"WITH {packets_sql()} SELECT frame_no, client || ':' || cport || '|192.168.10.50:443|6' AS text_key, client AS lo_ip, 443 AS hi_port FROM pk"),
    "proto_number": (proto_number, "WITH t AS (SELECT event_id AS frame_no, [6, 17, 6, 6, 1, NULL, NULL, NULL, 17][event_id % 9 + 1] AS number FROM events) SELECT frame_no, number, CASE number WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'unknown' END AS name FROM t"),
    "validate_contract": (validate_contract, f"""WITH {packets_sql()}, {sessions_sql(IDLE[2])}, {flows_sql()}, r AS (SELECT *, t_start_us / 1e6 AS a, CASE WHEN n_pkts % 5 = 0 THEN t_start_us / 1e6 - 5 ELSE t_start_us / 1e6 + (t_end_us - t_start_us) / 1e6 END AS b, (t_end_us - t_start_us) / 1e6 AS du, CASE WHEN n_pkts % 3 = 0 THEN -pkts_fwd ELSE pkts_fwd END AS pf FROM f
), p AS (SELECT 'reversed time' AS problem, count(*) FILTER (WHERE b < a) AS n FROM r UNION ALL SELECT 'duration differs', count(*) FILTER (WHERE abs(du - (b - a)) > 1e-3) FROM r UNION ALL SELECT 'no packets', count(*) FILTER (WHERE pf + pkts_bwd <= 0) FROM r UNION ALL SELECT 'negative pkts_fwd', count(*) FILTER (WHERE pf < 0) FROM r)
SELECT * FROM p WHERE n > 0"""),
    "coerce_contract": (coerce_contract, f"WITH {packets_sql()}, {sessions_sql(IDLE[2])}, {flows_sql()} SELECT row_id AS tool_row_id, CAST(6 AS SMALLINT) AS proto, src_port, bytes_fwd, pkts_bwd, CAST(NULL AS BIGINT) AS syn_fwd, label AS tool_kind, CAST(NULL AS DOUBLE) AS t_end FROM f"),
}
