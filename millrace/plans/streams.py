"""Queries that run a stream over the ``events`` file to its end and return what it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranges import scratch
from millrace.plans.common import ACTIVE, IDLE, SECOND, active_sql, packets, packets_of, packets_sql, sessions_sql
from millrace.streaming import flows as st


def _stream(spark, d) -> DataFrame:
    """The packets of ``events`` as a file stream."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    plain = spark.read.parquet(f"{d}/events.parquet")

    stream = spark.readStream.schema(plain.schema).option("pathGlobFilter", "events.parquet").parquet(d)  # a file stream watches a folder
    return packets_of(stream).withColumn("ts", F.timestamp_micros("ts_us"))


def _ran(spark, df: DataFrame, mode: str) -> DataFrame:
    path = scratch(spark, "streams")
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


def stream_labels(spark, d):
    p = _stream(spark, d).select("frame_no", "src_ip", "src_port", "dst_ip", "dst_port", "proto", (F.col("ts_us") / 1e6).alias("t_start"), (F.col("ts_us") / 1e6).alias("t_end"))
    rules = [{"label": "web", "t_start": 0.0, "t_end": 4e9, "dst_ports": [443], "protos": [6], "directional": True}]
    return _ran(spark, st.labeled_stream(p, rules), "append").select("frame_no", "label", "n_rule_matches")


def stream_sessions(spark, d):
    """Sessions that the watermark has closed by the end of the stream."""
    out = _ran(spark, st.idle_flows(_stream(spark, d), f"{IDLE[1]} seconds", "0 seconds"), "append")
    return out.select("key", F.unix_micros("start").alias("start_us"), "n_pkts", "n_bytes")


_CLOSED = f"""WITH {packets_sql()}, {sessions_sql(IDLE[1])}, g AS (
  SELECT any_value(client) || ':' || any_value(cport) || '|192.168.10.50:443|6' AS key, min(ts_us) AS start_us, max(ts_us) AS e, count(*) AS n_pkts, CAST(sum(wire_len) AS BIGINT) AS n_bytes FROM s GROUP BY user_id, session)
SELECT key, start_us, n_pkts, n_bytes FROM g WHERE e + {IDLE[1] * SECOND} <= (SELECT (max(ts_us) // 1000) * 1000 FROM pk)"""


def stream_assembly(spark, d):
    """Flows by both timeouts that are closed by the end of the stream."""
    name, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, own)
    try:
        return _ran(spark, st.assembled_flows(_stream(spark, d), IDLE[2] * SECOND, ACTIVE * SECOND, "0 seconds"), "append")
    finally:
        spark.conf.set(name, before)


_ASSEMBLED = f"""WITH RECURSIVE {packets_sql()}, {sessions_sql(IDLE[2])}, {active_sql(ACTIVE)}, f AS (
  SELECT any_value(client) || ':' || any_value(cport) || '|192.168.10.50:443|6' AS key, min(ts_us) AS t_start_us, max(ts_us) AS t_end_us, count(*) AS n_pkts, CAST(sum(wire_len) AS BIGINT) AS n_bytes FROM g GROUP BY user_id, session, segment)
SELECT * FROM f WHERE least(t_end_us + {IDLE[2] * SECOND}, t_start_us + {ACTIVE * SECOND}) < (SELECT (max(ts_us) // 1000) * 1000 FROM pk)"""


def stream_projection(spark, d):
    """T4: streamed packets joined to static reference events within the tolerance."""
    p = _stream(spark, d).select("frame_no", "src_ip", "src_port", "dst_ip", "dst_port", "proto", (F.col("ts_us") / 1e6).alias("t_start"), F.lit("BENIGN").alias("label"), F.lit("BENIGN").alias("binary_label"))
    r = packets(spark, d).where("event_type = 'error'").select("src_ip", "src_port", "dst_ip", "dst_port", "proto", (F.col("ts_us") / 1e6).alias("t_start"))
    out = st.projected_stream(p, r, "fault", 3600.0, ("src_ip", "src_port", "dst_ip", "dst_port", "proto"))
    return _ran(spark, out, "append").select("frame_no", "label", "binary_label")


def stream_counts(spark, d):
    """T5: packets of each event type in windows of six hours; windows that the watermark has closed by the end."""
    return _ran(spark, st.running_counts(_stream(spark, d), "event_type", window="6 hours", late="0 seconds"), "append").select(F.unix_micros("start").alias("start_us"), "event_type", "n")


_NEAR = f"""WITH {packets_sql()} SELECT a.frame_no, CASE WHEN count(b.frame_no) > 0 THEN 'fault' ELSE 'BENIGN' END AS label, CASE WHEN count(b.frame_no) > 0 THEN 'ATTACK' ELSE 'BENIGN' END AS binary_label
FROM pk a LEFT JOIN pk b ON a.user_id = b.user_id AND a.up = b.up AND b.event_type = 'error' AND abs(a.ts_us - b.ts_us) <= {3600 * SECOND} GROUP BY a.frame_no"""
_SIX_HOURS = 6 * 3600 * SECOND
_WINDOWS = f"""WITH {packets_sql()}, w AS (SELECT ts_us // {_SIX_HOURS} * {_SIX_HOURS} AS start_us, event_type FROM pk)
SELECT start_us, event_type, count(*) AS n FROM w WHERE start_us + {_SIX_HOURS} <= (SELECT (max(ts_us) // 1000) * 1000 FROM pk) GROUP BY start_us, event_type"""
QUERIES = {
    "stream_assembly": (stream_assembly, _ASSEMBLED),
    "stream_projection": (stream_projection, _NEAR),
    "stream_counts": (stream_counts, _WINDOWS),
    "stream_labels": (stream_labels, "SELECT event_id AS frame_no, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'web' ELSE 'BENIGN' END AS label, CAST(CASE WHEN event_type IN ('view', 'click', 'signup') THEN 1 ELSE 0 END AS BIGINT) AS n_rule_matches FROM events"),
    "stream_sessions": (stream_sessions, _CLOSED),
}
