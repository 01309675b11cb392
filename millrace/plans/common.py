"""Packets and flows from the ``events`` table, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.flow import text_key
from millrace.operators.sessions import assemble

SECOND = 1_000_000
IDLE = (2_000, 11_000, 26_500, 52_700)
ACTIVE = 86_400
SERVER, SERVER_PORT = "192.168.10.50", 443


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet for each event, between the user's address and one server; some event types go up, the others down."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # times without zone are UTC
    return packets_of(table(spark, sf_dir, "events"))


def packets_of(e: DataFrame) -> DataFrame:
    client = F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 250).cast("string"), F.lit("."), (F.col("user_id") % 250).cast("string"))
    up = F.col("event_type").isin("view", "click", "signup")
    port = (F.lit(1000) + F.col("user_id") % 7).cast("int")
    return e.select(
        F.lit("events").alias("capture"), F.col("event_id").alias("frame_no"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.when(up, client).otherwise(SERVER).alias("src_ip"), F.when(up, port).otherwise(SERVER_PORT).alias("src_port"),
        F.when(up, F.lit(SERVER)).otherwise(client).alias("dst_ip"), F.when(up, F.lit(SERVER_PORT)).otherwise(port).alias("dst_port"),
        F.lit(6).alias("proto"), F.floor("value").cast("int").alias("wire_len"), (F.col("event_id") % 256).cast("int").alias("tcp_flags"), "event_type", "user_id",
    )


def flows(spark: SparkSession, sf_dir: str, idle: int, active: int | None = None, sequence: int = 0, extra=()) -> DataFrame:
    """Flows with a text key, a row id and the first packet's event type as label."""
    made = assemble(packets(spark, sf_dir), idle * SECOND, active * SECOND if active else None, sequence, (F.min_by("event_type", "frame_no").alias("label"), *extra))
    keyed = made.drop("key").withColumn("key", text_key())
    return keyed.withColumn("row_id", F.concat_ws(":", "key", F.col("session").cast("string"), F.col("segment").cast("string")))


def packets_sql() -> str:
    return f"""pk AS (
  SELECT event_id AS frame_no, epoch_us(ts) AS ts_us, event_type, user_id, event_type IN ('view', 'click', 'signup') AS up, event_id % 256 AS tcp_flags,
    '10.0.' || CAST(CAST(floor(user_id / 250) AS BIGINT) AS VARCHAR) || '.' || CAST(user_id % 250 AS VARCHAR) AS client, 1000 + user_id % 7 AS cport, CAST(floor(value) AS INT) AS wire_len
  FROM events)"""


def sessions_sql(idle: int, name: str = "s") -> str:
    return f"""{name}_gap AS (
  SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY frame_no) > {idle * SECOND} THEN 1 ELSE 0 END AS new FROM pk
), {name} AS (
  SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY frame_no) AS BIGINT) AS session, 0 AS segment FROM {name}_gap)"""


def active_sql(active: int, source: str = "s", name: str = "g") -> str:
    return f"""{name}_rn AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY frame_no) AS rn FROM {source}
), {name}_walk AS (
  SELECT user_id, session, rn, ts_us AS start_us, 0 AS seg FROM {name}_rn WHERE rn = 1
  UNION ALL
  SELECT n.user_id, n.session, n.rn, CASE WHEN n.ts_us - w.start_us > {active * SECOND} THEN n.ts_us ELSE w.start_us END, w.seg + CASE WHEN n.ts_us - w.start_us > {active * SECOND} THEN 1 ELSE 0 END
  FROM {name}_walk w JOIN {name}_rn n ON n.user_id = w.user_id AND n.session = w.session AND n.rn = w.rn + 1
), {name} AS (SELECT r.* EXCLUDE (segment), w.seg AS segment FROM {name}_rn r JOIN {name}_walk w USING (user_id, session, rn))"""


def flows_sql(source: str = "s", name: str = "f", more: str = "") -> str:
    """Flows of segmented packets ``source``; ``more`` adds aggregates."""
    return f"""{name}_p AS (
  SELECT *, first_value(up) OVER (PARTITION BY user_id, session, segment ORDER BY frame_no) = up AS fwd FROM {source}
), {name} AS (
  SELECT any_value(client) || ':' || any_value(cport) || '|{SERVER}:{SERVER_PORT}|6' AS key,
    any_value(client) || ':' || any_value(cport) || '|{SERVER}:{SERVER_PORT}|6:' || session || ':' || segment AS row_id, user_id, session, segment,
    CASE WHEN arg_min(up, frame_no) THEN any_value(client) ELSE '{SERVER}' END AS src_ip, CASE WHEN arg_min(up, frame_no) THEN '{SERVER}' ELSE any_value(client) END AS dst_ip,
    CASE WHEN arg_min(up, frame_no) THEN any_value(cport) ELSE {SERVER_PORT} END AS src_port, CASE WHEN arg_min(up, frame_no) THEN {SERVER_PORT} ELSE any_value(cport) END AS dst_port,
    arg_min(ts_us, frame_no) AS t_start_us, arg_max(ts_us, frame_no) AS t_end_us, count(*) AS n_pkts, CAST(sum(wire_len) AS BIGINT) AS n_bytes,
    count(*) FILTER (WHERE fwd) AS pkts_fwd, count(*) FILTER (WHERE NOT fwd) AS pkts_bwd,
    CAST(coalesce(sum(wire_len) FILTER (WHERE fwd), 0) AS BIGINT) AS bytes_fwd, CAST(coalesce(sum(wire_len) FILTER (WHERE NOT fwd), 0) AS BIGINT) AS bytes_bwd,
    arg_min(event_type, frame_no) AS label{more}
  FROM {name}_p GROUP BY user_id, session, segment)"""
