"""Queries of column functions on text, bytes and arrays of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import flow as fn
from millrace.operators import features as fe
from millrace.plans.common import IDLE, flows, flows_sql, packets_sql, sessions_sql, table

#: The bytes kept of each packet.
PACKET_BYTES = 128


def json_props(spark, d):
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"), F.max("p.k").alias("most"))


def packet_stats(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("double").alias("size")))).alias("ts"))
    s = c.select("conv_id", fn.array_stats(F.col("ts.size")).alias("s"))
    return s.select("conv_id", F.col("s.n").alias("n"), F.round("s.mean", 6).alias("mean"), F.round("s.std", 6).alias("std"), F.col("s.min").alias("least"), F.col("s.max").alias("most"))


def hex_bigrams(spark, d):
    t = table(spark, d, "documents").select("doc_id", fn.hex_bigrams(F.col("text"), 24, 16).alias("tokens"))
    return t.select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


def pad_mask(spark, d):
    t = table(spark, d, "documents").select("doc_id", fn.padded(F.slice(F.split("text", " "), 1, F.pmod("doc_id", F.lit(9)).cast("int")), 6, "").alias("p"))
    return t.select("doc_id", F.array_join("p.values", "|").alias("vals"), F.array_join(F.col("p.mask").cast("array<string>"), "").alias("mask"))


def byte_layout(spark, d):
    t = table(spark, d, "documents").select("doc_id", fn.header_layout(F.concat(F.unhex(F.lit("45000000000000004011" + "00" * 10)), F.col("text").cast("binary")), 30, 8).alias("p"))
    return t.select("doc_id", "p.header", "p.payload")


def unit_bytes(spark, d):
    t = table(spark, d, "documents").select("doc_id", fn.unit_bytes(F.col("text"), 3).alias("b"))
    return t.select("doc_id", *[F.round(F.col("b")[i], 6).alias(f"b{i}") for i in range(3)])


def header_fields(spark, d):
    head = F.unhex(F.lit("450000280000000040060000" + "0a000001" + "0a000002" + "01bb0050" + "00" * 8 + "5012ffff" + "00" * 4))
    t = table(spark, d, "documents").select("doc_id", fn.ip_fields(F.concat(head, F.col("text").cast("binary")), 2).alias("h"))
    return t.select("doc_id", "h.src_port", "h.dst_port", "h.flags", "h.window", "h.ttl", F.col("h.payload")[0].alias("p0"), F.col("h.payload")[1].alias("p1"))


def hex_bigrams_full(spark, d):
    t = table(spark, d, "documents").select("doc_id", fn.hex_bigrams(F.col("text")).alias("tokens"))
    return t.select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


def byte_layout_full(spark, d):
    head = F.unhex(F.lit("45000000000000004011" + "00" * 10))
    t = table(spark, d, "documents").select("doc_id", fn.header_layout(F.concat(head, F.col("text").cast("binary"))).alias("p"))
    return t.select("doc_id", "p.header", "p.payload")


def unit_bytes_full(spark, d):
    t = table(spark, d, "documents").select("doc_id", fn.unit_bytes(F.col("text"), PACKET_BYTES).alias("b"))
    return t.select("doc_id", F.transform("b", lambda x: F.round(x, 6)).alias("bytes"))


def header_fields_full(spark, d):
    head = F.unhex(F.lit("450000280000000040060000" + "0a000001" + "0a000002" + "01bb0050" + "00" * 8 + "5012ffff" + "00" * 4))
    t = table(spark, d, "documents").select("doc_id", fn.ip_fields(F.concat(head, F.col("text").cast("binary"))).alias("h"))
    return t.select("doc_id", "h.src_port", "h.dst_port", "h.flags", "h.window", "h.ttl", *[F.col("h.payload")[i].alias(f"p{i}") for i in range(6)])


def common_features(spark, d):
    f = flows(spark, d, IDLE[1]).withColumn("proto", F.lit(6))
    return fe.common_features(f, ["row_id"])


def day_first_times(spark, d):
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy hh:mm:ss a").alias("a"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("b"))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    t = e.select("event_id", fn.mixed_epoch(F.when(F.col("event_id") % 2 == 0, F.col("a")).otherwise(F.col("b"))).alias("t"), fn.local_epoch(F.lit("2017-07-04"), F.lit("09:20:00"), "America/Halifax").alias("fixed"))
    return t.select("event_id", F.col("t").cast("long").alias("t"), F.col("fixed").cast("long").alias("fixed"))


QUERIES = {
    "json_props": (json_props, "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS total, max(CAST(json_extract_string(props, '$.k') AS INT)) AS most FROM events GROUP BY event_type"),
    "packet_stats": (packet_stats, "SELECT conv_id, count(*) AS n, round(avg(length(text)), 6) AS mean, round(stddev_pop(length(text)), 6) AS std, CAST(min(length(text)) AS DOUBLE) AS least, CAST(max(length(text)) AS DOUBLE) AS most FROM conversations GROUP BY conv_id"),
    "hex_bigrams": (hex_bigrams, "WITH h AS (SELECT doc_id, lower(substr(hex(encode(text)), 49)) AS h FROM documents), n AS (SELECT *, least(16, greatest(0, length(h) // 2 - 1)) AS n FROM h) SELECT doc_id, n, array_to_string([substr(h, 2 * i + 1, 4) for i in range(n)], ' ') AS tokens FROM n"),
    "pad_mask": (pad_mask, "WITH s AS (SELECT doc_id, string_split(text, ' ')[1:doc_id % 9] AS w FROM documents) SELECT doc_id, array_to_string([coalesce(w[i], '') for i in range(1, 7)], '|') AS vals, array_to_string([CASE WHEN i <= len(w) THEN '1' ELSE '0' END for i in range(1, 7)], '') AS mask FROM s"),
    "byte_layout": (byte_layout, "WITH h AS (SELECT doc_id, '4500000000000000401100000000000000000000' || lower(hex(encode(text))) AS h FROM documents) SELECT doc_id, rpad(substr(h, 1, 56), 60, '0') AS header, rpad(substr(h, 57, 16), 16, '0') AS payload FROM h"),
    "unit_bytes": (unit_bytes, "WITH h AS (SELECT doc_id, rpad(hex(encode(text)), 6, '0') AS h FROM documents) SELECT doc_id, " + ", ".join(f"round(CAST('0x' || substr(h, {2 * i + 1}, 2) AS INT) / 255.0, 6) AS b{i}" for i in range(3)) + " FROM h"),
    "header_fields": (header_fields, "WITH h AS (SELECT doc_id, rpad(hex(encode(text)), 8, '0') AS h FROM documents) SELECT doc_id, 443 AS src_port, 80 AS dst_port, 18 AS flags, 65535 AS \"window\", 64 AS ttl, CAST('0x' || substr(h, 1, 4) AS INT) AS p0, CAST('0x' || substr(h, 5, 4) AS INT) AS p1 FROM h"),
    "hex_bigrams_full": (hex_bigrams_full, "WITH h AS (SELECT doc_id, lower(substr(hex(encode(text)), 49)) AS h FROM documents), n AS (SELECT *, least(127, greatest(0, length(h) // 2 - 1)) AS n FROM h) SELECT doc_id, n, array_to_string([substr(h, 2 * i + 1, 4) for i in range(n)], ' ') AS tokens FROM n"),
    "byte_layout_full": (byte_layout_full, "WITH h AS (SELECT doc_id, '4500000000000000401100000000000000000000' || lower(hex(encode(text))) AS h FROM documents) SELECT doc_id, rpad(substr(h, 1, 56), 160, '0') AS header, rpad(substr(h, 57, 480), 480, '0') AS payload FROM h"),
    "unit_bytes_full": (unit_bytes_full, f"WITH h AS (SELECT doc_id, rpad(hex(encode(text)), {2 * PACKET_BYTES}, '0') AS h FROM documents) SELECT doc_id, [round(CAST('0x' || substr(h, 2 * i + 1, 2) AS INT) / 255.0, 6) for i in range({PACKET_BYTES})] AS bytes FROM h"),
    "header_fields_full": (header_fields_full, "WITH h AS (SELECT doc_id, rpad(hex(encode(text)), 24, '0') AS h FROM documents) SELECT doc_id, 443 AS src_port, 80 AS dst_port, 18 AS flags, 65535 AS \"window\", 64 AS ttl, " + ", ".join(f"CAST('0x' || substr(h, {4 * i + 1}, 4) AS INT) AS p{i}" for i in range(6)) + " FROM h"),
    "common_features": (common_features, f"WITH {packets_sql()}, {sessions_sql(IDLE[1])}, {flows_sql()} SELECT row_id, (t_end_us - t_start_us) / 1e6 AS duration, CAST(pkts_fwd AS DOUBLE) AS pkts_fwd, CAST(pkts_bwd AS DOUBLE) AS pkts_bwd, CAST(bytes_fwd AS DOUBLE) AS bytes_fwd, CAST(bytes_bwd AS DOUBLE) AS bytes_bwd, CAST(pkts_fwd + pkts_bwd AS DOUBLE) AS tot_pkts, CAST(bytes_fwd + bytes_bwd AS DOUBLE) AS tot_bytes, 1.0::DOUBLE AS is_tcp, 0.0::DOUBLE AS is_udp FROM f"),
    "day_first_times": (day_first_times, "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, 1499170800 AS fixed FROM events"),
}
