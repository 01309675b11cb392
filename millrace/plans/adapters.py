"""Queries of the log adapters: flows of the ``events`` table, written as each tool's log would have them, as canonical flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import contract
from millrace.plans.common import IDLE, flows, flows_sql, packets_sql, sessions_sql
from millrace.sources.logs import ADAPTERS

ENDS = ("src_ip", "src_port", "dst_ip", "dst_port")
COUNTS = ("pkts_fwd", "pkts_bwd", "bytes_fwd", "bytes_bwd")
START, END = "t_start_us / 1e6D", "t_end_us / 1e6D"
ISO = "date_format(timestamp_micros({}), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"


def _ends(*names: str) -> list[str]:
    return [f"{c} AS `{n}`" for c, n in zip(ENDS, names, strict=True)]


def _counts(*names: str) -> list[str]:
    return [f"{c} AS {n}" for c, n in zip(COUNTS, names, strict=True)]


#: The columns of each log. Errors, purchases and flows of one packet stand in for the odd rows that an adapter must treat.
LOGS = {
    "zeek": [*_ends("id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p"), *_counts("orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes"), "row_id AS uid", "'tcp' AS proto", f"{START} AS ts", f"if(n_pkts = 1, NULL, {END} - {START}) AS duration"],
    "tranalyzer": [*_ends("srcIP", "srcPort", "dstIP", "dstPort"), *_counts("pktsSnt", "pktsRcvd", "l7BytesSnt", "l7BytesRcvd"), "row_id AS flowInd", "6 AS l4Proto", f"{START} AS timeFirst", f"{END} AS timeLast", f"{END} - {START} AS duration", "CASE label WHEN 'error' THEN 'B' WHEN 'view' THEN ' ' WHEN 'click' THEN NULL ELSE 'A' END AS dir"],
    "cicflowmeter": [*_ends(*ENDS), *_counts(*COUNTS), "row_id AS flow_id", "'6.0' AS proto", "if(label = 'view', date_format(timestamp_micros(t_start_us), 'dd/MM/yyyy HH:mm:ss'), date_format(timestamp_micros(t_start_us), 'yyyy-MM-dd HH:mm:ss')) AS time", "if(label = 'purchase', -1, t_end_us - t_start_us) AS duration_us", *[f"0 AS {x}_{y}" for x in ("psh", "urg") for y in ("fwd", "bwd")]],
    "argus": [*_ends("SrcAddr", "Sport", "DstAddr", "Dport"), *_counts("SrcPkts", "DstPkts", "SrcBytes", "DstBytes"), "if(label = 'error', ' MAN', 'TCP') AS Proto", f"{START} AS StartTime", f"if(label = 'view', '', CAST({END} AS STRING)) AS LastTime", f"{END} - {START} AS Dur"],
    "goflows": [*_ends("sourceIPAddress", "sourceTransportPort", "destinationIPAddress", "destinationTransportPort"), "6 AS protocolIdentifier", "t_start_us / 1e3D AS flowStartMilliseconds", "t_end_us / 1e3D AS flowEndMilliseconds", "n_pkts AS packetTotalCount", "n_bytes AS octetTotalCount"],
    "yaf": ["if(label = 'error', NULL, src_ip) AS sourceIPv4Address", "CAST(NULL AS STRING) AS sourceIPv6Address", "if(label = 'view', NULL, dst_ip) AS destinationIPv4Address", "if(label = 'view', dst_ip, NULL) AS destinationIPv6Address", "src_port AS sourceTransportPort", "dst_port AS destinationTransportPort", "6 AS protocolIdentifier", f"{ISO.format('t_start_us')} AS flowStartMilliseconds", f"{ISO.format('t_end_us')} AS flowEndMilliseconds", *_counts("packetTotalCount", "reversePacketTotalCount", "octetTotalCount", "reverseOctetTotalCount")],
    "joy": [*_ends("sa", "sp", "da", "dp"), *_counts("out_", "in_", "bytes_out", "bytes_in"), "if(label = 'error', 0, pkts_fwd) AS num_pkts_out", "if(label = 'error', NULL, pkts_bwd) AS num_pkts_in", "6 AS pr", f"{START} AS time_start", f"if(label = 'purchase', {START} - 5, {END}) AS time_end", "CAST(NULL AS array<struct<b:bigint,dir:string,ipt:double>>) AS packets"],
    "nfstream": [*_ends(*ENDS), *_counts("src2dst_packets", "dst2src_packets", "src2dst_bytes", "dst2src_bytes"), "6 AS protocol", "t_start_us div 1000 AS bidirectional_first_seen_ms", "t_end_us div 1000 AS bidirectional_last_seen_ms"],
}


def _micros(c: str):
    return F.round(F.col(c) * 1e6).cast("long").alias(f"{c}_us")


def _query(tool: str):
    def run(spark, d):
        log = flows(spark, d, IDLE[1]).selectExpr(*LOGS[tool])
        made = contract.coerce(ADAPTERS[tool](log, "events", "all"))
        return made.select("tool", *ENDS, F.col("proto").cast("int").alias("proto"), *[_micros(c) for c in ("t_start", "t_end", "duration")], *COUNTS)

    return run


_S = "t_start_us // 1000000 * 1000000"
#: What an adapter changes: rows that stay, start, end, and the counts of both directions.
_SQL = {
    "zeek": {}, "tranalyzer": {"rows": "label <> 'error'"}, "argus": {"rows": "label <> 'error'"}, "yaf": {"rows": "label <> 'error'"},
    "cicflowmeter": {"start": _S, "end": f"{_S} + CASE WHEN label = 'purchase' THEN 0 ELSE t_end_us - t_start_us END"},
    "goflows": {"counts": "n_pkts AS pkts_fwd, CAST(NULL AS BIGINT) AS pkts_bwd, n_bytes AS bytes_fwd, CAST(NULL AS BIGINT) AS bytes_bwd"},
    "joy": {"rows": "label <> 'error'", "end": "CASE WHEN label = 'purchase' THEN t_start_us ELSE t_end_us END"},
    "nfstream": {"start": "t_start_us // 1000 * 1000", "end": "t_end_us // 1000 * 1000"},
}


def _oracle(tool: str, rows: str = "true", start: str = "t_start_us", end: str = "t_end_us", counts: str = ", ".join(COUNTS)) -> str:
    times = f"CAST({start} AS BIGINT) AS t_start_us, CAST({end} AS BIGINT) AS t_end_us, CAST(({end}) - ({start}) AS BIGINT) AS duration_us"
    return f"WITH {packets_sql()}, {sessions_sql(IDLE[1])}, {flows_sql()} SELECT '{tool}' AS tool, {', '.join(ENDS)}, 6 AS proto, {times}, {counts} FROM f WHERE {rows}"


QUERIES = {f"canonical_{tool}": (_query(tool), _oracle(tool, **changes)) for tool, changes in _SQL.items()}
