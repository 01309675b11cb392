"""Native flow logs to canonical flows: readers for eight log formats, and one adapter for each."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.flow import FLAGS, array_stats, iso_epoch, mixed_epoch, protocol_number
from millrace.operators.contract import coerce

#: Header spellings of CSV flow logs, normalised to letters and digits, by field; the first that is there counts.
SYNONYMS = {
    "flow_id": ("flowid",), "src_ip": ("srcip", "sourceip"), "src_port": ("srcport", "sourceport"), "dst_ip": ("dstip", "destinationip"), "dst_port": ("dstport", "destinationport"),
    "proto": ("protocol", "proto"), "time": ("timestamp",), "duration_us": ("flowduration",),
    "pkts_fwd": ("totalfwdpacket", "totalfwdpackets", "totfwdpkts"), "pkts_bwd": ("totalbwdpackets", "totalbackwardpackets", "totbwdpkts"),
    "bytes_fwd": ("totallengthoffwdpacket", "totallengthoffwdpackets", "totlenfwdpkts"), "bytes_bwd": ("totallengthofbwdpacket", "totallengthofbwdpackets", "totlenbwdpkts"),
    "psh_fwd": ("fwdpshflags",), "psh_bwd": ("bwdpshflags",), "urg_fwd": ("fwdurgflags",), "urg_bwd": ("bwdurgflags",),
}


def number(c: str | Column) -> Column:
    return (F.col(f"`{c}`") if isinstance(c, str) else c).try_cast("double")


def read_hash_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated logs whose ``#fields`` line names the columns; ``-`` and ``(empty)`` are null.

    Headers are per file, so fields are looked up by name in the row's own file's header.
    """
    lines = spark.read.text(path).withColumn("_file", F.input_file_name())
    heads = lines.where(F.startswith("value", F.lit("#fields"))).groupBy("_file").agg(F.first(F.slice(F.split("value", "\t"), 2, 100_000)).alias("_names"))
    names = sorted({n for r in heads.select("_names").distinct().collect() for n in r[0]})  # one row for each kind of header
    rows = lines.where(~F.startswith("value", F.lit("#")) & (F.length("value") > 0)).withColumn("_cells", F.split("value", "\t"))
    joined = rows.join(heads, "_file")  # a header for each file, so Spark sizes this join
    cells = F.map_from_arrays("_names", F.transform("_names", lambda _, i: F.get("_cells", i)))  # null where a row is short
    named = joined.select(cells.alias("_m"))
    return named.select(*[F.when(~F.try_element_at("_m", F.lit(n)).isin("-", "(empty)"), F.try_element_at("_m", F.lit(n))).alias(n) for n in names])


def read_percent_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated flows, all text; the first header starts with ``%``."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    return df.withColumnsRenamed({c: c.lstrip("%").strip() for c in df.columns})


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV flows, all text, blanks around headers stripped."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    return df.toDF(*[c.strip() for c in df.columns])


def read_drifting_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV flows whose headers are spelt in several ways, under the names of ``SYNONYMS``."""
    df = read_csv(spark, path)
    by_norm = {re.sub("[^a-z0-9]", "", c.lower()): c for c in reversed(df.columns)}
    found = {field: next((by_norm[n] for n in names if n in by_norm), None) for field, names in SYNONYMS.items()}
    known = set(found.values())
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(f) for f, c in found.items()], *[F.col(f"`{c}`").alias("tool_" + re.sub("[^a-z0-9]+", "_", c.lower()).strip("_")) for c in df.columns if c not in known])


FLOW_JSON = "sourceIPv4Address string, sourceIPv6Address string, destinationIPv4Address string, destinationIPv6Address string, sourceTransportPort int, destinationTransportPort int, protocolIdentifier int, flowStartMilliseconds string, flowEndMilliseconds string, packetTotalCount bigint, octetTotalCount bigint, reversePacketTotalCount bigint, reverseOctetTotalCount bigint"


def read_flow_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of flows, bare or in a ``flows`` envelope; malformed, blank and ``stats`` lines are skipped."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = lines.select(F.from_json("value", f"flows struct<{FLOW_JSON.replace(' string', ':string').replace(' int', ':int').replace(' bigint', ':bigint')}>, stats string, {FLOW_JSON}").alias("j"))
    own = F.struct(*[F.col(f"j.{c.split()[0]}").alias(c.split()[0]) for c in FLOW_JSON.split(", ")])
    return parsed.where("j IS NOT NULL AND j.stats IS NULL").select(F.coalesce("j.flows", own).alias("f")).select("f.*")


PACKET_JSON = "version string, sa string, da string, sp int, dp int, pr int, time_start double, time_end double, num_pkts_out bigint, num_pkts_in bigint, bytes_out bigint, bytes_in bigint, packets array<struct<b:bigint,dir:string,ipt:double>>"


def read_packet_ndjson(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Gzip JSON lines with an array of packets; header lines and objects without ``sa`` are skipped.

    A gzip file can't be split; ``partitions`` deals its rows out after reading.
    """
    df = spark.read.schema(PACKET_JSON).json(path, mode="DROPMALFORMED").where("sa IS NOT NULL AND version IS NULL")
    return df.repartition(partitions) if partitions else df


def _canonical(df: DataFrame, tool: str, dataset: str, capture: str, columns: dict[str, Column], native: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    given = {"tool": F.lit(tool), "dataset": F.lit(dataset), "capture": F.lit(capture)} | columns
    out = df.select(*[c.alias(n) for n, c in given.items()], *[F.col(f"`{c}`").alias(c if c.startswith("tool_") else f"tool_{c}") for c in native])
    return coerce(out)


def _ends(src_ip, src_port, dst_ip, dst_port, proto) -> dict[str, Column]:
    c = lambda x: F.col(f"`{x}`") if isinstance(x, str) else x
    return {"src_ip": c(src_ip), "src_port": c(src_port), "dst_ip": c(dst_ip), "dst_port": c(dst_port), "proto": protocol_number(c(proto))}


def from_zeek(df: DataFrame, dataset: str, capture: str) -> DataFrame:
    """end = ts + duration (null: 0), IP-layer bytes, six flags in both directions."""
    ts, dur = number("ts"), F.coalesce(number("duration"), F.lit(0.0))
    cols = _ends("id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto") | {"t_start": ts, "t_end": ts + dur, "duration": dur, "pkts_fwd": number("orig_pkts"), "pkts_bwd": number("resp_pkts"), "bytes_fwd": number("orig_ip_bytes"), "bytes_bwd": number("resp_ip_bytes"), "flow_id": F.col("uid")}
    for f in ("syn", "fin", "rst", "psh", "ack", "urg"):
        for d, p in (("fwd", "s"), ("bwd", "r")):
            if f"{p}_{f}" in df.columns:
                cols[f"{f}_{d}"] = number(f"{p}_{f}")
    used = {"ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "duration", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes"}
    return _canonical(df, "zeek", dataset, capture, cols, [c for c in df.columns if c not in used and not re.match("[sr]_(syn|fin|rst|psh|ack|urg)$", c) and "." not in c])


def from_tranalyzer(df: DataFrame, dataset: str, capture: str) -> DataFrame:
    """The initiator's records (dir A, empty or null); bytes of layer 7."""
    df = df.where("dir IS NULL OR trim(dir) IN ('A', '')")
    cols = _ends("srcIP", "srcPort", "dstIP", "dstPort", "l4Proto") | {"t_start": number("timeFirst"), "t_end": number("timeLast"), "duration": number("duration"), "pkts_fwd": number("pktsSnt"), "pkts_bwd": number("pktsRcvd"), "bytes_fwd": number("l7BytesSnt"), "bytes_bwd": number("l7BytesRcvd"), "flow_id": F.col("flowInd")}
    return _canonical(df, "tranalyzer", dataset, capture, cols)


def from_cicflowmeter(df: DataFrame, dataset: str, capture: str, tool: str = "cicflowmeter") -> DataFrame:
    """Microseconds to seconds, negative durations are 0, PSH and URG only."""
    dur = F.greatest(number("duration_us"), F.lit(0.0)) / 1e6
    start = mixed_epoch(F.col("time"))
    cols = _ends("src_ip", "src_port", "dst_ip", "dst_port", "proto") | {"t_start": start, "t_end": start + dur, "duration": dur, "flow_id": F.col("flow_id")}
    cols |= {c: number(c) for c in ("pkts_fwd", "pkts_bwd", "bytes_fwd", "bytes_bwd", "psh_fwd", "psh_bwd", "urg_fwd", "urg_bwd")}
    return _canonical(df, tool, dataset, capture, cols, [c for c in df.columns if c.startswith("tool_")])


def from_argus(df: DataFrame, dataset: str, capture: str) -> DataFrame:
    """P7d, F1: without management records and zero addresses; a blank last time is start + duration; duration is recomputed, 0 at least."""
    df = df.where(~F.lower(F.trim(F.coalesce("Proto", F.lit("")))).isin("man", "rtp", "arp", "") & ~F.coalesce("SrcAddr", F.lit("")).isin("0", "0.0.0.0", "") & ~F.coalesce("DstAddr", F.lit("")).isin("0", "0.0.0.0", ""))
    start = number("StartTime")
    end = F.coalesce(number("LastTime"), start + number("Dur"))
    cols = _ends("SrcAddr", "Sport", "DstAddr", "Dport", "Proto") | {"t_start": start, "t_end": end, "duration": F.greatest(end - start, F.lit(0.0)), "pkts_fwd": number("SrcPkts"), "pkts_bwd": number("DstPkts"), "bytes_fwd": number("SrcBytes"), "bytes_bwd": number("DstBytes")}
    return _canonical(df, "argus", dataset, capture, cols)


def from_goflows(df: DataFrame, dataset: str, capture: str) -> DataFrame:
    """P7e: milliseconds to seconds; totals and flags of both directions stand in fwd, bwd is null."""
    start, end = number("flowStartMilliseconds") / 1e3, number("flowEndMilliseconds") / 1e3
    cols = _ends("sourceIPAddress", "sourceTransportPort", "destinationIPAddress", "destinationTransportPort", "protocolIdentifier") | {"t_start": start, "t_end": end, "duration": end - start, "pkts_fwd": number("packetTotalCount"), "bytes_fwd": number("octetTotalCount")}
    for f in ("syn", "fin", "rst", "psh", "ack", "urg"):
        name = f"tcp{f.capitalize()}TotalCount"
        if name in df.columns:
            cols[f"{f}_fwd"] = number(name)
    return _canonical(df, "goflows", dataset, capture, cols)


def from_yaf(df: DataFrame, dataset: str, capture: str) -> DataFrame:
    """P7f, F3: IPv4 or IPv6 addresses, ISO times; rows without both addresses go."""
    src, dst = F.coalesce("sourceIPv4Address", "sourceIPv6Address"), F.coalesce("destinationIPv4Address", "destinationIPv6Address")
    df = df.where(src.isNotNull() & dst.isNotNull())
    start, end = iso_epoch(F.col("flowStartMilliseconds")), iso_epoch(F.col("flowEndMilliseconds"))
    cols = _ends(src, "sourceTransportPort", dst, "destinationTransportPort", "protocolIdentifier") | {"t_start": start, "t_end": end, "duration": end - start, "pkts_fwd": F.col("packetTotalCount"), "bytes_fwd": F.col("octetTotalCount"), "pkts_bwd": F.coalesce("reversePacketTotalCount", F.lit(0)), "bytes_bwd": F.coalesce("reverseOctetTotalCount", F.lit(0))}
    return _canonical(df, "yaf", dataset, capture, cols)


def from_joy(df: DataFrame, dataset: str, capture: str) -> DataFrame:
    """P7g, P12, F3: end not before start, no empty flows, packet statistics instead of the packet array."""
    df = df.where(F.coalesce("num_pkts_out", F.lit(0)) + F.coalesce("num_pkts_in", F.lit(0)) > 0)
    packets = F.coalesce("packets", F.array().cast("array<struct<b:bigint,dir:string,ipt:double>>"))

    def sizes(mark: str) -> Column:
        return F.transform(F.filter(packets, lambda p: p["dir"] == mark), lambda p: p["b"].cast("double"))

    gaps = F.transform(F.slice(packets, 2, 1 << 30), lambda p: p["ipt"])
    stats = {"fwd_size": array_stats(sizes(">")), "bwd_size": array_stats(sizes("<")), "iat": array_stats(gaps)}
    df = df.select("*", *[s[x].cast("double").alias(f"tool_{n}_{x}") for n, s in stats.items() for x in ("n", "mean", "std", "min", "max")])
    end = F.greatest("time_end", "time_start")
    cols = _ends("sa", "sp", "da", "dp", "pr") | {"t_start": F.col("time_start"), "t_end": end, "duration": end - F.col("time_start"), "pkts_fwd": F.col("num_pkts_out"), "pkts_bwd": F.coalesce("num_pkts_in", F.lit(0)), "bytes_fwd": F.col("bytes_out"), "bytes_bwd": F.coalesce("bytes_in", F.lit(0))}
    return _canonical(df, "joy", dataset, capture, cols, [c for c in df.columns if c.startswith("tool_")])


def from_nfstream(df: DataFrame, dataset: str, capture: str) -> DataFrame:
    """S11, P7h: milliseconds to seconds, sixteen flag counters by name."""
    start, end = number("bidirectional_first_seen_ms") / 1e3, number("bidirectional_last_seen_ms") / 1e3
    cols = _ends("src_ip", "src_port", "dst_ip", "dst_port", "protocol") | {"t_start": start, "t_end": end, "duration": end - start}
    for d, way in (("fwd", "src2dst"), ("bwd", "dst2src")):
        cols |= {f"pkts_{d}": number(f"{way}_packets"), f"bytes_{d}": number(f"{way}_bytes")}
        cols |= {f"{f}_{d}": number(f"{way}_{f}_packets") for f in FLAGS if f"{way}_{f}_packets" in df.columns}
    return _canonical(df, "nfstream", dataset, capture, cols)


Adapter = Callable[[DataFrame, str, str], DataFrame]
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"zeek": read_hash_tsv, "tranalyzer": read_percent_tsv, "cicflowmeter": read_drifting_csv, "argus": read_csv, "goflows": read_csv, "yaf": read_flow_ndjson, "joy": read_packet_ndjson, "nfstream": lambda s, p: s.read.parquet(p)}
ADAPTERS: dict[str, Adapter] = {"zeek": from_zeek, "tranalyzer": from_tranalyzer, "cicflowmeter": from_cicflowmeter, "argus": from_argus, "goflows": from_goflows, "yaf": from_yaf, "joy": from_joy, "nfstream": from_nfstream}


def ingest(spark: SparkSession, tool: str, path: str, dataset: str, capture: str, max_flows: int | None = None) -> DataFrame:
    """A native log as canonical flows; O3: with ``max_flows`` some of them, at most so many."""
    flows = ADAPTERS[tool](READERS[tool](spark, path), dataset, capture)
    return flows if max_flows is None else flows.limit(max_flows)


