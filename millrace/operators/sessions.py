"""Packets to flows: two-timeout sessions, per-direction counts, packet sequences, gap windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.flow import FLAGS, endpoint_key
from millrace.operators.ranges import dealt, numbered_runs, running_sums, scanned, stored

KEY = ("capture", "key")
#: Packets of a key that are sorted in one task; where a key has more, all packets are sorted into ranges.
HOT_KEY = 200_000
#: Packets of a task on average; more of them take more tasks, whatever the number of shuffle partitions.
TASK_ROWS = 200_000
#: The bytes kept of each packet of a sequence.
PACKET_BYTES = 128


def _in_ranges(packets: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Packets in sorted ranges where a key has more than ``HOT_KEY`` of them, by a count; else each key in one task.

    Tasks or ranges hold ``TASK_ROWS`` packets on average at most, so what a task sorts doesn't grow with the table.
    """
    if "_part" in packets.columns:
        return packets
    varies = [(F.min(F.xxhash64(k)) != F.max(F.xxhash64(k))).alias(f"_varies{i}") for i, k in enumerate(keys)]
    sizes = packets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("rows"), *varies).first()
    tasks = -(-(sizes["rows"] or 0) // TASK_ROWS)
    if (sizes["most"] or 0) > HOT_KEY:
        return dealt(packets, [*keys, order], tasks)
    # Windows leave out columns that are literals, and would shuffle anew what is dealt by these too.
    by = [k for i, k in enumerate(keys) if sizes[f"_varies{i}"]] or list(keys)
    return packets.repartition(tasks, *by) if tasks > int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions")) else packets


def idle_sessions(packets: DataFrame, idle_us: int, keys: Sequence[str] = KEY, time: str = "ts_us", order: str = "frame_no", ranges: bool = False) -> DataFrame:
    """``session`` numbers the runs of a key whose gaps are at most ``idle_us``.

    Where keys are hot, packets are sorted into ranges, and a range takes over the last time and the number of gaps of the
    key's ranges before it, so a key may have any number of packets. ``ranges`` keeps the number of the range, ``_part``.
    """
    out = numbered_runs(_in_ranges(packets, keys, order), keys, [order], time, lambda before, now: now - before > idle_us, "session")
    return out if ranges else out.drop("_part")


def pointed(records: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """(keys, t, to): for each record's time the key's first later record over ``reach`` after it; none: no row.

    Times and times plus ``reach`` are sorted together, backwards, and each of the latter takes the record before it.
    """
    none = F.lit(None).cast("long")

    def mark(at: Column, kind: int, record: Column, origin: Column) -> Column:
        return F.struct(at.alias("_at"), F.lit(kind).alias("_kind"), record.alias("_record"), origin.alias("_from"))

    marks = F.explode(F.array(mark(-F.col("t") - reach, 0, none, F.col("t")), mark(-F.col("t"), 1, F.col("t"), none))).alias("m")
    table = dealt(records.select(*keys, marks).select(*keys, "m.*"), [*keys, "_at", "_kind"])
    # Records come latest first, so the record that a query has passed last is the smallest so far.
    found = scanned(table, keys, ["_at", "_kind"], {"_to": ("largest_before", -F.col("_record"))})
    return found.where(F.col("_from").isNotNull() & F.col("_to").isNotNull()).select(*keys, F.col("_from").alias("t"), (-F.col("_to")).alias("to"))


def restarts(records: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """(keys, t): the times reached from each key's first one by going to the first over ``reach`` later, again and again.

    Pointer doubling: a round follows the pointers of all times known and replaces every pointer by where two of it lead,
    so n restarts take log2(n) rounds; pointers that lead beyond the end go.
    """
    jumps = stored(pointed(records, keys, reach))
    known = stored(records.groupBy(*keys).agg(F.min("t").alias("t")))
    while not jumps.isEmpty():
        ahead = known.join(jumps, [*keys, "t"]).select(*keys, F.col("to").alias("t"))
        known = stored(known.union(ahead))
        second = jumps.select(*keys, F.col("t").alias("to"), F.col("to").alias("_further"))
        jumps = stored(jumps.join(second, [*keys, "to"]).select(*keys, "t", F.col("_further").alias("to")))
    return known


def active_segments(packets: DataFrame, active_us: int, keys: Sequence[str] = (*KEY, "session"), time: str = "ts_us", order: str = "frame_no", ranges: bool = False) -> DataFrame:
    """``segment`` restarts a session at the first packet more than ``active_us`` after its segment's start.

    A restart is later than all packets before it, so only such packets (records) of sessions longer than the timeout
    are looked at. No session is gathered anywhere.
    """
    table = stored(scanned(_in_ranges(packets, keys, order), keys, [order], {"_most": ("largest_before", F.col(time))}))
    fresh = F.col("_most").isNull() | (F.col(time) > F.col("_most"))
    whole = F.struct(*keys)  # nulls in a key equal each other within a struct
    long = table.groupBy(whole.alias("_key")).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi")).where(F.col("_hi") - F.col("_lo") > active_us).select("_key")
    records = table.where(fresh).select(whole.alias("_key"), F.col(time).alias("t")).join(long, "_key", "left_semi")
    starts = restarts(stored(records), ["_key"], active_us).withColumnRenamed("t", "_t")
    # A restart's time is new in its session, so the first packet of that time is the restart.
    again = F.when(fresh & F.col("_t").isNotNull() & F.col("_most").isNotNull(), 1).otherwise(0).cast("long")
    joined = table.join(starts, (whole == F.col("_key")) & (F.col(time) == F.col("_t")), "left").withColumn("_start", again).drop("_t", "_most", "_key")
    out = scanned(joined, keys, [order], {"segment": ("sum", F.col("_start"))}).drop("_start")
    return out if ranges else out.drop("_part")


def segmented(packets: DataFrame, idle_us: int, active_us: int | None = None) -> DataFrame:
    """Packets with key, session, segment and the number of their range, ``_part``."""
    sessions = idle_sessions(packets.withColumn("key", endpoint_key()), idle_us, ranges=True)
    return active_segments(sessions, active_us, ranges=True) if active_us is not None else sessions.withColumn("segment", F.lit(0).cast("long"))


def assemble(packets: DataFrame, idle_us: int, active_us: int | None = None, sequence: int = 0, extra: Sequence[Column] = ()) -> DataFrame:
    """Flows of packets (capture, frame_no, ts_us, 5-tuple, wire_len, optional tcp_flags and ip_bytes).

    A flow ends after a gap over ``idle_us`` or when a packet comes more than ``active_us`` after its start. Its
    initiator is the sender of its first packet; times follow the order of frames. ``sequence`` keeps that many first
    packets' directions, offsets and sizes, and where there are ``ip_bytes`` the first 128 bytes of each as ``packet_bytes``
    (``functions.flow`` has tokens, layout and image of these); ``extra`` aggregates over the flow's packets (``fwd`` tells the direction).
    """
    s = segmented(packets, idle_us, active_us)
    group = (*KEY, "session", "segment")
    scans = {"_first": ("first", F.struct("src_ip", "src_port", "dst_ip", "dst_port", "ts_us")), "_rn": ("sum", F.lit(1).cast("long"))}
    s = scanned(s, group, ["frame_no"], scans).withColumn("fwd", (F.col("src_ip") == F.col("_first.src_ip")) & F.col("src_port").eqNullSafe(F.col("_first.src_port")))
    aggs = [
        F.min_by(F.struct("src_ip", "src_port", "dst_ip", "dst_port", "proto"), "frame_no").alias("_e"),
        F.min_by("ts_us", "frame_no").alias("t_start_us"), F.max_by("ts_us", "frame_no").alias("t_end_us"),
        F.count(F.lit(1)).alias("n_pkts"), F.sum("wire_len").alias("n_bytes"),
        F.count_if("fwd").alias("pkts_fwd"), F.count_if(~F.col("fwd")).alias("pkts_bwd"),
        F.coalesce(F.sum(F.when(F.col("fwd"), F.col("wire_len"))), F.lit(0)).alias("bytes_fwd"), F.coalesce(F.sum(F.when(~F.col("fwd"), F.col("wire_len"))), F.lit(0)).alias("bytes_bwd"),
    ]
    kept = [("dir", "dirs"), ("t", "times"), ("size", "sizes")]
    if sequence:
        content = [F.coalesce(F.substring("ip_bytes", 1, PACKET_BYTES), F.lit(b"")).alias("bytes")] if "ip_bytes" in packets.columns else []
        kept += [("bytes", "packet_bytes")] if content else []
        item = F.struct("frame_no", F.when(F.col("fwd"), 0).otherwise(1).alias("dir"), F.round((F.col("ts_us") - F.col("_first.ts_us")) / 1e6, 6).alias("t"), F.col("wire_len").alias("size"), *content)
        aggs.append(F.array_sort(F.collect_list(F.when(F.col("_rn") <= sequence, item))).alias("_seq"))
    flows = s.groupBy(*group).agg(*aggs, *extra).select("*", "_e.*").drop("_e")
    if sequence:
        flows = flows.select("*", *[F.col(f"_seq.{f}").alias(n) for f, n in kept]).drop("_seq")
    return flows.withColumns({"t_start": F.col("t_start_us") / 1e6, "t_end": F.col("t_end_us") / 1e6, "duration": (F.col("t_end_us") - F.col("t_start_us")) / 1e6})


def flag_counters() -> list[Column]:
    """A1: aggregates for ``assemble``: packets of each direction with each TCP flag."""
    return [F.count_if(F.col("fwd").eqNullSafe(d == "fwd") & (F.col("tcp_flags").bitwiseAND(m) != 0)).alias(f"{f}_{d}") for f, m in FLAGS.items() for d in ("fwd", "bwd")]


def aggregate_by_spec(packets: DataFrame, spec: dict) -> DataFrame:
    """A2: flows by a spec: ``keys``, ``features`` (name to SQL aggregate), ``idle``, ``active`` in seconds, ``bidirectional``."""
    keys = list(spec["keys"])
    if spec.get("bidirectional", True):
        packets, keys = packets.withColumn("key", endpoint_key()), ["key"]
    group = ["capture", *keys]
    s = idle_sessions(packets, int(spec["idle"] * 1e6), group, ranges=True)
    if spec.get("active"):
        s = active_segments(s, int(spec["active"] * 1e6), (*group, "session"))
    else:
        s = s.withColumn("segment", F.lit(0).cast("long"))
    return s.groupBy(*group, "session", "segment").agg(*[F.expr(e).alias(n) for n, e in spec["features"].items()])


def number_flows(flows: DataFrame) -> DataFrame:
    """``flow_no`` from 1 by start and key in each capture, counted over sorted ranges."""
    numbered = running_sums(flows.withColumn("_one", F.lit(1).cast("long")), ["capture"], ["t_start_us", "key", "session", "segment"], ["_one"])
    return numbered.withColumnRenamed("run__one", "flow_no").drop("_one", "all__one")


def gap_windows(events: DataFrame, keys: Sequence[str], time: str, gap: float, pad: float = 0.0, clamp: bool = False) -> DataFrame:
    """Windows of a key's times without gaps over ``gap`` seconds, padded; ``clamp`` cuts at the start's UTC midnight."""
    runs = numbered_runs(_in_ranges(events, keys, time), keys, [time], time, lambda before, now: now - before > gap, "window_no")
    out = runs.groupBy(*keys, "window_no").agg((F.min(time) - pad).alias("w_start"), (F.max(time) + pad).alias("w_end"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("w_end", F.least("w_end", (F.floor(F.col("w_start") / 86400) + 1) * 86400 - 1)) if clamp else out


def bursts(packets: DataFrame, keys: Sequence[str], direction: str, order: str, time: str, size: str, most_packets: int = 6, most_bursts: int = 12) -> DataFrame:
    """Maximal runs of one direction, cut every ``most_packets``; the first ``most_bursts`` of each flow.

    Gives direction, bytes, packets and the gap in milliseconds to the burst before.
    """
    runs = numbered_runs(_in_ranges(packets, keys, order), keys, [order], direction, lambda before, now: before != now, "_run")
    placed = scanned(runs, [*keys, "_run"], [order], {"_at": ("sum", F.lit(1).cast("long"))})
    # The first bursts lie in the first runs, so a flow keeps a bounded number of packets for what follows.
    runs = placed.where((F.col("_run") < most_bursts) & (F.col("_at") <= most_bursts * most_packets)).drop("_part")
    part = F.floor((F.col("_at") - 1) / most_packets)
    grouped = runs.withColumn("_part", part).groupBy(*keys, "_run", "_part").agg(F.min(direction).alias("direction"), F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("packets"), F.min(time).alias("first_us"), F.max(time).alias("last_us"))
    by = W.partitionBy(*keys).orderBy("_run", "_part")
    out = grouped.withColumn("burst", F.row_number().over(by)).withColumn("gap_ms", F.coalesce((F.col("first_us") - F.lag("last_us").over(by)) / 1e3, F.lit(0.0)))
    return out.where(F.col("burst") <= most_bursts).select(*keys, "burst", "direction", "bytes", "packets", "gap_ms")
