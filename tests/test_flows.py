"""Flow operators on hand-made rows: assembly, contract, alignment, labels, keys, addresses, statistics."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from millrace.functions import flow as fn
from millrace.operators import alignment as al
from millrace.operators import contract as ct
from millrace.operators import evaluation as ev
from millrace.operators import inference as inf
from millrace.operators import labeling as lb
from millrace.operators import sessions as se
from millrace.sources import logs, pcap

US = 1_000_000
PACKET = "capture string, frame_no long, ts_us long, src_ip string, src_port int, dst_ip string, dst_port int, proto int, wire_len int, tcp_flags int"
S, SA, A, PA, FA, RA = 2, 18, 16, 24, 17, 20


def capture():
    """A mail session, a time query, a shell with a pause of 200 s, probes of 15 hosts, and a refused connection."""
    t0, rows = 1_704_110_400 * US, []

    def add(t, src, sp, dst, dp, proto, flags=0, size=60):
        rows.append(("lab", len(rows), t0 + round(t * US), src, sp, dst, dp, proto, size, flags))

    def talk(start, client, server, proto, *steps):
        for k, (way, flags, size) in enumerate(steps):
            ends = (*client, *server) if way == ">" else (*server, *client)
            add(start + 0.02 * k, *ends, proto, flags, size)

    mail = (("172.20.1.5", 33010), ("198.51.100.25", 25))
    talk(0.5, *mail, 6, (">", S, 44), ("<", SA, 44), (">", A, 40), ("<", PA, 88), (">", PA, 61), ("<", PA, 70), (">", PA, 900), (">", PA, 420), ("<", A, 40), ("<", PA, 66), (">", FA, 40), ("<", FA, 40), (">", A, 40))
    talk(2.0, ("172.20.1.6", 50123), ("203.0.113.9", 123), 17, (">", 0, 76), ("<", 0, 76), ("<", 0, 76))
    shell = (("172.20.1.7", 41007), ("198.51.100.22", 22))
    talk(4.0, *shell, 6, (">", S, 44), ("<", SA, 44), (">", A, 40), ("<", PA, 61), (">", PA, 61))
    talk(204.0, *shell, 6, (">", PA, 76), ("<", PA, 120), (">", RA, 40))
    for i in range(15):
        add(5 + 0.25 * i, "172.20.9.9", 7777, f"172.20.2.{i + 1}", 161, 17, size=71)
    talk(9.0, ("172.20.1.8", 52001), ("198.51.100.80", 8443), 6, (">", S, 44), ("<", RA, 40))
    return rows


def test_assembly_of_known_capture(spark):
    p = spark.createDataFrame(capture(), PACKET)
    assert p.count() == 41
    flows = se.assemble(p, 120 * US, extra=se.flag_counters(), sequence=4).collect()
    assert len(flows) == 20 and sum(f.n_pkts for f in flows) == 41
    assert se.assemble(p, 10_000 * US).count() == 19
    mail = next(f for f in flows if f.dst_port == 25)
    assert (mail.src_ip, mail.pkts_fwd, mail.pkts_bwd, mail.syn_fwd, mail.syn_bwd, mail.fin_fwd, mail.fin_bwd, mail.psh_fwd, mail.psh_bwd, mail.rst_fwd) == ("172.20.1.5", 7, 6, 1, 1, 1, 1, 3, 3, 0)
    assert (mail.bytes_fwd, mail.bytes_bwd) == (1545, 348)
    assert mail.dirs == [0, 1, 0, 1] and mail.times == pytest.approx([0, 0.02, 0.04, 0.06])
    assert sorted((f.pkts_fwd, f.pkts_bwd) for f in flows if f.dst_port == 22) == [(2, 1), (3, 2)]
    refused = next(f for f in flows if f.dst_port == 8443)
    assert (refused.pkts_fwd, refused.pkts_bwd, refused.rst_bwd) == (1, 1, 1)
    assert sum(f.dst_port == 161 and f.n_pkts == 1 for f in flows) == 15


def test_timeouts_are_strict(spark):
    def flows(times, idle, active=None):
        rows = [("c", i, round(t * US), "1.1.1.1", 1, "2.2.2.2", 2, 6, 60, 0) for i, t in enumerate(times)]
        return sorted((f.t_start_us / US, f.n_pkts) for f in se.assemble(spark.createDataFrame(rows, PACKET), idle * US, active * US if active else None).collect())

    assert len(flows([0, 120], 120)) == 1 and len(flows([0, 120.000001], 120)) == 2
    assert flows([100.0 * i for i in range(41)], 120, 1800) == [(0.0, 19), (1900.0, 19), (3800.0, 3)]
    assert flows([0, 1800, 1800.5], 5000, 1800) == [(0.0, 2), (1800.5, 1)]


def flow(**change):
    row = dict(src_ip="172.20.4.1", src_port=51000, dst_ip="198.51.100.9", dst_port=993, proto="6", t_start=5000.0, t_end=5002.5, duration=2.5, pkts_fwd=7, pkts_bwd=4, bytes_fwd=910, bytes_bwd=1520, tool="t", dataset="d", capture="c", flow_id="0")
    return row | change


def test_contract(spark):
    def found(**change):
        df = spark.createDataFrame([flow(**change)])
        return {r.problem for r in ct.problems(ct.coerce(df)).collect()}

    assert found() == set()
    assert found(bytes_bwd=-20) == {"negative bytes_bwd"}
    assert "reversed time" in found(t_start=5003.0, t_end=5001.0, duration=-2.0)
    with pytest.raises(ValueError):
        ct.coerce(spark.createDataFrame([flow(colour="red")]))
    kept = ct.coerce(ct.prefix_native(spark.createDataFrame([flow(ttl_sum=129, tool_x=1)])))
    assert kept.columns[: len(ct.CORE)] == list(ct.CORE) and {"tool_ttl_sum", "tool_x"} <= set(kept.columns)
    assert kept.first().syn_fwd is None
    text = spark.createDataFrame([(x,) for x in ("tcp", "UDP", "6", "6.0", "nan", "", None)], "p string")
    assert [r[0] for r in text.select(fn.protocol_number(F.col("p"))).collect()] == [6, 17, 6, 6, None, None, None]


def test_write_and_read_flows(spark, tmp_path):
    df = spark.createDataFrame([flow(), flow(capture="e")])
    ct.write_flows(df, str(tmp_path / "flows"))
    assert spark.read.parquet(str(tmp_path / "flows")).groupBy("capture").count().count() == 2
    with pytest.raises(ValueError):
        ct.write_flows(spark.createDataFrame([flow(src_ip=None, pkts_fwd=-3)], df.schema), str(tmp_path / "bad"))


@pytest.mark.parametrize(("a", "b", "want"), [
    ([(100, 140)], [(90, 150)], ["1:1"]),  # inside
    ([(2, 6)], [(6, 6)], ["1:1"]),  # an end and an instant
    ([(7, 7), (61, 75)], [(8, 9), (62, 63)], ["unmatched", "1:1"]),
    ([(0, 100)], [(5, 10), (40, 41), (99, 120)], ["split"]),
    ([(3, 9), (30, 44), (50, 52)], [(8, 31)], ["merge", "merge", "unmatched"]),
    ([(0, 20), (15, 40)], [(10, 18), (19, 33)], ["split", "split"]),  # each meets both
    ([(0, 20), (30, 40)], [(18, 33), (35, 60)], ["merge", "split"]),  # a chain
])
def test_alignment_categories(spark, a, b, want):
    def side(spans):
        return spark.createDataFrame([("k", i, s, e) for i, (s, e) in enumerate(spans)], "key string, row_id long, t_start_us long, t_end_us long")

    for bins in (None, 3):
        pairs = al.overlap_pairs(side(a), side(b), bin_us=bins)
        assert [r.category for r in al.categories(side(a), pairs).orderBy("row_id").collect()] == want


def test_keys_ignore_direction(spark):
    rows = [("172.18.0.40", 61022, "203.0.113.200", 5432, 6), ("203.0.113.200", 5432, "172.18.0.40", 61022, 6), ("172.18.0.40", None, "203.0.113.200", None, None)]
    df = spark.createDataFrame(rows, "src_ip string, src_port int, dst_ip string, dst_port int, proto int").select(fn.endpoint_key().alias("a"), fn.text_key().alias("b")).collect()
    assert df[0] == df[1] != df[2] and df[2].a.lo.port == -1


def test_addresses(spark):
    ips = ["198.18.99.3", "198.18.128.1", "2001:db8:a123::1", "fe80::7", "host", "300.1.1.1", None, "2001:db8:bfff:0:0:0:0:1", "239.1.2.3", "2001:db8:a000::198.51.100.7", "2001:db8:a000::198.51.100.400"]
    df = spark.createDataFrame([(x,) for x in ips], "ip string")
    got = [tuple(r) for r in df.select(fn.in_cidrs(F.col("ip"), ["198.18.64.9/18", "2001:db8:a000::/35"]), fn.is_host(F.col("ip"))).collect()]
    assert [g[0] for g in got] == [True, False, True, False, False, False, False, True, False, True, False]
    assert [g[1] for g in got][:9] == [True, True, True, True, True, True, False, True, False]
    text = spark.createDataFrame([(x,) for x in (" Normal ", "benign", " port sweep ", None)], "l string")
    assert [r[0] for r in text.select(fn.fold_benign(F.col("l"))).collect()] == ["BENIGN", "BENIGN", "port sweep", None]
    ports = spark.createDataFrame([(x,) for x in ("80", "80.0", "x", None)], "p string")
    assert [r[0] for r in ports.select(fn.int_or_minus(F.col("p"))).collect()] == [80, 80, -1, -1]


RULE = {"label": "guess", "t_start": 20_000.0, "t_end": 27_200.0, "attackers": ["203.0.113.66"], "victims": ["172.20.0.10"], "dst_ports": [22], "protos": [6]}


@pytest.mark.parametrize(("change", "label", "confidence"), [
    ({}, "guess", "exact"), (dict(src_ip="172.20.0.10", src_port=22, dst_ip="203.0.113.66", dst_port=9), "guess", "exact"), (dict(t_start=27_100.0, t_end=27_300.0), "guess", "window_edge"),
    (dict(src_ip="203.0.113.67"), "BENIGN", "benign"), (dict(t_start=27_201.0, t_end=27_300.0), "BENIGN", "benign"), (dict(dst_port=2222), "BENIGN", "benign"),
])
def test_rules(spark, change, label, confidence):
    row = dict(row_id=1, src_ip="203.0.113.66", src_port=9, dst_ip="172.20.0.10", dst_port=22, proto=6, t_start=21_000.0, t_end=21_004.0) | change
    out = lb.label_flows(spark.createDataFrame([row]), [RULE]).first()
    assert (out.label, out.label_confidence, out.n_rule_matches) == (label, confidence, int(label != "BENIGN"))


def test_first_rule_wins_and_direction_counts(spark):
    df = spark.createDataFrame([dict(row_id=1, src_ip="172.20.0.10", src_port=22, dst_ip="203.0.113.66", dst_port=9, proto=6, t_start=21_000.0, t_end=21_004.0)])
    out = lb.label_flows(df, [RULE | {"directional": True, "label": "one"}, RULE | {"label": "two"}, RULE | {"label": "three"}]).first()
    assert (out.label, out.n_rule_matches) == ("two", 2)
    assert lb.label_flows(df, [RULE | {"captures": ["mon"]}], "tue").first().label == "BENIGN"


def test_projection_tolerance(spark):
    key = dict(src_ip="a", src_port=1, dst_ip="b", dst_port=2, proto=6)
    rows = [dict(row_id=i, t_start=t, label="BENIGN", binary_label="BENIGN", label_confidence="benign", **key) for i, t in enumerate((98.0, 102.0, 102.001))]
    rows.append(rows[0] | dict(row_id=3, src_ip="b", dst_ip="a"))
    rows.append(rows[0] | dict(row_id=4, label="x", binary_label="ATTACK"))
    out = lb.project_reference(spark.createDataFrame(rows), spark.createDataFrame([dict(t_start=100.0, **key)]), "recon").orderBy("row_id").collect()
    assert [r.label for r in out] == ["recon", "recon", "BENIGN", "BENIGN", "x"]


def test_report_of_known_matrix(spark):
    """F1 is 2 * 90 / (120 + 100) = 9 / 11 for one class and 2 * 70 / (80 + 100) = 7 / 9 for the other."""
    cells = {("BENIGN", "BENIGN"): 90, ("BENIGN", "ATTACK"): 10, ("ATTACK", "BENIGN"): 30, ("ATTACK", "ATTACK"): 70}
    m = spark.createDataFrame([(t, p, n) for (t, p), n in cells.items()], "truth string, predicted string, n long")
    got = ev.summary(ev.class_report(m)).first()
    assert (got.macro_f1, got.balanced_accuracy) == (pytest.approx((9 / 11 + 7 / 9) / 2), pytest.approx(0.8))


def test_ranking_metrics_with_ties(spark):
    rows = [(0.9, 1), (0.8, 1), (0.8, 0), (0.3, 0), (0.3, 1)]
    r = ev.ranking_metrics(spark.createDataFrame([("g", s, y) for s, y in rows], "g string, score double, label int"), ["g"]).first()
    pairs = [(a, b) for a, y in rows if y for b, z in rows if not z]
    assert r.roc_auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))
    assert r.average_precision == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)


def test_normal_tail_and_pareto(spark):
    z = spark.createDataFrame([(0.0,), (1.0,), (1.959964,), (4.0,), (8.0,)], "z double")
    assert [r[0] for r in z.select(inf.normal_tail(F.col("z"))).collect()] == pytest.approx([0.5, 0.158655254, 0.025, 3.16712e-05, 6.22096e-16], rel=1e-5)
    pts = spark.createDataFrame([("a", 9.0, 0.5), ("b", 5.0, 0.7), ("c", 4.0, 0.6), ("d", 4.0, 0.9)], "n string, r double, q double")
    assert [r.n for r in inf.pareto(pts, "r", "q", "n").where("optimal").orderBy("n").collect()] == ["a", "b", "d"]


def test_nearest_prefers_smaller_id_on_ties(spark):
    left = spark.createDataFrame([("k", 10, 1), ("k", 0, 2), ("z", 5, 3)], "key string, t long, row_id long")
    right = spark.createDataFrame([("k", 8, 7, "x"), ("k", 12, 6, "y"), ("k", 30, 1, "w")], "key string, t long, row_id long, v string")
    got = {r.row_id: (r.near_id, r.near_v) for r in al.nearest(left, right, "key", "t", ["v"]).collect()}
    assert got == {1: (6, "y"), 2: (7, "x"), 3: (None, None)}


def pcap_bytes(cut=0):
    eth = bytes(12) + b"\x08\x00"
    vlan = bytes(12) + b"\x81\x00\x00\x05\x08\x00"
    ip = bytes.fromhex("450000280000000040060000") + bytes([10, 0, 0, 1, 10, 0, 0, 2])
    tcp = struct.pack(">HHIIBBHHH", 443, 80, 0, 0, 0x50, 0x12, 100, 0, 0)
    frames = [eth + ip + tcp, vlan + ip + tcp, bytes(12) + b"\x08\x06" + bytes(30), eth + ip + tcp]
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack("<IIII", 100 + i, 5, len(f), len(f)) + f
    return out[: len(out) - cut]


def test_capture_source(spark, tmp_path):
    (tmp_path / "one.pcap").write_bytes(pcap_bytes())
    (tmp_path / "two.pcap").write_bytes(pcap_bytes(cut=7))
    pcap.register(spark)
    for df in (spark.read.format("pcap").load(str(tmp_path)), pcap.read_captures(spark, str(tmp_path))):
        rows = sorted((r.capture, r.frame_no, r.ts_us, r.src_ip, r.src_port, r.dst_port, r.tcp_flags) for r in df.collect())
        assert rows == [(c, n, (100 + n) * US + 5, "10.0.0.1", 443, 80, 18) for c, n in (("one", 0), ("one", 1), ("one", 3), ("two", 0), ("two", 1))]
    assert pcap.fingerprints(spark, str(tmp_path)).select("fingerprint").distinct().count() == 2


def test_log_adapters(spark, tmp_path):
    (tmp_path / "conn.log").write_text("#separator \\x09\n#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tduration\torig_pkts\tresp_pkts\torig_ip_bytes\tresp_ip_bytes\ts_syn\n100.5\tC1\t1.1.1.1\t5\t2.2.2.2\t80\ttcp\t-\t3\t2\t300\t200\t1\n#close\n")
    z = logs.ingest(spark, "zeek", str(tmp_path / "conn.log"), "d", "c").first()
    assert (z.proto, z.t_start, z.t_end, z.duration, z.pkts_fwd, z.syn_fwd, z.ece_fwd) == (6, 100.5, 100.5, 0.0, 3, 1, None)
    (tmp_path / "cic.csv").write_text("Flow ID, Src IP,Src Port,Dst IP,Dst Port,Protocol,Timestamp,Flow Duration,Total Fwd Packet,Total Bwd packets,Tot Len Fwd Pkts,Total Length of Bwd Packets,Fwd PSH Flags,Idle Mean\nx,1.1.1.1,5,2.2.2.2,80,6,04/07/2017 09:20:00 AM,-5,1,0,10,0,1,3.5\n")
    c = logs.ingest(spark, "cicflowmeter", str(tmp_path / "cic.csv"), "d", "c").first()
    assert (c.t_start, c.duration, c.pkts_fwd, c.bytes_fwd, c.psh_fwd, c.tool_idle_mean) == (1499160000.0, 0.0, 1, 10, 1, "3.5")
    (tmp_path / "yaf.json").write_text('{"stats":{"x":1}}\n\nnot json\n{"flows":{"sourceIPv4Address":"1.1.1.1","destinationIPv4Address":"2.2.2.2","protocolIdentifier":17,"flowStartMilliseconds":"2021-07-07 12:00:00.5","flowEndMilliseconds":"2021-07-07 12:00:01","packetTotalCount":2,"octetTotalCount":99}}\n{"sourceIPv6Address":"::1","flowStartMilliseconds":"2021-07-07 12:00:00"}\n')
    y = logs.ingest(spark, "yaf", str(tmp_path / "yaf.json"), "d", "c").collect()
    assert len(y) == 1 and (y[0].t_start, y[0].duration, y[0].pkts_fwd, y[0].pkts_bwd) == (1625659200.5, 0.5, 2, 0)
    (tmp_path / "joy.json").write_text('{"version":"1"}\n{"sa":"1.1.1.1","da":"2.2.2.2","sp":1,"dp":2,"pr":6,"time_start":10.0,"time_end":9.0,"num_pkts_out":2,"bytes_out":7,"packets":[{"b":3,"dir":">","ipt":0},{"b":5,"dir":">","ipt":4}]}\n')
    j = logs.ingest(spark, "joy", str(tmp_path / "joy.json"), "d", "c").first()
    assert (j.t_end, j.tool_fwd_size_mean, j.tool_fwd_size_std, j.tool_iat_n, j.tool_bwd_size_n) == (10.0, 4.0, 1.0, 1.0, None)
    (tmp_path / "argus.csv").write_text("StartTime,LastTime,Dur,Proto,SrcAddr,Sport,DstAddr,Dport,SrcPkts,DstPkts,SrcBytes,DstBytes\n10,,2,tcp,1.1.1.1,1,2.2.2.2,2,1,1,9,9\n10,11,1,man,0,,0,,1,1,9,9\n")
    a = logs.ingest(spark, "argus", str(tmp_path / "argus.csv"), "d", "c").collect()
    assert len(a) == 1 and (a[0].t_end, a[0].duration) == (12.0, 2.0)


def streamed(spark, tmp_path, name, rows, files, idle, active, late):
    """Flows of packets that come in that many files, a file a batch, the last packet in the last file."""
    from millrace.streaming import flows as st

    folder = tmp_path / name
    for i in range(files):
        spark.createDataFrame(rows[:-1][i::files] + (rows[-1:] if i == files - 1 else []), PACKET).coalesce(1).write.mode("append").parquet(str(folder))
    s = spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("ts", F.timestamp_micros("ts_us"))
    q = st.assembled_flows(s, idle * US, active * US, late).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}_state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r.key, r.t_start_us, r.t_end_us, r.n_pkts, r.n_bytes) for r in spark.table(name).collect())


def test_stream_gives_equal_flows_however_batches_are_cut(spark, tmp_path):
    base = 1_700_000_000  # a packet at time 0 would be late from the start
    made = random.Random(4)
    times = [0, 50, 100, 400, 1000, 1001, 1090, 1000 + 200, 100 + 1000, 150 + 1000, 205 + 1000] + [made.uniform(1300, 4000) for _ in range(60)]
    rows = [("c", i, int((base + t) * US), "1.1.1.1", 1 + i % 2, "2.2.2.2", 2, 6, 60 + i, 0) for i, t in enumerate(times)]
    rows.append(("c", 999, (base + 90_000) * US, "1.1.1.1", 9, "2.2.2.2", 2, 6, 60, 0))  # takes the watermark past all others
    got = [streamed(spark, tmp_path, f"cut{files}", rows, files, 120, 800, "20 hours") for files in (1, 2, 5)]
    assert got[0] == got[1] == got[2]
    want = []
    for port in (1, 2):
        flow = None
        for _, t, frame, size in sorted((r[4], r[2], r[1], r[8]) for r in rows if r[4] == port):
            if flow and t - flow[1] <= 120 * US and t - flow[0] <= 800 * US:
                flow = [flow[0], t, flow[2] + 1, flow[3] + size]
            else:
                want += [flow] if flow else []
                flow = [t, t, 1, size]
        want.append(flow)
    closed = [f for f in want if min(f[1] + 120 * US, f[0] + 800 * US) < (base + 90_000 - 72_000) * US]
    assert len(closed) == len(want) and sorted(g[1:] for g in got[0]) == sorted(map(tuple, want))


def test_stream_of_ordered_packets_equals_the_batch(spark, tmp_path):
    base = 1_700_000_000
    times = [0, 50, 100, 400, 1000, 1001, 9000, 90_000]
    rows = [("c", i, (base + t) * US, "1.1.1.1", 1, "2.2.2.2", 2, 6, 60, 0) for i, t in enumerate(times)]
    got = [(g[1] // US - base, g[3]) for g in streamed(spark, tmp_path, "ordered", rows, 1, 120, 80, "0 seconds")]
    want = sorted((f.t_start_us // US - base, f.n_pkts) for f in se.assemble(spark.createDataFrame(rows, PACKET), 120 * US, 80 * US).collect())
    assert got == want[:-1]  # the last packet's flow stays open


def test_streams_of_many_keys_share_few_states(spark, tmp_path):
    """Flows of each key, also of null addresses, equal plain steps; the state's rows grow with the buckets, not with keys or packets."""
    from millrace.streaming import flows as st

    base, r, idle, active = 1_700_000_000, random.Random(9), 100, 250
    rows = [("c", i, (base + r.randrange(3000)) * US + r.randrange(US), r.choice([None, f"1.1.{i % 10}.{i % 7}"]) if i % 9 == 0 else f"1.1.{i % 10}.{i % 7}", i % 3, "2.2.2.2", 2, 6, r.randrange(900), 0) for i in range(4000)]
    (tmp_path / "in").mkdir()
    for part in (rows[0::2], rows[1::2]):
        spark.createDataFrame(part, PACKET).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(PACKET).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_micros("ts_us"))
    q = st.assembled_flows(read, idle * US, active * US, "20 minutes", 4).writeStream.format("memory").queryName("many").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    passed, want, flows = max(x[2] for x in rows) // 1000 * 1000 - 1200 * US, [], {}
    keyed = spark.createDataFrame(rows, PACKET).select(fn.text_key().alias("key"), "ts_us", "wire_len").collect()
    assert len({x.key for x in keyed}) > 150
    for x in sorted(keyed, key=lambda x: x.ts_us):
        f = flows.get(x.key)
        if f and x.ts_us - f[2] <= idle * US and x.ts_us - f[1] <= active * US:
            f[2:] = [x.ts_us, f[3] + 1, f[4] + x.wire_len]
        else:
            flows[x.key] = [x.key, x.ts_us, x.ts_us, 1, x.wire_len]
            want.append(flows[x.key])
    closed = [f for f in want if min(f[2] + idle * US, f[1] + active * US) < passed]
    assert 0 < len(closed) < len(want)
    assert sorted(map(repr, map(tuple, spark.table("many").collect()))) == sorted(map(repr, map(tuple, closed)))
    assert 0 < max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) <= 4 * 8


def plain_segments(packets, idle, active):
    """(frame, session, segment) of one key's (frame, time) rows, one after the other."""
    out, session, segment, start, last = [], 0, 0, None, None
    for frame, t in sorted(packets):
        if last is not None and t - last > idle:
            session, segment, start = session + 1, 0, t
        elif start is not None and t - start > active:
            segment, start = segment + 1, t
        start = t if start is None else start
        out.append((frame, session, segment))
        last = t
    return out


@pytest.mark.parametrize(("seed", "hot"), [(0, 50), (1, 50), (2, 10_000)])
def test_sessions_and_segments_over_ranges(spark, monkeypatch, seed, hot):
    """Keys that reach over many ranges, times out of order, ties and null addresses; without hot keys the same."""
    monkeypatch.setattr(se, "HOT_KEY", hot)
    r = random.Random(seed)
    rows, want = [], []
    for host in (None, "1.1.1.1", "3.3.3.3"):
        t, own = 0, []
        for i in range(r.choice([300, 900])):
            t += r.choice([0, 1, 3, 9, 40]) * US
            own.append((i, t + r.choice([0, 0, 0, -15, 30]) * US))
        rows += [("c", f, x, host, 5, "9.9.9.9", 7, 6, 60, 0) for f, x in own]
        want += [(host, *x) for x in plain_segments(own, 35 * US, 100 * US)]
    out = se.segmented(spark.createDataFrame(r.sample(rows, len(rows)), PACKET), 35 * US, 100 * US)
    got = [(x.src_ip, x.frame_no, x.session, x.segment) for x in out.collect()]
    key = lambda x: (x[0] or "", *x[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    if hot == 50:
        assert out.groupBy("src_ip").agg(F.count_distinct("_part").alias("n")).where("n > 1").count() >= 1
    packets = spark.createDataFrame(rows, PACKET)
    by_key = se.gap_windows(packets.where("src_ip is not null").withColumn("t", F.col("ts_us") / US), ["src_ip"], "t", 60.0)
    for host in ("1.1.1.1", "3.3.3.3"):
        times = sorted(x[2] / US for x in rows if x[3] == host)
        assert by_key.where(F.col("src_ip") == host).count() == 1 + sum(b - a > 60 for a, b in zip(times, times[1:], strict=False))


def test_one_key_of_a_million_packets(spark):
    """No array a session, no task with the whole key: a keep-alive every second for eleven days."""
    n, parts = 1_000_000, spark.conf.get("spark.sql.shuffle.partitions")
    p = spark.range(n).select(F.lit("c").alias("capture"), F.col("id").alias("frame_no"), (F.col("id") * US).alias("ts_us"), F.lit("1.1.1.1").alias("src_ip"), F.lit(1).alias("src_port"), F.lit("2.2.2.2").alias("dst_ip"), F.lit(2).alias("dst_port"), F.lit(6).alias("proto"), F.lit(60).alias("wire_len"), F.lit(0).alias("tcp_flags"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        flows = se.assemble(p, 120 * US, 1800 * US, 3)
        plan = flows._jdf.queryExecution().executedPlan().toString()
        rows = flows.orderBy("segment").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert plan.count("collect_list") <= 4  # of the three packets of a sequence alone
    assert [(f.t_start_us // US, f.n_pkts) for f in rows] == [(1801 * k, min(1801, n - 1801 * k)) for k in range(-(-n // 1801))]
    assert all(f.pkts_fwd == f.n_pkts and list(f.times) == [0.0, 1.0, 2.0] for f in rows)


def test_nearest_takes_no_row_without_time_or_key(spark):
    left = spark.createDataFrame([(1, "k", 5.0), (2, "k", None), (3, None, 5.0), (4, "other", 5.0)], "row_id long, k string, t double")
    right = spark.createDataFrame([(10, "k", None, "x"), (11, "k", 9.0, "y"), (12, None, 5.0, "z")], "row_id long, k string, t double, what string")
    got = {r.row_id: (r.near_id, r.near_what) for r in al.nearest(left, right, "k", "t", ["what"]).collect()}
    assert got == {1: (11, "y"), 2: (None, None), 3: (None, None), 4: (None, None)}
    assert all(r.near_id is None for r in al.nearest(left, right.where("t is null"), "k", "t", ["what"]).collect())


def test_directed_key(spark):
    """The tuple as the initiator sees it, its reverse for the other side."""
    row = spark.createDataFrame([("1.1.1.1", 5, "2.2.2.2", 80, 6, 1_700_000_000.25)], "src_ip string, src_port int, dst_ip string, dst_port int, proto int, t double")
    assert tuple(row.select(fn.directed_key().alias("k")).first().k) == ("1.1.1.1", 5, "2.2.2.2", 80, 6)
    back = row.toDF("dst_ip", "dst_port", "src_ip", "src_port", "proto", "t")
    assert tuple(back.select(fn.directed_key().alias("k")).first().k) == ("2.2.2.2", 80, "1.1.1.1", 5, 6)


def test_exclusive_sources_read_every_frame(spark):
    """A benign row in any frame, not only in every 40th, ends a source's exclusiveness."""
    from millrace.plans import labels

    d = "/root/testdata/sf0.001"
    seen: dict = {}
    for e in spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).alias("day")).collect():
        seen.setdefault((f"d{e.day % 4}", f"10.0.{e.user_id // 250}.{e.user_id % 250}"), []).append(e.event_type)
    sole = {k: v for k, v in seen.items() if "view" not in v}
    assert sole and {tuple(r) for r in labels.exclusive_sources_all(spark, d).collect()} == set(sole)
    rules = labels.derive_rules_all(spark, d).collect()
    assert sum(r.n_rows for r in rules) == sum(len(v) for v in sole.values())


def test_full_queries_keep_what_the_operators_keep(spark):
    from millrace.plans import corpus_tables as ct_

    d = "/root/testdata/sf0.001"
    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    long = max(text, key=lambda i: len(text[i]))
    b = text[long]
    got = {f.__name__: f(spark, d).where(F.col("doc_id") == long).first() for f in (ct_.hex_bigrams_full, ct_.byte_layout_full, ct_.unit_bytes_full, ct_.header_fields_full)}
    assert got["hex_bigrams_full"].tokens.split() == [b[24 + i : 26 + i].hex() for i in range(127)]
    assert (got["byte_layout_full"].header[40:56], got["byte_layout_full"].payload) == (b[:8].hex(), b[8:248].hex())
    assert got["unit_bytes_full"].bytes == pytest.approx([x / 255 for x in b[:128]], abs=1e-6)
    assert got["header_fields_full"].p5 == int.from_bytes(b[10:12], "big")


def test_reports_use_the_listed_model_settings(spark, monkeypatch):
    from millrace.plans import models

    made = []
    monkeypatch.setattr(models.mo, "fit", lambda train, kind, *a, **more: made.append((kind, more)))
    monkeypatch.setattr(models.mo, "evaluate", lambda *a: None)
    for q in (models.rf_report, models.logreg_report, models.kshot_report):
        q(spark, "/root/testdata/sf0.001")
    assert made == [("rf", {}), ("logreg", {}), ("logreg", {})]
    more = {}
    monkeypatch.setattr(models.mo, "transfer_matrix", lambda frames, kind, **m: more.update(m))
    models.transfer_matrix(spark, "/root/testdata/sf0.001")
    assert more == {}
    rf = models.mo.classifier("rf", 4, 2)
    assert (rf.getNumTrees(), rf.getMaxDepth(), models.mo.classifier("logreg", 4, 2).getMaxIter()) == (200, 30, 100)


def test_flows_keep_packet_bytes(spark):
    head = bytes.fromhex("450000280000000040110000") + bytes(8) + bytes(8)
    rows = [("c", i, i * US, "1.1.1.1", 1, "2.2.2.2", 2, 17, 60, 0, bytearray(head + bytes(range(1, 201)))) for i in range(40)]
    f = se.assemble(spark.createDataFrame(rows, PACKET + ", ip_bytes binary"), 120 * US, sequence=32)
    got = f.select("packet_bytes", fn.flow_bigrams(F.col("packet_bytes")).alias("tokens"), fn.flow_layout(F.col("packet_bytes")).alias("layout"), fn.flow_image(F.col("packet_bytes")).alias("image")).first()
    kept = head + bytes(range(1, 101))
    assert [bytes(b) for b in got.packet_bytes] == [kept] * 32
    body = kept[24:]
    assert got.tokens == ([body[i : i + 2].hex() for i in range(len(body) - 1)] * 2)[:127]
    assert bytes.fromhex(got.layout) == (kept[:28] + bytes(52) + kept[28:] + bytes(140)) * 5
    assert bytes(got.image) == kept * 32


def test_friedman_tail_and_wide_nemenyi(spark):
    assert [inf.chi_square_tail(x, k) for x, k in ((3.841459, 1), (5.991465, 2), (7.814728, 3), (18.307038, 10))] == pytest.approx([0.05] * 4, rel=1e-5)
    assert [inf.studentised_range(k) for k in (2, 5, 10)] == pytest.approx([inf.NEMENYI_Q[k] for k in (2, 5, 10)], abs=1e-3)
    rows = [(f"t{i:02}", f"b{b}", float(i)) for i in range(12) for b in range(5)]
    s = spark.createDataFrame(rows, "tool string, block string, score double")
    assert inf.friedman(s).first().p == pytest.approx(inf.chi_square_tail(55.0, 11))
    pairs = {(r.a, r.b): r.differs for r in inf.nemenyi(s).collect()}
    assert len(pairs) == 66 and pairs["t00", "t11"] is True and pairs["t00", "t01"] is False


def test_captures_are_read_by_ranges(spark, tmp_path):
    (tmp_path / "one.pcap").write_bytes(pcap_bytes())
    (tmp_path / "two.pcap").write_bytes(pcap_bytes(cut=7))
    frame = pcap_bytes()[40:94]
    block = lambda kind, body: struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    packet = block(6, struct.pack("<IIIII", 0, 0, 5_000, len(frame), 60) + frame + bytes(-len(frame) % 4))
    (tmp_path / "ng.pcap").write_bytes(block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHIHHB3xHH", 1, 0, 0, 9, 1, 3, 0, 0)) + packet * 3)
    pcap.register(spark)
    want = [("ng", 0), ("ng", 1), ("ng", 2), ("one", 0), ("one", 1), ("one", 3), ("two", 0), ("two", 1)]
    for df in (spark.read.format("pcap").option("rangeBytes", 50).load(str(tmp_path)), pcap.read_captures(spark, str(tmp_path), 50)):
        assert df.rdd.getNumPartitions() > 10
        assert {r.ts_us for r in df.where("capture = 'ng'").collect()} == {5_000_000}
        assert sorted((r.capture, r.frame_no) for r in df.collect()) == want
    assert {r.path[-8:]: r.dropped for r in pcap.tails(spark, str(tmp_path)).collect()} == {"one.pcap": 0, "two.pcap": 1, "/ng.pcap": 0}
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)  # as for files over Spark's limit
    try:
        assert len(pcap.read_captures(spark, str(tmp_path)).collect()) == 8
        assert len(pcap.fingerprints(spark, str(tmp_path), 64).collect()) == 3
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
