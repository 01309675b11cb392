"""Readers and adapters of flow logs whose files the other tests don't have."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import flow as fn
from millrace.sources import logs
from millrace.sources import tables as tb


def test_percent_header(spark, tmp_path):
    """The first name loses its sign; only the initiator's records stay."""
    (tmp_path / "t.txt").write_text("%dir\tflowInd\tsrcIP\tsrcPort\tdstIP\tdstPort\tl4Proto\ttimeFirst\ttimeLast\tduration\tpktsSnt\tpktsRcvd\tl7BytesSnt\tl7BytesRcvd\nA\t7\t172.19.0.3\t4100\t203.0.113.4\t995\t6\t50.25\t51.5\t1.25\t4\t3\t220\t90\nB\t7\t203.0.113.4\t995\t172.19.0.3\t4100\t6\t50.25\t51.5\t1.25\t3\t4\t90\t220\n")
    assert logs.read_percent_tsv(spark, str(tmp_path / "t.txt")).columns[:2] == ["dir", "flowInd"]
    (r,) = logs.ingest(spark, "tranalyzer", str(tmp_path / "t.txt"), "d", "c").collect()
    assert (r.flow_id, r.src_port, r.t_start, r.duration, r.pkts_bwd, r.bytes_fwd) == ("7", 4100, 50.25, 1.25, 3, 220)


def test_merged_totals(spark, tmp_path):
    """S8, P7e: totals of both directions stand in fwd; blanks around headers go; ``max_flows`` (O3)."""
    (tmp_path / "g.csv").write_text("sourceIPAddress, sourceTransportPort,destinationIPAddress,destinationTransportPort,protocolIdentifier,flowStartMilliseconds,flowEndMilliseconds,packetTotalCount,octetTotalCount,tcpSynTotalCount\n172.19.0.3,4100,203.0.113.4,995,6,2500,4000,9,700,2\n172.19.0.5,4101,203.0.113.4,53,17,2500,2500,1,70,0\n")
    r = logs.ingest(spark, "goflows", str(tmp_path / "g.csv"), "d", "c").orderBy("src_port").collect()
    assert [(x.src_port, x.t_start, x.duration, x.pkts_fwd, x.pkts_bwd, x.syn_fwd, x.syn_bwd) for x in r] == [(4100, 2.5, 1.5, 9, None, 2, None), (4101, 2.5, 0.0, 1, None, 0, None)]
    assert logs.ingest(spark, "goflows", str(tmp_path / "g.csv"), "d", "c", 1).count() == 1


def test_wide_statistics(spark, tmp_path):
    """S11, P7h: milliseconds, counters of each direction; flags that the frame lacks are null."""
    row = dict(src_ip="172.19.0.3", src_port=4100, dst_ip="203.0.113.4", dst_port=995, protocol=6, bidirectional_first_seen_ms=12_500, bidirectional_last_seen_ms=13_000)
    row |= dict(src2dst_packets=5, dst2src_packets=4, src2dst_bytes=410, dst2src_bytes=380, src2dst_syn_packets=1, dst2src_syn_packets=1)
    spark.createDataFrame([row]).write.parquet(str(tmp_path / "n"))
    r = logs.ingest(spark, "nfstream", str(tmp_path / "n"), "d", "c").first()
    assert (r.t_start, r.t_end, r.duration, r.pkts_fwd, r.bytes_bwd, r.syn_bwd, r.ack_fwd) == (12.5, 13.0, 0.5, 5, 380, 1, None)


def test_headers_longer_than_rows(spark, tmp_path):
    """Fields beyond a short row are null, however many; cells beyond the header go."""
    names = ["ts", *[f"f{i}" for i in range(1500)]]
    (tmp_path / "long.log").write_text("#fields\t" + "\t".join(names) + "\n1.5\t-\tx\n2.5\t" + "\t".join(map(str, range(1600))) + "\n")
    df = logs.read_hash_tsv(spark, str(tmp_path / "long.log"))
    assert sorted(df.columns) == sorted(names)
    assert [tuple(r) for r in df.orderBy("ts").select("ts", "f0", "f1", "f2", "f1499").collect()] == [("1.5", None, "x", None, None), ("2.5", "0", "1", "2", "1499")]


def test_local_times_with_an_offset(spark):
    """P10: 12 hours first, then 24; text that is no time, or no offset, gives null."""
    rows = [("03/11/2020 07:45:10 PM", 3.0), ("03/11/2020 19:45:10", 3.0), ("03/11/2020 19:45:10", -4.5), ("2020-11-03", 3.0), (None, 3.0), ("03/11/2020 19:45:10", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, h double").select(fn.shifted_epoch(F.col("t"), F.col("h"))).collect()]
    noon = 1_604_432_710
    assert got == [noon + 10_800, noon + 10_800, noon - 16_200, None, None, None]


def test_initiator_key(spark):
    """Unlike the undirected keys it tells both ways apart."""
    df = spark.createDataFrame([("a", 1, "b", 2, 6), ("b", 2, "a", 1, 6), ("a", 1, "b", 2, 6)], "src_ip string, src_port int, dst_ip string, dst_port int, proto int")
    assert df.groupBy(fn.directed_key().alias("k")).count().count() == 2


@pytest.mark.parametrize("memory", [None, 1.5])
def test_cost_row(spark, tmp_path, memory):
    """K8."""
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, float("nan")])], "flow_id long, embedding array<double>")
    r = tb.write_embeddings(df, str(tmp_path / "e"), 2.5, memory_gb=memory).first()
    assert (r.flows, r.dim, r.any_nan, r.wall_s, r.memory_gb) == (2, 2, True, 2.5, memory) and r.stored_bytes > 0
