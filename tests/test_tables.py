"""The library's own tables: written, read back and compared; rule files; validated streams."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import contract as ct
from millrace.operators import features as fe
from millrace.operators import inference as inf
from millrace.operators import labeling as lb
from millrace.sources import tables as tb
from millrace.streaming import flows as st


def flow(**change):
    row = dict(src_ip="172.20.4.1", src_port=51000, dst_ip="198.51.100.9", dst_port=993, proto=6, t_start=5000.0, t_end=5002.5, duration=2.5, pkts_fwd=7, pkts_bwd=4, bytes_fwd=910, bytes_bwd=1520, tool="t", dataset="d", capture="c", flow_id="0")
    return row | change


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_flows_are_coerced_and_foreign_columns_rejected(spark, tmp_path):
    """What is written comes back; missing columns are null, text numbers become numbers."""
    path = str(tmp_path / "flows")
    ct.write_flows(spark.createDataFrame([flow(), flow(capture="e", flow_id="1", tool_note="x")]), path)
    back = tb.read_flows(spark, path)
    assert back.columns[: len(ct.CORE)] == list(ct.CORE) and rows(back, "capture", "flow_id", "pkts_fwd", "syn_fwd", "tool_note") == [("c", "0", 7, None, None), ("e", "1", 7, None, "x")]
    assert dict(back.dtypes)["proto"] == "smallint" and tb.alignment_columns(back.withColumn("label", F.lit("BENIGN"))).columns == ["src_ip", "src_port", "dst_ip", "dst_port", "proto", "t_start", "t_end", "label"]
    spark.createDataFrame([flow(src_port="x", pkts_fwd="12")]).write.parquet(str(tmp_path / "text"))
    assert rows(tb.read_flows(spark, str(tmp_path / "text")), "src_port", "pkts_fwd") == [(None, 12)]
    spark.createDataFrame([flow(extra=1)]).write.parquet(str(tmp_path / "odd"))
    with pytest.raises(ValueError, match="extra"):
        tb.read_flows(spark, str(tmp_path / "odd"))
    assert rows(tb.read_core(spark, str(tmp_path / "odd")), "flow_id", "ack_fwd") == [("0", None)]
    assert ct.empty_flows(spark).columns == list(ct.CORE) and ct.empty_flows(spark).count() == 0


def test_flows_of_one_tool_are_tagged(spark, tmp_path):
    """S2, U1."""
    path = str(tmp_path / "flows")
    ct.write_flows(spark.createDataFrame([flow(capture=c, tool=t, flow_id=f"{t}{c}") for c in "abc" for t in "xy"]), path)
    assert rows(tb.tool_flows(spark, path, "x", "d"), "_capture", "flow_id") == [("a", "xa"), ("b", "xb"), ("c", "xc")]
    assert rows(tb.tool_flows(spark, path, "y", "d", ["b"]), "flow_id") == [("yb",)]
    with pytest.raises(ValueError):
        tb.tool_flows(spark, path, "z", "d")


def test_assembled_csv(spark, tmp_path):
    """List cells, packet bytes, whole and broken numbers."""
    (tmp_path / "a.csv").write_text("flow_id,src_ip,src_port,t_start,n_pkts,dirs,times,sizes,bytes\n0,1.1.1.1,80,1.5,2,0 1,0.0 0.25,60 1500,4500ff 00\n1,::1,x,2,0,,,,\n")
    a, b = tb.read_assembled_csv(spark, str(tmp_path / "a.csv")).orderBy("flow_id").collect()
    assert (a.src_port, a.t_start, a.n_pkts, a.dirs, a.times, a.sizes, [bytes(x) for x in a.bytes]) == (80, 1.5, 2, [0, 1], [0.0, 0.25], [60, 1500], [b"E\x00\xff", b"\x00"])
    assert (b.src_port, b.dirs, b.times, b.bytes) == (None, [], [], [])


def test_labelled_csv(spark, tmp_path):
    """With and without header; short rows and rows without a time go."""
    want = [("1.1.1.1", "Recon", 1562241600.0), ("2.2.2.2", "Benign", 1562198400.0)]
    body = "1.1.1.1,x,04/07/2019 12:00:00 PM,Recon\n2.2.2.2,x,04/07/2019 12:00:00 AM,Benign\n3.3.3.3,x,never,Recon\n4.4.4.4,x\n"
    for name, text, header in (("with", "Src IP,Flow,Timestamp,Stage\n" + body, True), ("without", body, False)):
        (tmp_path / f"{name}.csv").write_text(text)
        assert rows(tb.read_labelled_csv(spark, str(tmp_path / f"{name}.csv"), header, {"src_ip": 0, "time": 2, "stage": 3}), "src_ip", "stage", "t") == want


def test_metrics_and_results(spark, tmp_path):
    """Records appended twice are read as two, and unfold to cells."""
    record = {"config": {"tool": "a", "regime": "native", "model": "rf", "task": "binary", "split": "temporal", "seed": 3, "dataset": "d", "n_features": 5}, "n_train": 10, "n_test": 4,
              "metrics": {"macro_f1": 0.75, "per_class": {"BENIGN": {"precision": 1.0, "recall": 0.5, "f1-score": 0.667, "support": 2.0}}, "confusion_matrix": [[1, 1], [0, 2]], "class_order": ["BENIGN", "ATTACK"]}, "wall_seconds": 1.5}
    (tmp_path / "one.json").write_text(json.dumps(record))
    df = tb.read_metrics(spark, str(tmp_path / "one.json"))
    tb.write_metrics(df, str(tmp_path / "all"))
    tb.write_metrics(df.withColumn("config", F.col("config").withField("seed", F.lit(4))), str(tmp_path / "all"))
    back = tb.read_metrics(spark, str(tmp_path / "all"))
    assert rows(back, "config.seed", "metrics.macro_f1", "metrics.confusion_matrix") == [(3, 0.75, [[1, 1], [0, 2]]), (4, 0.75, [[1, 1], [0, 2]])]
    assert back.first().metrics.per_class["BENIGN"]["recall"] == 0.5
    summary, per_class = inf.explode_metrics(back)
    assert rows(inf.metric_cells(summary, task="binary", seed=4), "tool", "macro_f1") == [("a", 0.75)] and inf.metric_cells(summary, task="multiclass").count() == 0
    assert rows(per_class, "seed", "class", "recall", "`f1-score`") == [(3, "BENIGN", 0.5, 0.667), (4, "BENIGN", 0.5, 0.667)]
    (tmp_path / "r.csv").write_text("tool,score\na,0.5\nb,\n")
    assert rows(tb.read_results(spark, str(tmp_path / "r.csv"), "tool string, score double"), "tool", "score") == [("a", 0.5), ("b", None)]


def test_embeddings(spark, tmp_path):
    """Vectors and rows must match one to one; the cost row counts what is stored."""
    v = spark.createDataFrame([("0", [1.0, 2.0]), ("1", [float("nan"), 0.0])], "flow_id string, embedding array<float>").coalesce(1)
    cost = tb.write_embeddings(v, str(tmp_path / "v"), 2.5).first()
    size = sum(f.stat().st_size for f in (tmp_path / "v").glob("*.parquet"))
    assert (cost.flows, cost.wall_s, cost.dim, cost.any_nan, cost.stored_bytes) == (2, 2.5, 2, True, size)
    meta = spark.createDataFrame([("0", None), ("1", "x")], "flow_id string, label string")
    meta.write.parquet(str(tmp_path / "m"))
    assert rows(tb.read_embeddings(spark, str(tmp_path / "v"), str(tmp_path / "m")), "flow_id", "label") == [("0", "BENIGN"), ("1", "x")]
    meta.limit(1).write.parquet(str(tmp_path / "short"))
    with pytest.raises(ValueError):
        tb.read_embeddings(spark, str(tmp_path / "v"), str(tmp_path / "short"))


def test_captures_reference_and_provenance(spark, tmp_path):
    """S20, S21, K2."""
    caps = tb.captures_table(spark, {"d": {"train": ["mon"], "test": ["tue"]}}, {"mon": "m.pcap"})
    assert rows(caps, "capture", "file", "split") == [("mon", "m.pcap", "train"), ("tue", None, "test")]
    spark.createDataFrame([("c", "1", "80", "6", 1.0), ("c", "x", "80", "6", 2.0), ("o", "1", "80", "6", 3.0)], "_capture string, src_port string, dst_port string, proto string, t_start double").write.parquet(str(tmp_path / "ref"))
    assert rows(tb.reference_events(spark, str(tmp_path / "ref"), "c"), "src_port", "t_start") == [(1, 1.0)]
    a, b, c = (tb.provenance(spark, "t", "1.0", conf, 5, "f").first() for conf in ({"x": "1", "y": "2"}, {"y": "2", "x": "1"}, {"x": "1", "y": "3"}))
    assert a.config_hash == b.config_hash != c.config_hash and len(a.config_hash) == 16 and a.n_rows == 5


def test_only_what_is_new_is_written(spark, tmp_path):
    """K4, K5, U3, K7."""
    df = spark.createDataFrame([("d", "t", c, i) for i, c in enumerate("aab")], "dataset string, tool string, capture string, n int")
    path = str(tmp_path / "l")
    tb.write_labeled(df.where("capture = 'a'"), path)
    tb.write_labeled(df.withColumn("n", F.col("n") + 10), path, done=spark.read.parquet(path))
    assert rows(spark.read.parquet(path), "capture", "n") == [("a", 0), ("a", 1), ("b", 12)]
    tb.write_labeled(df.where("capture = 'b'"), path, force=True)
    assert rows(spark.read.parquet(path), "capture", "n") == [("a", 0), ("a", 1), ("b", 2)]
    assert rows(tb.not_done(df, df.where("n = 1"), ["n"]), "n") == [(0,), (2,)] and tb.not_done(df, None, ["n"]).count() == 3
    tb.append_new(df, str(tmp_path / "n"), ["n"])
    tb.append_new(df.union(spark.createDataFrame([("d", "t", "z", 9)], df.schema)), str(tmp_path / "n"), ["n"], spark.read.parquet(str(tmp_path / "n")))
    assert rows(spark.read.parquet(str(tmp_path / "n")), "n") == [(0,), (1,), (2,), (9,)]
    tb.write_sample(df, F.col("n") % 2 == 0, str(tmp_path / "s"), str(tmp_path / "mask"), ["n"])
    assert rows(spark.read.parquet(str(tmp_path / "s")), "n") == [(0,), (2,)] and rows(spark.read.parquet(str(tmp_path / "mask")), "n", "sampled") == [(0, True), (1, False), (2, True)]


def test_rules_from_a_file_label_flows(spark):
    """Local times, zones, one capture or several; rules of other captures don't count."""
    specs = spark.createDataFrame([
        (1, "r1", "scan", "2024-03-01", "09:00:00", "10:00:00", "Europe/Berlin", "mon", None, ["9.9.9.9"]),
        (2, "r2", "flood", "2024-03-01", "09:00:00", "10:00:00", None, None, ["mon", "tue"], None),
    ], "rule_no int, name string, label string, date string, start string, end string, tz string, capture string, captures array<string>, attackers array<string>")
    rules = lb.rules_of(lb.rule_table(specs))
    assert [(r["label"], r["t_start"], r["t_end"], r["captures"]) for r in rules] == [("scan", 1709280000.0, 1709283600.0, ["mon"]), ("flood", 1709283600.0, 1709287200.0, ["mon", "tue"])]
    flows = spark.createDataFrame([(i, c, "9.9.9.9", 1, "2.2.2.2", 2, 6, t, t + 1) for i, (c, t) in enumerate([("mon", 1709280100.0), ("tue", 1709280100.0), ("tue", 1709284000.0), ("wed", 1709284000.0)])], "row_id int, capture string, src_ip string, src_port int, dst_ip string, dst_port int, proto int, t_start double, t_end double")
    assert rows(lb.label_by_specs(flows, specs), "row_id", "label") == [(0, "scan"), (1, "BENIGN"), (2, "flood"), (3, "BENIGN")]
    assert rows(lb.label_by_specs(flows, specs, "mon"), "row_id", "label") == [(0, "scan"), (1, "scan"), (2, "flood"), (3, "flood")]


def test_feature_frames_by_regime(spark):
    """Names of identifiers go, look-alikes stay; without native columns the common ones stand in."""
    names = ["tool_ipv6", "tool_Src_Host", "tool_vlan", "tool_stime", "tool_date", "tool_index", "tool_rate", "tool_flow_id_x", "tool_shipped"]
    df = spark.createDataFrame([tuple(float(i * k) for k in range(1, len(names) + 1)) for i in range(4)], names)
    assert fe.native_columns(df) == ["tool_date", "tool_index", "tool_rate", "tool_shipped"]
    flows = spark.createDataFrame([flow(tool_rate="1.5"), flow(flow_id="1", tool_rate="2.5")])
    assert fe.feature_frame(flows, "native", ["flow_id"]).columns == ["flow_id", "tool_rate"]
    assert fe.feature_frame(flows.drop("tool_rate"), "native").columns == fe.feature_frame(flows, "common").columns
    got = spark.createDataFrame([("BENIGN",), ("dos",), (None,)], "label string").select(fe.target("binary"), fe.target("multiclass")).collect()
    assert [tuple(r) for r in got] == [("BENIGN", "BENIGN"), ("ATTACK", "dos"), ("BENIGN", "BENIGN")]


def test_validated_stream_names_problems_and_runs_again(spark, tmp_path):
    """Every rule of the contract, and a batch that runs again doubles nothing."""
    bad = [flow(flow_id="1", pkts_fwd=-3), flow(flow_id="2", t_end=5001.0), flow(flow_id="3", src_ip=None), flow(flow_id="4", pkts_fwd=0, pkts_bwd=0)]
    df = spark.createDataFrame([flow(), *bad])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for turn in range(2):  # the second run starts from nothing, so its first batch is the same again
        s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        st.validated_stream(s, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / f"state{turn}")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "good")), "flow_id") == [("0",)]
    got = {r.flow_id: r.problems for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert got == {"1": ["negative pkts_fwd"], "2": ["duration differs"], "3": ["no address"], "4": ["no packets"]}
