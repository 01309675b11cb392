"""Running sums, quantiles, numbers and nearest rows over ranges, beside plain versions; hot, null and empty groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import alignment as al
from millrace.operators import evaluation as ev
from millrace.operators import features as fe
from millrace.operators import inference as inf
from millrace.operators import labeling as lb
from millrace.operators import profiling as pr
from millrace.operators import ranges as ra
from millrace.operators import sessions as se


def grouped(seed=1, n=1500):
    """Most rows in one group, some in a group without a name, few values, so that many tie."""
    rnd = random.Random(seed)
    return [(rnd.choice(["hot"] * 7 + ["b", None]), rnd.choice([None, *range(60)]), rnd.randrange(5)) for _ in range(n)]


def test_running_sums_carry_over_ranges(spark):
    rows = [(g, i, v) for i, (g, _, v) in enumerate(grouped())]
    out = ra.running_sums(spark.createDataFrame(rows, "g string, i long, v long"), ["g"], ["i"], ["v"]).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"g", "i", "v", "run_v", "all_v"}
    for r in out:
        same = [(i, v) for g, i, v in rows if g == r.g]
        assert (r.run_v, r.all_v) == (sum(v for i, v in same if i <= r.i), sum(v for _, v in same))
    assert ra.running_sums(spark.createDataFrame([], "g string, i long, v long"), ["g"], ["i"], ["v"]).count() == 0


def test_quantiles_equal_numpy(spark):
    rows = [(g, None if v is None else v / 3) for g, v, _ in grouped(2)] + [("one", 4.5), ("none", None)]
    got = {r.g: r.quantiles for r in ra.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", [0, 0.01, 0.5, 0.99, 1]).collect()}
    assert set(got) == {"hot", "b", None, "one"}
    for g, q in got.items():
        assert q == pytest.approx(list(np.quantile([x for k, x in rows if k == g and x is not None], [0, 0.01, 0.5, 0.99, 1])))


def test_preprocessing_leaves_out_columns_without_values(spark):
    df = spark.createDataFrame([(float(i), None, float("inf")) for i in range(101)], "a double, b double, c double")
    fitted = fe.preprocessing(df, ["a", "b", "c"])
    assert set(fitted) == {"a"} and fitted["a"][:3] == (50.0, 1.0, 99.0)
    assert fe.preprocessing(df, []) == {} and fe.preprocessing(df.limit(0), ["a"]) == {}


def test_ks_of_hot_and_one_sided_groups(spark):
    rows = [(g, "a" if k % 3 else "b", None if v is None else float(v + k)) for g, v, k in grouped(3)] + [("left", "a", 1.0)]
    got = {r.g: r.ks for r in pr.ks_statistic(spark.createDataFrame(rows, "g string, side string, value double"), ["g"]).collect()}
    assert got["left"] is None
    for g in ("hot", "b", None):
        a, b = ([x for k, s, x in rows if k == g and s == side and x is not None] for side in "ab")
        want = max(abs(sum(x <= t for x in a) / len(a) - sum(x <= t for x in b) / len(b)) for t in {*a, *b})
        assert got[g] == pytest.approx(want)


def test_ranking_metrics_of_ties(spark):
    rows = [(g, float(v or 0) / 10, int(k > 2)) for g, v, k in grouped(4)]
    for r in ev.ranking_metrics(spark.createDataFrame(rows, "g string, score double, label int"), ["g"]).collect():
        own = [(s, y) for g, s, y in rows if g == r.g]
        pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
        area = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
        steps = sum(sum(p == t for p in pos) / len(pos) * sum(p >= t for p in pos) / sum(s >= t for s, _ in own) for t in set(pos))
        assert (r.roc_auc, r.average_precision) == (pytest.approx(area), pytest.approx(steps))


def test_flow_numbers_by_capture(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["x", "x", "x", "y"]), rnd.randrange(90), f"k{i}", 0, 0) for i in range(500)]
    got = {(r.capture, r.key): r.flow_no for r in se.number_flows(spark.createDataFrame(rows, "capture string, t_start_us long, key string, session long, segment long")).collect()}
    for c in "xy":
        assert [got[c, k] for _, k in sorted((t, k) for x, t, k, *_ in rows if x == c)] == list(range(1, sum(x == c for x, *_ in rows) + 1))


def test_nearest_rows_of_a_hot_key(spark):
    rnd = random.Random(6)
    left = [(i, rnd.choice(["hot"] * 6 + ["b", "alone", None]), rnd.randrange(4000)) for i in range(700)]
    right = [(i, rnd.choice(["hot", "hot", "b", None]), rnd.randrange(4000), i * 2) for i in range(200)]
    out = al.nearest(spark.createDataFrame(left, "row_id long, key string, t long"), spark.createDataFrame(right, "row_id long, key string, t long, w long"), "key", "t", ["w"]).collect()
    assert len(out) == len(left)
    for r in out:
        best = min(((abs(t - r.t), i) for i, k, t, _ in right if k == r.key), default=(None, None))
        assert (r.near_id, r.near_w) == (best[1], None if best[1] is None else best[1] * 2)


@pytest.mark.parametrize("bin_us", [None, 7, 10**9])
def test_overlaps_of_a_hot_key_in_bins(spark, bin_us):
    rnd = random.Random(8)

    def side():
        starts = [rnd.randrange(20_000) for _ in range(300)]
        return [(i, rnd.choice(["hot", "hot", "hot", "b"]), s, s + rnd.choice([0, 3, 40, 40, 2500])) for i, s in enumerate(starts)]

    a, b = side(), [*side(), (300, "hot", None, None)]
    kind = "row_id long, key string, t_start_us long, t_end_us long"
    got = sorted(map(tuple, al.overlap_pairs(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), bin_us=bin_us).collect()))
    assert got == sorted((i, j) for i, k, s, e in a for j, m, t, u in b if t is not None and k == m and s <= u and t <= e)


def test_bins_are_bounded_by_the_rows_and_the_longest(spark):
    t = spark.createDataFrame([(0, 10)] * 99 + [(0, 10**7)], "s long, e long")
    n = al.bin_length(t, t.limit(0), "s", "e")
    assert n == (99 * 10 + 10**7 + 99) // 100
    one = spark.createDataFrame([(0, 0)] * 99_999 + [(0, 10**9)], "s long, e long")
    assert al.bin_length(one, one.limit(0), "s", "e") == 10**9 // al.MOST_BINS
    assert al.bin_length(t.limit(0), t.limit(0), "s", "e") == 1


def test_windows_of_a_hot_stage_are_numbered_over_ranges(spark):
    r = random.Random(8)
    rows = [("c0", "scan", float(r.randrange(3000) * 7)) for _ in range(2000)] + [("c0", "scan", 90_000.0)] * 3 + [("c1", None, 5.0), ("c1", None, 500.0)]
    got = [tuple(x) for x in lb.numbered_windows(spark.createDataFrame(rows, "capture string, stage string, t double"), 20.0).select("capture", "stage", "t", "window_no").collect()]
    want, last, number = [], {}, {}
    for c, s, t in sorted(rows, key=lambda x: (x[0], x[2])):
        if (c, s) in last and t - last[c, s] > 20.0:
            number[c, s] = number.get((c, s), 0) + 1
        last[c, s] = t
        want.append((c, s, t, number.get((c, s), 0)))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_variance_shares_of_unequal_cells(spark):
    r = random.Random(9)
    rows = [(f"t{a}", f"m{b}", "one", 3.0 * a - b + r.random()) for a in range(3) for b in range(4) for _ in range(1 + (a * b) % 4)]
    got = {x.factor: x.sum_sq for x in inf.variance_shares(spark.createDataFrame(rows, "tool string, model string, day string, score double"), ["tool", "model", "day"]).collect()}

    def sse(*at):
        levels = [sorted({x[k] for x in rows}) for k in at]
        x = np.array([[1.0] + [float(row[k] == v) for k, vs in zip(at, levels, strict=True) for v in vs] for row in rows])
        y = np.array([row[3] for row in rows])
        return float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())

    assert set(got) == {"tool", "model", "residual"}
    assert got["tool"] == pytest.approx(sse(1) - sse(0, 1)) and got["model"] == pytest.approx(sse(0) - sse(0, 1)) and got["residual"] == pytest.approx(sse(0, 1))
    assert inf.variance_shares(spark.createDataFrame(rows[:9], "tool string, model string, day string, score double"), ["tool"]).count() == 0


def test_mismatches_of_numbers_and_bytes(spark):
    a = spark.createDataFrame([(k, k * 2, bytearray([k])) for k in range(30)], "k int, n int, b binary")
    b = spark.createDataFrame([(k, k * 2 + (k == 7), bytearray([k if k != 9 else 0])) for k in range(5, 40)], "k int, n int, b binary")
    assert [x.k for x in al.mismatches(a, b, ["k"], ["n", "b"]).collect()] == [7, 9]
    d = al.set_difference(a, b, ["k"], ["n", "b"]).first()
    assert (d.n_both, d.only_a, d.only_b, d.n_equal) == (25, 5, 10, 23) and d.match_rate == 23 / 25


@pytest.mark.parametrize("hot", [200_000, 20])
def test_tasks_of_an_assembly_hold_a_bounded_number_of_packets(spark, monkeypatch, hot):
    """With few shuffle partitions a task's packets don't grow with the table."""
    monkeypatch.setattr(se, "TASK_ROWS", 100)
    monkeypatch.setattr(se, "HOT_KEY", hot)
    rnd = random.Random(12)
    rows = [("c", k, i * 40 + k % 40, 1000 * i + rnd.randrange(900)) for k in range(60) for i in range(40)]
    packets = spark.createDataFrame(rows, "capture string, key long, frame_no long, ts_us long")
    dealt = se._in_ranges(packets, se.KEY, "frame_no")
    per_task = [r["n"] for r in dealt.groupBy(F.col("_part") if "_part" in dealt.columns else F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(per_task) == len(rows) and max(per_task) < len(rows) / 6  # four partitions up to now
    out = se.idle_sessions(packets, 1_000).collect()
    for k in range(60):
        session, last = 0, None
        for r in sorted((r for r in out if r["key"] == k), key=lambda r: r["frame_no"]):
            session += last is not None and r["ts_us"] - last > 1_000
            last = r["ts_us"]
            assert r["session"] == session
