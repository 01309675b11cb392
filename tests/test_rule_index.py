"""J1 by the rule index, held against the compiled expression of the same rules and against a plain loop."""

import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import labeling as lb
from millrace.operators import rule_index as ri

FLOWS = "row_id long, capture string, src_ip string, src_port int, dst_ip string, dst_port int, proto int, t_start double, t_end double"
RULES = "rule_no long, label string, t_start double, t_end double, attackers array<string>, victims array<string>, attacker_cidrs array<string>, victim_cidrs array<string>, dst_ports array<int>, protos array<int>, directional boolean, captures array<string>"
HOSTS = [f"10.1.{i % 3}.{i}" for i in range(12)] + ["fe80::1", "fe80::2:5", "2001:db8::9", "::ffff:10.1.0.3", "printer", None]
NETS = ["10.1.0.0/24", "10.1.1.4/30", "10.0.0.0/8", "0.0.0.0/0", "10.1.2.8/31", "fe80::/16", "2001:db8::/33", "fe80::2:0/111", "fe80::1"]
SHOWN = ("row_id", "label", "binary_label", "label_confidence", "n_rule_matches")


def made_flows(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        t = r.uniform(0, 5000)
        end = t + r.choice([0.0, 1.0, 30.0, 900.0, 6000.0, -5.0])
        out.append((i, r.choice(["a", "b"]), r.choice(HOSTS), r.choice([80, 443, 5000, None]), r.choice(HOSTS), r.choice([80, 443, 22, None]), r.choice([6, 17, None]), None if i % 41 == 0 else t, None if i % 37 == 0 else end))
    return out


def made_rules(n, seed, cidrs=True):
    r = random.Random(seed)
    some = lambda xs, most: r.sample([x for x in xs if x], r.randrange(most + 1)) if r.random() < 0.6 else []
    out = []
    for i in range(n):
        t = r.uniform(-100, 5000)
        out.append((i, f"kind{r.randrange(4)}", t, t + r.choice([0.0, 2.0, 60.0, 3000.0, 10000.0, -3.0]), some(HOSTS, 3), some(HOSTS, 3), some(NETS, 2) if cidrs else [], some(NETS, 2) if cidrs else [], some([80, 443, 22], 2), some([6, 17], 1), r.random() < 0.5, some(["a", "b"], 1)))
    return out


def shown(df):
    return sorted(map(tuple, df.select(*SHOWN).collect()))


@pytest.mark.parametrize(("seed", "few"), [(0, 500_000), (1, 0)])
def test_equals_the_compiled_rules(spark, monkeypatch, seed, few):
    monkeypatch.setattr(ri, "BROADCAST_ROWS", few)
    flows = spark.createDataFrame(made_flows(250, seed), FLOWS)
    rules = spark.createDataFrame(made_rules(9, 50 + seed), RULES)
    want = shown(lb.label_flows(flows, [r | {"by_row": True} for r in lb.rules_of(rules)]))
    assert shown(ri.label_by_table(flows, rules, capture="capture")) == want
    assert len({r[1] for r in want}) > 2 and max(r[4] for r in want) > 1


def plain(flows, rules):
    """Rules without networks, one flow and one rule after the other."""
    out = []
    for row, _, sip, sp, dip, dp, proto, a, b in flows:
        first, n = None, 0
        for no, label, t0, t1, att, vic, _, _, ports, protos, one_way, _ in rules:
            if a is None or b is None or a > t1 or b < t0 or (protos and proto not in protos):
                continue
            ways = (not att or sip in att) and (not vic or dip in vic)
            ways = ways or (not one_way and (not att or dip in att) and (not vic or sip in vic))
            port = not ports or dp in ports or (not one_way and sp in ports)
            if ways and port:
                first, n = first or (label, a >= t0 and b <= t1), n + 1
        out.append((row, first[0] if first else "BENIGN", "ATTACK" if first else "BENIGN", "benign" if not first else "exact" if first[1] else "window_edge", n))
    return sorted(out)


def test_thousands_of_rules_in_a_plan_of_one_size(spark):
    flows, rules = made_flows(300, 9), made_rules(10_000, 10, cidrs=False)
    rules = [r[:3] + (r[2] + (r[3] - r[2]) / 40,) + r[4:] for r in rules]
    df, many = spark.createDataFrame(flows, FLOWS), spark.createDataFrame(rules, RULES)
    start = time.time()
    out = ri.label_by_table(df, many)
    got = shown(out)
    assert time.time() - start < 60
    assert got == plain(flows, rules)
    few = ri.label_by_table(df, many.limit(20))
    size = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(out) == size(few)


def test_candidates_stay_near_the_hits(spark):
    # 2,000 rules on one hub, each of its own attacker and minute: every flow meets a few of them.
    hub = "192.168.9.9"
    rules = [(i, "x", 60.0 * i, 60.0 * i + 59, [f"10.2.{i % 50}.{i // 50}"], [hub], [], [], [], [], True, []) for i in range(2000)]
    flows = [(i, "a", f"10.2.{i % 50}.{i // 50 % 40}", 5, hub, 80, 6, 60.0 * (i % 2000) + 10, 60.0 * (i % 2000) + 20) for i in range(4000)]
    df, table = spark.createDataFrame(flows, FLOWS), spark.createDataFrame(rules, RULES)
    found = ri.anchors(ri.normal_rules(table))
    assert found.count() == 4000 and found.where("side = 'victims'").select("key").distinct().count() == 1
    hits = ri.rule_hits(df, table).collect()
    assert len(hits) == 4000 and all(h["inside"] for h in hits)


def test_odd_rules_and_flows(spark):
    inf = float("inf")
    flows = spark.createDataFrame([(1, "a", "10.0.0.1", 1, "10.0.0.2", 2, 6, 5.0, 9.0), (2, None, None, None, None, None, None, 5.0, 9.0), (3, "a", "10.0.0.1", 1, "10.0.0.2", 2, 6, float("nan"), 9.0)], FLOWS)
    table = [(0, "never", 0.0, inf, [], [], ["no net", "10.0.0.0/40"], [], [], [], False, []), (1, "always", -inf, inf, None, None, None, None, None, None, None, None), (2, "null time", None, 9.0, [], [], [], [], [], [], False, [])]
    got = {r["row_id"]: r for r in ri.label_by_table(flows, spark.createDataFrame(table, RULES)).collect()}
    assert [(got[i]["label"], got[i]["n_rule_matches"]) for i in (1, 2, 3)] == [("always", 1), ("always", 1), ("BENIGN", 0)]
    small = spark.createDataFrame([(0, "x", 0.0, 10.0)], "rule_no long, label string, t_start double, t_end double")
    assert [r["label"] for r in ri.label_by_table(flows, small).orderBy("row_id").collect()] == ["x", "x", "BENIGN"]
    assert [r["label"] for r in ri.label_by_table(flows, small.limit(0)).collect()] == ["BENIGN"] * 3
    assert ri.label_by_table(flows.limit(0), small).count() == 0
    assert ri.label_by_table(flows, small.withColumn("captures", F.array(F.lit("a"))), capture="capture").where("label = 'x'").select("row_id").first()[0] == 1


@pytest.mark.parametrize(("seed", "inline"), [(3, 0), (4, 1)])
def test_long_sets_are_looked_up(spark, monkeypatch, seed, inline):
    """with every set longer than what an index row may hold the labels stay the same."""
    monkeypatch.setattr(ri, "INLINE", inline)
    flows = spark.createDataFrame(made_flows(250, seed), FLOWS)
    rules = spark.createDataFrame(made_rules(9, 60 + seed), RULES)
    want = shown(lb.label_flows(flows, [r | {"by_row": True} for r in lb.rules_of(rules)]))
    assert shown(ri.label_by_table(flows, rules, capture="capture")) == want


def test_index_rows_of_a_rule_do_not_hold_its_long_sets(spark, monkeypatch):
    """a rule of n attackers took n rows of n attackers each."""
    made, stored = [], ri.stored
    monkeypatch.setattr(ri, "stored", lambda df: made.append(stored(df)) or made[-1])
    hosts = [f"10.3.{i // 200}.{i % 200}" for i in range(600)]
    rules = spark.createDataFrame([(0, "x", 0.0, 100.0, hosts, ["10.9.9.9"], [], [], [], [], True, [])], RULES)
    flows = spark.createDataFrame([(i, "a", h, 5, "10.9.9.9", 80, 6, 10.0, 20.0) for i, h in enumerate(hosts)] + [(999, "a", "10.9.9.9", 5, hosts[0], 80, 6, 10.0, 20.0)], FLOWS)
    assert {r["row_id"] for r in ri.rule_hits(flows, rules).collect()} == set(range(600))
    index = next(t for t in made if {"key", "bin", "case"} <= set(t.columns))
    held = sum(len(r[c] or []) for r in index.collect() for c in ("attackers", "victims"))
    assert held <= 2 * len(hosts), held
