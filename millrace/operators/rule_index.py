"""J1 for rule tables of any size: rules become rows of an index that flows meet by equality.

A rule is anchored at one of its sets: attackers, victims or ports; where it has none it is open. Its anchor gives keys
(an address, a network's prefix, a port, or one key for open rules), and its window a few time bins. A flow that overlaps
a rule either begins within the rule's window or the rule begins within the flow, so

* a rule stands in the bins of its window at the scale of its length, where flows look for the bin of their start, and
* a flow stands in the bins of its time at the scale of its length, where rules look for the bin of their start.

Scales are powers of four seconds, so either has at most two bins and long windows or flows are not multiplied. Keys that
meet give candidates, which are held against the whole rule. The plan has the same size for any number of rules.

An index row holds the sets of its rule that are short (``INLINE``). Whether an address is in a longer set is looked up by
equality in the set's keys, so a rule of many addresses isn't copied whole to the row of each of them. Flows look only at
the scales that their key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.flow import ipv4_number, ipv6_hex
from millrace.operators.labeling import ATTACK, BENIGN
from millrace.operators.ranges import running_sums, stored

#: Rows that the index or the labels found may have at most to be broadcast; beyond that both sides are shuffled.
BROADCAST_ROWS = 500_000
#: Entries of a set that every index row of its rule holds; longer sets are looked up.
INLINE = 16
#: Set columns of a rule table and their types; a column that is not there, null or empty doesn't constrain.
SETS = {"attackers": "string", "victims": "string", "attacker_cidrs": "string", "victim_cidrs": "string", "dst_ports": "int", "protos": "int", "captures": "string"}
#: The columns of a rule's attackers and victims.
ENDS = {"a": ("attackers", "attacker_cidrs", "nets_a"), "v": ("victims", "victim_cidrs", "nets_v")}
#: Scales of time in powers of four seconds: from one second to some 140 years.
SCALES = 17


def address_digits(ip: Column, v4: bool = True, v6: bool = True) -> Column:
    """An IPv4 address as 8, an IPv6 address as 32 lower-case hex digits; null for other text and kinds not asked for."""
    kinds = ([F.lower(F.lpad(F.hex(ipv4_number(ip)), 8, "0"))] if v4 else []) + ([ipv6_hex(ip)] if v6 else [])
    return F.coalesce(*kinds) if kinds else F.lit(None).cast("string")


def prefix(digits: Column, bits: Column) -> Column:
    """The first ``bits`` bits of an address: hex digits, the last one with its low bits cleared."""
    whole, rest = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    nibble = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    unit = F.element_at(F.array(*[F.lit(x) for x in (16, 8, 4, 2)]), rest + 1)
    part = F.when(rest > 0, F.lower(F.hex((F.floor(nibble / unit) * unit).cast("long")))).otherwise("")
    return F.concat(F.substr(digits, F.lit(1), whole), part)


def networks(rules: DataFrame, v6: bool = True) -> DataFrame:
    """(rule_no, nets_a, nets_v): the networks of attackers and victims as (width, bits, head), digits of an address, bits and digits of the prefix."""

    def side(letter: str, cidrs: str) -> Column:
        return F.transform(cidrs, lambda x: F.struct(F.lit(letter).alias("side"), x.alias("cidr")))

    sides = [side("a", "attacker_cidrs"), side("v", "victim_cidrs")]
    rows = rules.select("rule_no", F.explode(F.concat(*sides)).alias("n")).select("rule_no", "n.side", F.split("n.cidr", "/").alias("parts"))
    rows = rows.select("rule_no", "side", F.col("parts")[0].alias("base"), F.try_element_at("parts", F.lit(2)).try_cast("int").alias("bits"), (F.size("parts") > 1).alias("given"))
    rows = rows.withColumn("digits", address_digits(F.col("base"), v6=v6)).withColumn("width", F.length("digits"))
    rows = rows.withColumn("bits", F.when(F.col("given"), F.col("bits")).otherwise(F.col("width") * 4))
    known = rows.where(F.col("bits").between(0, F.col("width") * 4)).withColumn("net", F.struct("width", "bits", prefix(F.col("digits"), F.col("bits")).alias("head")))
    return known.groupBy("rule_no").agg(*[F.collect_list(F.when(F.col("side") == s, F.col("net"))).alias(f"nets_{s}") for s in "av"])


def normal_rules(rules: DataFrame) -> DataFrame:
    """The rules with all set columns and ``nets_a``, ``nets_v``, the networks of attackers and victims."""
    have = {c.lower() for c in rules.columns}
    sets = {c: (F.coalesce(F.col(c).cast(f"array<{t}>"), F.array().cast(f"array<{t}>")) if c in have else F.array().cast(f"array<{t}>")) for c, t in SETS.items()}
    directional = F.coalesce(F.col("directional"), F.lit(False)) if "directional" in have else F.lit(False)
    out = stored(rules.select(F.col("rule_no").cast("long").alias("rule_no"), F.col("label").alias("rule_label"), F.col("t_start").cast("double").alias("r_start"), F.col("t_end").cast("double").alias("r_end"), directional.alias("directional"), *[v.alias(c) for c, v in sets.items()]))
    v6 = not out.where(F.exists(F.concat("attacker_cidrs", "victim_cidrs"), lambda c: c.contains(":"))).isEmpty()  # spares the long expression
    joined = out.join(networks(out, v6), "rule_no", "left")
    kind = "array<struct<width:int,bits:int,head:string>>"
    return joined.withColumns({n: F.coalesce(F.col(n).cast(kind), F.array().cast(kind)) for n in ("nets_a", "nets_v")})


def _keys(ips: Column, nets: Column) -> Column:
    return F.concat(F.transform(ips, lambda x: F.concat(F.lit("h:"), x)), F.transform(nets, lambda n: F.concat_ws(":", n["width"], n["bits"], n["head"])))


def anchors(rules: DataFrame) -> DataFrame:
    """(rule_no, side, key): every set of a rule that could be its anchor; a set that fits no address gives no row."""
    sides = {"attackers": ("attackers", "attacker_cidrs", "nets_a"), "victims": ("victims", "victim_cidrs", "nets_v")}
    named = {s: F.when((F.size(ips) > 0) | (F.size(cidrs) > 0), _keys(F.col(ips), F.col(nets))) for s, (ips, cidrs, nets) in sides.items()}
    named["ports"] = F.when(F.size("dst_ports") > 0, F.transform("dst_ports", lambda p: F.concat(F.lit("p:"), p.cast("string"))))
    none = F.when(F.greatest(*[F.size(c) for c in ("attackers", "attacker_cidrs", "victims", "victim_cidrs", "dst_ports")]) == 0, F.array(F.lit("*")))
    rows = F.explode(F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(s).alias("side"), k.alias("keys")) for s, k in {**named, "open": none}.items()]), lambda x: x["keys"].isNotNull()))).alias("side", "keys")
    return rules.select("rule_no", rows).select("rule_no", "side", F.explode(F.array_distinct("keys")).alias("key"))


def flow_keys(kinds: Sequence[str]) -> Column:
    """The keys under which a flow can meet a rule; ``kinds`` of the keys in use: ``h``, ``p``, ``*`` or width:bits."""
    out: list[Column] = []
    if "h" in kinds:
        out += [F.concat(F.lit("h:"), F.col(c)) for c in ("src_ip", "dst_ip")]
    if "p" in kinds:
        out += [F.concat(F.lit("p:"), F.col(c).cast("string")) for c in ("src_port", "dst_port")]
    for kind in (k for k in kinds if ":" in k):
        width, bits = map(int, kind.split(":"))
        out += [F.when(F.length(d) == width, F.concat(F.lit(f"{kind}:"), prefix(F.col(d), F.lit(bits)))) for d in ("_src_digits", "_dst_digits")]
    if "*" in kinds:
        out.append(F.lit("*"))
    return F.array_distinct(F.array_compact(F.array(*out)))


def _end_keys(e: str, kinds: Sequence[str]) -> Column:
    """The keys of one end's address, among ``kinds``."""
    out = [F.concat(F.lit("h:"), F.col(f"{e}_ip"))]
    for kind in (k for k in kinds if ":" in k):
        width, bits = map(int, kind.split(":"))
        out.append(F.when(F.length(f"_{e}_digits") == width, F.concat(F.lit(f"{kind}:"), prefix(F.col(f"_{e}_digits"), F.lit(bits)))))
    return F.array_distinct(F.array_compact(F.array(*out)))


def _at_end(e: str) -> Column:
    return F.transform(f"_{e}_keys", lambda x: F.struct(F.lit(e).alias("end"), x.alias("key")))


def _kind(key: Column) -> Column:
    return F.when(key.startswith("h:"), "h").when(key.startswith("p:"), "p").when(key == "*", "*").otherwise(F.regexp_extract(key, "^([0-9]+:[0-9]+):", 1))


def _scale(length: Column) -> Column:
    """The smallest power of four, from 0 on, that is at least ``length`` seconds."""
    return sum((F.when(length > 4.0**k, 1).otherwise(0) for k in range(SCALES - 1)), F.lit(0))


def _bin(t: Column, scale: Column) -> Column:
    """The bin of a time; those beyond some 3,000 years stand at the ends, which keeps every time within its window."""
    return F.floor(F.greatest(F.lit(-1e11), F.least(F.lit(1e11), t)) / F.pow(F.lit(4.0), scale))


def _slots(start: Column, end: Column, own: Column, mine: int, other: int, scales: Sequence[int] | Column) -> Column:
    """(case, scale, bin): at the own scale all bins of the time (case ``mine``), at each of ``scales`` that of the start."""
    whole = F.transform(F.sequence(_bin(start, own), F.greatest(_bin(end, own), _bin(start, own))), lambda b: F.struct(F.lit(mine).alias("case"), own.alias("scale"), b.alias("bin")))
    scales = scales if isinstance(scales, Column) else F.array(*map(F.lit, scales)).cast("array<int>")
    return F.concat(whole, F.transform(scales, lambda k: F.struct(F.lit(other).alias("case"), k.alias("scale"), _bin(start, k).alias("bin"))))


def _in_set(ip: str, digits: str, ips: str, cidrs: str, nets: str, any_net: bool) -> Column:
    named = ((F.size(ips) == 0) & (F.size(cidrs) == 0)) | F.array_contains(F.col(ips), F.col(ip))
    if not any_net:
        return named
    return named | F.exists(nets, lambda n: (F.length(digits) == n["width"]) & (prefix(F.col(digits), n["bits"]) == n["head"]))


def fits(capture: str | None, any_net: bool = True) -> Column:
    """Whether a flow and a rule that stand in one row fit; ``capture`` names the flows' column of captures."""
    end = {(e, s): F.coalesce(_in_set(f"{e}_ip", f"_{e}_digits", *cols, any_net), F.lit(False)) for e in ("src", "dst") for s, cols in (("a", ("attackers", "attacker_cidrs", "nets_a")), ("v", ("victims", "victim_cidrs", "nets_v")))}
    return (F.col("t_start") <= F.col("r_end")) & (F.col("t_end") >= F.col("r_start")) & _fits(end, capture)


def _fits(end: dict, capture: str | None) -> Column:
    """``fits`` but for times, from whether each end of the flow is in the attackers and in the victims."""
    ports = {e: F.coalesce(F.array_contains("dst_ports", F.col(f"{e}_port")), F.lit(False)) for e in ("src", "dst")}
    ways = (end["src", "a"] & end["dst", "v"]) | (~F.col("directional") & end["dst", "a"] & end["src", "v"])
    port = (F.size("dst_ports") == 0) | ports["dst"] | (~F.col("directional") & ports["src"])
    proto = (F.size("protos") == 0) | F.coalesce(F.array_contains("protos", F.col("proto").cast("int")), F.lit(False))
    out = ways & port & proto
    return out & ((F.size("captures") == 0) | F.coalesce(F.array_contains("captures", F.col(capture)), F.lit(False))) if capture else out


def _known(time: str) -> Column:
    return F.col(time).isNotNull() & ~F.isnan(time)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def rule_hits(flows: DataFrame, rules: DataFrame, row_id: str = "row_id", capture: str | None = None) -> DataFrame:
    """(row_id, rule_no, rule_label, inside): each flow with each rule that fits it, once.

    Of the sets that could anchor a rule, the one whose keys the fewest flows have is taken, by a count over the flows.
    """
    normal = stored(normal_rules(rules).where(_known("r_start") & _known("r_end")))
    found = stored(anchors(normal))
    kinds = sorted(r[0] for r in found.select(_kind(F.col("key"))).distinct().collect())  # at most 3 and a width and length each
    v4, v6 = (any(k.startswith(w) for k in kinds) for w in ("8:", "32:"))
    slim = flows.select(F.col(row_id).alias("_row"), "src_ip", F.col("src_port").cast("int").alias("src_port"), "dst_ip", F.col("dst_port").cast("int").alias("dst_port"), "proto", F.col("t_start").cast("double").alias("t_start"), F.col("t_end").cast("double").alias("t_end"), *([capture] if capture else []), *[address_digits(F.col(f"{e}_ip"), v4, v6).alias(f"_{e}_digits") for e in ("src", "dst")])
    slim = stored(slim.where(_known("t_start") & _known("t_end")))
    frequent = slim.select(F.explode(flow_keys(kinds)).alias("key")).join(_few(found.select("key").distinct()), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    priced = found.join(frequent, "key", "left").groupBy("rule_no", "side").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    chosen = priced.groupBy("rule_no").agg(F.min_by("side", F.struct("n", "side")).alias("side"))
    keyed = stored(found.join(chosen, ["rule_no", "side"]).select("rule_no", "key"))
    probed = sorted(r[0] for r in keyed.select(_kind(F.col("key"))).distinct().collect())

    length = F.greatest(F.col("r_end") - F.col("r_start"), F.lit(0.0))
    rule_rows = normal.withColumn("_scale", _scale(length))
    flow_rows = slim.withColumn("_scale", _scale(F.greatest(F.col("t_end") - F.col("t_start"), F.lit(0.0))))
    flow_scales = sorted(r[0] for r in flow_rows.select("_scale").distinct().collect())

    slotted = rule_rows.select("rule_no", F.explode(_slots(F.col("r_start"), F.col("r_end"), F.col("_scale"), 1, 2, flow_scales)).alias("_slot")).select("rule_no", "_slot.*")
    long = F.greatest(*[F.size(c) for c in (*ENDS["a"], *ENDS["v"])]) > INLINE
    lean = {c: F.when(~long, F.col(c)) for c in (*ENDS["a"], *ENDS["v"])}
    slim_rules = rule_rows.withColumn("long", long).withColumns(lean).drop("_scale")
    index = stored(keyed.join(slotted, "rule_no").join(slim_rules, "rule_no"))
    scales = index.where("case = 1").groupBy("key").agg(F.sort_array(F.collect_set("scale")).alias("_scales"))  # SCALES a key at most
    met_keys = flow_rows.withColumn("key", F.explode(flow_keys(probed))).join(_few(scales), "key")
    probes = met_keys.withColumn("_slot", F.explode(_slots(F.col("t_start"), F.col("t_end"), F.col("_scale"), 2, 1, F.col("_scales")))).drop("_scale", "_scales").select("*", "_slot.*").drop("_slot")
    begins = (F.col("case") == 1) == (F.col("t_start") >= F.col("r_start"))  # each pair in one of the two cases only
    during = (F.col("t_start") <= F.col("r_end")) & (F.col("t_end") >= F.col("r_start"))
    inside = (F.col("t_start") >= F.col("r_start")) & (F.col("t_end") <= F.col("r_end"))
    met = probes.join(_few(index), ["key", "case", "scale", "bin"]).where(begins & during)
    shown = ("_row", "rule_no", "rule_label", inside.alias("inside"))
    short = met.where(~F.col("long") & fits(capture, v4 or v6)).select(*shown)
    if normal.where(long).isEmpty():
        return short.distinct().withColumnRenamed("_row", row_id)
    open_ends = {s: (F.size(ENDS[s][0]) == 0) & (F.size(ENDS[s][1]) == 0) for s in "av"}
    asked = met.where("long").dropDuplicates(["_row", "rule_no"]).withColumns({f"_{e}_keys": _end_keys(e, kinds) for e in ("src", "dst")})
    asked = asked.select(*shown, "directional", "src_port", "dst_port", "proto", "dst_ports", "protos", "captures", *([capture] if capture else []), F.explode(F.concat(*[_at_end(e) for e in ("src", "dst")], F.array(F.struct(F.lit("none").alias("end"), F.lit("").alias("key"))))).alias("_k"))
    members = found.where("side IN ('attackers', 'victims')").join(normal.where(long).select("rule_no"), "rule_no", "left_semi").groupBy("rule_no", "key").agg(F.collect_set("side").alias("_sides"))
    held = asked.select("*", "_k.*").drop("_k").join(_few(members), ["rule_no", "key"], "left")
    has = {(e, s): F.coalesce(F.bool_or((F.col("end") == e) & F.array_contains("_sides", side)), F.lit(False)).alias(f"_{e}_{s}") for e in ("src", "dst") for s, side in (("a", "attackers"), ("v", "victims"))}
    rest = ["rule_label", "inside", "directional", "src_port", "dst_port", "proto", "dst_ports", "protos", "captures", *([capture] if capture else [])]
    each = held.groupBy("_row", "rule_no").agg(*has.values(), *[F.first(c).alias(c) for c in rest])
    each = each.join(normal.where(long).select("rule_no", *[x.alias(f"_open_{s}") for s, x in open_ends.items()]), "rule_no")
    ends = {(e, s): F.col(f"_{e}_{s}") | F.col(f"_open_{s}") for e, s in has}
    return short.union(each.where(_fits(ends, capture)).select("_row", "rule_no", "rule_label", "inside")).distinct().withColumnRenamed("_row", row_id)


def label_by_table(flows: DataFrame, rules: DataFrame, row_id: str = "row_id", capture: str | None = None) -> DataFrame:
    """J1 for many rules: what ``label_flows`` gives, from a table of rules (rule_no, label, t_start, t_end, sets).

    ``row_id`` tells the flows apart. The rule of the smallest ``rule_no`` that fits wins, ``n_rule_matches`` counts all.
    Rules that name ``captures`` hold for flows whose column ``capture`` has one of them, or for all where none is given.
    Flows without times fit no rule; networks that are none fit nothing.
    """
    hits = rule_hits(flows, rules, row_id, capture)
    first = hits.groupBy(row_id).agg(F.min_by(F.struct("rule_label", "inside"), "rule_no").alias("_first"), F.count(F.lit(1)).alias("_n"))
    joined = flows.join(_few(stored(first)), row_id, "left")
    none = F.col("_first").isNull()
    return joined.withColumns({
        "label": F.when(none, BENIGN).otherwise(F.col("_first.rule_label")),
        "binary_label": F.when(none, BENIGN).otherwise(ATTACK),
        "label_confidence": F.when(none, "benign").when(F.col("_first.inside"), "exact").otherwise("window_edge"),
        "n_rule_matches": F.coalesce(F.col("_n"), F.lit(0)).cast("long"),
    }).drop("_first", "_n")


def numbered_rules(derived: DataFrame) -> DataFrame:
    """Derived rules as a rule table: numbered from 0 by capture, stage and window, for their own capture, one way."""
    one = derived.withColumn("_one", F.lit(1).cast("long")).withColumn("_all", F.lit(0))
    numbered = running_sums(one, ["_all"], ["capture", "stage", "window_no"], ["_one"])
    return numbered.select((F.col("run__one") - 1).alias("rule_no"), F.col("stage").alias("label"), "t_start", "t_end", "attackers", "victims", "dst_ports", "protos", F.array("capture").alias("captures"), F.lit(True).alias("directional"))
