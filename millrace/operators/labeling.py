"""Labels for flows: time, address and port rules, projection from reference events, rule derivation, fidelity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.flow import in_cidrs, is_host
from millrace.operators.ranges import dealt, with_part

BENIGN, ATTACK = "BENIGN", "ATTACK"


def _one_of(value: Column, wanted: Sequence) -> Column:
    return value.isin(list(wanted)) if wanted else F.lit(True)


def _endpoint(ip: Column, ips: Sequence[str], cidrs: Sequence[str]) -> Column:
    """No addresses and no networks: any; a network that fits nothing fits nothing."""
    if not ips and not cidrs:
        return F.lit(True)
    hit = ip.isin(list(ips)) if ips else F.lit(False)
    return hit | in_cidrs(ip, list(cidrs)) if cidrs else hit


def rule_fits(rule: Mapping, capture: str | None = None) -> Column:
    """Whether a flow (src_ip, ..., t_start, t_end) fits one rule; empty sets don't constrain."""
    src, dst = F.col("src_ip"), F.col("dst_ip")
    attackers, victims = (rule.get("attackers", []), rule.get("attacker_cidrs", [])), (rule.get("victims", []), rule.get("victim_cidrs", []))
    forward = _endpoint(src, *attackers) & _endpoint(dst, *victims)
    ports = rule.get("dst_ports", [])
    port = _one_of(F.col("dst_port"), ports)
    if not rule.get("directional"):
        forward = forward | (_endpoint(dst, *attackers) & _endpoint(src, *victims))
        port = port | _one_of(F.col("src_port"), ports)
    fits = (F.col("t_start") <= float(rule["t_end"])) & (F.col("t_end") >= float(rule["t_start"])) & forward & port & _one_of(F.col("proto"), rule.get("protos", []))
    if rule.get("captures") and capture is None and rule.get("by_row"):
        fits = fits & F.col("capture").isin(list(rule["captures"]))
    if rule.get("captures") and capture is not None and capture not in rule["captures"]:
        fits = F.lit(False)
    return F.coalesce(fits, F.lit(False))


def label_flows(flows: DataFrame, rules: Sequence[Mapping], capture: str | None = None) -> DataFrame:
    """The first rule that fits labels a flow: label, binary_label, label_confidence, n_rule_matches.

    Rules become one expression; there is no join, so the flows are neither shuffled nor multiplied.
    """
    hits = [F.when(rule_fits(r, capture), F.struct(F.lit(i).alias("i"), F.lit(r["label"]).alias("label"), ((F.col("t_start") >= float(r["t_start"])) & (F.col("t_end") <= float(r["t_end"]))).alias("inside"))) for i, r in enumerate(rules)]
    if not hits:
        return flows.withColumns({"label": F.lit(BENIGN), "binary_label": F.lit(BENIGN), "label_confidence": F.lit("benign"), "n_rule_matches": F.lit(0).cast("long")})
    found = flows.withColumn("_hits", F.filter(F.array(*hits), lambda h: h.isNotNull()))
    first = F.try_element_at("_hits", F.lit(1))
    return found.withColumns({
        "label": F.coalesce(first["label"], F.lit(BENIGN)),
        "binary_label": F.when(first.isNull(), BENIGN).otherwise(ATTACK),
        "label_confidence": F.when(first.isNull(), "benign").when(first["inside"], "exact").otherwise("window_edge"),
        "n_rule_matches": F.size("_hits").cast("long"),
    }).drop("_hits")


def rule_table(specs: DataFrame, default_zone: str = "UTC") -> DataFrame:
    """Rules with date, start, end and zone as text become rules with epoch bounds and a capture list."""
    zone = F.coalesce("tz", F.lit(default_zone))

    def at(c: str) -> Column:
        return F.unix_micros(F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", "date", c)), zone)) / 1e6

    captures = F.coalesce("captures", F.when(F.col("capture").isNotNull(), F.array("capture")), F.array().cast("array<string>"))
    return specs.select("rule_no", "name", "label", at("start").alias("t_start"), at("end").alias("t_end"), captures.alias("captures"), *[c for c in specs.columns if c not in ("rule_no", "name", "label", "date", "start", "end", "tz", "capture", "captures")])


def rules_of(table: DataFrame) -> list[dict]:
    """The rows of a rule table, by ``rule_no``, as the mappings that ``label_flows`` takes; a file of rules has a few."""
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in table.orderBy("rule_no").collect()]


def label_by_specs(flows: DataFrame, specs: DataFrame, capture: str | None = None, default_zone: str = "UTC") -> DataFrame:
    """Flows labelled by the rows of a rule file."""
    rules = rules_of(rule_table(specs, default_zone))
    return label_flows(flows, rules if capture is not None else [r | {"by_row": True} for r in rules], capture)


def class_distribution(labeled: DataFrame) -> DataFrame:
    """Flows of each class and of each confidence, the largest class first."""
    kinds = ("exact", "window_edge", "benign", "projected")
    return labeled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label_confidence") == k).alias(k) for k in kinds]).orderBy(F.desc("n"), "label")


def label_audit(labeled: DataFrame) -> DataFrame:
    """Rows, attacks, rows that more than one rule fits."""
    return labeled.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("binary_label") == ATTACK).alias("n_attack"), F.count_if(F.col("n_rule_matches") > 1).alias("n_multi"))


def project_reference(flows: DataFrame, reference: DataFrame, label: str, tolerance: float = 2.0, key: Sequence[str] = ("src_ip", "src_port", "dst_ip", "dst_port", "proto")) -> DataFrame:
    """Benign flows with a reference event of the same key within ``tolerance`` seconds get ``label``.

    Times are dealt to bins of the tolerance, and an event stands in three of them, so the join is on equality.
    """
    r = reference.select(*key, F.col("t_start").alias("_rt"))
    r = r.withColumn("_bin", F.explode(F.array(*[F.floor(F.col("_rt") / tolerance) + d for d in (-1, 0, 1)])))
    f = flows.withColumn("_bin", F.floor(F.col("t_start") / tolerance))
    benign = F.col("binary_label") == BENIGN
    open_rows = f.where(benign).select("row_id", *key, "t_start", "_bin")
    hits = open_rows.join(r, [*key, "_bin"]).where(F.abs(F.col("t_start") - F.col("_rt")) <= tolerance).select("row_id").distinct().withColumn("_hit", F.lit(True))
    joined = f.drop("_bin").join(hits, "row_id", "left")
    hit = F.col("_hit").isNotNull()
    return joined.withColumns({"label": F.when(hit, label).otherwise(F.col("label")), "binary_label": F.when(hit, ATTACK).otherwise(F.col("binary_label")), "label_confidence": F.when(hit, "projected").otherwise(F.col("label_confidence"))}).drop("_hit")


def exclusive_endpoints(events: DataFrame, capture: str = "capture", endpoint: str = "src_ip", stage: str = "stage") -> DataFrame:
    """Endpoints of a capture that occur in attack rows and in no benign row."""
    bad = events.where(F.col(stage) != BENIGN).select(capture, endpoint).distinct()
    return bad.join(events.where(F.col(stage) == BENIGN).select(capture, endpoint).distinct(), [capture, endpoint], "left_anti")


def numbered_windows(rows: DataFrame, gap: float) -> DataFrame:
    """``rows`` (capture, stage, t) with ``window_no``, from 0 in each capture and stage: a gap of over ``gap`` seconds begins the next."""
    group = ["capture", "stage"]
    table = dealt(rows, [*group, "t"])
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    edges = table.groupBy(*group, "_part").agg(F.max("t").alias("_last")).select(*group, "_part", F.max("_last").over(earlier).alias("_before"))
    here = W.partitionBy(*group, "_part").orderBy("t")
    step = F.col("t") - F.coalesce(F.lag("t").over(here), "_before")
    flagged = with_part(table, edges, group).withColumn("_new", F.when(step > gap, 1).otherwise(0))
    flagged = flagged.withColumn("_run", F.sum("_new").over(here.rowsBetween(W.unboundedPreceding, 0)))
    begun = flagged.groupBy(*group, "_part").agg(F.sum("_new").alias("_begun")).select(*group, "_part", F.coalesce(F.sum("_begun").over(earlier), F.lit(0)).alias("_offset"))
    return with_part(flagged, begun, group).withColumn("window_no", F.col("_offset") + F.col("_run")).drop("_part", "_before", "_new", "_run", "_offset")


def derive_rules(events: DataFrame, gap: float = 600, pad: float = 30, most_ports: int = 12) -> DataFrame:
    """Attack rows (capture, stage, src_ip, dst_ip, dst_port, proto, t) to rules of each gap window.

    Attackers are endpoints without benign rows; port lists of more than ``most_ports`` are left open. Rows are sorted in
    ranges, so the rows of a stage are not one task.
    """
    attacks = events.where((F.col("stage") != BENIGN) & is_host(F.col("src_ip")) & is_host(F.col("dst_ip")))
    sole = exclusive_endpoints(events)
    attacks = attacks.join(sole, ["capture", "src_ip"], "left_semi")
    runs = numbered_windows(attacks, gap)
    ports = F.sort_array(F.collect_set("dst_port"))
    out = runs.groupBy("capture", "stage", "window_no").agg((F.min("t") - pad).alias("t_start"), (F.max("t") + pad).alias("t_end"), F.sort_array(F.collect_set("src_ip")).alias("attackers"), F.sort_array(F.collect_set("dst_ip")).alias("victims"), ports.alias("_ports"), F.sort_array(F.collect_set("proto")).alias("protos"), F.count(F.lit(1)).alias("n_rows"))
    return out.withColumn("dst_ports", F.when(F.size("_ports") <= most_ports, F.col("_ports")).otherwise(F.array().cast(out.schema["_ports"].dataType))).drop("_ports")


def rule_coverage(events: DataFrame, rules: DataFrame) -> DataFrame:
    """A23's log: for each capture and stage its attack rows, its rules, the rows they came from and the rows' share."""
    seen = events.where(F.col("stage") != BENIGN).groupBy("capture", "stage").agg(F.count(F.lit(1)).alias("n_attack"))
    ruled = rules.groupBy("capture", "stage").agg(F.count(F.lit(1)).alias("n_rules"), F.sum("n_rows").alias("n_ruled"))
    both = seen.join(ruled, ["capture", "stage"], "left").na.fill(0, ["n_rules", "n_ruled"])
    return both.withColumn("share", F.col("n_ruled") / F.col("n_attack"))


def clock_offset(packets: DataFrame, local: DataFrame, most_spread: float = 0.05) -> DataFrame:
    """Hours between first packet and first local time: rounded half-even mean over captures, spread, and whether it is steady."""
    a = packets.groupBy("capture").agg(F.min("t").alias("t"))
    b = local.groupBy("capture").agg(F.min("t").alias("local_t"))
    h = a.join(b, "capture").select(((F.col("t") - F.col("local_t")) / 3600).alias("h"))
    return h.agg(F.bround(F.avg("h"), 0).alias("offset_hours"), (F.max("h") - F.min("h")).alias("spread")).withColumn("steady", F.col("spread") < most_spread)


def stage_events(events: DataFrame, stage: str) -> DataFrame:
    """Reference events of one stage."""
    return events.where(F.col("stage") == stage).select("capture", "src_ip", "src_port", "dst_ip", "dst_port", "proto", F.col("t").alias("t_start"))


def fidelity(rows: DataFrame, truth: str = "stage", predicted: str = "label") -> DataFrame:
    """True and false positives, false negatives, precision and recall of each stage, and of ATTACK as a whole."""
    one = rows.select(F.col(truth).alias("t"), F.col(predicted).alias("p"))
    as_binary = one.select(*[F.when(F.col(c) == BENIGN, BENIGN).otherwise(ATTACK).alias(c) for c in ("t", "p")]).where("t <> 'BENIGN' OR p <> 'BENIGN'")
    counts = one.groupBy("t", "p").agg(F.count(F.lit(1)).alias("n")).union(as_binary.groupBy("t", "p").agg(F.count(F.lit(1)).alias("n")))
    each = counts.select("n", F.explode(F.array_distinct(F.array(F.struct(F.col("t").alias("stage")), F.struct(F.col("p").alias("stage"))))).alias("s"), "t", "p").select("s.stage", "n", "t", "p")
    agg = each.where(F.col("stage") != BENIGN).groupBy("stage").agg(F.sum(F.when((F.col("t") == F.col("stage")) & (F.col("p") == F.col("stage")), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("t") != F.col("stage"), F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("p") != F.col("stage"), F.col("n")).otherwise(0)).alias("fn"))
    return agg.select("stage", "tp", "fp", "fn", (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"), (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("recall"))
