"""Comparing two segmentations of the same traffic: interval joins, multiplicities, nearest times, set differences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.ranges import dealt, stored, with_part

CATEGORIES = ("1:1", "split", "merge", "unmatched")
#: No interval is dealt to more than about so many time bins.
MOST_BINS = 1_000


def bin_length(a: DataFrame, b: DataFrame, start: str, end: str) -> int:
    """The mean length of all intervals, so that bins at most treble the rows; longer where the longest needs over ``MOST_BINS``."""
    lengths = [t.select(F.greatest(F.col(end) - F.col(start), F.lit(0)).alias("x")) for t in (a, b)]
    r = lengths[0].union(lengths[1]).agg(F.avg("x").alias("mean"), F.max("x").alias("most")).first()
    return max(1, math.ceil(r.mean or 0), math.ceil((r.most or 0) / MOST_BINS))


def overlap_pairs(a: DataFrame, b: DataFrame, key: str = "key", start: str = "t_start_us", end: str = "t_end_us", bin_us: int | None = None, tie: tuple[str, ...] = ()) -> DataFrame:
    """(ia, ib) of flows with equal keys (and ``tie`` columns) whose closed intervals overlap.

    Intervals are dealt to time bins and joined on (key, bin), so a key of very many flows is split; a pair counts only
    in the first bin that both touch. ``bin_us`` is the bins' length, measured (``bin_length``) unless given.
    """
    on = [key, *tie]
    left = a.select(*on, F.col("row_id").alias("ia"), F.col(start).alias("sa"), F.col(end).alias("ea"))
    right = b.select(*on, F.col("row_id").alias("ib"), F.col(start).alias("sb"), F.col(end).alias("eb"))
    meets = (F.col("sa") <= F.col("eb")) & (F.col("sb") <= F.col("ea"))
    bin_us = bin_us or bin_length(a, b, start, end)

    def bins(s: str, e: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(s) / bin_us), F.floor(F.col(e) / bin_us)))

    left, right, on = left.withColumn("_bin", bins("sa", "ea")), right.withColumn("_bin", bins("sb", "eb")), [*on, "_bin"]
    meets = meets & (F.col("_bin") == F.greatest(F.floor(F.col("sa") / bin_us), F.floor(F.col("sb") / bin_us)))
    return left.join(right, on).where(meets).select(*tie, "ia", "ib")


def categories(a: DataFrame, pairs: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """Every flow of ``a`` with its category: one partner that has no other is ``1:1``."""
    n_b = F.count(F.lit(1)).over(W.partitionBy(*tie, "ia"))
    n_a = F.count(F.lit(1)).over(W.partitionBy(*tie, "ib"))
    per = pairs.withColumn("n_b", n_b).withColumn("n_a", n_a).groupBy(*tie, "ia").agg(F.max("n_b").alias("n_b"), F.max("n_a").alias("n_a"))
    joined = a.join(per.withColumnRenamed("ia", "row_id"), [*tie, "row_id"], "left")
    kind = F.when(F.col("n_b").isNull(), "unmatched").when(F.col("n_b") > 1, "split").when(F.col("n_a") == 1, "1:1").otherwise("merge")
    return joined.withColumn("category", kind).drop("n_a", "n_b")


def one_to_one(pairs: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """The pairs whose members have no other partner."""
    n_b, n_a = F.count(F.lit(1)).over(W.partitionBy(*tie, "ia")), F.count(F.lit(1)).over(W.partitionBy(*tie, "ib"))
    return pairs.withColumn("n_b", n_b).withColumn("n_a", n_a).where("n_a = 1 AND n_b = 1").drop("n_a", "n_b")


def category_summary(categorised: DataFrame, by: tuple[str, ...] = (), label: str = "label") -> DataFrame:
    """A3: counts and 4-digit shares of categories for each label and for ALL; null labels count in ALL only."""
    sets = f"GROUPING SETS (({', '.join(by)}), ({', '.join([*by, label])}))"
    view = categorised.select(*by, label, "category")
    counts = ", ".join(f"count_if(category = '{c}') AS `c_{c.replace(':', 'to')}`" for c in CATEGORIES)
    cols = "".join(f"{c}, " for c in by)
    grouped = view.sparkSession.sql(f"SELECT {cols}{label} AS _label, grouping({label}) AS _all, count(*) AS n, {counts} FROM {{view}} GROUP BY {sets}", view=view)
    out = grouped.where("_all = 1 OR _label IS NOT NULL").select(*by, F.when(F.col("_all") == 1, "ALL").otherwise(F.col("_label")).alias("class"), "n", *[f"c_{c.replace(':', 'to')}" for c in CATEGORIES])
    return out.select("*", *[F.round(F.col(f"c_{c.replace(':', 'to')}") / F.col("n"), 4).alias(f"f_{c.replace(':', 'to')}") for c in CATEGORIES])


def agreement_matrix(summary: DataFrame, tools: list[str]) -> DataFrame:
    """A4: share of 1:1 flows of tool_a (rows) against tool_b (columns), over all days."""
    sums = summary.where("class = 'ALL'").groupBy("tool_a", "tool_b").agg((F.sum("c_1to1") / F.sum("n")).alias("share"))
    return sums.groupBy("tool_a").pivot("tool_b", tools).agg(F.round(F.first("share"), 6))


def per_class(summary: DataFrame, order: list[str]) -> DataFrame:
    """Shares of categories of each class over all pairs, in a fixed order of classes."""
    sums = summary.where("class <> 'ALL'").groupBy("class").agg(F.sum("n").alias("n"), *[F.sum(f"c_{c.replace(':', 'to')}").alias(f"c_{c.replace(':', 'to')}") for c in CATEGORIES])
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i)]), F.col("class")), F.lit(99))
    return sums.select("class", "n", *[(F.col(f"c_{c.replace(':', 'to')}") / F.col("n")).alias(f"f_{c.replace(':', 'to')}") for c in CATEGORIES], place.alias("place")).orderBy("place", "class")


def ordered_pairs(tools: DataFrame, name: str = "tool") -> DataFrame:
    """Ordered pairs of different tools; a dimension of a few rows."""
    a, b = tools.select(F.col(name).alias("tool_a")).distinct(), tools.select(F.col(name).alias("tool_b")).distinct()
    return a.join(F.broadcast(b), F.col("tool_a") != F.col("tool_b"))


def align_all(flows: DataFrame, bin_us: int | None = None) -> DataFrame:
    """J2, J3 for all ordered pairs of tools in one job: flows (tool, key, row_id, start, end, label) with tool_b and category.

    Flows are dealt to bins once and meet in one self-join, each two tools in one order; both directions come from these
    pairs. A flow's partners are counted for each other tool, and a flow with one partner looks up how many that one has.
    Flows take their categories as one map, so they are shuffled once whatever the number of tools.
    """
    bin_us = bin_us or bin_length(flows, flows.limit(0), "t_start_us", "t_end_us")
    span = F.sequence(F.floor(F.col("t_start_us") / bin_us), F.floor(F.col("t_end_us") / bin_us))
    dealt_flows = flows.select("key", F.explode(span).alias("_bin"), F.struct(F.col("tool"), F.col("row_id").alias("id"), F.col("t_start_us").alias("s"), F.col("t_end_us").alias("e")).alias("f"))
    a, b = (dealt_flows.select("key", "_bin", F.col("f").alias(side)) for side in ("a", "b"))
    meets = (F.col("a.tool") < F.col("b.tool")) & (F.col("a.s") <= F.col("b.e")) & (F.col("b.s") <= F.col("a.e"))
    first = F.col("_bin") == F.greatest(F.floor(F.col("a.s") / bin_us), F.floor(F.col("b.s") / bin_us))

    def way(x: str, y: str) -> Column:
        return F.struct(F.col(f"{x}.tool").alias("tool"), F.col(f"{x}.id").alias("row_id"), F.col(f"{y}.tool").alias("other"), F.col(f"{y}.id").alias("partner"))

    both = a.join(b, ["key", "_bin"]).where(meets & first).select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("w")).select("w.*")
    per = stored(both.groupBy("tool", "row_id", "other").agg(F.count(F.lit(1)).alias("n"), F.min("partner").alias("partner")))
    backs = per.select(F.col("other").alias("tool"), F.col("row_id").alias("partner"), F.col("tool").alias("other"), F.col("n").alias("n_back"))
    kinds = per.withColumn("partner", F.when(F.col("n") == 1, F.col("partner"))).join(backs, ["tool", "partner", "other"], "left")
    kind = F.when(F.col("n") > 1, "split").when(F.col("n_back") == 1, "1:1").otherwise("merge")
    maps = kinds.groupBy("tool", "row_id").agg(F.map_from_entries(F.collect_list(F.struct("other", kind.alias("kind")))).alias("_kinds"))  # an entry a tool
    others = ordered_pairs(flows).groupBy(F.col("tool_a").alias("tool")).agg(F.collect_list("tool_b").alias("_others"))
    out = flows.join(maps, ["tool", "row_id"], "left").join(F.broadcast(others), "tool").withColumn("tool_b", F.explode("_others"))
    return out.withColumn("category", F.coalesce(F.try_element_at("_kinds", F.col("tool_b")), F.lit("unmatched"))).withColumnRenamed("tool", "tool_a").drop("_kinds", "_others")


def nearest(left: DataFrame, right: DataFrame, key: str, time: str, payload: list[str]) -> DataFrame:
    """For each left row the right row of its key nearest in time (smaller id on ties); null without a partner.

    Both sides are sorted together in ranges of key and time: the rows before and after a left row's time are the only
    ones in question, and a range takes the nearest ones of a key from the ranges around it, so a key is not one task.
    A left row without time or key has no partner, and a right row without time or key is none.
    """
    right = right.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    row = F.struct(F.col(time).alias("t"), F.col("row_id").alias("id"), *[F.col(c) for c in payload])
    l = left.select(F.col(key), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))  # noqa: E741
    r = right.groupBy(key, F.col(time).alias("_t")).agg(F.min(row).alias("_r")).select(key, "_t", F.lit(0).alias("_side"), "_r", F.lit(None).cast(l.schema["_l"].dataType).alias("_l"))
    both = dealt(r.unionByName(l), [key, "_t", "_side"])
    edges = both.groupBy(key, "_part").agg(F.max("_r").alias("_last"), F.min("_r").alias("_first"))  # by time first
    over = W.partitionBy(key).orderBy("_part")
    around = edges.select(key, "_part", F.last("_last", True).over(over.rowsBetween(W.unboundedPreceding, -1)).alias("_earlier"), F.first("_first", True).over(over.rowsBetween(1, W.unboundedFollowing)).alias("_later"))
    up, down = W.partitionBy(key, "_part").orderBy("_t", "_side"), W.partitionBy(key, "_part").orderBy(F.desc("_t"), "_side")
    before, after = F.last("_r", True).over(up.rowsBetween(W.unboundedPreceding, 0)), F.last("_r", True).over(down.rowsBetween(W.unboundedPreceding, 0))
    found = with_part(both.withColumn("_before", before).withColumn("_after", after), around, [key])
    found = found.withColumn("_before", F.coalesce("_before", "_earlier")).withColumn("_after", F.coalesce("_after", "_later"))
    gap_b, gap_a = F.col("_t") - F.col("_before.t"), F.col("_after.t") - F.col("_t")
    best = F.when(F.col("_t").isNotNull(), F.when(F.col("_before").isNull(), F.col("_after")).when(F.col("_after").isNull(), F.col("_before")).when((gap_b < gap_a) | ((gap_b == gap_a) & (F.col("_before.id") <= F.col("_after.id"))), F.col("_before")).otherwise(F.col("_after")))
    return found.where("_side = 1").withColumn("_best", best).select("_l.*", F.col("_best.id").alias("near_id"), F.col("_best.t").alias("near_t"), *[F.col(f"_best.{c}").alias(f"near_{c}") for c in payload])


def matched(a: DataFrame, b: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Keys of both sides with ``a_x`` and ``b_x`` of each column x of ``compare`` (of rows of one key the least), ``in_a``, ``in_b`` and ``same``."""
    left = a.groupBy(*keys).agg(*[F.min(c).alias(f"a_{c}") for c in compare]).withColumn("in_a", F.lit(True))
    right = b.groupBy(*keys).agg(*[F.min(c).alias(f"b_{c}") for c in compare]).withColumn("in_b", F.lit(True))
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return left.join(right, keys, "full_outer").withColumn("same", same)


def set_difference(a: DataFrame, b: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """One row: rows in both, only in one, in both with equal ``compare`` columns (numbers or bytes), and the latter's share of the former."""
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    counts = matched(a, b, keys, compare).agg(F.count_if(both).alias("n_both"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.count_if(both & F.col("same")).alias("n_equal"))
    return counts.withColumn("match_rate", F.col("n_equal") / F.nullif(F.col("n_both"), F.lit(0)))


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], compare: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` keys, by their order, that both sides have and whose ``compare`` columns differ."""
    return matched(a, b, keys, compare).where("in_a AND in_b AND NOT same").drop("in_a", "in_b", "same").orderBy(*keys).limit(n)
