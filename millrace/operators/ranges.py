"""Tables written for reuse, and scans, running sums and exact quantiles over sorted ranges, so that no group is one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that all executors see (``spark.checkpoint.dir``); on a local master without it a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return f"{base or tempfile.mkdtemp(prefix='millrace-')}/{kind}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """A table that several parts of a plan read: written once, read back."""
    path = scratch(df.sparkSession, "tables")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, order: Sequence[str], least: int = 1) -> DataFrame:
    """``rows`` in ``least`` ranges of ``order`` or more, with the range's number ``_part``; written, so that a lost task meets the same ranges."""
    n = max(least, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stored(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def with_part(rows: DataFrame, parts: DataFrame, group: Sequence[str]) -> DataFrame:
    """``rows`` of ``dealt`` beside the row that ``parts`` has for their group and range; null groups meet each other."""
    side = parts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), *[c for c in parts.columns if c not in (*group, "_part")])
    on: Column = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(side, on).drop("_p", *[f"_g{i}" for i in range(len(group))])


#: What a scan gives a row: the row before's value; the sum up to the row; the largest value before it; the group's first value.
SCANS = {
    "previous": (lambda c, here: F.lag(c).over(here), lambda c, order: F.max_by(c, order), lambda c, before: F.last(c, ignorenulls=True).over(before), lambda own, carry: F.coalesce(own, carry)),
    "sum": (lambda c, here: F.sum(c).over(here.rowsBetween(W.unboundedPreceding, 0)), lambda c, order: F.sum(c), lambda c, before: F.sum(c).over(before), lambda own, carry: own + F.coalesce(carry, F.lit(0))),
    "largest_before": (lambda c, here: F.max(c).over(here.rowsBetween(W.unboundedPreceding, -1)), lambda c, order: F.max(c), lambda c, before: F.max(c).over(before), lambda own, carry: F.greatest(own, carry)),
    "first": (lambda c, here: F.first(c).over(here), lambda c, order: F.min_by(c, order), lambda c, before: F.first(c, ignorenulls=True).over(before), lambda own, carry: F.coalesce(carry, own)),
}


def scanned(table: DataFrame, group: Sequence[str], order: Sequence[str], scans: dict[str, tuple[str, Column]]) -> DataFrame:
    """``table`` (from ``dealt``, in whose order the groups are stretches) with a column for each scan (kind, value not null).

    Each range is scanned by itself and then takes over what the group's ranges before it give. Ranges are sorted, so only
    a group that reaches over a range's edge stands in two; what is carried is two rows a range at most, and broadcast.
    ``table`` is read twice, so it should be a written one or cheap to make from one. A table without ``_part`` is one
    range, whose groups are sorted each in a task.
    """
    if "_part" not in table.columns:
        whole = W.partitionBy(*group).orderBy(*order)
        return table.withColumns({n: SCANS[k][0](c, whole) for n, (k, c) in scans.items()})
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    parts = table.groupBy(*group, "_part").agg(*[SCANS[k][1](c, by).alias(n) for n, (k, c) in scans.items()])
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), F.count(F.lit(1)).over(before).alias("_k"), *[SCANS[k][2](F.col(n), before).alias(f"_carry_{n}") for n, (k, _) in scans.items()])
    here = W.partitionBy(*group, "_part").orderBy(*order)
    own = table.withColumns({n: SCANS[k][0](c, here) for n, (k, c) in scans.items()})
    joined = _beside(own, carried.where("_k > 0"), group)
    return joined.withColumns({n: SCANS[k][3](F.col(n), F.col(f"_carry_{n}")) for n, (k, _) in scans.items()}).drop("_k", *[f"_carry_{n}" for n in scans])


def _beside(rows: DataFrame, carried: DataFrame, group: Sequence[str]) -> DataFrame:
    """``rows`` beside what is carried into their group and range (``_g0``, ..., ``_p``), if anything."""
    on: Column = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(F.broadcast(carried), on, "left").drop("_p", *[f"_g{i}" for i in range(len(group))])


def numbered_runs(table: DataFrame, group: Sequence[str], order: Sequence[str], value: str, breaks: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """``table`` (from ``dealt``) with ``name``: from 0 on in each group, one more wherever ``breaks(value before, value)`` holds.

    Each range is numbered by itself and written; a group's later ranges add the numbers begun before them, and one if the
    break falls on their edge. A table without ``_part`` is one range.
    """
    if "_part" not in table.columns:
        whole = W.partitionBy(*group).orderBy(*order)
        new = F.when(breaks(F.lag(value).over(whole), F.col(value)), 1).otherwise(0).cast("long")
        return table.withColumn("_new", new).withColumn(name, F.sum("_new").over(whole.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    here = W.partitionBy(*group, "_part").orderBy(*order)
    new = F.when(breaks(F.lag(value).over(here), F.col(value)), 1).otherwise(0).cast("long")
    own = stored(table.withColumn("_new", new).withColumn(name, F.sum("_new").over(here.rowsBetween(W.unboundedPreceding, 0))).drop("_new"))
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    parts = own.groupBy(*group, "_part").agg(F.min_by(value, by).alias("_first"), F.max_by(value, by).alias("_last"), F.max(name).alias("_begun"))
    up = W.partitionBy(*group).orderBy("_part")
    edges = parts.withColumn("_edge", F.when(breaks(F.lag("_last").over(up), F.col("_first")), 1).otherwise(0)).withColumn("_at", F.row_number().over(up))
    offset = F.sum("_edge").over(up.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.sum("_begun").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carried = edges.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), offset.alias("_offset"), "_at").where("_at > 1").drop("_at")
    return _beside(own, carried, group).withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0))).drop("_offset")


def running_sums(rows: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """``rows`` with ``run_x``, the sum of x over the group's rows up to this one in ``order``, and ``all_x``, over the group.

    Rows are sorted within ranges; a range adds the sums of the group's earlier ranges, a row for each range. Rows of
    equal order stand in any order; null groups are one group, and nulls in ``order`` come first.
    """
    table = dealt(rows, [*group, *order])
    parts = table.groupBy(*group, "_part").agg(*[F.sum(x).alias(x) for x in sums])
    whole = W.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = parts.select(*group, "_part", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_before_{x}") for x in sums], *[F.sum(x).over(whole).alias(f"all_{x}") for x in sums])
    here = W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    runs = {f"run_{x}": F.col(f"_before_{x}") + F.coalesce(F.sum(x).over(here), F.lit(0)) for x in sums}
    return with_part(table, totals, group).withColumns(runs).drop("_part", *[f"_before_{x}" for x in sums])


def exact_quantiles(values: DataFrame, group: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """A row for each group: its columns and ``quantiles``, an array in the order of ``shares``, interpolated linearly.

    Null values don't count, a group of nulls alone has no row. Values are counted, then ranked by ``running_sums``.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_k"))
    ranked = running_sums(counts, group, [value], ["_k"])
    out = []
    for q in shares:
        place = F.lit(float(q)) * (F.col("all__k") - 1)
        low, high = F.floor(place), F.ceil(place)

        def at(rank: Column) -> Column:
            return F.max(F.when((F.col("run__k") - F.col("_k") <= rank) & (rank < F.col("run__k")), F.col(value)))

        rest = F.max(place - low)
        out.append(F.when(rest == 0, at(low)).otherwise((1 - rest) * at(low) + rest * at(high)))
    return ranked.groupBy(*group).agg(F.array(*out).alias("quantiles"))
