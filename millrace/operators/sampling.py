"""Splits and samples that depend on row ids and a seed alone, so every run and partitioning picks the same rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Hashes lie from 0 to this, exclusive.
HASHES = 1 << 32


def order_hash(id_col: str, seed: int) -> Column:
    """A hash of an id of any type that any SQL engine can make: the first 32 bits of the MD5 of ``seed:id`` as text; null ids count as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def ranked(df: DataFrame, by: list[str], id_col: str, seed: int, name: str = "rn") -> DataFrame:
    """Rows of a class numbered in hash order; with a filter on small numbers Spark keeps only those of each partition before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(order_hash(id_col, seed), id_col)))


def first_of_class(df: DataFrame, by: list[str], id_col: str, seed: int, quota: Column, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: is the row among the first ``quota`` rows of its class in hash order?

    ``quota`` is an expression over the class's columns and ``_n``, its number of rows. Hashes are counted in 4,096
    ranges; the ranges before a class's last one are in as a whole, and only rows of that one are numbered, so no task
    sorts a class.
    """
    keyed = df.withColumn("_range", F.shiftright(order_hash(id_col, seed), 20))
    counts = keyed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    so_far = counts.withColumn("_upto", F.sum("_rows").over(W.partitionBy(*by).orderBy("_range"))).withColumn("_n", F.sum("_rows").over(W.partitionBy(*by))).withColumn("_quota", quota)
    inside = F.max(F.when(F.col("_upto") <= F.col("_quota"), F.col("_range")))
    last = so_far.groupBy(*by, "_quota").agg(F.coalesce(inside, F.lit(-1)).alias("_in"), F.min(F.when(F.col("_upto") > F.col("_quota"), F.struct("_range", (F.col("_quota") - F.col("_upto") + F.col("_rows")).alias("room")))).alias("_edge"))
    last = last.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_in", F.col("_edge._range").alias("_edge"), F.col("_edge.room").alias("_room"))
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    placed = keyed.join(last, on)
    edge = F.col("_range") == F.col("_edge")
    rest = placed.where(~F.coalesce(edge, F.lit(False))).withColumn(name, F.col("_range") <= F.col("_in"))
    cut = placed.where(edge).withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(order_hash(id_col, seed), id_col)) <= F.col("_room"))
    return rest.unionByName(cut).select(*df.columns, name)


def temporal_split(df: DataFrame, captures: DataFrame) -> DataFrame:
    """Train or test by capture, from (capture, split); other captures drop out."""
    return df.join(F.broadcast(captures.select("capture", "split")), "capture")


def stratified_split(df: DataFrame, label: str, id_col: str, seed: int = 0, train: float = 0.7) -> DataFrame:
    """A share of each class to train; classes of one row go to train."""
    quota = F.when(F.col("_n") < 2, F.col("_n")).otherwise(F.round(train * F.col("_n")).cast("long"))
    marked = first_of_class(df, [label], id_col, seed, quota, "_in_train")
    return marked.withColumn("split", F.when(F.col("_in_train"), "train").otherwise("test")).drop("_in_train")


def cap_rows(df: DataFrame, label: str, id_col: str, most: int, seed: int = 0) -> DataFrame:
    """At most about ``most`` rows, in proportion to classes; a class keeps one row at least."""
    total = df.where(F.col(label).isNotNull()).count()
    quota = F.col("_n") if total <= most else F.greatest(F.lit(1), F.floor(F.col("_n") * most / F.lit(total)))
    return first_of_class(df.where(F.col(label).isNotNull()), [label], id_col, seed, quota.cast("long"), "_taken").where("_taken").drop("_taken")


def down_sample(df: DataFrame, label: str, value: str, share: float, id_col: str, seed: int = 0) -> DataFrame:
    """Keep a share of the rows of one class and all of the others."""
    return df.where((F.col(label) != value) | (order_hash(id_col, seed) < int(share * HASHES)))


def class_caps(df: DataFrame, label: str, id_col: str, caps: Mapping[str, int], by: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """At most ``caps[class]`` rows of a class in each group; classes without a cap stay whole."""
    cap = F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col(label).cast("string"))
    taken = first_of_class(df.where(cap.isNotNull()), [*by, label], id_col, seed, cap.cast("long"), "_taken").where("_taken").drop("_taken")
    return taken.unionByName(df.where(cap.isNull()))


def k_shot(df: DataFrame, label: str, id_col: str, k: int, repeat: int = 0) -> DataFrame:
    """K rows of each class, seeded by 1000 k + repeat."""
    return ranked(df, [label], id_col, 1000 * k + repeat, "_rn").where(F.col("_rn") <= k).drop("_rn")


def uniform_cap(df: DataFrame, id_col: str, most: int, seed: int = 0) -> DataFrame:
    """``most`` rows by hash order."""
    return df.orderBy(order_hash(id_col, seed), id_col).limit(most)


def aligned_pick(tables: Mapping[str, DataFrame], label: str, id_col: str, per_class: int, seed: int = 0) -> dict[str, DataFrame]:
    """The same rows of each class from every representation: ids that all of them have."""
    shared = None
    for t in tables.values():
        ids = t.select(id_col, label)
        shared = ids if shared is None else shared.join(ids.select(id_col), id_col, "left_semi")
    picked = ranked(shared, [label], id_col, seed, "_rn").where(F.col("_rn") <= per_class).select(id_col)
    return {k: t.join(picked, id_col, "left_semi") for k, t in tables.items()}
