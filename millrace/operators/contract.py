"""The canonical flow table: its columns, coercion into it, validation, and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.flow import FLAGS, finite, protocol_number

_CORE = [("src_ip", "string"), ("src_port", "int"), ("dst_ip", "string"), ("dst_port", "int"), ("proto", "smallint")]
_CORE += [(c, "double") for c in ("t_start", "t_end", "duration")]
_CORE += [(c, "bigint") for c in ("pkts_fwd", "pkts_bwd", "bytes_fwd", "bytes_bwd")]
_CORE += [(f"{f}_{d}", "bigint") for f in FLAGS for d in ("fwd", "bwd")]
_CORE += [(c, "string") for c in ("tool", "dataset", "capture", "flow_id")]
CORE = dict(_CORE)
COUNTS = [c for c, t in CORE.items() if t == "bigint"]
NATIVE = "tool_"


def core_schema() -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in CORE.items()))


def empty_flows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], core_schema())


def prefix_native(df: DataFrame, prefix: str = NATIVE) -> DataFrame:
    """Columns outside the contract get the native prefix, once."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in CORE and not c.startswith(prefix)})


def coerce(df: DataFrame) -> DataFrame:
    """Core columns first, cast or added as null, then native ones; other columns are an error."""
    foreign = [c for c in df.columns if c not in CORE and not c.startswith(NATIVE)]
    if foreign:
        raise ValueError(f"columns outside the contract: {foreign}")

    def cast(c: str, t: str):
        if c not in df.columns:
            return F.lit(None).cast(t).alias(c)
        if c == "proto":
            return protocol_number(F.col(c)).alias(c)
        as_number = F.col(c).try_cast("double") if t != "string" else F.col(c)
        return (finite(as_number).try_cast(t) if t != "string" else as_number.cast(t)).alias(c)

    tail = [F.col(c) if not isinstance(df.schema[c].dataType, T.NullType) else F.col(c).cast("string").alias(c) for c in df.columns if c not in CORE]
    return df.select(*[cast(c, t) for c, t in CORE.items()], *tail)


def row_rules() -> dict[str, Column]:
    """V1: what a row may break; null counts as not broken."""
    total = F.coalesce("pkts_fwd", F.lit(0)) + F.coalesce("pkts_bwd", F.lit(0))
    rules = {
        "reversed time": F.col("t_end") < F.col("t_start"),
        "duration differs": F.abs(F.col("duration") - (F.col("t_end") - F.col("t_start"))) > 1e-3,
        "no packets": total <= 0,
        "no address": F.col("src_ip").isNull() | F.col("dst_ip").isNull(),
    } | {f"negative {c}": F.col(c) < 0 for c in COUNTS}
    return {k: F.coalesce(r, F.lit(False)) for k, r in rules.items()}


def problems(df: DataFrame) -> DataFrame:
    """V1: (problem, n) for every rule of the contract that rows break, in one pass."""
    rules = row_rules()
    counted = df.agg(*[F.count_if(r).alias(k) for k, r in rules.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("problem"), F.col(f"`{k}`").alias("n")) for k in rules]))
    return counted.select(rows.alias("r")).select("r.*").where("n > 0")


def validate(df: DataFrame) -> None:
    missing = [c for c in CORE if c not in df.columns]
    found = [] if missing else [f"{r['problem']}: {r['n']}" for r in problems(df).collect()]
    if missing or found:
        raise ValueError(f"missing columns: {missing}; {', '.join(found)}")


def write_flows(df: DataFrame, path: str, mode: str = "append") -> None:
    """K1: coerce, validate, write by dataset, tool and capture; ``overwrite`` replaces only the partitions it has."""
    flows = coerce(df)
    validate(flows)
    flows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "tool", "capture").parquet(path)
