"""Model features of flows: common and native columns, targets, and preprocessing fitted on training rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.flow import finite
from millrace.operators.ranges import exact_quantiles

COMMON = ("duration", "pkts_fwd", "pkts_bwd", "bytes_fwd", "bytes_bwd")
#: Parts of names (between underscores, in any case) that mark identifiers, addresses, ports, times and labels.
ID_WORDS = (
    "ip", "ipv4", "ipv6", "addr", "mac", "oui", "host", "hostname", "port", "sport", "dport", "time", "first", "last", "start", "end", "stime", "ltime", "timestamp",
    "id", "flowind", "flow_id", "uid", "vlan", "tunnel", "label", "src", "dst", "saddr", "daddr",
)
ID_LIKE = re.compile(f"(^|_)({'|'.join(ID_WORDS)})($|_)", re.I)


def common_features(flows: DataFrame, keep: Sequence[str] = (), with_port: bool = False) -> DataFrame:
    """Five core columns, totals (null counts as 0 in sums only), protocol indicators."""
    zero = F.lit(0)
    out = [F.col(c).cast("double").alias(c) for c in COMMON]
    out += [(F.coalesce("pkts_fwd", zero) + F.coalesce("pkts_bwd", zero)).cast("double").alias("tot_pkts"), (F.coalesce("bytes_fwd", zero) + F.coalesce("bytes_bwd", zero)).cast("double").alias("tot_bytes")]
    out += [F.coalesce((F.col("proto") == n).cast("double"), F.lit(0.0)).alias(name) for name, n in (("is_tcp", 6), ("is_udp", 17))]
    out += [F.col("dst_port").cast("double").alias("dst_port")] if with_port else []
    return flows.select(*keep, *out)


def native_columns(flows: DataFrame, prefix: str = "tool_", least_numeric: float = 0.5) -> list[str]:
    """Native columns that are no identifiers, numeric in half of the rows and not constant; one pass over all rows."""
    names = [f.name for f in flows.schema if f.name.startswith(prefix) and not ID_LIKE.search(f.name[len(prefix) :]) and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    if not names:
        return []
    number = {c: finite(F.col(f"`{c}`").try_cast("double")) for c in names}
    row = flows.agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{k}_{i}") for i, x in enumerate(number.values()) for k, f in (("c", F.count), ("lo", F.min), ("hi", F.max))]).first()
    return [c for i, c in enumerate(names) if row[f"c_{i}"] >= least_numeric * row["n"] and row[f"c_{i}"] and row[f"lo_{i}"] != row[f"hi_{i}"]]


def feature_frame(flows: DataFrame, regime: str, keep: Sequence[str] = ()) -> DataFrame:
    """``common`` or ``native`` features; native falls back to common if nothing is left."""
    names = native_columns(flows) if regime == "native" else []
    return flows.select(*keep, *[F.col(c).try_cast("double").alias(c) for c in names]) if names else common_features(flows, keep)


def target(task: str, label: str = "label"):
    """BENIGN or ATTACK for ``binary``, the class for ``multiclass``; null is BENIGN."""
    c = F.coalesce(label, F.lit("BENIGN"))
    return F.when(c == "BENIGN", "BENIGN").otherwise("ATTACK") if task == "binary" else c


def preprocessing(train: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> dict[str, tuple[float, float, float, float, float]]:
    """(median, low, high, mean, population deviation) of each column of the training rows.

    Exact percentiles with linear interpolation; means are those of imputed, clipped values. Columns without any
    finite value are left out.
    """
    clean = train.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns])
    long = clean.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("x")) for i, c in enumerate(columns)])).alias("v")).select("v.*") if columns else None
    at = {r.i: r.quantiles for r in exact_quantiles(long, ["i"], "x", [low, 0.5, high]).collect()} if columns else {}  # a row for each column
    some = {c: at[i] for i, c in enumerate(columns) if i in at}
    if not some:
        return {}
    filled = clean.select(*[F.least(F.greatest(F.coalesce(c, F.lit(v[1])), F.lit(v[0])), F.lit(v[2])).alias(c) for c, v in some.items()])
    m = filled.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(some) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (v[1], v[0], v[2], m[f"m{i}"], m[f"s{i}"]) for i, (c, v) in enumerate(some.items())}


def preprocess(df: DataFrame, fitted: dict, keep: Sequence[str] = ()) -> DataFrame:
    """M1: impute, clip and standardise by the fitted figures; constant columns become 0."""
    out = []
    for c, (median, lo, hi, mean, std) in fitted.items():
        x = F.least(F.greatest(F.coalesce(finite(F.col(c).cast("double")), F.lit(median)), F.lit(lo)), F.lit(hi))
        out.append(((x - mean) / (std or 1.0)).alias(c))
    return df.select(*keep, *out)
