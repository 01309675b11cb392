"""Helpers that every operator of this package shares: reading tables, cutting lineage, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows that a table may have at most to be broadcast: 2 million rows of a few longs, under 100 MB in memory.
BROADCAST_ROWS = 2_000_000
#: Bytes that a table of uneven rows may have at most to be broadcast.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``; where it is unset a new temporary one, on a local master only."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return folder or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of a narrow table: its lineage ends at files in the shared folder, so a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like ``cut`` for wide tables: compressed Parquet in the shared folder, read back."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialised table for broadcast if it has few enough rows; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded_bytes(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Like ``bounded`` for rows of uneven size: ``size`` gives the bytes of a row."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def unique_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (column names ignore case in Spark)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def column(name: str) -> Column:
    """The column of that name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def every(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever signs their names have."""
    return [column(c) for c in df.columns]


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow``, which takes dots in names for fields: such columns come in under other names and go out under those of ``schema``."""
    names = [unique_name(df, f"column_{i}") if set(c) & set(".`") else c for i, c in enumerate(df.columns)]
    return df.toDF(*names).mapInArrow(function, schema)

