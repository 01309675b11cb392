"""Sharding along a Hilbert curve: documents that are alike in several metadata dimensions get near each other.

Each dimension is quantised to a few bits, the point's index on the Hilbert curve is the sort key, and the sorted
rows are cut into runs of equal length, so that a reader that wants a box of the metadata space opens few shards.

The sort is a range shuffle on (curve index, hash of the text, id): equal texts of one cell stand together, and a
frequent text is split by its ids. Only rows equal in all three, as replication makes them, stay in one range; they
are as many as one document's repetitions. Row numbers are exact: the position inside a sorted partition plus the
rows of all partitions before it; only one count per partition comes together, never rows.

Law ``rows``: shard sizes differ by at most one row. Defined results: a null text is empty, a null dimension is
quantised to 0, null ids sort first, repeated rows each get a slot of their own, an empty table gives an empty
table, and columns whose names clash with the new ones keep theirs (the new ones get an underscore in front).
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, every, unique_name, written

BITS = 5


def category_code(c: Column, bits: int = BITS) -> Column:
    """A category's cell: its checksum modulo the number of cells; null is cell 0."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % (1 << bits), F.lit(0)).cast("int")


def size_code(c: Column, bits: int = BITS) -> Column:
    """A size's cell: its binary logarithm in half octaves, the last cell for all beyond."""
    return F.coalesce(F.least(F.floor(2 * F.log2(F.greatest(c.cast("double"), F.lit(1.0)))), F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of ``points`` (n rows, d columns of ``bits`` bits).

    The bit planes are walked from the top; in each, the orthant's Gray-code rank becomes the next d bits of the
    index, and the axes below are reflected and exchanged so that the curve of the orthant joins its neighbours'.
    """
    x = [points[:, j].astype(np.int64).copy() for j in range(points.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for j in range(len(x)):
            flip = (x[j] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[j]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[j] ^= swap
        q >>= 1
    for j in range(1, len(x)):
        x[j] ^= x[j - 1]
    carry, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        carry ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    index = np.zeros_like(carry)
    for b in range(bits - 1, -1, -1):
        for j in range(len(x)):
            index = (index << 1) | (((x[j] ^ carry) >> b) & 1)
    return index


def curve_index(codes: list[Column], bits: int = BITS) -> Column:
    @F.pandas_udf("long")
    def of(*axes: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([a.to_numpy() for a in axes], axis=1), bits))

    return of(*[c.cast("int") for c in codes])


def global_row_numbers(ordered: DataFrame, name: str, keep=written) -> tuple[DataFrame, int]:
    """Number the rows of a range-sorted table from 0; also their count. ``keep`` fixes the partitions before they are counted."""
    mark, part = unique_name(ordered, "mark"), unique_name(ordered, "part")
    # The id's upper bits are the partition, the lower 33 the row's place in it.
    fixed = keep(ordered.withColumn(mark, F.monotonically_increasing_id()))
    counts = fixed.groupBy(F.shiftright(mark, 33).alias(part)).agg(F.count(F.lit(1)).alias("rows"))
    per_part = sorted((r[0], r[1]) for r in counts.collect())  # a row for each partition
    before, total = {}, 0
    for p, n in per_part:
        before[p], total = total, total + n
    spark = ordered.sparkSession
    start = unique_name(ordered, "start_row")
    starts = spark.createDataFrame(list(before.items()), f"`{part}` long, `{start}` long")
    numbered = fixed.withColumn(part, F.shiftright(mark, 33)).join(F.broadcast(starts), part)
    place = F.col(start) + F.col(mark).bitwiseAND((1 << 33) - 1)
    return numbered.select(*every(ordered), place.alias(name)), total


def hilbert_shards(docs: DataFrame, dims: Mapping[str, Column], n_shards: int = 16, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", tie: Column | None = None, keep=written) -> DataFrame:
    """``docs`` with ``curve_index``, ``shard`` (0 to n_shards-1) and ``slot`` (0 upwards in each shard)."""
    if len(dims) * bits > 62:
        raise ValueError("the curve index must fit into 62 bits")
    index, tied, row = unique_name(docs, "curve_index"), unique_name(docs, "tie_hash"), unique_name(docs, "row_no")
    keyed = docs.withColumn(index, curve_index(list(dims.values()), bits)).withColumn(tied, tie if tie is not None else F.xxhash64(text_col))
    n = max(n_shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = keyed.repartitionByRange(n, index, tied, id_col).sortWithinPartitions(index, tied, id_col)
    numbered, total = global_row_numbers(ordered, row, keep)
    shard_col, all_rows = unique_name(docs, "shard"), max(total, 1)
    first = F.expr(f"(`{shard_col}` * {all_rows}L + {n_shards - 1}) div {n_shards}")
    placed = numbered.withColumn(shard_col, F.expr(f"`{row}` * {n_shards} div {all_rows}").cast("int"))
    return placed.withColumn(unique_name(docs, "slot"), (F.col(row) - first).cast("long")).drop(tied, row)


def document_dims(lang: str = "lang", source: str = "source", size: Column | None = None) -> dict[str, Column]:
    return {"lang": category_code(F.col(lang)), "source": category_code(F.col(source)), "size": size_code(F.length("text") if size is None else size)}


def op10_sharding(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = hilbert_shards(slim, document_dims(size=F.col("size")), tie=F.col("text_crc32"), keep=cut)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index")


def _sql(n_shards: int = 16, bits: int = BITS) -> str:
    """Checksums byte by byte over a table made by rule; the curve's steps one subquery each."""
    byte_list = "list_transform(regexp_extract_all(hex({}), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295, {}), lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])))"
    axes = [f"x{j}" for j in range(3)]
    step = "axes"
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        step = f"(SELECT * REPLACE (CASE WHEN x0 & {q} <> 0 THEN xor(x0, {low}) ELSE x0 END AS x0) FROM {step})"
        for x in axes[1:]:
            swapped = f"CASE WHEN {x} & {q} <> 0 THEN 0 ELSE xor(x0, {x}) & {low} END"
            step = f"(SELECT * REPLACE (CASE WHEN {x} & {q} <> 0 THEN xor(x0, {low}) ELSE xor(x0, {swapped}) END AS x0, xor({x}, {swapped}) AS {x}) FROM {step})"
    for before, x in zip(axes, axes[1:]):
        step = f"(SELECT * REPLACE (xor({before}, {x}) AS {x}) FROM {step})"
    carry = "0"
    for b in range(bits - 1, 0, -1):
        carry = f"xor({carry}, CASE WHEN {axes[-1]} & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    index = " + ".join(f"(((xor({x}, carry) >> {b}) & 1) << {b * len(axes) + len(axes) - 1 - j})" for b in range(bits) for j, x in enumerate(axes))
    return f"""
WITH crc_table AS MATERIALIZED (
  SELECT k, list_reduce(list_prepend(k, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS k)
), d AS (
  SELECT doc_id, {byte_list.format("encode(coalesce(text, ''))")} AS bytes, {byte_list.format("encode(lang)")} AS lang, {byte_list.format("encode(source)")} AS source, steps FROM documents, (SELECT list(v ORDER BY k) AS steps FROM crc_table)
), sums AS (
  SELECT doc_id, len(bytes) + 1 AS size, {crc.format("bytes")} AS text_crc32, coalesce({crc.format("lang")} % {1 << bits}, 0) AS x0, coalesce({crc.format("source")} % {1 << bits}, 0) AS x1 FROM d
), axes AS (SELECT *, least(CAST(floor(2 * (ln(size) / ln(2))) AS BIGINT), {(1 << bits) - 1}) AS x2 FROM sums
), carried AS (SELECT *, {carry} AS carry FROM {step}
), points AS (SELECT doc_id, size, text_crc32, CAST({index} AS BIGINT) AS curve_index FROM carried
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY curve_index, text_crc32, doc_id NULLS FIRST) - 1 AS row_no, greatest(count(*) OVER (), 1) AS n FROM points
), placed AS (SELECT *, row_no * {n_shards} // n AS shard FROM numbered)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(row_no - (shard * n + {n_shards - 1}) // {n_shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, curve_index
FROM placed
"""


OP10_SQL = _sql()
