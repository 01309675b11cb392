"""Line deduplication across documents: lines that many documents repeat are dropped (DataFrame functions only).

Lines are exploded as (document, position, hash of the normalised form), distinct documents are counted per hash,
frequent hashes are joined back, and each text is reassembled from the positions that stay, in their order.

Defined results:
* a null or empty text is one empty line; nothing is dropped from it;
* a document is a ``doc_id``: rows that repeat one count once, and lose the same lines;
* rows whose ``doc_id`` is null count for nothing and keep every line;
* texts are read whole; a very long one costs time in proportion to its length, whatever number of its lines goes;
* an empty table gives an empty table, and columns other than the id and the text pass through unchanged, whatever
  signs their names have; new columns whose names clash get an underscore in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, bounded, bounded_bytes, column, cut, every, unique_name, written

#: Characters stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_hash(line: Column, min_chars: int) -> Column:
    """128 bits of the key's hash, null for a key that is too short to count."""
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.unhex(F.md5(key)))


def long_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, text_hash, pos, line_hash): every line that is long enough to count, by its position from 0.

    Rows of equal id and text have the same lines, so the id and 64 bits of the text's hash stand for the row.
    """
    keyed = F.filter(F.transform(F.split(column(text_col), "\n"), lambda x, i: F.struct(i.alias("pos"), line_hash(x, min_chars).alias("line_hash"))), lambda x: x["line_hash"].isNotNull())
    rows = docs.where(column(id_col).isNotNull()).select(column(id_col).alias("id"), F.xxhash64(column(text_col)).alias("text_hash"), F.explode(keyed).alias("line"))
    return rows.select("id", "text_hash", "line.pos", "line.line_hash")


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(line_hash, keeper): keys in at least ``min_docs`` documents, and the largest id that holds each."""
    # Distinct documents are counted by (hash, id) first, so a line in a third of all documents is spread over the ids.
    counted = lines.groupBy("line_hash").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper"))
    return counted.where(F.col("n") >= min_docs).select("line_hash", "keeper")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``; the columns of ``docs`` stay as they are."""
    lines = written(long_lines(docs, id_col, text_col, min_chars))  # no texts
    # Small next to the texts, and read by a join of its own, so Spark can split a line that stands in every document.
    frequent = bounded(cut(frequent_lines(lines, min_docs)), 400_000)
    hits = lines.join(frequent, "line_hash").where(F.col("id") != F.col("keeper"))
    drop, key, text_hash = (unique_name(docs, n) for n in ("drop_lines", "drop_id", "drop_hash"))
    drops = cut(hits.groupBy(F.col("id").alias(key), F.col("text_hash").alias(text_hash)).agg(F.collect_set("pos").alias(drop)))
    small = bounded_bytes(drops, F.size(drop) * 4 + 100)
    joined = docs.join(small, (column(id_col) == F.col(key)) & (F.xxhash64(column(text_col)) == F.col(text_hash)), "left")
    parts = F.split(F.coalesce(column(text_col), F.lit("")), "\n")

    def reassembled(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
        kept = F.when(F.col(drop).isNull(), lines).otherwise(F.transform(stay, lambda p: F.get(lines, p)))
        return F.struct(F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))

    # The lines are split once, as the only element of an array.
    names = [unique_name(docs, n) for n in ("n_lines", "n_dropped", "kept_text")]
    done = joined.select(*every(docs), F.transform(F.array(parts), reassembled)[0].alias(drop))
    n_lines, kept = F.col(drop)["n_lines"], F.col(drop)["kept"]
    return done.select(*every(docs), n_lines.alias(names[0]), (n_lines - F.size(kept)).alias(names[1]), F.array_join(kept, "\n").alias(names[2]))


def op6_line_dedup(docs: DataFrame) -> DataFrame:
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = """
WITH lines AS (
  SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, coalesce(frequent.keeper <> doc_id, false) AS gone FROM keyed LEFT JOIN frequent USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""
