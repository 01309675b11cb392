"""Benchmark decontamination by Wu-Manber search for many word patterns at once.

Texts are lower-cased (A-Z) and read as words of digits, letters and non-ASCII characters. The patterns are all
windows of ten words of each benchmark item (an item of fewer words is one pattern). Wu-Manber runs on words as its
alphabet: a shift table over blocks of two words says how far the search may skip, a block that ends a pattern
selects a bucket, buckets are split by the pattern's first word, and direct comparison confirms. Patterns
shorter than ten words make a search of their own per length, as the shortest pattern bounds the skips.

Benchmark items are broadcast in blocks of at most ``BLOCK_WINDOWS`` windows, and a worker builds a block's tables
once (about 100 MB for a full block); a benchmark of more makes further passes over the documents, each cut off from
the one before, so neither broadcast nor tables grow with the benchmark. A single item of more windows than that is a
block of its own.

Defined results: texts are read whole, a document's words are held for one document at a time; a null or empty text
has no words and is clean; an item without words matches nothing; an item
with a null id marks words but is in no list; equal items (or repeated item rows) each count by their id; an empty
benchmark leaves every document clean; columns of the documents pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import every, map_arrow, unique_name, written

WINDOW = 10
BLOCK_WINDOWS = 200_000
#: Lower-cases A-Z and turns all other ASCII characters but digits and letters into blanks.
TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split() if text else []


def windows(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    if len(words) < width:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


class WuManber:
    """Search tables for patterns of one length: tuples of words, each with the ids of its items."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length = m = len(next(iter(patterns)))
        self.block = b = min(2, m)
        self.skip = m - b + 1  # for a block that is in no pattern
        self.shift: dict = {}
        self.buckets: dict = {}
        for p, ids in patterns.items():
            for end in range(b, m + 1):
                key = p[end - b : end]
                if m - end < self.shift.get(key, self.skip):
                    self.shift[key] = m - end
            self.buckets.setdefault((*p[m - b :], p[0]), []).append((p, ids))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(first word, item ids) of every occurrence."""
        m, b, skip, shift, buckets = self.length, self.block, self.skip, self.shift, self.buckets
        at, n = m - 1, len(words)  # the window's last word
        while at < n:
            block = (words[at - 1], words[at]) if b == 2 else (words[at],)
            by = shift.get(block, skip)
            if by:
                at += by
                continue
            first = at - m + 1
            for pattern, ids in buckets.get((*block, words[first]), ()):
                if tuple(words[first : at + 1]) == pattern:
                    yield first, ids
            at += 1


def build(rows: list[tuple[str | None, str | None]], width: int = WINDOW) -> list[WuManber]:
    """One searcher for each pattern length of (item id, text) rows."""
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, text in rows:
        for w in set(windows(split_words(text), width)):
            by_length.setdefault(len(w), {}).setdefault(w, []).extend([] if item is None else [item])
    return [WuManber(p) for p in by_length.values()]


_built: tuple[list, list[WuManber]] = ([], [])


def built(rows: list[tuple[str | None, str | None]]) -> list[WuManber]:
    """The searchers of a broadcast block; a worker that runs several tasks builds them once."""
    global _built
    if _built[0] is not rows:
        _built = (rows, build(rows))
    return _built[1]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_windows: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Benchmark rows in runs of at most ``block_windows`` windows; a longer item makes a run of its own."""
    rows, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        n = max(1, len(split_words(r[1])) - WINDOW + 1)
        if rows and size + n > block_windows:
            yield rows
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += n
    yield rows


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word ranges, end exclusive, merged) and ``hit_items`` (sorted ids)."""
    n_words, spans_col, items_col = (unique_name(docs, n) for n in ("n_words", "hit_spans", "hit_items"))
    spark = docs.sparkSession
    out, first = docs, True
    span_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    schema = None
    for rows in _blocks(benchmark, item_id, item_text, block_windows):
        tables = spark.sparkContext.broadcast(rows)

        def scan(batches: Iterator[pa.RecordBatch], tables=tables, first=first) -> Iterator[pa.RecordBatch]:
            searchers = built(tables.value)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                ns, all_spans, all_items = [], [], []
                before = ([], []) if first else (batch.column(spans_col), batch.column(items_col))
                for i in range(len(texts)):
                    words = split_words(texts[i].as_py())
                    spans = [] if first else [(s["a"], s["b"]) for s in before[0][i].as_py()]
                    items = set() if first else set(before[1][i].as_py())
                    for s in searchers:
                        for at, ids in s.search(words):
                            spans.append((at, at + s.length))
                            items.update(ids)
                    ns.append(len(words))
                    all_spans.append([{"a": a, "b": b} for a, b in merged(spans)])
                    all_items.append(sorted(items))
                kept = [batch.column(i) for i in range(batch.num_columns)][: len(docs_columns)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(ns, pa.int64()), pa.array(all_spans, span_type), pa.array(all_items, pa.list_(pa.string()))], names=[*docs_columns, n_words, spans_col, items_col])

        docs_columns = list(docs.columns)
        if schema is None:
            schema = docs.select(*every(docs), F.lit(0).cast("long").alias(n_words), F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))).alias(spans_col), F.array(F.lit("")).alias(items_col)).schema
        out = map_arrow(out if first else written(out), scan, schema)
        first = False
    return out


def n_hit(spans: str = "hit_spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs, with the columns of ``docs``."""
    marked = mark_contamination(docs, benchmark)
    return marked.where(F.size(unique_name(docs, "hit_spans")) == 0).select(*every(docs))


def op3_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    marked = mark_contamination(docs.select("doc_id", "text"), benchmark)
    hit = n_hit()
    return marked.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), pat AS (
  SELECT DISTINCT item_id, list_aggregate(w[i : i + least(10, len(w)) - 1], 'string_agg', ' ') AS p, least(10, len(w)) AS m
  FROM b, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i) WHERE len(w) > 0
), lens AS (SELECT DISTINCT m FROM pat
), win AS (
  SELECT r, i, m, list_aggregate(w[i : i + m - 1], 'string_agg', ' ') AS p FROM d, lens, LATERAL (SELECT unnest(range(1, greatest(0, len(w) - m + 1) + 1)) AS i)
), hits AS (SELECT r, i, win.m, item_id FROM win JOIN pat ON win.p = pat.p AND win.m = pat.m
), covered AS (
  SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS x FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
