"""Quality rules: counts of junk signs, and how far a document's make-up is from its language's.

A document's histogram of character classes and its histogram of common words are compared to the references of
its language by Jensen-Shannon distance (base 2, from 0 to 1). A language's references are the summed histograms of
all its documents that pass the base rules and the length guard. Short texts are far from any reference by chance
alone: documents of fewer than ``MIN_WORDS`` words pass this part, and above that the allowed distance falls with
the square root of the number of words to its limit.

Defined results:
* a null or empty text has no words, fails the base rules and is not kept;
* a null language is a language of its own; one without references judges by the base rules alone;
* lines count as equal only if equal as written; the first of them is no duplicate;
* texts are read whole, a very long one is measured alone;
* repeated rows are judged each on its own; an empty table gives an empty table; columns of the documents pass
  through, and new columns whose names clash get an underscore in front.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import text as tx
from millrace.llm.common import bounded, column, cut, every, map_arrow, unique_name, written

SYMBOLS = b"#*$%&|<>"
#: Length guard of the divergence rules.
MIN_WORDS = 100
#: The largest distances allowed: a limit, and what is added to it over the square root of the number of words.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = (0.15, 1.2), (0.20, 3.0)

#: The most common function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in a is that for it was with as on be by this are from at or an which not have "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans par sur au avec il "
    "el y los se del las con no una su al lo como más pero sus le ha"
).split()

#: Character classes by their first byte: small letter, capital, digit, blank, stop, other mark, symbol, control, beyond ASCII.
CLASSES = ("lower", "upper", "digit", "blank", "stop", "mark", "symbol", "control", "beyond")


def _class_of_byte() -> np.ndarray:
    out = np.full(256, CLASSES.index("mark"), dtype=np.int64)
    out[:0x20] = out[0x7F] = CLASSES.index("control")
    out[0x61:0x7B], out[0x41:0x5B], out[0x30:0x3A] = (CLASSES.index(c) for c in ("lower", "upper", "digit"))
    out[tx.BLANK] = CLASSES.index("blank")
    out[list(b".,;:")] = CLASSES.index("stop")
    out[list(SYMBOLS)] = CLASSES.index("symbol")
    out[0x80:] = CLASSES.index("beyond")
    return out


CLASS_OF_BYTE = _class_of_byte()
N_WORDS = len(dict.fromkeys(COMMON_WORDS)) + 1  # the last is every other word
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
HISTOGRAMS = ("char_hist", "word_hist")


def repeated_words(w: np.ndarray) -> int:
    """Words inside three-word windows that occur twice or more; ``w`` has the hash of every window."""
    ranked = np.sort(w)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    at = np.minimum(np.searchsorted(twice, w), len(twice) - 1)
    again, inside = twice[at] == w, np.zeros(len(w) + 2, dtype=bool)
    for k in range(3):
        inside[k : k + len(w)] |= again
    return int(np.count_nonzero(inside))


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measure_texts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts and histograms of each text of a string column, a row for each; null counts as empty."""
    vocabulary = list(dict.fromkeys(COMMON_WORDS))
    known = tx.words(pa.array([" ".join(vocabulary)])).hashes
    order = np.argsort(known)
    parts: dict[str, list[np.ndarray]] = {k: [] for k in (*COUNTS, *HISTOGRAMS)}
    for _, chunk in tx.chunks(column):
        raw, offsets = tx.utf8(chunk)
        n = len(chunk)
        exact, lowered = tx.words(chunk, lower=False), tx.words(chunk)
        triples, begins = tx.windows(exact.hashes, 3), exact.begins
        head = (raw & 0xC0) != 0x80  # a character's first byte
        doc = np.repeat(np.arange(n), np.diff(offsets))
        chars = np.bincount(doc[head] * len(CLASSES) + CLASS_OF_BYTE[raw[head]], minlength=n * len(CLASSES)).reshape(n, -1)
        at = np.minimum(np.searchsorted(known[order], lowered.hashes), len(known) - 1)
        word = np.where(known[order][at] == lowered.hashes, order[at], N_WORDS - 1)
        word_doc = np.repeat(np.arange(n), np.diff(lowered.begins))
        parts["word_hist"].append(np.bincount(word_doc * N_WORDS + word, minlength=n * N_WORDS).reshape(n, -1))
        parts["char_hist"].append(chars)
        parts["n_words"].append(np.diff(exact.begins))
        parts["word_chars"].append(chars.sum(axis=1) - chars[:, CLASSES.index("blank")])
        parts["n_symbols"].append(chars[:, CLASSES.index("symbol")])
        parts["n_dup_lines"].append(np.array([duplicate_lines(t.as_py()) for t in chunk], dtype=np.int64))
        parts["n_repeat_words"].append(np.array([repeated_words(triples[begins[t] : max(begins[t], begins[t + 1] - 2)]) for t in range(n)], dtype=np.int64))
    widths = {"char_hist": len(CLASSES), "word_hist": N_WORDS}
    return {k: np.concatenate(v) if v else np.zeros((0, widths[k]) if k in widths else 0, np.int64) for k, v in parts.items()}


def lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel(), pa.int32()))


def measured(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the counts and histograms, and what their columns are called."""
    names = {k: unique_name(docs, k) for k in (*COUNTS, *HISTOGRAMS)}
    columns = list(docs.columns)
    schema = docs.select(*every(docs), *[F.lit(0).cast("long").alias(names[k]) for k in COUNTS], *[F.array(F.lit(0)).alias(names[k]) for k in HISTOGRAMS]).schema

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measure_texts(b.column(b.schema.get_field_index(text_col)))
            new = [pa.array(m[k], pa.int64()) for k in COUNTS] + [lists(m[k].astype(np.int32)) for k in HISTOGRAMS]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*columns, *names.values()])

    return map_arrow(docs, measure, schema), names


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))


def js_distance(counts: np.ndarray, refs: pa.Array) -> np.ndarray:
    """Jensen-Shannon distance, from 0 to 1, of each row of counts to its row of reference shares; NaN where that is null."""
    out = np.full(len(counts), np.nan)
    known = np.asarray(refs.is_valid())
    if known.any():
        q = refs.flatten().to_numpy(zero_copy_only=False).reshape(int(known.sum()), -1)
        p = counts[known] / np.maximum(counts[known].sum(axis=1, keepdims=True), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = np.where(p > 0, p * np.log2(2 * p / (p + q)), 0) + np.where(q > 0, q * np.log2(2 * q / (p + q)), 0)
        out[known] = np.sqrt(np.maximum(terms.sum(axis=1) / 2, 0))
    return out


def language_references(m: DataFrame, names: dict[str, str], lang_col: str = "lang", min_words: int = MIN_WORDS) -> DataFrame:
    """(ref_lang, ref_chars, ref_words): each language's shares over all its documents that pass the base rules."""
    good = m.where(~base_failed(F.col(names["n_words"]), F.col(names["n_repeat_words"])) & (F.col(names["n_words"]) >= min_words))
    sizes = {"char_hist": len(CLASSES), "word_hist": N_WORDS}
    sums = good.groupBy(F.col(f"`{lang_col}`").alias("ref_lang")).agg(*[F.sum(F.col(names[h])[i]).alias(f"{h}_{i}") for h, k in sizes.items() for i in range(k)])
    refs = [shares(F.array(*[F.col(f"{h}_{i}") for i in range(k)])).alias(name) for (h, k), name in zip(sizes.items(), ("ref_chars", "ref_words"), strict=True)]
    return cut(sums.select("ref_lang", *refs))


def allowed(limit: tuple[float, float], n_words: Column) -> Column:
    return limit[0] + limit[1] / F.sqrt(F.greatest(n_words, F.lit(1)).cast("double"))


def verdicts(docs: DataFrame, refs: DataFrame, columns: list[str], lang_col: str = "lang", text_col: str = "text", names: dict[str, str] | None = None, min_words: int = MIN_WORDS, max_char_distance: tuple[float, float] = MAX_CHAR_DISTANCE, max_word_distance: tuple[float, float] = MAX_WORD_DISTANCE) -> DataFrame:
    """``columns`` of the documents and the counts, ``char_distance``, ``word_distance`` (null: not judged), ``base_failed`` and ``kept``.

    Documents that are measured already come with the ``names`` of their measures, others are measured on the way.
    """
    mine = {r: unique_name(docs, r) for r in refs.columns}
    refs = refs.select(*[F.col(r).alias(mine[r]) for r in refs.columns])
    joined = docs.join(bounded(refs, 10_000), column(lang_col).eqNullSafe(F.col(mine["ref_lang"])), "left")
    counts = {k: names[k] if names else unique_name(docs, k) for k in COUNTS}
    taken = docs.drop(*names.values()) if names else docs
    cd, wd, bf, kept = (unique_name(taken, c) for c in ("char_distance", "word_distance", "base_failed", "kept"))
    read = [column(c) for c in columns] + [F.col(mine[r]) for r in ("ref_chars", "ref_words")] + ([F.col(n) for n in names.values()] if names else [column(text_col)])
    given = [f"_{i}" for i in range(len(read))]
    n_kept, n_all = len(columns), len(columns) + 2

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Texts are measured a few megabytes at a time, so that memory doesn't follow the size of batches.
        for b in batches if names else (b.slice(at, len(c)) for b in batches for at, c in tx.chunks(b.column(n_all))):
            if names:
                m = {k: b.column(n_all + i) for i, k in enumerate(names)}
                m = {k: (v.flatten().to_numpy().reshape(len(v), -1) if k in HISTOGRAMS else v.to_numpy()) for k, v in m.items()}
            else:
                m = measure_texts(b.column(n_all))
            short = m["n_words"] < min_words
            far = [np.where(short, np.nan, js_distance(m[h], b.column(n_kept + i))) for i, h in enumerate(HISTOGRAMS)]
            new = [pa.array(m[k], pa.int64()) for k in COUNTS] + [pa.array(d, pa.float64(), from_pandas=True) for d in far]
            yield pa.RecordBatch.from_arrays([*b.columns[:n_kept], *new], names=[*given[:n_kept], *COUNTS, "cd", "wd"])

    flat = joined.select(*[c.alias(g) for c, g in zip(read, given, strict=True)])
    schema = flat.select(*given[:n_kept], *[F.lit(0).cast("long").alias(k) for k in COUNTS], F.lit(0.0).alias("cd"), F.lit(0.0).alias("wd")).schema
    for f in schema:
        f.nullable = True
    out = flat.mapInArrow(judge, schema).toDF(*columns, *counts.values(), cd, wd)
    n_words = F.col(counts["n_words"])
    near = (F.coalesce(F.col(cd), F.lit(0.0)) <= allowed(max_char_distance, n_words)) & (F.coalesce(F.col(wd), F.lit(0.0)) <= allowed(max_word_distance, n_words))
    failed = base_failed(n_words, F.col(counts["n_repeat_words"]))
    return out.withColumn(bf, failed).withColumn(kept, ~failed & near)


def judge_quality(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``docs`` with the verdicts; texts are measured once for the references and once more on the way."""
    slim, slim_names = measured(docs.select(column(lang_col).alias("lang"), column(text_col).alias("text")))
    return verdicts(docs, language_references(slim.drop("text"), slim_names), list(docs.columns), lang_col, text_col)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    kept = unique_name(docs, "kept")
    return judge_quality(docs).where(F.col(kept)).select(*every(docs))


def op4_quality_rules(docs: DataFrame) -> DataFrame:
    m, names = measured(docs.select("doc_id", "lang", "text"))
    m = written(m.drop("text"))  # narrow: read for the references and for the verdicts
    judged = verdicts(m, language_references(m, names), ["doc_id"], names=names)
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def _sql() -> str:
    """The counts from word and line lists; the histograms as rows of (document, bucket, count)."""
    word = r"[^\x20\x09-\x0D]+"
    classes = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "blank": r"[\x20\x09-\x0D]", "stop": "[.,;:]", "symbol": r"[#*$%&|<>]", "control": r"[\x00-\x08\x0E-\x1F\x7F]", "beyond": r"[^\x00-\x7F]"}
    counted = ", ".join(f"len(t) - len(regexp_replace(t, '{c}', '', 'g')) AS {k}" for k, c in classes.items())
    marks = f"len(t) - {' - '.join(classes)}"
    char_rows = " UNION ALL ".join(f"SELECT i, lang, 'char' AS kind, '{k}' AS bucket, {marks if k == 'mark' else k} AS n FROM chars" for k in CLASSES)
    vocabulary = ", ".join(f"'{w}'" for w in dict.fromkeys(COMMON_WORDS))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    most = {k: f"{a} + {b} / sqrt(n_words)" for k, (a, b) in (("char", MAX_CHAR_DISTANCE), ("word", MAX_WORD_DISTANCE))}
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, lang, coalesce(text, '') AS t FROM documents
), w AS MATERIALIZED (SELECT i, lang, regexp_extract_all(t, '{word}') AS w FROM d
), triples AS (
  SELECT i, p, count(*) OVER (PARTITION BY i, a, b, c) AS times
  FROM (SELECT i, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS p))
), repeats AS (
  SELECT i, count(DISTINCT p + k) AS n FROM triples, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY i
), lines AS (
  SELECT i, count(*) - count(DISTINCT line) AS n FROM (SELECT i, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{word}') GROUP BY i
), chars AS (SELECT i, lang, t, {counted} FROM d
), base AS MATERIALIZED (
  SELECT d.i, d.doc_id, d.lang, len(w.w) AS n_words, len(c.t) - c.blank AS word_chars, c.symbol AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(w.w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w.w) AS base_failed
  FROM d JOIN w USING (i) JOIN chars c USING (i) LEFT JOIN lines l USING (i) LEFT JOIN repeats r USING (i)
), hist AS MATERIALIZED (
  {char_rows}
  UNION ALL SELECT i, lang, 'word' AS kind, CASE WHEN x IN ({vocabulary}) THEN x ELSE '' END AS bucket, count(*) AS n
  FROM (SELECT i, lang, translate(unnest(w), '{upper}', '{lower}') AS x FROM w) GROUP BY ALL
), refs AS (
  SELECT lang, kind, bucket, q FROM (
    SELECT h.lang, kind, bucket, sum(h.n) / sum(sum(h.n)) OVER (PARTITION BY h.lang, kind) AS q
    FROM hist h JOIN base USING (i) WHERE NOT base_failed AND n_words >= {MIN_WORDS} GROUP BY h.lang, kind, bucket) WHERE q > 0
), wholes AS (SELECT i, kind, sum(n) AS whole FROM hist GROUP BY i, kind
), shares AS (
  SELECT h.i, h.lang, h.kind, h.bucket, n / whole AS p FROM hist h JOIN wholes USING (i, kind) JOIN base USING (i) WHERE n > 0 AND n_words >= {MIN_WORDS}
), judged AS (SELECT i, kind FROM base JOIN (SELECT DISTINCT lang, kind FROM refs) r ON base.lang IS NOT DISTINCT FROM r.lang WHERE n_words >= {MIN_WORDS}
), terms AS (
  SELECT i, s.kind, sum(CASE WHEN q IS NULL THEN p ELSE p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q)) - q END) AS x
  FROM shares s LEFT JOIN refs r ON s.lang IS NOT DISTINCT FROM r.lang AND s.kind = r.kind AND s.bucket = r.bucket GROUP BY i, s.kind
), distances AS (  -- buckets that only the reference has give its share, so all references start at 1
  SELECT i, kind, sqrt(greatest((1 + x) / 2, 0)) AS far FROM terms JOIN judged USING (i, kind)
), beside AS (
  SELECT base.*, c.far AS cd, w.far AS wd FROM base LEFT JOIN distances c ON base.i = c.i AND c.kind = 'char' LEFT JOIN distances w ON base.i = w.i AND w.kind = 'word'
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance,
  NOT base_failed AND coalesce(cd <= {most["char"]}, true) AND coalesce(wd <= {most["word"]}, true) AS kept
FROM beside
"""


OP4_SQL = _sql()
