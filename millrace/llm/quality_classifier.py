"""Quality classifier without hand-made labels: heuristic labellers, expectation-maximisation, a hashed linear scorer.

Seven labellers vote good (1), bad (-1) or nothing (0) on each document. All documents count: Spark counts the vote
patterns, of which there are at most 3**7, and expectation-maximisation over that table estimates each labeller's
accuracy in good and bad documents. A logistic scorer over hashed words and word shapes is fitted to the posteriors
of a bounded sample and scores every document. The sample has the ``FIT_ROWS`` distinct rows (id and text) of the
smallest hashes, or all if there are fewer, each weighted by how often it stands in the table.

Defined results: a document without words has quality 0 and is not kept; null text counts as empty; repeated rows
score equally; texts are read whole, and a very long one is worked on alone; an empty table gives an empty table;
columns of the documents pass through, new names that clash get an underscore in front.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import quality_rules as qr
from millrace.llm import text as tx
from millrace.llm.common import column, map_arrow, unique_name, written

#: Distinct rows that the scorer is fitted to at most.
FIT_ROWS = 10_000
WORD_BUCKETS = 4096
SHAPES = 1 << len(qr.CLASSES)
#: Hashed words, word shapes, and the shares of repeated windows and of words that follow themselves.
N_FEATURES = WORD_BUCKETS + SHAPES + 2
KEEP_FROM = 0.5
LABELLERS = ("symbols", "capitals", "repeats", "common_words", "word_length", "duplicate_lines", "length")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(names: dict[str, str]) -> list[Column]:
    """The labellers' votes on measured documents, in the order of ``LABELLERS``."""
    n = F.greatest(F.col(names["n_words"]), F.lit(1))
    chars, words = F.col(names["char_hist"]), F.col(names["word_hist"])
    at = {c: chars[i] for i, c in enumerate(qr.CLASSES)}
    letters = F.greatest(at["lower"] + at["upper"], F.lit(1))
    common = 1 - words[qr.N_WORDS - 1] / n
    length = F.col(names["word_chars"]) / n
    return [
        _vote(F.col(names["n_symbols"]) > 0.1 * n, F.col(names["n_symbols"]) <= 0.02 * n),
        _vote(at["upper"] > 0.3 * letters, at["upper"] < 0.1 * letters),
        _vote(F.col(names["n_repeat_words"]) > 0.4 * n, F.col(names["n_repeat_words"]) < 0.15 * n),
        _vote(common < 0.1, common > 0.2),
        _vote((length < 2.5) | (length > 14), length.between(3.5, 9)),
        _vote(F.col(names["n_dup_lines"]) > 0.03 * n, F.col(names["n_dup_lines"]) == 0),
        _vote(F.col(names["n_words"]) < 20, F.col(names["n_words"]) > 100),
    ]


def estimate(patterns: np.ndarray, counts: np.ndarray, iterations: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each pattern, reliability[labeller, class, vote]) by expectation-maximisation."""
    p = (np.sum(patterns > 0, axis=1) + 1.0) / (np.sum(patterns != 0, axis=1) + 2.0)
    table = np.zeros((patterns.shape[1], 2, 3))
    for _ in range(iterations):
        mass = np.stack([counts * (1 - p), counts * p])
        prior = (mass.sum(axis=1) + 1) / (mass.sum() + 2)
        score = np.log(prior)[:, None] + np.zeros((2, len(counts)))
        for j in range(patterns.shape[1]):
            for c in range(2):
                table[j, c] = np.bincount(patterns[:, j] + 1, weights=mass[c], minlength=3) + 1
                table[j, c] /= table[j, c].sum()
                score[c] += np.log(table[j, c])[patterns[:, j] + 1]
        p = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
    return p, table


def features(chunk: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) triples of a string column without nulls, and the number of words of each document."""
    raw, offsets = tx.utf8(chunk)
    w = tx.words(chunk)
    exact = tx.words(chunk, lower=False)
    n = np.diff(w.begins)
    doc = np.repeat(np.arange(len(chunk)), n)
    share = 1.0 / np.maximum(n, 1)
    starts, ends = tx.word_bounds(raw, offsets)
    # A word's shape is the set of its character classes.
    bits = np.concatenate([[0], (1 << qr.CLASS_OF_BYTE[raw])])
    edges = np.stack([starts + 1, ends + 1], axis=1).ravel()
    padded = np.concatenate([bits, [0]])
    shape = np.bitwise_or.reduceat(padded, edges)[::2] if len(starts) else np.zeros(0, np.int64)
    again = np.zeros(len(chunk))
    if len(w.hashes) > 1:
        same = (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1])
        again = np.bincount(doc[1:][same], minlength=len(chunk)) * share
    triples = tx.windows(exact.hashes, 3)
    repeated = np.array([qr.repeated_words(triples[a : max(a, b - 2)]) for a, b in zip(exact.begins[:-1], exact.begins[1:], strict=True)]) * share if len(chunk) else again
    docs = np.concatenate([doc, doc, np.arange(len(chunk)), np.arange(len(chunk))])
    which = np.concatenate([(w.hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), WORD_BUCKETS + shape, np.full(len(chunk), N_FEATURES - 2), np.full(len(chunk), N_FEATURES - 1)])
    return docs, which, np.concatenate([share[doc], share[doc], repeated, again]), n


def fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, target: np.ndarray, times: np.ndarray, steps: int = 200, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on sparse rows, each counted ``times``, by Adagrad over all rows; the last weight is the bias."""
    w, seen = np.zeros(N_FEATURES + 1), np.full(N_FEATURES + 1, 1e-8)
    for _ in range(steps):
        z = np.bincount(rows, weights=w[cols] * values, minlength=len(target)) + w[-1]
        off = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) * times
        g = np.append(np.bincount(cols, weights=off[rows] * values, minlength=N_FEATURES), off.sum()) / times.sum() + ridge * np.append(w[:-1], 0)
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Weights of the scorer, from the votes on all documents and the sample."""
    slim = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    row_hash = F.xxhash64("doc_id", "text")
    m, names = qr.measured(slim.withColumn("row_hash", row_hash))
    voted = written(m.select("row_hash", *[v.alias(k) for v, k in zip(votes(names), LABELLERS, strict=True)]))  # no texts
    seen = voted.groupBy(*LABELLERS).agg(F.count(F.lit(1)).alias("n")).collect()  # 3**7 rows at most
    if not seen:
        return np.zeros(N_FEATURES + 1)
    patterns, counts = np.array([r[:-1] for r in seen]), np.array([r[-1] for r in seen], dtype=float)
    posterior, _ = estimate(patterns, counts)
    truth = {tuple(p): float(x) for p, x in zip(patterns.tolist(), posterior, strict=True)}

    last = voted.select("row_hash").distinct().orderBy("row_hash").limit(fit_rows).agg(F.max("row_hash")).first()[0]
    chosen = slim.where(row_hash <= last).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("times")).drop("doc_id")
    m, names = qr.measured(chosen)
    labelled = m.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), "times", *[v.alias(k) for v, k in zip(votes(names), LABELLERS, strict=True)])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = list(zip(*[b.column(i + 2).to_pylist() for i in range(len(LABELLERS))], strict=True))
            for row, chunk in tx.chunks(b.column(0)):
                d, which, value, _ = features(chunk)
                key, at = np.unique(d * N_FEATURES + which, return_inverse=True)
                total = np.bincount(at, weights=value)
                begins = np.searchsorted(key // N_FEATURES, np.arange(len(chunk) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(begins), pa.array(x)) for x in ((key % N_FEATURES).astype(np.int32), total.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([truth[v] for v in given[row : row + len(chunk)]]), b.column(1).slice(row, len(chunk))], names=["cols", "vals", "p", "times"])

    sample = labelled.mapInArrow(sparse, "cols array<int>, vals array<float>, p double, times long").toArrow()  # fit_rows rows at most
    cols, vals = (sample.column(k).combine_chunks() for k in ("cols", "vals"))
    lengths = np.array([len(x) for x in cols], dtype=np.int64)
    return fit(np.repeat(np.arange(len(cols)), lengths), cols.flatten().to_numpy().astype(np.int64), vals.flatten().to_numpy().astype(float), sample.column("p").to_numpy(), sample.column("times").to_numpy().astype(float))


def score_quality(docs: DataFrame, weights: np.ndarray, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` with ``quality`` (0 to 1) and ``kept``."""
    quality, kept = unique_name(docs, "quality"), unique_name(docs, "kept")
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    columns = list(docs.columns)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            out = []
            for _, chunk in tx.chunks(b.column(b.schema.get_field_index(text_col))):
                d, which, value, n = features(chunk)
                z = np.bincount(d, weights=w[which] * value, minlength=len(chunk)) + w[-1]
                out.append(np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0))
            q = np.round(np.concatenate(out), 6) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(q), pa.array(q >= keep_from)], names=[*columns, quality, kept])

    schema = docs.select(*[F.col(f"`{c}`") for c in columns], F.lit(0.0).alias(quality), F.lit(True).alias(kept)).schema
    return map_arrow(docs, score, schema)


def op7_quality_classifier(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text")
    return score_quality(slim, train(slim)).select("doc_id", "quality", "kept")
