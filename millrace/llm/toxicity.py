"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled, noisy-or joins the two.

A sentence has the probability 1 / (1 + exp(-z)) of being toxic, where z is a bias and the weights of its words' features
(a word as a whole and its first 3 to 6 letters, lower-cased); a document is toxic unless none of its sentences is:
1 - product of (1 - p). Weights are fitted to document labels alone, so that blame falls on the sentences that tell toxic
documents from others, and these are then located in every text.

Training reads at most ``FIT_ROWS`` labelled rows of each label, those of the smallest hashes of id and text (all, if
there are fewer). Spark counts in how many of them each feature stands; the ``FEATURES`` features that tell most about
the label go to the driver with the sentences that have one. Every document is scored.

Defined results: a null or empty text, or one without letters, scores 0. Sentences end at ``.``, ``!``, ``?`` or a line
break. Rows of documents with equal texts score equally, whatever their ids; a null id is never trained on. An id with two
labels counts as toxic; labels other than 0 and 1, null ones and null ids are left out. Without labels of both kinds all
scores are 0. Texts are read whole, a few megabytes at a time. An empty table gives an empty table. Columns of the
documents pass through; new names that clash get an underscore in front.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import text as tx
from millrace.llm.common import column, map_arrow, unique_name, written

#: Labelled rows of each label that the model is fitted to at most.
FIT_ROWS = 5_000
#: Features that have a weight at most, and rows of the sample in which one of them stands at least.
FEATURES = 1_024
MIN_ROWS = 3
#: Gain in log likelihood that a feature's presence gives at least: chance gives that to one feature in 15,000.
MIN_GAIN = 8.0
TOXIC_FROM = 0.5
#: Words whose weight a worker remembers at most before it starts anew.
REMEMBERED = 1 << 20
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
SPANS = "array<struct<start: bigint, end: bigint, score: double>>"


def word_features(word: str) -> list[str]:
    """The whole word, marked by a blank behind it, and its beginnings."""
    return [word + " ", *[word[:k] for k in range(3, 7) if len(word) >= k]]


@dataclass
class Model:
    """Weights by feature and the bias; without weights nothing is toxic."""

    weights: dict[str, float]
    bias: float

    def sentence_scores(self, text: str, known: dict[str, float]) -> list[tuple[int, int, float]]:
        """(start, end, z) of each sentence with words; ``known`` remembers words' weights from call to call."""
        out = []
        for m in SENTENCE.finditer(text):
            z, some = self.bias, False
            for w in WORD.findall(m[0].lower()):
                some = True
                x = known.get(w)
                if x is None:
                    x = known[w] = sum(self.weights.get(f, 0.0) for f in word_features(w))
                z += x
            if some:
                out.append((m.start(), m.end(), z))
        if len(known) > REMEMBERED:
            known.clear()
        return out


def noisy_or(z: np.ndarray, doc: np.ndarray, times: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Log of the probability that no sentence of a document is toxic, and each sentence's own probability."""
    return -np.bincount(doc, weights=times * np.logaddexp(0, z), minlength=docs), 1 / (1 + np.exp(-z))


def fit(rows: np.ndarray, cols: np.ndarray, doc: np.ndarray, blank: np.ndarray, toxic: np.ndarray, weight: np.ndarray, start: np.ndarray, steps: int = 400, rate: float = 0.3, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the largest penalised likelihood, by Adagrad over the whole sample.

    ``rows``, ``cols``: features of sentences; ``doc``: the document of each sentence with features; ``blank``: each
    document's number of sentences without; ``weight``: how much a document counts; ``start``: the weights to begin with.
    """
    docs, sentences, n_features = len(toxic), len(doc), len(start)
    owner = np.concatenate([doc, np.arange(docs)])  # a document's blank sentences are one that counts so many times
    times = np.concatenate([np.ones(sentences), blank])
    w, bias, seen = start.copy(), -6.0, np.full(n_features + 1, 1e-8)
    for _ in range(steps):
        z = np.concatenate([np.bincount(rows, weights=w[cols], minlength=sentences), np.zeros(docs)]) + bias
        log_clean, p = noisy_or(z, owner, times, docs)
        clean = np.exp(log_clean)
        # The slope of the loss by z: p for a clean document, -p * clean / (1 - clean) for a toxic one.
        slope = np.where(toxic, -clean / np.maximum(1 - clean, 1e-12), 1.0) * weight
        g = slope[owner] * p * times / weight.sum()
        step = np.append(np.bincount(cols, weights=g[:sentences][rows], minlength=n_features) + ridge * (w - start), g.sum())
        seen += step * step
        move = rate * step / np.sqrt(seen)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


def held_out(id_col: str) -> Column:
    """Every fifth id by the CRC-32 of its decimal digits; false for null."""
    return F.coalesce(F.crc32(column(id_col).cast("string")) % 5 == 0, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, fit_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of the sample and the number of distinct labelled rows of each label; documents are (doc_id, text)."""
    row = F.xxhash64("doc_id", "text")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marked = written(docs.select("doc_id", row.alias("row")).join(known, "doc_id").select("row", "toxic").distinct())
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [marked.where(F.col("toxic") == t).orderBy("row").limit(fit_rows) for t in (0, 1)]
    chosen = parts[0].union(parts[1])  # 2 * fit_rows rows at most
    return written(docs.withColumn("row", row).join(F.broadcast(chosen), "row").dropDuplicates(["row"]).select("text", "toxic")), counts


def informative(sample: DataFrame, sizes: dict[int, int], features: int, min_rows: int, min_gain: float = MIN_GAIN) -> dict[str, float]:
    """The features whose presence tells most about the label, by the likelihood ratio of their table with it, and their log odds."""

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[t].update({f for w in set(WORD.findall((text or "").lower())) for f in word_features(w)})
            for t, counter in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(counter), pa.string()), pa.array([t] * len(counter), pa.int32()), pa.array(list(counter.values()), pa.int64())], names=["feature", "toxic", "n"])

    counts = sample.mapInArrow(presence, "feature string, toxic int, n long").groupBy("feature").agg(*[F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)).alias(f"n{t}") for t in (0, 1)])
    total = sizes[0] + sizes[1]

    def cell(k: Column, of: int, rows: Column) -> Column:
        return F.when(k > 0, k * F.log(k * total / (rows * of))).otherwise(0.0)

    n0, n1 = F.col("n0"), F.col("n1")
    here, away = n0 + n1, total - n0 - n1
    gain = cell(n0, sizes[0], here) + cell(n1, sizes[1], here) + cell(sizes[0] - n0, sizes[0], away) + cell(sizes[1] - n1, sizes[1], away)
    odds = F.log((n1 + 0.5) / (sizes[1] + 1.0)) - F.log((n0 + 0.5) / (sizes[0] + 1.0))
    chosen = counts.withColumn("gain", F.round(gain, 9)).where((here >= min_rows) & (F.col("gain") >= min_gain))
    return {r["feature"]: r["odds"] for r in chosen.orderBy(F.desc("gain"), "feature").limit(features).select("feature", odds.alias("odds")).collect()}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, features: int = FEATURES, min_rows: int = MIN_ROWS) -> Model:
    """The model of the labels (doc_id, toxic) of the given documents; the caller leaves out what it holds out."""
    sample, counts = sampled(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")), labels.select("doc_id", "toxic"), fit_rows)
    if not counts.get(0) or not counts.get(1):
        return Model({}, -50.0)
    sizes = {t: min(fit_rows, n) for t, n in counts.items()}
    odds = informative(sample, sizes, features, min_rows)
    place = {f: i for i, f in enumerate(odds)}
    share = 1 / len(word_features("sixsix"))  # a word's features begin with about the odds of one of them

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, blanks = [], []
            for text in b.column(0).to_pylist():
                mine, blank = [], 0
                for m in SENTENCE.finditer(text or ""):
                    words = WORD.findall(m[0].lower())
                    at = [place[f] for w in words for f in word_features(w) if f in place]
                    if at:
                        mine.append(at)
                    blank += bool(words) and not at
                lists.append(mine)
                blanks.append(blank)
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.list_(pa.int32()))), pa.array(blanks, pa.int64()), b.column(1)], names=["sentences", "blank", "toxic"])

    got = sample.mapInArrow(sparse, "sentences array<array<int>>, blank long, toxic int").toArrow()  # 2 * fit_rows rows at most
    per_doc, toxic = got.column("sentences").combine_chunks(), got.column("toxic").to_numpy() == 1
    sentences = per_doc.flatten()
    doc, rows = (np.repeat(np.arange(len(x)), pc.list_value_length(x).to_numpy()) for x in (per_doc, sentences))
    cols = sentences.flatten().to_numpy().astype(np.int64)
    weight = np.where(toxic, counts[1] / sizes[1], counts[0] / sizes[0])
    w, bias = fit(rows, cols, doc, got.column("blank").to_numpy().astype(float), toxic, weight, share * np.array(list(odds.values()), dtype=float))
    return Model({f: float(w[i]) for f, i in place.items() if abs(w[i]) > 1e-6}, float(bias))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", toxic_from: float = TOXIC_FROM) -> DataFrame:
    """``docs`` with ``score`` and ``toxic_spans``: code points and scores of the sentences that reach ``toxic_from``."""
    score, spans = unique_name(docs, "score"), unique_name(docs, "toxic_spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns, at = list(docs.columns), docs.columns.index(text_col)
    schema = docs.select("*", F.lit(0.0).alias(score), F.lit(None).cast(SPANS).alias(spans)).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        for b in batches:
            for row, chunk in tx.chunks(b.column(at)):
                scores, found = [], []
                for text in chunk.to_pylist():
                    sentences = m.sentence_scores(text, known) if m.weights else []
                    z = np.array([s[2] for s in sentences])
                    log_clean, p = noisy_or(z, np.zeros(len(z), np.int64), np.ones(len(z)), 1)
                    scores.append(round(float(-np.expm1(log_clean[0])), 6))
                    found.append([{"start": sentences[i][0], "end": sentences[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= toxic_from)])
                yield pa.RecordBatch.from_arrays([*b.slice(row, len(chunk)).columns, pa.array(scores, pa.float64()), pa.array(found, kind)], names=[*columns, score, spans])

    return map_arrow(docs, run, schema)


def op12_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Whole documents scored; trained on the labels of ids that are not held out. ``n_spans``: toxic sentences found."""
    slim = docs.select("doc_id", "text")
    model = train(slim.where(~held_out("doc_id")), labels.where(~held_out("doc_id")))
    scored = score_toxicity(slim, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans"))
