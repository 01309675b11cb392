"""Toxicity: held-out accuracy, sentences located in made documents, slopes against differences, awkward rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import toxicity as tox
from tests.llm.test_operators import DOCS, ODD

SF = "/root/testdata/sf0.1"
BAD = ["vilgar", "vilgaro", "vilgarest", "snorp", "snorpy"]
LABELS = "doc_id long, toxic int"


def made_docs(n, seed):
    """(doc_id, text, toxic, spans): documents of random sentences, some with a sentence that holds one of the bad words."""
    r, out = random.Random(seed), []
    for i in range(n):
        text, spans, toxic = "", [], r.random() < 0.3
        bad = {r.randrange(8) for _ in range(r.randrange(1, 3))} if toxic else set()
        for k in range(8):
            ws = [f"{r.choice(['stone', 'river', 'light', 'wood', 'night'])}{r.choice(['', 's', 'en', 'ly'])}" for _ in range(r.randrange(4, 12))]
            if k in bad:
                ws[r.randrange(len(ws))] = r.choice(BAD).upper() if r.random() < 0.3 else r.choice(BAD)
                spans.append(k)
            text += " ".join(ws) + r.choice([". ", "! ", "?\n"])
        out.append((i, text, int(toxic), sorted(spans)))
    return out


def test_held_out_documents_of_the_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = tox.op12_toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    right = {0: [], 1: []}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        if r["held_out"] and r["doc_id"] in truth:
            right[truth[r["doc_id"]]].append(r["predicted"] == truth[r["doc_id"]])
    assert min(map(len, right.values())) >= 5
    assert np.mean(right[0]) >= 0.99 and np.mean(right[1]) >= 0.85  # some toxic rows hold no word that tells


def test_sentences_that_offend_are_located(spark):
    known, fresh = made_docs(400, 1), made_docs(200, 2)
    df = spark.createDataFrame([r[:2] for r in known], "doc_id long, text string")
    model = tox.train(df, spark.createDataFrame([(r[0], r[2]) for r in known], LABELS))
    scored = tox.score_toxicity(spark.createDataFrame([r[:2] for r in fresh], "doc_id long, text string"), model)
    for row, (_, text, toxic, spans) in zip(scored.orderBy("doc_id").collect(), fresh, strict=True):
        assert (row["score"] >= 0.5) == bool(toxic)
        ends = [m.span() for m in tox.SENTENCE.finditer(text) if tox.WORD.search(m[0])]
        assert [ends.index((s["start"], s["end"])) for s in row["toxic_spans"]] == spans


def test_a_bounded_sample_learns_too_and_labels_do_not_leak(spark):
    known, fresh = made_docs(600, 3), made_docs(150, 4)
    df = spark.createDataFrame([r[:2] for r in known], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in known], LABELS)
    sample, counts = tox.sampled(df, labels, 60)
    assert sample.groupBy("toxic").count().where("count = 60").count() == 2 and sum(counts.values()) == 600
    model = tox.train(df, labels, fit_rows=60)
    got = tox.score_toxicity(spark.createDataFrame([r[:2] for r in fresh], "doc_id long, text string"), model)
    truth = {r[0]: r[2] for r in fresh}
    assert np.mean([(r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in got.collect()]) >= 0.97
    # Labels of ids that are held out change nothing.
    flipped = labels.withColumn("toxic", F.when(tox.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, tox.op12_toxicity(df, x).collect())) for x in (labels, flipped))
    assert a == b


def test_likelihood_slopes_and_optimum():
    r = np.random.default_rng(3)
    rows, cols = np.repeat(np.arange(12), 2), r.integers(0, 4, 24)
    doc, blank = np.sort(r.integers(0, 5, 12)), np.array([0.0, 2, 1, 0, 3])
    start = np.array([0.5, 0.0, -1.0, 2.0])
    toxic, weight = np.array([True, False, True, False, False]), np.array([1.0, 2, 1, 1, 3])

    def loss(x):
        z = np.concatenate([np.bincount(rows, weights=x[:4][cols], minlength=12), np.zeros(5)]) + x[4]
        log_clean, _ = tox.noisy_or(z, np.concatenate([doc, np.arange(5)]), np.concatenate([np.ones(12), blank]), 5)
        return -(weight * np.where(toxic, np.log(-np.expm1(log_clean)), log_clean)).sum() / weight.sum() + 0.01 / 2 * ((x[:4] - start) ** 2).sum()

    w, bias = tox.fit(rows, cols, doc, blank, toxic, weight, start, steps=6000, ridge=0.01)
    best = np.append(w, bias)
    for k in range(5):
        for step in (-1e-3, 1e-3):
            other = best.copy()
            other[k] += step
            assert loss(other) >= loss(best) - 1e-7


def test_awkward_rows(spark):
    known = made_docs(300, 5)
    docs = spark.createDataFrame([(r[0] + 1000, r[1], "en", "s", 1) for r in known] + ODD + [(None, None, None, None, None)], DOCS)
    labels = spark.createDataFrame([(r[0] + 1000, r[2]) for r in known] + [(None, 1), (1, 1), (2, None), (3, 7), (7, 0), (7, 0), (5, 0), (5, 1)], LABELS)
    rows = tox.op12_toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add(r["score"])
    assert by_id[1] == by_id[2] == by_id[3] == {0.0} and len(by_id[5]) == 1
    assert all(r["score"] == 0 for r in tox.op12_toxicity(docs, labels.limit(0)).collect())
    assert all(r["score"] == 0 for r in tox.op12_toxicity(docs, labels.where("toxic = 0")).collect())
    assert tox.op12_toxicity(docs.limit(0), labels).count() == 0
    clash = spark.createDataFrame([(1, "vilgar snorp.", 2, 3)], "`Score` long, text string, toxic_spans long, `a.b` long")
    out = tox.score_toxicity(clash, tox.Model({"snorp ": 9.0}, -5.0))
    assert out.columns == ["Score", "text", "toxic_spans", "a.b", "_score", "_toxic_spans"] and out.first()["_score"] > 0.9


def test_same_text_scores_equally_in_any_order(spark):
    model = tox.Model({"snorp ": 6.0, "vil": 2.0}, -4.0)
    text = "Vilgar light. SNORP!\nnothing here? vilna snorp"
    df = spark.createDataFrame([(i, text if i % 3 else "clean words only.") for i in range(50)], "doc_id long, text string")
    assert tox.score_toxicity(df.repartition(5), model).select("text", "score").distinct().count() == 2
    z = [s[2] for s in model.sentence_scores(text, {})]
    assert z == pytest.approx([-2.0, 2.0, -4.0, 4.0])
