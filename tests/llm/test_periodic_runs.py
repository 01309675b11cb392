"""Periodic runs against a plain search over all periods, and the query on the smallest tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from millrace.llm import periodic_runs as pr
from tests.llm.test_operators import DOCS, ODD, SF, words


def plain_runs(w, min_length=6, min_exponent=4):
    """Every maximal stretch with period q, for each q, unless a divisor of q is a period of it too."""
    found = []
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            stretch = w[start : i + q]
            if len(stretch) >= max(min_length, min_exponent * q) and not any(stretch[k:] == stretch[: len(stretch) - k] for k in range(1, q)):
                found.append((start, len(stretch), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    at = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *at, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def periodic(seed):
    """Random words with stretches of periods inside others."""
    r = random.Random(seed)
    out = []
    for _ in range(r.randrange(1, 9)):
        unit = [r.choice("abcd" if r.random() < 0.5 else "abcdefghijklmnop") for _ in range(r.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 31]))]
        if r.random() < 0.3:
            unit = unit * r.randrange(2, 6) + [r.choice("xyz")]
        out += (unit * 12)[: r.randrange(1, 6 * len(unit) + 8)] + [r.choice("uvw") for _ in range(r.randrange(3))]
    return out


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_the_plain_search(seed):
    w = periodic(seed)
    for length, exponent in ((6, 4), (1, 3), (12, 5)):
        _, runs = pr.chunk_runs([" ".join(w).encode()], length, exponent)
        assert [tuple(r) for r in runs[0].tolist()] == plain_runs(w, length, exponent)


def test_runs_of_one_letter_of_powers_and_of_fibonacci_words():
    fib = ["a", "ab"]
    while len(fib[-1]) < 2000:
        fib.append(fib[-1] + fib[-2])
    for w in (["a"] * 3000, (["a"] * 100 + ["b"]) * 12, list(fib[-1]), list("ab" * 700 + "a" * 40 + "ab" * 9), ["x", "y", "x", "z"] * 500):
        _, runs = pr.chunk_runs([" ".join(w).encode(), b"", b"a a a a a a"], 6, 4)
        assert [tuple(r) for r in runs[0].tolist()] == plain_runs(w)
        assert len(runs[1]) == 0 and runs[2].tolist() == [[0, 6, 1]]


def test_digests_that_agree_by_chance_are_seen_through(monkeypatch):
    monkeypatch.setattr(pr.Words, "agree", lambda self, x, y, n: np.ones(len(x), bool))
    for seed in range(20):
        w = periodic(seed)
        _, runs = pr.chunk_runs([" ".join(w).encode()], 6, 4)
        assert [tuple(r) for r in runs[0].tolist()] == plain_runs(w)


def test_transform_is_the_cyclic_product():
    r = np.random.default_rng(5)
    for p, root in pr.PRIMES:
        x, y = (r.integers(0, p, (3, 16)).astype(np.uint64) for _ in range(2))
        got = pr.restored(pr.transformed(x, p, root) * pr.transformed(y, p, root) % np.uint64(p), p, root)
        for row in range(3):
            assert got[row].tolist() == [sum(int(x[row][i]) * int(y[row][(k - i) % 16]) for i in range(16)) % p for k in range(16)]
    values = r.integers(1, 4, 200)
    for b in (1, 2, 4, 8):
        starts = np.arange(0, 150, b)
        s, d = pr.occurrences(np.concatenate([values, np.zeros(3 * b, values.dtype)]).astype(np.uint64), starts, b)
        want = {(i, k) for i in starts.tolist() for k in range(b, 2 * b) if i + k + b <= 200 and values[i : i + b].tolist() == values[i + k : i + k + b].tolist()}
        assert set(zip(s.tolist(), d.tolist(), strict=True)) == want


def test_query_equals_the_plain_version(spark):
    made = [(1000 + i, " \n".join(periodic(i)), "en", "s", 1) for i in range(80)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(ODD[:8] + ODD[10:] + made, DOCS).select("doc_id", "text"))
    out = pr.op11_periodic_runs(docs)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [plain_row(*r) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert sum(r[1] > 0 for r in want) > 60


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([("x", "a b a b a b a b c", 1, 2)], "`runs` string, text string, `N_words` long, `a.b` long")
    out = pr.find_runs(docs)
    assert out.columns == ["runs", "N_words", "a.b", "_n_words", "_runs", "collapsed"]
    row = out.first()
    assert (row["runs"], row["_n_words"], row["collapsed"]) == ("x", 9, "a b c") and tuple(row["_runs"][0]) == (0, 8, 2)
    assert pr.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pr.find_runs(docs, min_exponent=2)
