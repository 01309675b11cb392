"""Each corpus operator against a plain version, on the smallest tables and on rows made to be awkward."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import components, decontamination, license_scan, line_dedup, mixing, ngram_join, pii, quality_classifier, quality_rules, sharding, url_filter
from millrace.llm import text as tx
from millrace.llm.common import cut

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "A line that many documents repeat, of over forty characters."
LONG = " ".join(f"w{i % 977} the of" for i in range(30_000))


def rng_text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("the of and alpha beta gamma delta omega river stone light".split()) + str(r.randrange(40)) for _ in range(n))


ODD = [
    (None, "a text without an id", "en", "s", 1),
    (1, None, "en", "s", None),
    (2, "", None, None, 0),
    (3, " \n\t \n", "en", "s", 3),
    (4, "one", "en", "s", 3),
    (5, "same words here now twice", "en", "s", 3),
    (5, "same words here now twice", "en", "s", 3),
    (6, "SAME words Here\nnow\ttwice", "de", "t", 3),
    (7, LONG, "en", "s", 3),
    (8, LONG + " end", "en", "s", 3),
    (9, "é𝒳 ü ñ ß é𝒳 ü ñ ß", "xx", "s", 3),
    *[(20 + i, f"{LINE}\n  {LINE.upper()}\t\nrow {i}\n", "en", "s", 3) for i in range(6)],
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---------------------------------------------------------------- op1


def poisson_inverse(rate, u):
    p = c = math.exp(-rate)
    k = 0
    while c <= u and k < 63:
        k += 1
        p *= rate / k
        c += p
    return k if c > u else 64


def test_mixing_draws_by_inverse_and_keeps_weights(spark, docs, odd, empty):
    both = docs.union(odd)
    rows = both.collect()
    weights = {s: 1.0 for s in {r.source for r in rows}} | {"src0": 40.0}
    rates = {r.source: r.rate for r in mixing.source_rates(both, weights=weights).collect()}
    n = defaultdict(int)
    for r in rows:
        n[r.source] += 1
    assert sum(rates[s] * n[s] for s in n) == pytest.approx(len(rows))
    want = defaultdict(int)
    for r in rows:
        draws = math.ceil(rates[r.source] / mixing.DRAW_RATE)
        for k in range(1, draws + 1):
            u = int(hashlib.md5(f"42|{'~' if r.doc_id is None else r.doc_id}|{k}".encode()).hexdigest()[:13], 16) / 2**52
            want[(r.doc_id, r.source, r.text)] += poisson_inverse(rates[r.source] / draws, u)
    got = defaultdict(int)
    out = mixing.mix_sources(both, weights=weights).collect()
    for r in out:
        got[(r.doc_id, r.source, r.text)] += 1
    assert got == {k: v for k, v in want.items() if v}
    own = [(r.doc_id, r["copy"]) for r in out if r.doc_id is not None and r.doc_id >= 30]  # smaller ids stand in both tables
    assert len(set(own)) == len(own)
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(both, weights={"src0": 1.0}).where("source <> 'src0'").count() == 0
    clash = mixing.mix_sources(odd.withColumnRenamed("n_chars", "copy"))
    assert {"copy", "_copy", "shuffle_key"} <= set(clash.columns)


def test_mixing_high_rates_split_draws(spark):
    d = spark.createDataFrame([(i, "x", "en", "big" if i < 200 else "small", 1) for i in range(220)], DOCS)
    out = mixing.mix_sources(d, weights={"big": 0.1, "small": 0.9}, total=2000.0).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in out}
    assert abs(n["small"] - 1800) < 200 and abs(n["big"] - 200) < 70


# ---------------------------------------------------------------- op2


def brute_components(rows):
    sets = []
    for r in rows:
        w = words(low(r[1]))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            inter = len(sets[i] & sets[j])
            if 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                a, b = find(rows[i][0]), find(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted(((r[0], len(s), None if r[0] is None else find(r[0])) for r, s in zip(rows, sets, strict=True)), key=str)


def near_copies(n, seed=3):
    """A base text and copies with random words changed: links near the threshold, chains, and lone copies."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append((1000 + i, " ".join(w), "en", "s", 1))
    return out


def test_ngram_join_equals_all_pairs(spark, odd, empty, monkeypatch):
    rows = [r[:2] for r in ODD] + [r[:2] for r in near_copies(150)] + [(2000 + i, " ".join(f"c{j}" for j in range(i, 60 + i)), "en", "s", 1)[:2] for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "TREE_SETS", 16)  # long lists go through blocks
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.op2_ngram_join(df).collect()), key=str)
    assert got == brute_components(rows)
    assert ngram_join.op2_ngram_join(empty).count() == 0


def test_ngram_join_of_long_lists_equals_all_pairs(spark):
    """1,200 texts made of a few common passages, so that lists are far longer than a tree and mostly unlinked."""
    r = random.Random(17)
    passages = [[f"p{k}w{i}" for i in range(40)] for k in range(9)]
    rows = []
    for i in range(1200):
        w = [x for k in sorted(r.sample(range(9), 3)) for x in passages[k]]
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w + [f"end{i}"] * r.randrange(2))))
    bit, masks = {}, []
    for _, t in rows:
        w = t.split()
        mask = 0
        for g in {tuple(w[i : i + 5]) for i in range(len(w) - 4)}:
            mask |= 1 << bit.setdefault(g, len(bit))
        masks.append((mask, mask.bit_count()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, n) in enumerate(masks):
        for j in range(i):
            b, m = masks[j]
            both = (a & b).bit_count()
            if 100 * both >= 80 * (n + m - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = {d.doc_id: (d.n_shingles, d.component_id) for d in ngram_join.op2_ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (masks[i][1], find(i)) for i in range(len(rows))}


def test_prefix_tree_leaves_out_subtrees():
    """A subtree below a node that can't reach the overlap is not entered; labels leave out sets of the own component."""
    sets = [(k, 10, np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 100 + k]), k % 2) for k in range(6)] + [(9, 10, np.arange(200, 210), 0), (10, 3, np.array([1, 2, 3]), 1)]
    tree = ngram_join.grow(sets)
    assert {c.run[0] for c in tree.children} == {1, 200} and tree.least_n == 3 and tree.most == 10
    probe = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 77])
    assert sorted(s[0] for s in ngram_join.walk(tree, probe, 10)) == list(range(6))
    assert sorted(s[0] for s in ngram_join.walk(tree, probe, 10, lambda x: x == 0)) == [1, 3, 5]
    assert [s[0] for s in ngram_join.walk(tree, np.array([1, 2, 3]), 3)] == [10]


def test_tree_join_finds_what_sets_share():
    r = random.Random(5)
    sets = []
    base = sorted(r.sample(range(10**6), 200))
    for k in range(60):
        s = sorted(set(base[: r.randrange(120, 200)]) | set(r.sample(range(10**6), r.randrange(0, 60))))
        sets.append((k, len(s), np.array(s, dtype=np.int64)))
    probe = np.array(base, dtype=np.int64)
    want = [k for k, n, s in sets if 100 * len(set(base) & set(s.tolist())) >= 80 * len(set(base) | set(s.tolist()))]
    assert sorted(ngram_join.tree_join(probe, len(base), sets)) == want and want


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(200, 201), (201, 200), (5, 5)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 60)} | {200: 200, 201: 200}


# ---------------------------------------------------------------- op3


def brute_hits(text, items):
    def ws(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))

    w, hit, found = ws(text), set(), set()
    for item, t in items:
        iw = ws(t)
        m = min(10, len(iw))
        for win in {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)} if m else ():
            for p in range(len(w) - m + 1):
                if tuple(w[p : p + m]) == win:
                    hit.update(range(p, p + m))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_equals_plain_search(spark, docs, odd, empty):
    items = [(1, rng_text(1, 25)), (2, rng_text(2, 12)), (3, "Short item"), (4, "one"), (5, None), (6, " ... "), (None, rng_text(9, 14)), (7, rng_text(1, 25)), (10, "é𝒳 ü, ñ")]
    t = rng_text(1, 25)
    rows = [r[:2] for r in ODD] + [(50, "before " + t + " after"), (51, t.upper().replace(" ", ", ")), (52, "x " + rng_text(9, 14)), (53, " ".join(t.split()[:9])), (54, t + " " + t)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(r[0], *brute_hits(r[1], items)) for r in rows], key=str)
    assert sorted([tuple(r) for r in decontamination.op3_decontamination(df, bench).collect()], key=str) == want
    blocks = decontamination.mark_contamination(df, bench, block_windows=5)  # several passes give the same
    assert sorted((str(r.doc_id), sum(s.b - s.a for s in r.hit_spans), len(r.hit_items)) for r in blocks.collect()) == sorted((str(r[0]), r[2], r[3]) for r in want)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.op3_decontamination(df, none).where("contaminated").count() == 0
    assert decontamination.op3_decontamination(empty, bench).count() == 0
    clean = decontamination.decontaminate(odd.withColumnRenamed("n_chars", "hit_spans"), bench)
    assert clean.columns == [*odd.columns[:-1], "hit_spans"] and clean.where("doc_id = 4").count() == 0


# ---------------------------------------------------------------- op4


def brute_quality(text):
    t = text or ""
    w = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = defaultdict(int)
    for x in tri:
        count[x] += 1
    inside = {i + k for i, x in enumerate(tri) if count[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)


def brute_distance(p, q):
    p, q = p / max(p.sum(), 1), q / max(q.sum(), 1)
    s = sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q, strict=True))
    return math.sqrt(max(0.0, s / 2))


def test_quality_counts_and_divergence(spark, docs, odd, empty):
    rows = docs.union(odd).collect()
    got = {(str(r.doc_id), r.n_words, r.word_chars): r for r in quality_rules.op4_quality_rules(docs.union(odd)).collect()}
    m = quality_rules.measure_texts(pa.array([r.text for r in rows]))
    refs = {}
    for lang in {r.lang for r in rows}:
        ok = [i for i, r in enumerate(rows) if r.lang == lang and not brute_quality(r.text)[5] and brute_quality(r.text)[0] >= 100]
        refs[lang] = {h: m[h][ok].sum(axis=0) for h in quality_rules.HISTOGRAMS} if ok else None
    for i, r in enumerate(rows):
        b = brute_quality(r.text)
        g = got[(str(r.doc_id), b[0], b[1])]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == b
        kept = not b[5]
        for h, d, most in (("char_hist", g.char_distance, quality_rules.MAX_CHAR_DISTANCE), ("word_hist", g.word_distance, quality_rules.MAX_WORD_DISTANCE)):
            if b[0] >= 100 and refs[r.lang]:
                x = brute_distance(m[h][i].astype(float), refs[r.lang][h].astype(float))
                assert d == pytest.approx(x, abs=2e-6)
                kept = kept and x <= most[0] + most[1] / math.sqrt(b[0])
            else:
                assert d is None
        assert g.kept == kept
    assert quality_rules.op4_quality_rules(empty).count() == 0
    clash = quality_rules.keep_good(docs.withColumnRenamed("n_chars", "kept"))
    assert clash.columns == ["doc_id", "text", "lang", "source", "kept"] and 0 < clash.count() < docs.count()


def test_quality_keeps_labelled_good_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    j = quality_rules.op4_quality_rules(docs).join(labels, "doc_id").where("NOT base_failed")
    assert j.where("quality = 1 AND NOT kept").count() == 0


# ---------------------------------------------------------------- op5


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def brute_pii(text):
    t, out = text or "", []

    def dg(x):
        return re.sub("[^0-9]", "", x)

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(dg(m)) <= 19 and luhn(dg(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(dg(m)) <= 15),
    )
    for rank, (kind, pattern, ok) in enumerate(kinds):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, t) if ok(m.group())]
    return [(k, a, b) for a, _, k, b in sorted(out)]


PII_ODD = [
    (900, "a@b.com_x@c.d 1.2.3.4.5.6.7.8 999.1.1.1 é𝒳 4111 1111 1111 1111 +1 (555) 555-0199. +49.30.1234567-"),
    (901, "a@b.c..d@e.f @@x@y.z. 4111-1111-1111-1111-4 4111  1111111111111111 001.002.003.004 99999999999999999999.1.1.1"),
    (902, "write to john at example dot com or call (212) 555-0182 now; phone 212-555-0182"),
    (903, "mail: a@b.io x@y"),
    (904, "a" * 20_000 + "@b.co " + "1 " * 5_000 + "c.d." * 3_000 + "+1" * 2_000),
]


def test_pii_base_spans_equal_plain_patterns(spark, docs, odd, empty):
    df = cut(docs.union(odd).select("doc_id", "text").union(spark.createDataFrame(PII_ODD, "doc_id long, text string")))
    rows = {str(r.doc_id): r.text for r in df.collect()}
    got = pii.op5_pii(df).collect()
    added = 0
    for g in got:
        b = brute_pii(rows[str(g.doc_id)])
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        assert g.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(x[0] == k for x in b) for k in pii.KINDS]
        assert {x for x in text.split(",") if x} <= set(g.spans.split(","))
        added += g.n_added
    assert added >= 2  # the spelt address and the local number with cues before them
    assert all(g.n_spans == len([x for x in g.spans.split(",") if x]) for g in got)
    assert pii.op5_pii(empty).count() == 0
    assert "_pii" in pii.detect_pii(odd.withColumnRenamed("n_chars", "pii")).columns


def planted_pii(n=600, seed=11):
    """Documents with one planted span each (text, start, end), and clean ones with numbers that are none of it."""
    r = random.Random(seed)

    def num(k):
        return "".join(r.choice("123456789") for _ in range(k))

    def card():
        body = "4" + num(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    spelt = [lambda: f"{r.choice(('ann', 'bob.k', 'c_d'))} at mail{num(1)} dot com", lambda: f"{r.choice(('eve', 'joe.x'))} [at] host{num(1)} [dot] org", lambda: f"info(at)site{num(1)}(dot)de"]
    phones = [lambda: f"({r.randrange(201, 990)}) 555-{num(4)}", lambda: f"{r.randrange(201, 990)}-555-{num(4)}", lambda: f"030 {num(4)} {num(4)}"]
    secrets = [lambda: 'token = "' + hashlib.sha1(num(9).encode()).hexdigest(), lambda: "api_key: " + hashlib.md5(num(9).encode()).hexdigest() + "Z", lambda: "password=" + num(3) + "qWe" + num(3) + "rTzUiOp" + num(2)]
    cards = [lambda: card() + " " + card()]
    base = [lambda: f"ann.{num(2)}@mail{num(1)}.example.com", lambda: f"+1 ({num(3)}) 555-{num(4)}", lambda: f"{num(2)}.{num(2)}.{num(2)}.{num(1)}", card]
    cues = {0: "please write to ", 1: "please call ", 2: "set ", 3: "pay by card ", 4: "see "}
    clean = [lambda: f"order {num(9)}", lambda: f"version {num(1)}.{num(2)}.{num(1)}", lambda: f"in {num(4)} and {num(4)}", lambda: "he was at home by the dot com crash", lambda: "key = value", lambda: f"total: {num(3)}.{num(2)}", lambda: f"isbn {num(3)}-{num(1)}-{num(4)}", lambda: f"lines {num(3)}-{num(3)}"]
    rows = []
    for i in range(n):
        before, after = rng_text(seed + i, r.randrange(3, 30)), rng_text(seed * 7 + i, r.randrange(3, 30))
        if i % 2:
            rows.append((i, f"{before} {r.choice(clean)()} {after}", None))
        else:
            k = r.randrange(5)
            span = r.choice((spelt, phones, secrets, cards, base)[k])()
            head = f"{before} {cues[k]}"
            rows.append((i, f"{head}{span} {after}", (len(head), len(head) + len(span))))
    return rows


def test_pii_finds_planted_spans_and_leaves_clean_texts(spark):
    rows = planted_pii()
    got = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x] for r in pii.op5_pii(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")).collect()}
    planted = [(got[i], span) for i, _, span in rows if span]
    caught = sum(any(a < e and s < b for a, b in spans) for spans, (s, e) in planted)
    exact = sum(sum(b - a for a, b in spans if s <= a and b <= e) >= 0.9 * (e - s) and all(s <= a and b <= e for a, b in spans) for spans, (s, e) in planted)
    false = sum(bool(got[i]) for i, _, span in rows if not span)
    assert caught >= 0.95 * len(planted) and exact >= 0.9 * len(planted), (caught, exact, len(planted))
    assert false <= 0.02 * len(rows) / 2, false


def test_pii_reliabilities_equal_a_plain_estimate():
    r = random.Random(2)
    seen = defaultdict(float)
    for _ in range(3000):
        true = r.random() < 0.4
        seen[tuple(0 if r.random() < 0.2 else 1 if (r.random() < a) == true else -1 for a in (0.95, 0.9, 0.8, 0.7, 0.6))] += 1
    patterns = sorted(seen.items())
    p = {v: (sum(x > 0 for x in v) + 1) / (sum(x != 0 for x in v) + 2) for v in seen}
    for _ in range(pii.ITERATIONS):
        yes, no = sum(n * p[v] for v, n in seen.items()), sum(n * (1 - p[v]) for v, n in seen.items())
        new = {}
        for v in seen:
            t, f = (yes + 1) / (yes + no + 2), (no + 1) / (yes + no + 2)
            for j, x in enumerate(v):
                t *= (sum(n * p[w] for w, n in seen.items() if w[j] == x) + 1) / (yes + 3)
                f *= (sum(n * (1 - p[w]) for w, n in seen.items() if w[j] == x) + 1) / (no + 3)
            new[v] = t / (t + f)
        p = new
    assert pii.estimate(patterns) == pytest.approx([p[v] for v, _ in patterns], rel=1e-9)


# ---------------------------------------------------------------- op6


def test_line_dedup_equals_plain_version(spark, docs, odd, empty):
    rows = [tuple(r)[:2] for r in docs.union(odd).collect()]

    def key(line):
        return low(line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40 and i is not None:
                holders[key(x)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or gone.get(key(x), i) == i]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = [tuple(r) for r in line_dedup.op6_line_dedup(docs.union(odd)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert line_dedup.op6_line_dedup(empty).count() == 0
    assert {"n_lines", "_n_lines"} <= set(line_dedup.dedup_lines(odd.withColumnRenamed("n_chars", "n_lines")).columns)
    # one long document of which many lines go, and rows of one id with different texts
    lines = [f"{LINE} number {k}" for k in range(3000)]
    many = [(i, "\n".join(lines)) for i in range(5)] + [(9, lines[7] + "\nx"), (9, "y\n" + lines[7] + "\n" + lines[7]), (10, lines[7])]
    got = {(r.doc_id, r.n_lines): (r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(spark.createDataFrame(many, "doc_id long, text string")).collect()}
    assert got[0, 3000] == (3000, "") and got[4, 3000] == (1, "\n".join(lines[:7] + lines[8:]))
    assert got[9, 2] == (1, "x") and got[9, 3] == (2, "y") and got[10, 1] == (0, lines[7])


# ---------------------------------------------------------------- op7


def test_labeller_accuracies_are_recovered():
    r = np.random.default_rng(1)
    truth = r.random(20_000) < 0.7
    acc = [0.95, 0.85, 0.7, 0.9, 0.6]
    votes = np.stack([np.where(r.random(20_000) < 0.2, 0, np.where((r.random(20_000) < a) == truth, 1, -1)) for a in acc], axis=1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, table = quality_classifier.estimate(patterns, counts.astype(float))
    assert np.mean((p[inverse] > 0.5) == truth) > 0.93
    for j, a in enumerate(acc):
        assert table[j, 1, 2] / (table[j, 1, 2] + table[j, 1, 0]) == pytest.approx(a, abs=0.03)


def test_classifier_on_labels_and_odd_rows(spark, odd, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "good")
    j = quality_classifier.op7_quality_classifier(d).join(labels, "doc_id")
    n = {(r.good, r.kept): r["count"] for r in j.groupBy("good", "kept").count().collect()}
    assert n[(1, True)] / (n[(1, True)] + n.get((1, False), 0)) > 0.97
    assert n[(0, False)] / (n[(0, False)] + n.get((0, True), 0)) > 0.5
    out = quality_classifier.op7_quality_classifier(odd).collect()
    assert len(out) == len(ODD) and all(r.quality == 0 and not r.kept for r in out if r.doc_id in (1, 2, 3))
    assert quality_classifier.op7_quality_classifier(empty).count() == 0


def plain_features(text):
    """{feature: value} of one text: shares of hashed words and of word shapes, of repeated windows, of words that follow themselves."""
    w, out = words(text), defaultdict(float)
    classes = {**{c: 0 for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: 1 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: 2 for c in "0123456789"}, **{c: 4 for c in ".,;:"}, **{c: 6 for c in "#*$%&|<>"}}
    for x in w:
        out[int(tx.words(pa.array([x])).hashes[0] % np.uint64(quality_classifier.WORD_BUCKETS))] += 1 / len(w)
        kinds = {8 if ord(c) > 127 else 7 if ord(c) < 32 or ord(c) == 127 else classes.get(c, 5) for c in x}
        out[quality_classifier.WORD_BUCKETS + sum(1 << k for k in kinds)] += 1 / len(w)
    if w:
        out[quality_classifier.N_FEATURES - 2] = brute_quality(text)[4] / len(w)
        out[quality_classifier.N_FEATURES - 1] = sum(low(a) == low(b) for a, b in zip(w, w[1:])) / len(w)
    return out


def plain_votes(text):
    n_words, chars, n_symbols, dup, again, _ = brute_quality(text)
    n, t = max(n_words, 1), text or ""
    lower, upper = len(re.findall("[a-z]", t)), len(re.findall("[A-Z]", t))
    common = 1 - sum(low(x) not in quality_rules.COMMON_WORDS for x in words(t)) / n
    rules = (
        (n_symbols > 0.1 * n, n_symbols <= 0.02 * n), (upper > 0.3 * max(lower + upper, 1), upper < 0.1 * max(lower + upper, 1)), (again > 0.4 * n, again < 0.15 * n), (common < 0.1, common > 0.2),
        (not 2.5 <= chars / n <= 14, 3.5 <= chars / n <= 9), (dup > 0.03 * n, dup == 0), (n_words < 20, n_words > 100),
    )
    return tuple(-1 if bad else 1 if good else 0 for bad, good in rules)


def test_classifier_equals_a_plain_version(spark, docs, odd):
    rows = [(r.doc_id, r.text) for r in docs.union(odd).collect()]
    votes = defaultdict(float)
    for _, t in rows:
        votes[plain_votes(t)] += 1
    patterns = sorted(votes)
    p, _ = quality_classifier.estimate(np.array(patterns), np.array([votes[v] for v in patterns]))
    truth = dict(zip(patterns, p, strict=True))
    distinct = defaultdict(int)
    for r in rows:
        distinct[r] += 1
    x = np.zeros((len(distinct), quality_classifier.N_FEATURES + 1))
    x[:, -1] = 1
    for k, (_, t) in enumerate(distinct):
        for f, v in plain_features(t).items():
            x[k, f] = v
    y, times = np.array([truth[plain_votes(t)] for _, t in distinct]), np.array(list(distinct.values()))
    w, seen = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(200):
        g = x.T @ ((1 / (1 + np.exp(-(x @ w))) - y) * times) / times.sum() + 1e-4 * np.append(w[:-1], 0)
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    want = {i: (1 / (1 + np.exp(-(x[k] @ w))) if words(t) else 0.0) for k, (i, t) in enumerate(distinct)}
    for r in quality_classifier.op7_quality_classifier(docs.union(odd)).collect():
        if r.doc_id is None or r.doc_id >= 30:  # smaller ids stand in both tables
            assert r.quality == pytest.approx(want[r.doc_id], abs=2e-3) and r.kept == (r.quality >= 0.5)


def test_fit_sample_is_bounded_by_distinct_rows(spark, monkeypatch):
    """Repeated rows neither swell the sample nor leave it empty."""
    sizes = []
    plain = quality_classifier.fit
    monkeypatch.setattr(quality_classifier, "fit", lambda rows, cols, values, target, times: (sizes.append((len(target), int(times.sum()))), plain(rows, cols, values, target, times))[1])
    same = spark.range(20_000).selectExpr("7L AS doc_id", f"'{rng_text(1, 60)}' AS text")
    quality_classifier.train(same, fit_rows=100)
    other = spark.range(300).selectExpr("id AS doc_id", "concat('some words of a text number ', id) AS text")
    quality_classifier.train(same.union(other), fit_rows=100)
    quality_classifier.train(spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string"), fit_rows=100)
    assert sizes[0] == (1, 20_000) and sizes[1][0] == 100 and sizes[2] == (2, 2)


# ---------------------------------------------------------------- op8


def test_license_scan_finds_templates_in_context(spark, odd, empty):
    around = rng_text(4, 40)
    rows = [(i, f"{around}\n{t.upper()}. {around}") for i, t in enumerate(license_scan.TEMPLATES.values())]
    mit = license_scan.TEMPLATES["MIT-text"].split()
    rows += [(100, " ".join(mit[:10] + ["changed"] + mit[11:])), (101, " ".join(mit[:9])), (102, "under license"), (103, None), (104, "")]
    rows += [(105, "word " * 200_000 + license_scan.TEMPLATES["ISC-text"] + " word" * 1000)]
    both = spark.createDataFrame(rows, "doc_id long, text string").union(odd.selectExpr("doc_id + 1000", "text"))
    got = {r.doc_id: r.licenses for r in license_scan.op8_license_scan(both).collect()}
    for i, name in enumerate(license_scan.TEMPLATES):
        assert name in got[i].split(","), name
    assert got[101] == got[102] == got[103] == got[104] == "" and got[105] == "ISC-text"
    assert not any(v for i, v in got.items() if i is not None and i >= 1000)
    assert license_scan.op8_license_scan(empty).count() == 0


def test_license_scan_recalls_damaged_texts_among_long_ones(spark):
    r = random.Random(12)
    rows, want = [], {}
    for name, text in license_scan.TEMPLATES.items():
        w = license_scan.template_words(text)
        for share in (0.03, 0.12):  # a changed word costs up to five shingles
            body = list(w)
            for at in sorted(r.sample(range(len(w)), int(share * len(w) / 3))):
                body[at] = "altered"
            have = set(license_scan.template_shingles(body))
            wanted = license_scan.template_shingles(w)
            if 100 * sum(s in have for s in wanted) >= license_scan.CONTAINED * len(wanted):
                want[len(rows)] = name
            rows.append((len(rows), f"{rng_text(len(rows), 300)} {' '.join(body)}\n{rng_text(len(rows) + 1, 200)}"))
    got = {x.doc_id: x.licenses.split(",") for x in license_scan.op8_license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > len(license_scan.TEMPLATES) and all(name in got[i] for i, name in want.items())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {i: x.split(",") for i, _, x in con.execute(f"SELECT doc_id, n_licenses, licenses FROM ({license_scan.OP8_SQL})").fetchall()} == got


def test_license_scan_of_null_ids_clashing_names_and_repeated_rows_equals_its_sql(spark):
    notice = list(license_scan.TEMPLATES.values())
    names = "doc_id long, text string, template string, words string, `a.b` string, length string, key string"
    rows = [(None, f"x {notice[5]} y"), (None, f"{notice[6]} and {notice[7]}"), (None, None), (None, "plain words"), (1, f"a {notice[0]}"), (1, f"b {notice[9]} b"), (2, notice[15]), (2, notice[15]), (3, "all rights are reserved")]
    docs = spark.createDataFrame([(*r, "t", "w", "d", "l", "k") for r in rows], names)
    got = sorted(map(repr, (tuple(r[c] for c in ("doc_id", "n_licenses", "licenses")) for r in license_scan.op8_license_scan(docs).collect())))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted(map(repr, con.execute(f"SELECT doc_id, n_licenses, licenses FROM ({license_scan.OP8_SQL})").fetchall()))
    assert "(None, 1, 'MIT')" in got and "(None, 2, 'BSD-text,MIT-text')" in got and got.count("(1, 2, 'Apache-2.0,ISC-text')") == 2


# ---------------------------------------------------------------- op9


def test_url_filter_rules_and_trust(spark):
    def link(h):
        return f'<a href="https://{h}/x">x</a>'

    pages = [
        (1, "http://a.example.com/en/1?q", None), (2, "http://www.example.com/en/1", ""), (3, "HTTP://B.Net/es/x#f", "x"), (4, "nothing", None), (5, None, None),
        (6, "http://good.com/", link("friend.org") + link("friend.org") + link("good.com")), (7, "http://friend.org/a", link("pal.org")), (8, "http://pal.org", ""),
        (9, "http://bad.net/es/1", ""), (10, "http://farm.org/1", link("bad.net") + link("BAD.net")), (11, "http://farm.org/2", link("bad.net")), (12, "http://alone.org:80/p?x#y", None), (12, "http://alone.org:80/p?x#y", None),
        (13, "http://comx/", ""), (14, "ftp://x.com", ""),
    ]
    got = {r.page_id: r for r in url_filter.op9_url_filter(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (1, 2, 3, 4, 5)] == [
        ("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("b.net", "/es/x", "net/es/", "block"), ("", "", None, "allow"), ("", "", None, "allow"),
    ]
    assert got[7].trust > got[8].trust > 0 and got[7].verdict == got[8].verdict == "allow"
    assert got[10].distrust > 0 and got[10].verdict == "block" and got[11].rule is None
    assert (got[12].host, got[12].path, got[12].verdict) == ("alone.org:80", "/p", "allow")
    assert got[13].rule is None and got[14].path == "" and got[14].rule is None
    assert url_filter.op9_url_filter(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_filter_spreads_until_it_settles(spark):
    """A chain of 13 hosts to a blocked seed, its links without schemes, and a ring whose mass has a known limit."""
    chain = [f"h{i}.org" for i in range(13)] + ["bad.net"]
    pages = [(i, f"http://{a}/", f'<a href="//{b}/x">x</a>') for i, (a, b) in enumerate(zip(chain, chain[1:]))] + [(13, "http://bad.net/es/1", "")]
    ring = ["good.com", "r1.org", "r2.org"]
    pages += [(20 + i, f"http://{a}/", f"<a href=https://{ring[(i + 1) % 3]}/>x</a>") for i, a in enumerate(ring)]
    got = {r.page_id: r for r in url_filter.op9_url_filter(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i].verdict == "block" and got[i].distrust == pytest.approx(url_filter.MASS * 0.15 * 0.85 ** (13 - i), rel=1e-5) for i in range(13))
    assert [got[20 + i].trust for i in range(3)] == pytest.approx([url_filter.MASS * 0.15 * 0.85**i / (1 - 0.85**3) for i in range(3)], rel=1e-5)


def plain_rank(links, seeds, total):
    """Personalised PageRank by plain power iteration; hosts without links keep what reaches them."""
    out = defaultdict(list)
    for a, b in links:
        out[a].append(b)
    start = {h: total // len(seeds) * 15 // 100 for h in seeds}
    rank = dict(start)
    for _ in range(600):
        new = defaultdict(float, start)
        for h, m in rank.items():
            for to in out[h]:
                new[to] += m * 0.85 / len(out[h])
        rank = new
    return rank


def test_url_filter_equals_plain_power_iteration(spark):
    """Random links, a hub that a third of the hosts link to, dangling hosts, and chains of over 20 hosts to the seeds."""
    r = random.Random(8)
    hosts = [f"h{i}.org" for i in range(120)] + ["a.com", "b.com", "x.net", "y.net"]
    links = {(r.choice(hosts), r.choice(hosts[:100])) for _ in range(240)} | {(h, "hub.org") for h in hosts[::3]} | {("hub.org", h) for h in hosts[:60:2]}
    for seed in ("y.net", "b.com"):
        chain = [f"{seed[0]}{i}.info" for i in range(25)]
        links |= set(zip(chain, chain[1:])) | ({(chain[-1], seed)} if seed == "y.net" else {(seed, chain[0])})
    links = {(a, b) for a, b in links if a != b}
    every_host = sorted({h for x in links for h in x} | set(hosts))
    path = {"x.net": "/es/1", "y.net": "/fr/"}
    pages = [(k, f"http://{h}{path.get(h, '/')}", "".join(f'<a href="{"https:" if len(b) % 2 else ""}//{b}/z">z</a>' for a, b in sorted(links) if a == h)) for k, h in enumerate(every_host)]
    trust = plain_rank(links, ["a.com", "b.com"], url_filter.MASS)
    distrust = plain_rank({(b, a) for a, b in links}, ["x.net", "y.net"], url_filter.MASS)
    got = url_filter.op9_url_filter(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()
    assert len(got) == len(pages)
    for g in got:
        t, d = trust.get(g.host, 0.0), distrust.get(g.host, 0.0)
        assert g.trust == pytest.approx(t, rel=2e-5, abs=2) and g.distrust == pytest.approx(d, rel=2e-5, abs=2), g.host
        if g.rule is None and abs(d - 2 * t) > 1e-4 * d:
            assert g.verdict == ("block" if d > 2 * t else "allow"), g.host
    far = {g.host: g for g in got}
    assert far["y0.info"].verdict == "block" and far["b24.info"].trust > 0


def test_url_filter_takes_long_pages_and_clashing_names(spark):
    long = "http://long.org/" + "p" * 300_000
    rows = [(1, long, '<a href="http://bad.net/es/">x</a>' * 20_000, 5, "v"), (2, "http://bad.net/es/", "y" * 100_000, 6, "w"), (3, long, None, 7, None)]
    got = {r.page_id: r for r in url_filter.op9_url_filter(spark.createDataFrame(rows, "page_id long, url string, html string, host long, verdict string")).collect()}
    assert len(got[1].path) == 300_001 and got[1].verdict == got[3].verdict == "block" and got[2].rule == "net/es/"


# ---------------------------------------------------------------- op10


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    points = np.array(list(product(range(1 << bits), repeat=dims)))
    index = sharding.hilbert_index(points, bits)
    assert sorted(index) == list(range(len(points)))
    steps = np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_sharding_law_and_order(spark, docs, odd, empty):
    both = docs.union(odd)
    rows, got = both.collect(), sharding.op10_sharding(both).collect()
    assert sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows) == sorted((str(g.doc_id), g.size, g.text_crc32) for g in got)
    by = defaultdict(list)
    for g in got:
        assert g.law == "rows" and g.grown_shard is None
        by[g.shard].append(g)
    assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(g.slot for g in v) == list(range(len(v))) for v in by.values())
    order = [g.curve_index for s in range(16) for g in sorted(by[s], key=lambda g: g.slot)]
    assert order == sorted(order)
    few = sharding.op10_sharding(docs.limit(5)).collect()
    assert sorted(g.slot for g in few) == [0] * 5 and len({g.shard for g in few}) == 5
    assert sharding.op10_sharding(empty).count() == 0
    clash = sharding.hilbert_shards(odd.withColumnRenamed("n_chars", "shard"), sharding.document_dims())
    assert {"shard", "_shard", "slot"} <= set(clash.columns) and clash.count() == len(ODD)


# ---------------------------------------------------------------- words and pipeline


def test_word_hashes_follow_words():
    texts = ["the The  THE\tof", "", " \n", "é𝒳 é𝒳", "x" * 5000, "a b c d e f"]
    w = tx.words(pa.array(texts))
    assert [len(w.of(i)) for i in range(len(texts))] == [len(words(t)) for t in texts]
    assert len(set(w.of(0)[:3])) == 1 and len(set(w.of(3))) == 1
    assert len(set(tx.words(pa.array(texts), lower=False).of(0)[:3])) == 3
    even, odd_ = "a", "b"  # Thue-Morse words of 2048 letters: polynomials modulo 2**64 can't tell them apart
    for _ in range(11):
        even, odd_ = even + odd_, odd_ + even
    assert len({int(h) for h in tx.words(pa.array([f"{even} {odd_} {even.upper()}"])).hashes}) == 2
    parts = [len(c) for _, c in tx.chunks(pa.array(["x" * 10] * 10 + [None]), 25)]
    assert sum(parts) == 11 and max(parts) <= 3


def test_pipeline_stages_decide(spark, docs):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    rows = {r.doc_id: r for r in docs.collect()}
    q = {r.doc_id for r in quality_rules.op4_quality_rules(docs).where("kept").collect()}
    left = [(i, rows[i].text) for i in sorted(q)]
    firsts = {i for i, _, c in brute_components(left) if i == c}
    clean = {i for i in firsts if not brute_hits(rows[i].text, [(b.item_id, b.text) for b in bench])[4]}
    n = defaultdict(int)
    for i in clean:
        n[rows[i].source] += 1
    total = sum(math.sqrt(v) for v in n.values())
    want = defaultdict(int)
    for i in clean:
        rate = math.sqrt(n[rows[i].source]) / total * len(clean) / n[rows[i].source]
        u = int(hashlib.md5(f"42|{i}|1".encode()).hexdigest()[:13], 16) / 2**52
        want[i] += poisson_inverse(rate, u)
    out = cp.run(spark, SF).collect()
    got = defaultdict(int)
    for r in out:
        got[r.doc_id] += 1
    assert got == {k: v for k, v in want.items() if v}
    sizes = defaultdict(int)
    for r in out:
        sizes[r.shard] += 1
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_one_row_stays_of_each_id_and_group(spark, odd):
    rows = [*ODD, (30, rng_text(3, 60), "en", "s", 1), (30, rng_text(4, 60), "en", "s", 2), (31, rng_text(3, 60), "en", "s", 3), (31, None, "en", "s", 4)]
    left = ngram_join.first_of_each(spark.createDataFrame(rows, DOCS))
    assert left.columns == odd.columns
    ids = [r[0] for r in left.collect()]
    assert len(ids) == len(set(ids))
    assert set(ids) == {None, 1, 2, 3, 4, 5, 7, 9, 20, 30}  # 6, 8 and 31 link to 5, 7 and 30; the lines of 20 to 25 are alike
    assert left.where("doc_id = 5").first()["text"] == "same words here now twice"


def test_column_names_with_dots_pass_through(spark, odd):
    wide = odd.selectExpr("*", "doc_id AS `a.b`", "'x' AS copy", "1 AS n_words", "2 AS shard")
    bench = spark.createDataFrame([("i", "same words here now twice")], "item_id string, text string")
    wide_named = line_dedup.dedup_lines(wide.withColumnRenamed("text", "t.x").withColumnRenamed("doc_id", "i.d"), "i.d", "t.x")
    assert wide_named.where("n_dropped > 0").count() == 5
    pii_out = pii.detect_pii(wide)
    assert pii_out.columns == [c for c in wide.columns if c != "text"] + ["pii"] and pii_out.count() == len(ODD)
    for out in (line_dedup.dedup_lines(wide), mixing.mix_sources(wide), decontamination.mark_contamination(wide, bench), decontamination.decontaminate(wide, bench), ngram_join.first_of_each(wide), quality_rules.keep_good(wide), quality_classifier.score_quality(wide, np.zeros(quality_classifier.N_FEATURES + 1)), sharding.hilbert_shards(wide, sharding.document_dims())):
        assert out.columns[: len(wide.columns)] == wide.columns
        out.write.format("noop").mode("overwrite").save()


def test_pipeline_takes_clashing_names_and_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").union(odd).selectExpr("*", "1 AS curve_index", "2 AS shard", "3 AS slot", "4 AS copy", "5 AS kept", "6 AS `a.b`", "7 AS n_words", "8 AS hit_spans")
    for name, rows in (("full", docs), ("none", docs.limit(0))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        out = cp.run(spark, str(tmp_path / name))
        assert out.columns == [*docs.columns, "_curve_index", "_shard", "_slot"]
        assert (out.count() > 0) == (name == "full")
