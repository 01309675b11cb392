"""Token alignment against a plain version: sets of common ends, all pairs of each group, dictionaries of counts."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import token_alignment as ta
from tests.llm.test_operators import LONG, ODD, SF

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

STRANGE = [
    (None, "abc def"), (-1, None), (-2, ""), (-3, "▁ x"), (-4, "<|endoftext|> <s> </s> a\x00b é𝒳\n\n  "), (-5, "the the the the"), (-5, "the the the the"),
    (-6, "a" * 3000), (-7, " "), (-8, "\n"), (-9, "日本語のテキスト und русский текст ﬁ"), (-10, "🙂" * 50),
]


@pytest.fixture(scope="module")
def plain_tokenizers():
    a = tokenizers.Tokenizer.from_file(ta.A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=ta.B_FILE)
    signs = ta.byte_signs()

    def encode(text):
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        pa = [bytes(signs[c] for c in a.id_to_token(i)) for i in ia]
        pb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        return ia, ib, pa, pb

    return encode


def plain(docs, encode):
    per, counts = [], Counter()
    for i, text in docs:
        ia, ib, pa, pb = encode(text) if text else ([], [], [], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(pa) != raw or b"".join(pb) != raw:
            per.append((i, [], [], [], []))
            continue
        ea, eb = np.cumsum([len(x) for x in pa]).tolist(), np.cumsum([len(x) for x in pb]).tolist()
        groups, p, q = [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            group = ([], [])
            while p < len(ea) and ea[p] <= cut:
                group[0].append(ia[p])
                p += 1
            while q < len(eb) and eb[q] <= cut:
                group[1].append(ib[q])
                q += 1
            groups.append(group)
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        counts.update(set(links))
        per.append((i, ia, ib, groups, links))
    top = defaultdict(int)
    for (x, _), k in counts.items():
        top[x] = max(top[x], k)
    out = []
    for i, ia, ib, groups, links in per:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(ia), len(ib), len(groups), len(links), sum(counts[z] == top[z[0]] for z in links), sum(counts[z] for z in links), hashlib.sha256(text.encode()).hexdigest() if ia else ""))
    return sorted(map(repr, out))


def test_query_equals_the_plain_version(spark, plain_tokenizers):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(STRANGE + [r[:2] for r in ODD], "doc_id long, text string"))
    rows = ta.op13_token_alignment(docs)
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(repr(tuple(r)) for r in rows.collect()) == plain([tuple(r) for r in docs.collect()], plain_tokenizers)


def test_small_blocks_give_equal_rows(spark, plain_tokenizers):
    rows = [(i, f"common words here number {i % 7} thanedble {i}") for i in range(60)] + [(100, LONG[:4000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = ta.align_and_count(docs.select("doc_id", "text"), block_tokens=40).drop("groups")
    got = sorted((*tuple(r)[:5], *tuple(r)[5:]) for r in out.collect())
    want = plain(rows, plain_tokenizers)
    assert [repr(r)[:-1] for r in sorted(got, key=repr)] == [w.rsplit(",", 1)[0] for w in want]


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([("x", "some text", 1, 2)], "`n_a` string, text string, `block` long, `a.b` long")
    out = ta.align_and_count(docs)
    assert out.columns == ["n_a", "block", "a.b", "_n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    row = out.first()
    assert row["n_a"] == "x" and row["a.b"] == 2 and row["groups"].count(";") == row["n_groups"] - 1 and row["n_best"] == row["n_links"]
    assert ta.op13_token_alignment(docs.limit(0).select(docs["n_a"].alias("doc_id"), "text")).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_common_ends_and_pairs_of_random_cuts(seed):
    r = random.Random(seed)
    n = r.choice([1, 2, 5, 80, 400])
    shared = {n} | {i for i in range(1, n) if r.random() < r.choice([0.05, 0.5, 0.95])}
    ends = [np.array(sorted(shared | {i for i in range(1, n) if r.random() < p})) for p in (r.random(), r.random() * 0.2)]
    na, nb = ta.common_ends(*ends)
    cuts = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
    for counts, e in zip((na, nb), ends, strict=True):
        assert e[np.cumsum(counts) - 1].tolist() == cuts
    a, b = (np.array([r.randrange(9) for _ in e]) for e in ends)
    want, p, q = Counter(), 0, 0
    for x, y in zip(na, nb, strict=True):
        want.update((int(s), int(t)) for s in a[p : p + x] for t in b[q : q + y])
        p, q = p + x, q + y
    for limit in (1 << 20, 7):
        ta.LINKS_AT_ONCE, before = limit, ta.LINKS_AT_ONCE
        pairs, times = ta.linked_pairs(a, b, na, nb)
        ta.LINKS_AT_ONCE = before
        assert {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(t) for k, t in zip(pairs, times, strict=True)} == dict(want)


def test_slower_encoder_agrees_with_the_quick_one():
    definition = open(ta.A_FILE, "rb").read()
    quick = ta.byte_level(definition)
    slow = ta.byte_level(json.dumps(json.loads(definition) | {"normalizer": {"type": "Sequence", "normalizers": []}}).encode())
    texts = [" " + (t or "") for _, t in STRANGE]
    assert quick.encode(texts) == slow.encode(texts)
