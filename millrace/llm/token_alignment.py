"""Alignment of two tokenizers: where their tokens end together, which tokens meet, and how often ids meet in the corpus.

Each text, with a space in front, is cut into tokens by a byte-level BPE (A) and by a sentencepiece model (B). The ends of
a text's tokens, as byte offsets, are two rising sequences. They are walked along their diagonal: at the present shift
between the two indices, runs of equal ends are found by comparing stretches of 1, 2, 4, ... ends until one differs, and a
halving search finds where; each of these ends closes a group of one A and one B token. An irregular group is resolved by
stepping the sequence that is behind until both meet, which sets the new shift.

Counts of linked id pairs are made on Spark. Documents stand in blocks of about ``BLOCK_TOKENS`` tokens; a block has a
dictionary of its distinct pairs, a document the numbers of its pairs in it. The dictionaries, not the documents'
links, are exploded, summed over the corpus and joined back, and each block meets its own dictionary once. So no table is
broadcast, no task holds more than a block, and a pair that every document has is a row a block.

Defined results: null and empty texts, and texts whose joined A or B token bytes differ from space and text, have no
tokens: counts 0, no groups. Rows are independent: null or repeated ids are fine, equal rows count as documents each.
Texts are read whole; a very long one is a block of its own. An empty table gives an empty table. Columns of the
documents pass through; new names that clash get an underscore in front. Pairs of equal count tie: all are best.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from millrace.llm import text as tx
from millrace.llm.common import every, map_arrow, unique_name, written

#: Files of the two tokenizers; they are read on the driver and sent to the tasks, a few megabytes.
A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: A block ends once it has so many tokens of A.
BLOCK_TOKENS = 1_000_000
#: Links of groups that are laid out at once.
LINKS_AT_ONCE = 1 << 20
#: Fixed value: how the byte-level scheme cuts texts before merging.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_signs() -> dict[str, int]:
    """The byte-level scheme writes printable Latin-1 bytes as themselves and the others, in order, as signs from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Tokenizer:
    """``encode`` of texts into lists of ids, and the bytes of each id."""

    encode: Callable[[list[str]], list[list[int]]]
    pieces: list[bytes]
    sizes: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.sizes = np.array([len(p) for p in self.pieces], dtype=np.int64)


def byte_level(definition: bytes) -> Tokenizer:
    """A byte-level BPE from the JSON of its vocabulary, without special tokens.

    Where ids follow the order of the merges and the usual pattern cuts texts, a faster encoder with the same result is used.
    """
    spec = json.loads(definition)
    vocab, signs = spec["model"]["vocab"], byte_signs()
    pieces = [b""] * (max([*vocab.values(), *[t["id"] for t in spec["added_tokens"]]]) + 1)
    for token, i in vocab.items():
        pieces[i] = bytes(signs[c] for c in token)
    for t in spec["added_tokens"]:
        pieces[t["id"]] = t["content"].encode()
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
    ranked = [vocab[m] for m in joined]
    cutter = spec.get("pre_tokenizer") or {}
    if ranked == sorted(ranked) and spec.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space"):
        import tiktoken

        known = {pieces[i]: i for i in vocab.values()}
        quick = tiktoken.Encoding("byte_level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=known, special_tokens={})
        return Tokenizer(lambda texts: [quick.encode_ordinary(t) for t in texts], pieces)
    import tokenizers

    t = tokenizers.Tokenizer.from_str(definition.decode())
    t.encode_special_tokens = True
    return Tokenizer(lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)], pieces)


def sentence_pieces(definition: bytes) -> Tokenizer:
    """A sentencepiece model; it puts a space in front of the text itself."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=definition)
    pieces = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(sp.id_to_piece, range(sp.vocab_size())))]
    return Tokenizer(lambda texts: sp.encode(texts, num_threads=1), pieces)


@lru_cache(maxsize=2)
def loaded(a: bytes, b: bytes) -> tuple[Tokenizer, Tokenizer]:
    return byte_level(a), sentence_pieces(b)


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B each group has; both rise strictly and end equally.

    Runs of equal ends are compared as bytes, eight for each end.
    """
    wide = 8
    at, bt = a.tobytes(), b.tobytes()
    ae, be = a.tolist(), b.tolist()
    n, m = len(ae), len(be)
    runs: list[int] = []  # one-to-one groups since the last irregular group
    many_a: list[int] = []
    many_b: list[int] = []
    i = j = run = 0
    while i < n:
        if ae[i] == be[j]:
            # Stretches double while they agree; the first that doesn't is halved down to where it differs.
            step, most = 1, min(n - i, m - j)
            done = 1
            while done < most:
                k = min(step, most - done)
                x, y = (i + done) * wide, (j + done) * wide
                if at[x : x + k * wide] == bt[y : y + k * wide]:
                    done, step = done + k, step * 2
                    continue
                while k > 1:
                    half = k // 2
                    x, y = (i + done) * wide, (j + done) * wide
                    if at[x : x + half * wide] == bt[y : y + half * wide]:
                        done, k = done + half, k - half
                    else:
                        k = half
                break
            i, j, run = i + done, j + done, run + done
        else:
            i0, j0 = i, j
            x, y = ae[i], be[j]
            while x != y:
                if x < y:
                    i += 1
                    x = ae[i]
                else:
                    j += 1
                    y = be[j]
            i, j = i + 1, j + 1
            runs.append(run)
            many_a.append(i - i0)
            many_b.append(j - j0)
            run = 0
    # Each irregular group stands behind its run of ones.
    size = np.array(runs, dtype=np.int64) + 1
    place = np.cumsum(size) - 1
    groups = int(size.sum()) + run
    na, nb = np.ones(groups, np.int64), np.ones(groups, np.int64)
    na[place], nb[place] = many_a, many_b
    return na, nb


def linked_pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs (A id * 2**32 + B id) and how often each is linked; ``na``, ``nb``: tokens of each group."""
    a0, b0, links = np.cumsum(na) - na, np.cumsum(nb) - nb, na * nb
    small = links <= LINKS_AT_ONCE
    found, times = [], []
    total = np.cumsum(np.where(small, links, 0))
    begin = 0
    while begin < len(na):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + LINKS_AT_ONCE, side="right")))
        g = np.arange(begin, end)[small[begin:end]]
        n = links[g]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(nb[g], n)
        x, k = np.unique((a[np.repeat(a0[g], n) + within // wide] << 32) + b[np.repeat(b0[g], n) + within % wide], return_counts=True)
        found.append(x)
        times.append(k)
        begin = end
    for g in np.flatnonzero(~small):  # ids repeat in so large a group
        x, kx = np.unique(a[a0[g] : a0[g] + na[g]], return_counts=True)
        y, ky = np.unique(b[b0[g] : b0[g] + nb[g]], return_counts=True)
        found.append(((x[:, None] << 32) + y[None, :]).ravel())
        times.append((kx[:, None] * ky[None, :]).ravel())
    if len(found) == 1:
        return found[0], times[0]
    pairs, at = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, at, np.concatenate(times) if times else np.zeros(0, np.int64))
    return pairs, total


def planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers with all first bytes in front of all second bytes and so on, which packs well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def id_texts(n_a: int, n_b: int) -> pa.Array:
    """Each A id with a comma behind it, each with a bar, then each B id with a comma, each with a semicolon."""
    return pa.array([f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)], pa.large_string())


def group_text(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, signs: pa.Array, n_a: int, n_b: int) -> str:
    """All groups of a text as ``a1,a2|b1;a3|b2``; ``signs`` from ``id_texts(n_a, n_b)``."""
    both = na + nb
    code = np.empty(len(a) + len(b), np.int64)
    is_b = np.arange(len(code)) - np.repeat(np.cumsum(both) - both, both) >= np.repeat(na, both)
    last_a, last_b = a.copy(), b + 2 * n_a
    last_a[np.cumsum(na) - 1] += n_a
    last_b[np.cumsum(nb) - 1] += n_b
    code[~is_b], code[is_b] = last_a, last_b
    return tx.utf8(signs.take(pa.array(code)))[0].tobytes()[:-1].decode()


@dataclass
class Block:
    """Rows of documents that wait for their block to end."""

    rows: list[pa.RecordBatch] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    pairs: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)
    tokens: int = 0


def close(block: Block, number: int, names: list[str]) -> pa.RecordBatch:
    """The rows of a block; the last one carries the dictionary, the most frequent pairs first."""
    n = [len(p) for p in block.pairs]
    seen, at, docs = np.unique(np.concatenate(block.pairs), return_inverse=True, return_counts=True)
    order = np.argsort(-docs, kind="stable")
    rank = np.empty(len(seen), np.int64)
    rank[order] = np.arange(len(seen))
    local, codes, times = rank[at], [], []
    for k, (end, size) in enumerate(zip(np.cumsum(n).tolist(), n, strict=True)):
        mine = local[end - size : end]
        by = np.argsort(mine)
        codes.append(planes(np.diff(mine[by], prepend=0)))
        times.append(planes(block.times[k][by] - 1))
    last = len(n) - 1
    dictionary = [[None] * last + [x.tolist()] for x in (seen[order], docs[order])]
    rows = pa.Table.from_batches(block.rows).combine_chunks().to_batches()[0] if len(block.rows) > 1 else block.rows[0]
    counts = np.stack(block.counts)
    new = [*[pa.array(counts[:, i]) for i in range(len(COUNTS))], pa.array(block.groups, pa.string()), pa.array([number] * len(n), pa.int64()), pa.array(codes, pa.binary()), pa.array(times, pa.binary()), *[pa.array(d, pa.list_(pa.int64())) for d in dictionary]]
    return pa.RecordBatch.from_arrays([*rows.columns, *new], names=names)


NEW = (*COUNTS, "groups", "block", "pair_codes", "pair_times", "block_pairs", "block_docs")


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the alignment of each text, and what the new columns are called.

    ``n_a``, ``n_b``, ``n_groups``, ``n_links``; ``groups``, ids of each group as ``a1,a2|b1;a3|b2`` (null without tokens);
    ``block`` and the other columns hold the linked pairs for ``pair_counts`` and ``score_links``. The text column goes.
    """
    names = {k: unique_name(docs, k) for k in NEW}
    with open(a_file, "rb") as fa, open(b_file, "rb") as fb:
        files = docs.sparkSession.sparkContext.broadcast((fa.read(), fb.read()))
    kept = [c for c in docs.columns if c != text_col]
    ordered = docs.select(*[c for c, name in zip(every(docs), docs.columns, strict=True) if name != text_col], F.col(f"`{text_col}`"))
    out_names = [*kept, *names.values()]
    kinds = {"groups": StringType(), "pair_codes": BinaryType(), "pair_times": BinaryType(), "block_pairs": ArrayType(LongType()), "block_docs": ArrayType(LongType())}
    schema = StructType([*ordered.schema.fields[:-1], *[StructField(names[k], kinds.get(k, LongType())) for k in NEW]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = loaded(*files.value)
        n_a, n_b = len(a.pieces), len(b.pieces)
        signs = id_texts(n_a, n_b)
        partition, number = TaskContext.get().partitionId(), 0
        block = Block()
        for batch in batches:
            for row, chunk in tx.chunks(batch.column(len(kept))):
                texts = chunk.to_pylist()
                encoded_a, encoded_b = a.encode([" " + t for t in texts]), b.encode(texts)
                begin = 0
                for k, (t, ia, ib) in enumerate(zip(texts, encoded_a, encoded_b, strict=True)):
                    raw = b" " + t.encode()
                    whole = len(raw) > 1 and b"".join(map(a.pieces.__getitem__, ia)) == raw and b"".join(map(b.pieces.__getitem__, ib)) == raw
                    x, y = (np.array(i if whole else [], dtype=np.int64) for i in (ia, ib))
                    na, nb = common_ends(np.cumsum(a.sizes[x]), np.cumsum(b.sizes[y]))
                    pairs, times = linked_pairs(x, y, na, nb)
                    block.counts.append(np.array([len(x), len(y), len(na), int((na * nb).sum())]))
                    block.groups.append(group_text(x, y, na, nb, signs, n_a, n_b) if whole else None)
                    block.pairs.append(pairs)
                    block.times.append(times)
                    block.tokens += len(x)
                    if block.tokens >= block_tokens:
                        block.rows.append(batch.slice(row + begin, k + 1 - begin).select(range(len(kept))))
                        yield close(block, (partition << 32) + number, out_names)
                        block, begin, number = Block(), k + 1, number + 1
                if begin < len(texts):
                    block.rows.append(batch.slice(row + begin, len(texts) - begin).select(range(len(kept))))
        if block.counts:
            yield close(block, (partition << 32) + number, out_names)

    return map_arrow(ordered, run, schema), names


def pair_counts(entries: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold the pair linked, and whether no pair of its A id has more."""
    counts = entries.groupBy("pair").agg(F.sum("docs").alias("count"))
    mates = W.partitionBy(F.shiftright("pair", 32))  # as many rows as B has ids at most
    return counts.select("pair", "count", (F.col("count") == F.max("count").over(mates)).alias("best"))


def dictionary(aligned: DataFrame, names: dict[str, str]) -> DataFrame:
    """(block, local, pair, docs): the entries of all blocks' dictionaries."""
    rows = aligned.where(F.col(names["block_pairs"]).isNotNull())
    entry = F.posexplode(F.arrays_zip(F.col(names["block_pairs"]).alias("pair"), F.col(names["block_docs"]).alias("docs"))).alias("local", "entry")
    return rows.select(F.col(names["block"]).alias("block"), entry).select("block", "local", F.col("entry.pair").alias("pair"), F.col("entry.docs").alias("docs"))


def score_links(aligned: DataFrame, names: dict[str, str]) -> DataFrame:
    """``aligned`` (a written table) with ``n_best`` and ``count_sum`` in place of the columns that hold the pairs."""
    entries = dictionary(aligned, names)
    counted = entries.select("block", "local", "pair").join(pair_counts(entries), "pair").select("block", "local", "count", "best")
    gone = {names[k] for k in ("block", "pair_codes", "pair_times", "block_pairs", "block_docs")}
    kept = [c for c in aligned.columns if c not in gone]
    slim = aligned.drop(names["block_pairs"], names["block_docs"])
    place = {c: i for i, c in enumerate(slim.columns)}
    flat = slim.toDF(*[f"c{i}" for i in range(len(place))])
    best, total = unique_name(slim.drop(*gone), "n_best"), unique_name(slim.drop(*gone), "count_sum")
    schema = StructType([*[f for f in slim.schema if f.name in kept], StructField(best, LongType()), StructField(total, LongType())])

    def look_up(docs: pa.Table, entries: pa.Table) -> pa.Table:
        local = entries.column("local").to_numpy()
        count, top = np.zeros(len(local), np.int64), np.zeros(len(local), bool)
        count[local], top[local] = entries.column("count").to_numpy(), entries.column("best").to_numpy(zero_copy_only=False)
        n_best, sums = [], []
        for codes, times in zip(docs.column(f"c{place[names['pair_codes']]}").to_pylist(), docs.column(f"c{place[names['pair_times']]}").to_pylist(), strict=True):
            at, links = np.cumsum(unplanes(codes)), unplanes(times) + 1
            n_best.append(int(links[top[at]].sum()))
            sums.append(int((links * count[at]).sum()))
        return pa.table([*[docs.column(f"c{place[c]}") for c in kept], pa.array(n_best, pa.int64()), pa.array(sums, pa.int64())], names=[f"c{i}" for i in range(len(kept) + 2)])

    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    block = f"c{place[names['block']]}"
    return flat.groupBy(block).cogroup(counted.groupBy("block")).applyInArrow(look_up, plain).toDF(*schema.names)


def align_and_count(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` without the text, with counts, ``groups``, ``n_best`` and ``count_sum``; the groups are written and shuffled too."""
    aligned, names = align(docs, a_file, b_file, text_col, block_tokens)
    return score_links(written(aligned), names)


def op13_token_alignment(docs: DataFrame) -> DataFrame:
    aligned, names = align(docs.select("doc_id", "text"))
    digest = F.coalesce(F.sha2("groups", 256), F.lit("")).alias("groups_sha256")
    narrow = aligned.select(*[digest if c == "groups" else F.col(c) for c in aligned.columns])
    return score_links(written(narrow), names).select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")
