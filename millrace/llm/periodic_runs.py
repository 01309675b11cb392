"""Stretches of a text that repeat with a period, found by block convolution, and texts with the repeats taken out.

A run is a stretch of words with smallest period q and at least ``MIN_EXPONENT`` times q words that no neighbouring word
extends. At each dyadic scale b the words are cut into blocks of b. A run with b <= q < 2b holds a whole block and its
copy q words on. A number theoretic transform gives, for all distances from b to 2b - 1 at once, the sum of squared
differences between a block's word numbers and those that far on, exact, as the product of the primes exceeds the largest
sum; the zeros are the block's occurrences. Their distances are seeds: each is extended to both sides as far as words that
far apart agree. Runs of multiples of a period have the ends of the run of the period itself and are left out.

Blocks are left out only where they can't add a run: those with a word whose next copy is 2b or more words on, and those
whose whole window lies in a run that a smaller scale has found (all their distances are multiples of its period).
Texts of an Arrow batch are worked on a few megabytes at a time, one behind the other with a sign of its own between.

Defined results: a null or empty text has no words, no runs and an empty collapsed text. Words are runs of characters
outside space and 0x09 to 0x0D, told apart by all their bytes. Texts are read whole; a very long one is worked on alone.
Rows are independent, so null, repeated and equal ids don't matter. An empty table gives an empty table. Columns of the
documents pass through; new names that clash get an underscore in front.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import text as tx
from millrace.llm.common import every, map_arrow, unique_name

#: Words that a run has at least, and times its period that it is long at least (from 3 on the search is complete).
MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Primes below 2**30 that are a multiple of a high power of two plus one, with a primitive root of each.
PRIMES = ((998244353, 3), (469762049, 3), (167772161, 3))
#: Numbers that are transformed at once.
AT_ONCE = 1 << 19
RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


@lru_cache(maxsize=256)
def _roots(p: int, root: int, n: int) -> np.ndarray:
    """The first n / 2 powers of an n-th root of unity modulo p."""
    step, out = pow(root, (p - 1) // n, p), np.ones(max(1, n // 2), np.uint64)
    filled = 1
    while filled < len(out):  # each pass doubles the powers known
        k = min(filled, len(out) - filled)
        out[filled : filled + k] = out[:k] * np.uint64(pow(step, filled, p)) % np.uint64(p)
        filled += k
    return out


def transformed(x: np.ndarray, p: int, root: int) -> np.ndarray:
    """The transform of each row, in bit-reversed order; the row length is a power of two."""
    rows, n = x.shape
    q, size = np.uint64(p), n
    while size > 1:
        half = size // 2
        v = x.reshape(rows, n // size, 2, half)
        low, high = v[:, :, 0], v[:, :, 1]
        out = np.empty_like(v)
        out[:, :, 0] = (low + high) % q
        out[:, :, 1] = (low + q - high) * _roots(p, root, size) % q
        x, size = out.reshape(rows, n), half
    return x


def restored(x: np.ndarray, p: int, root: int) -> np.ndarray:
    """The inverse of ``transformed``."""
    rows, n = x.shape
    q, size, back = np.uint64(p), 2, pow(root, -1, p)
    while size <= n:
        half = size // 2
        v = x.reshape(rows, n // size, 2, half)
        low, high = v[:, :, 0], v[:, :, 1] * _roots(p, back, size) % q
        out = np.empty_like(v)
        out[:, :, 0] = (low + high) % q
        out[:, :, 1] = (low + q - high) % q
        x, size = out.reshape(rows, n), size * 2
    return x * np.uint64(pow(n, -1, p)) % q


def mismatches(values: np.ndarray, starts: np.ndarray, b: int, p: int, root: int) -> np.ndarray:
    """For each block and each distance from b to 2b - 1 the sum of squared differences modulo p.

    ``values`` goes on for 3b words behind every start.
    """
    q = np.uint64(p)
    block = values[starts[:, None] + np.arange(b)]
    window = np.zeros((len(starts), 2 * b), np.uint64)
    window[:, : 2 * b - 1] = values[starts[:, None] + np.arange(b, 3 * b - 1)]
    turned = np.zeros_like(window)
    turned[:, :b] = block[:, ::-1]
    product = restored(transformed(turned, p, root) * transformed(window, p, root) % q, p, root)[:, b - 1 : 2 * b - 1]
    squares = np.concatenate([np.zeros((len(starts), 1), np.uint64), np.cumsum(window * window % q, axis=1)], axis=1)
    own = (block * block % q).sum(axis=1, dtype=np.uint64)
    moved = squares[:, b : 2 * b] - squares[:, :b]
    return (own[:, None] + moved + 2 * (q - product)) % q


def occurrences(values: np.ndarray, starts: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) wherever a block of b words stands again from b to 2b - 1 words on."""
    most, primes = b * int(values.max()) ** 2, 1
    while np.prod([float(p) for p, _ in PRIMES[:primes]]) <= most * 1.01:
        primes += 1
        if primes > len(PRIMES):
            raise ValueError("more different words than the primes can tell apart")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, AT_ONCE // (2 * b))
    for at in range(0, len(starts), step):
        left = starts[at : at + step]
        zero = np.ones((len(left), b), bool)
        for p, root in PRIMES[:primes]:
            zero &= mismatches(values, left, b, p, root) == 0
            some = zero.any(axis=1)
            left, zero = left[some], zero[some]
            if not len(left):
                break
        row, distance = np.nonzero(zero)
        found.append((left[row], distance + b))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Words:
    """Numbered words (from 1 on) with digests of all their prefixes, to see how far two stretches agree."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.numbers, n = numbers, len(numbers)
        with np.errstate(over="ignore"):
            self.powers = np.full(n + 1, tx.ROOT, np.uint64)
            self.powers[0] = 1
            self.powers = np.multiply.accumulate(self.powers)
            terms = tx.mix(numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * self.powers[:n]
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def agree(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[x + n] - self.sums[x]) * self.powers[y - x] == self.sums[y + n] - self.sums[y]

    def stretches(self, s: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word of the stretch around each s in which words d apart agree, and the end of the agreement."""
        low, high = np.zeros_like(s), np.minimum(len(self.numbers) - d - s, len(self.numbers))
        while (low < high).any():  # the longest agreement to the right
            middle = (low + high + 1) // 2
            good = self.agree(s, s + d, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        right, low, high = s + low, np.zeros_like(s), s.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = self.agree(s - middle, s - middle + d, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return s - low, right

    def exact(self, s: int, d: int, start: int, end: int) -> tuple[int, int]:
        """``stretches`` of one seed compared word by word; digests that agree by chance make a stretch too long only."""
        x = self.numbers
        if np.array_equal(x[start:end], x[start + d : end + d]):
            return start, end
        differ = np.flatnonzero(x[:-d] != x[d:])
        k = int(np.searchsorted(differ, s))
        return (int(differ[k - 1]) + 1 if k else 0), (int(differ[k]) if k < len(differ) else len(x) - d)


def runs_of(numbers: np.ndarray, longest: int, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows of (start, length, period), sorted by start and period; ``longest``: words that a run can have at most."""
    n = len(numbers)
    words = Words(numbers)
    order = np.argsort(numbers, kind="stable")
    gap = np.full(n, np.iinfo(np.int64).max)
    same = numbers[order[1:]] == numbers[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    runs: dict[tuple[int, int], int] = {}
    b = 1
    while b * min_exponent <= longest:
        blocks = n // b
        gap = gap[: blocks * b] if b == 1 else gap[: blocks * 2].reshape(-1, 2).max(axis=1)  # the largest in each block
        starts = np.flatnonzero(gap < 2 * b) * b
        if runs and len(starts):
            reach = np.zeros(n + 1, np.int64)
            edges = np.array(list(runs))
            np.maximum.at(reach, edges[:, 0], edges[:, 1])
            starts = starts[np.maximum.accumulate(reach)[starts] < starts + 3 * b - 1]
        if len(starts):
            values = np.concatenate([numbers, np.zeros(3 * b, numbers.dtype)]).astype(np.uint64)
            s, d = occurrences(values, starts, b)
            first, end = words.stretches(s, d)
            long = end + d - first >= np.maximum(min_length, min_exponent * d)
            for at, distance, x, y in sorted(set(zip(*(v[long].tolist() for v in (s, d, first, end)), strict=True)), key=lambda r: r[1]):
                x, y = words.exact(at, distance, x, y)
                if y + distance - x >= max(min_length, min_exponent * distance):
                    runs.setdefault((x, y + distance), distance)  # a multiple of a period has the same ends and comes later
        b *= 2
    found = np.array([(x, y - x, q) for (x, y), q in runs.items()], dtype=np.int64).reshape(-1, 3)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def chunk_runs(texts: list[bytes], min_length: int, min_exponent: int) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """The words and the runs of each text."""
    known: dict[bytes, int] = {}
    words = [t.split() for t in texts]  # at blanks of ASCII alone, as these are bytes
    numbers = [np.array([known.setdefault(w, len(known) + 1) for w in ws], dtype=np.int64) for ws in words]
    sizes = np.array([len(ws) + 1 for ws in words])
    laid = np.zeros(int(sizes.sum()), np.int64)
    ends = np.cumsum(sizes)
    laid[ends - 1] = len(known) + 1 + np.arange(len(texts))  # the signs between, each of its own
    for x, end in zip(numbers, ends.tolist(), strict=True):
        laid[end - 1 - len(x) : end - 1] = x
    runs = runs_of(laid, int(sizes.max()) - 1, min_length, min_exponent)
    cuts = np.searchsorted(runs[:, 0], ends - sizes), np.searchsorted(runs[:, 0], ends)
    return words, [runs[x:y] - np.array([base, 0, 0]) for x, y, base in zip(*(c.tolist() for c in cuts), (ends - sizes).tolist(), strict=True)]


def collapsed_text(words: list[bytes], runs: np.ndarray) -> str:
    """The words outside runs, and of each run its first period, joined by one space."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words).decode()


def find_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``runs`` (start, length and period in words, sorted by start) and ``collapsed``."""
    if min_exponent < 3:
        raise ValueError("runs of an exponent under 3 may escape the blocks")
    names = [unique_name(docs, c) for c in ("n_words", "runs", "collapsed")]
    kept = [c for c in docs.columns if c != text_col]
    ordered = docs.select(*[c for c, name in zip(every(docs), docs.columns, strict=True) if name != text_col], F.col(f"`{text_col}`"))
    schema = ordered.select(*every(ordered)[:-1], F.lit(0).cast("long").alias(names[0]), F.lit(None).cast(RUN).alias(names[1]), F.lit("").alias(names[2])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, chunk in tx.chunks(b.column(len(kept))):
                words, runs = chunk_runs(chunk.cast(pa.binary()).to_pylist(), min_length, min_exponent)
                every_run = np.concatenate(runs)
                fields = pa.StructArray.from_arrays([pa.array(every_run[:, i]) for i in range(3)], names=["start", "length", "period"])
                begins = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                new = [pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(begins), fields), pa.array([collapsed_text(w, r) for w, r in zip(words, runs, strict=True)], pa.string())]
                yield pa.RecordBatch.from_arrays([*b.slice(row, len(chunk)).columns[: len(kept)], *new], names=[*kept, *names])

    return map_arrow(ordered, run, schema)


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, of which about every tenth goes on periodically from some word on, as the query wants it.

    With h the CRC-32 of the id: where 10 divides h, words from number a on become those of the period that starts there.
    A null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    split = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, split).alias("w"))
    n = F.size("w").cast("long")
    a = F.col("g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))

    def part(words: Column, start: Column, length: Column) -> Column:
        return F.slice(words, (start + 1).cast("int"), length.cast("int"))

    times = F.ceil((n - a) / p).cast("int")
    tail = part(F.flatten(F.array_repeat(part(F.col("w"), a, p), times)), F.lit(0), n - a)
    planted = F.array_join(F.concat(part(F.col("w"), F.lit(0), a), tail), " ")
    return some.select("doc_id", F.when(F.col("w").isNotNull() & (n > 0), planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(docs: DataFrame) -> DataFrame:
    found = find_runs(with_planted_tails(docs))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length = -F.col("best.less")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
