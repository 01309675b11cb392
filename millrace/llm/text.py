"""Words and shingles of a batch of texts as numpy arrays, for operators that run inside Arrow batches.

A word is a run of bytes outside space and 0x09 to 0x0D; as every byte of a non-ASCII character is above 0x7F,
working on UTF-8 bytes gives the same words as working on characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 2 << 20

#: Longer words are hashed from a digest: for polynomials modulo 2**64 long words that collide are known.
LONG_WORD = 256

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit changes every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


with np.errstate(over="ignore"):
    BYTE_VALUE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
ROOT = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
ROOT_INVERSE = pow(ROOT, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


@dataclass
class Words:
    """Words of consecutive texts: hash and text number of each word, and where each text's words begin."""

    hashes: np.ndarray
    begins: np.ndarray

    def of(self, text: int) -> np.ndarray:
        return self.hashes[self.begins[text] : self.begins[text + 1]]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a string column of about ``limit`` bytes, each with its first row's number; nulls become empty."""
    column = pc.fill_null(column, "")
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))])
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(sizes, sizes[row] + limit, side="right")) - 1)
        yield row, column.slice(row, end - row)
        row = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offsets of its texts in them."""
    wide = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = wide.buffers()
    o = np.frombuffer(offsets, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return raw, o - o[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; a word never reaches over the end of a text."""
    blank = BLANK[raw]
    first = np.ones(len(raw) + 1, dtype=bool)  # a text's first byte follows a break
    first[1:-1] = blank[:-1]
    first[offsets] = True
    word = ~blank
    starts = np.flatnonzero(word & first[:-1])
    last = np.ones(len(raw), dtype=bool)
    last[:-1] = blank[1:] | first[1:-1]
    return starts, np.flatnonzero(word & last) + 1


def words(column: pa.Array, lower: bool = True) -> Words:
    """Hashes of the words of a string column without nulls, lower-cased (A-Z only) or as they are."""
    raw, offsets = utf8(column)
    starts, ends = word_bounds(raw, offsets)
    with np.errstate(over="ignore"):
        terms = BYTE_VALUE[LOWERED[raw] if lower else raw] * _power(ROOT, len(raw))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        h = (sums[ends] - sums[starts]) * _power(ROOT_INVERSE, len(raw) + 1)[starts]
        h = mix(h + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        word = raw[starts[k] : ends[k]]
        h[k] = int.from_bytes(hashlib.blake2b((LOWERED[word] if lower else word).tobytes(), digest_size=8).digest(), "little")
    return Words(h, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` consecutive words."""
    n = max(0, len(hashes) - width + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width if n else 0):
            rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k])
    return rolled


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a text of fewer words, but not none, is one shingle."""
    w = words(column)
    rolled = windows(w.hashes, width)
    with np.errstate(over="ignore"):
        for t in range(len(column)):
            a, b = int(w.begins[t]), int(w.begins[t + 1])
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                h = np.full(1, b - a, dtype=np.uint64)
                for x in w.hashes[a:b]:
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x)
                yield h
            else:
                yield np.zeros(0, np.uint64)
