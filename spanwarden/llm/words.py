"""Vectorised words, word hashes and word n-grams over Arrow string buffers.

Texts stay UTF-8 bytes: both word definitions in use treat every non-ASCII byte as a word byte,
so byte tables decide. A word's 64-bit hash comes from prefix sums of byte codes times powers of
an odd number modulo 2**64, mixed afterwards; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from spanwarden.llm.common import sliced

U64 = np.uint64
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK + 1), base, U64)
        step[0] = 1
        have = _powers[base] = np.cumprod(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_separated() -> np.ndarray:
    word = np.ones(256, bool)
    word[9:14] = False
    word[32] = False
    return word


def alphanumeric() -> np.ndarray:
    """Digits, lower-case ASCII letters (upper case is folded before) and all non-ASCII bytes."""
    word = np.zeros(256, bool)
    word[0x30:0x3A] = word[0x61:0x7B] = word[0x80:] = True
    word[0x41:0x5B] = True
    return word


@dataclass
class Words:
    raw: np.ndarray  # bytes of the texts, one after another
    bounds: np.ndarray  # of the texts in raw, one more than texts
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text's words, one more than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def prefix(raw: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = np.empty(len(raw) + 1, U64)
    out[0] = 0
    np.cumsum(codes[raw] * _power(_BASE, len(raw)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = _power(_BASE_INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64))


def split(raw: np.ndarray, bounds: np.ndarray, word: np.ndarray, fold: bool) -> Words:
    n = len(raw)
    inside = word[raw]
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[bounds] = False
    start = np.flatnonzero(inside & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[bounds] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    codes = BYTE_CODES[lower_ascii()] if fold else BYTE_CODES
    return Words(raw, bounds, start, end, doc, span_hash(prefix(raw, codes), start, end), first)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from each position, whether those k words are of one text)."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, bool)
    out = np.zeros(n, U64)
    for i in range(k):
        out *= U64(0xC2B2AE3D27D4EB4F)
        out += w.hash[i : i + n]
    return mix(out), w.doc[:n] == w.doc[k - 1 :]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, text bounds, is null) of a string column; a null text is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    null = np.asarray(column.is_null())
    if null.any():
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, bounds, null


def blocks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of slices that fit the cache."""
    raw, bounds, _ = buffers(column)
    for i, j in sliced(bounds, limit):
        yield i, j, raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]


def per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each text's words."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
