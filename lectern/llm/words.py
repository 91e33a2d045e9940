"""Word spans and hashes of whole texts, one Arrow batch at a time.

A word is a maximal run of bytes other than space and the five ASCII control
blanks (0x09-0x0D).  These bytes never occur inside a multi-byte UTF-8
character, so working on bytes gives the words of ``[^\\x20\\x09-\\x0D]+``.
Everything here is a small numpy helper for functions that Spark runs over
Arrow batches; a null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: The same words as a regular expression, for SQL and for Spark's own functions.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one numpy pass works on, unless one text alone is longer.
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(*parts: int) -> int:
    """One 64-bit number from a few integers."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            h = mix(np.array([h * np.uint64(31) + np.uint64(p & 0xFFFFFFFFFFFFFFFF) + np.uint64(_BASE)], np.uint64))[0]
    return int(h)


#: A random 64-bit number for each byte value, the same in every process.
_TABLE = mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(_BASE))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def powers(n: int) -> np.ndarray:
    """The factors of n places in a rolling hash."""
    return _power(_BASE, n)


def inverse_powers(n: int) -> np.ndarray:
    return _power(_INVERSE, n)


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end]; equal slices hash equally."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_INVERSE, len(values) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """The words of some consecutive texts of a batch.

    data: the bytes; starts, ends: of each word; doc: its text's index in the
    batch; first: for text i of this chunk, the index of its first word, so
    that its words are first[i]:first[i + 1]; lo, hi: the texts' indexes.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    lo: int
    hi: int

    def hashes(self) -> np.ndarray:
        return rolling(_TABLE[self.data], self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return ends, (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))


def words(column: pa.Array, lower: bool = False) -> Iterator[Words]:
    """The words of a string column in chunks of about CHUNK_BYTES; lower: A-Z become a-z."""
    if column.null_count:
        column = column.fill_null("")
    at, data = buffers(column)
    n, lo = len(column), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK_BYTES, "right")) - 1)
        part = data[at[lo] : at[hi]]
        if lower:
            part = _LOWER[part]
        bounds = at[lo : hi + 1] - at[lo]
        inside = ~_SPACE[part]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(part):
            before[0] = False
            before[1:] = inside[:-1]
            before[bounds[:-1][bounds[:-1] < len(part)]] = False
            after[-1] = False
            after[:-1] = inside[1:]
            after[bounds[1:][bounds[1:] > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        first = np.searchsorted(starts, bounds)
        yield Words(part, starts, ends, np.repeat(np.arange(lo, hi), np.diff(first)), first, lo, hi)
        lo = hi


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and each run's first word."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(n - k + 1)
    last = np.repeat(first[1:], np.diff(first))[at]  # the end of each word's text
    at = at[at + k <= last]
    return rolling(mix(hashes), at, at + k), at
