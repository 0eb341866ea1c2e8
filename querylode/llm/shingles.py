"""Hashed words and word shingles of whole batches of texts, in numpy.

A word's hash is a polynomial of random 64-bit values of its bytes, taken from one running sum over the
batch's bytes, then mixed. It is the same in every process. Two different words or shingles
of one text or pair of texts share a 64-bit hash with a chance of about 2**-64 for each pair of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> _SHIFT)) * _MIX1
    x = (x ^ (x >> _SHIFT)) * _MIX2
    return x ^ (x >> _SHIFT)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_LOWERED = _BYTE.copy()
_LOWERED[65:91] = _BYTE[97:123]
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Also ends words at every ASCII sign that is neither letter nor digit.
_SIGNS = BLANK.copy()
_SIGNS[:128] |= ~np.array([chr(i).isalnum() for i in range(128)])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64; kept for the next batch."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column one after the other, and where each row begins and the last ends."""
    column = column.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, signs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the bytes, and the index of the first word of each row (with one more at the end)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~(_SIGNS if signs else BLANK)[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(raw)]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWERED if lower else _BYTE)[raw] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def hashed_words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, A-Z lower-cased, and the index of each row's first word."""
    raw, offsets = text_buffer(column)
    starts, ends, rows = word_spans(raw, offsets)
    return word_hashes(raw, starts, ends, lower), rows


def combined(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words."""
    n = len(words) - k + 1
    total = np.full(max(n, 0), k, np.uint64)
    for i in range(k if n > 0 else 0):
        total = total * _STEP + words[i : n + i]
    return mix(total)


def slices(column: pa.Array, size: int = 1 << 20) -> Iterator[pa.Array]:
    """Parts of a text column of about so many bytes: the arrays made of a text take some 50 bytes for each of its own, and a batch may hold many long ones."""
    column = column.cast(pa.binary()).fill_null(b"")
    ends = np.cumsum(pa.compute.binary_length(column).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield column.slice(at, upto - at)
        at = upto


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each row its distinct k-word shingles as sorted hashes: all words as one shingle if they are fewer, none without words."""
    for part in slices(column):
        words, rows = hashed_words(part)
        runs = combined(words, k)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            else:
                yield combined(words[a:b], b - a) if b > a else words[:0]
