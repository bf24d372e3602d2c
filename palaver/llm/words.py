"""Words, shingles and their hashes as numpy arrays, straight from Arrow string buffers.

A word is a run of bytes other than the ASCII white space ``\\x20 \\x09-\\x0D``; A-Z count as a-z.
A word's hash is made of its bytes eight at a time, so that a whole batch is hashed by a few array
operations on as many numbers as it has words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa

#: Bytes of text that a task works on at once (a single longer text is taken whole).
SLICE_BYTES = 1 << 20

_libc = ctypes.CDLL(None)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] = LOWER[97:123]
_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def as_fraction(threshold: float) -> tuple[int, int]:
    """A threshold as the fraction that its decimal digits say, to a millionth: similarities are compared in whole numbers."""
    exact = Fraction(str(threshold)).limit_denominator(1_000_000)
    return exact.numerator, exact.denominator


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    offsets = np.asarray(string_buffers(texts)[1])
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield start, stop
        start = stop
    settle()


def settle() -> None:
    """Hands freed memory back to the system: a Python worker lives on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and each text's bounds in them (nulls: empty)."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not wide and not (pa.types.is_string(texts.type) or pa.types.is_binary(texts.type)):
        texts, wide = texts.cast(pa.large_string()), True
    _, offs, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def word_bounds(raw: np.ndarray, bounds: np.ndarray, kept: np.ndarray = _INSIDE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of ``kept`` bytes); a text's bound ends a word."""
    inside = np.zeros(len(raw) + 2, bool)
    np.take(kept, raw, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    split = bounds[inside[bounds] & inside[bounds + 1]]  # a text begins where another's word would go on
    if len(split):
        split = np.unique(split)
        starts, ends = np.sort(np.r_[starts, split]), np.sort(np.r_[ends, split])
    return starts, ends


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, by its (lower-cased) bytes alone."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    low = np.zeros(len(raw) + 8, np.uint8)
    np.take(LOWER, raw, out=low[: len(raw)])
    eight = np.ndarray(len(raw) + 1, "<u8", low, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    out = mix(eight[starts] & _FIRST[np.minimum(size, 8)])
    long = np.flatnonzero(size > 8)
    if len(long):
        parts = -(-size[long] // 8)
        firsts = np.cumsum(parts) - parts
        k = np.arange(parts.sum()) - np.repeat(firsts, parts)
        at = np.repeat(starts[long], parts) + 8 * k
        value = eight[at] & _FIRST[np.minimum(np.repeat(ends[long], parts) - at, 8)]
        out[long] = np.add.reduceat(mix(value + k.astype(np.uint64) * _BASE), firsts)
    return mix(out + size.astype(np.uint64) * _BASE)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and bounds: text i has ``words[bounds[i]:bounds[i + 1]]``."""
    raw, bounds = string_buffers(texts)
    starts, ends = word_bounds(raw, bounds)
    return hash_spans(raw, starts, ends), np.searchsorted(starts, bounds)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; a shorter sequence is one shingle as a whole."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, np.uint64(width))
    for k in range(width):
        out = mix(out * np.uint64(0x9DDFEA08EB382D69) + words[k : len(words) - width + 1 + k])
    return out
