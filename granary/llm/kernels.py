"""Vectorised text kernels used inside Arrow tasks: word hashes, shingle sets, bottom-k sketches.

A word is a run of ``[^\\x20\\x09-\\x0D]``; A-Z count as a-z.  Every function takes one Arrow batch and works
through it in chunks of about ``CHUNK`` bytes, so memory follows the longest single text, never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled by one pass of array operations.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_MASK = (1 << 64) - 1
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply): equal in, equal out, every bit spread."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(_FOLD.astype(np.uint64) * _MULT + np.uint64(7))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        _powers = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b), dtype=np.uint64)]) for b in (_STEP, inverse))  # type: ignore[assignment]
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each, at least one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts, and where each text's words begin (one more than texts)."""
    n = len(data)
    counts = np.zeros(len(offsets), np.int64)
    if not n:
        return np.zeros(0, np.uint64), counts
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | edge[1:])) + 1
    forward, back = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * forward[:n], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets)


def word_counts(column: pa.Array) -> np.ndarray:
    """The number of words of every row's text."""
    data, offsets = utf8(column)
    out = np.zeros(len(offsets) - 1, np.int64)
    for a, b in chunks(offsets):
        word = ~_SPACE[data[offsets[a] : offsets[b]]]
        at = offsets[a : b + 1] - offsets[a]
        first = word.copy()
        first[1:] &= ~word[:-1]
        begin = at[:-1][at[:-1] < at[1:]]
        first[begin] = word[begin]
        sums = np.concatenate([[0], np.cumsum(first)])
        out[a:b] = sums[at[1:]] - sums[at[:-1]]
    return out


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole sequence when it is shorter; none without words."""
    if not len(words):
        return words
    width_here = min(width, len(words))
    total = np.full(len(words) - width_here + 1, width_here, np.uint64)
    for k in range(width_here):
        total = total * _MULT + words[k : len(words) - width_here + 1 + k]
    return mix(total)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For every row the sorted distinct shingle hashes of its text."""
    data, offsets = utf8(column)
    for a, b in chunks(offsets):
        words, at = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        every = shingle_hashes(words, width)
        for k in range(b - a):
            n = at[k + 1] - at[k]
            own = every[at[k] : at[k + 1] - width + 1] if n >= width else shingle_hashes(words[at[k] : at[k + 1]], width)
            yield np.unique(own)
