"""Vectorised word and shingle hashing over Arrow string columns (numpy inside Spark tasks).

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A null text counts as empty.
All functions work on slices of whole documents, so memory follows the slice, not the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD_BREAKS = np.zeros(256, bool)
WORD_BREAKS[[9, 10, 11, 12, 13, 32]] = True
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32

_RNG = np.random.default_rng(20240601)
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHINGLE_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(step: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, step, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def buffer_of(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and n+1 offsets into them; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    large = pa.large_binary() if pa.types.is_large_binary(col.type) or pa.types.is_binary(col.type) else pa.large_string()
    if col.type != large:
        col = col.cast(large)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_large_binary(large) else "")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, col.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, target: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of documents with about ``target`` bytes each; one long document makes its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + target, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (n+1 values)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~WORD_BREAKS[buf]
    begins = np.zeros(len(buf) + 1, bool)
    begins[offsets[:-1]] = True
    begins = begins[:-1]
    start = word.copy()
    start[1:] &= ~word[:-1] | begins[1:]
    last = np.zeros(len(buf), bool)
    last[:-1] = word[:-1] & (~word[1:] | begins[1:])
    last[-1] = word[-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.zeros(len(buf) + 1, np.int32)
    first[starts] = 1
    first[0] = 0
    which = np.cumsum(first[:-1])
    if starts[0] == 0:
        base = starts
    else:
        base = np.concatenate(([0], starts))
    within = np.arange(len(buf)) - base[which]
    values = _BYTE_VALUE[buf] * powers(_STEP, int(within.max()) + 1)[within]
    values[WORD_BREAKS[buf]] = 0
    return mix64(np.add.reduceat(values, starts) + lengths.astype(np.uint64) * _STEP)


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles (a shorter document is one shingle), and n+1 offsets by document."""
    counts = np.diff(first)
    step = powers(_SHINGLE_STEP, n)
    if len(words) >= n:
        rolled = sum(words[k : len(words) - n + 1 + k] * step[k] for k in range(n))
        rolled = mix64(rolled + np.uint64(n))
    else:
        rolled = np.zeros(0, np.uint64)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out = np.concatenate(([0], np.cumsum(sizes)))
    take = np.arange(out[-1]) - np.repeat(out[:-1], sizes) + np.repeat(first[:-1], sizes)
    short = np.flatnonzero((counts > 0) & (counts < n))
    take[out[short]] = 0
    hashes = rolled[take] if len(rolled) else np.zeros(len(take), np.uint64)
    for d in short:
        w = words[first[d] : first[d + 1]]
        hashes[out[d]] = mix64(np.array([np.sum(w * step[: len(w)]) + np.uint64(len(w))], np.uint64))[0]
    return hashes, out
