"""Windows routed to shards by their anchors.

A window's anchor is the k-gram in it with the smallest hash (the leftmost of equals). Equal windows
have equal anchors at equal places, so all occurrences of a repeated window meet under the
anchor's hash, whatever surrounds them. Neighbouring windows that share one anchor occurrence
form a segment; a document yields about two segments a window length.
"""

from __future__ import annotations

import numpy as np

from lodestone.llm.textbytes import powers

_POSITION_BITS = np.uint64(24)
_POSITION = (np.uint64(1) << _POSITION_BITS) - np.uint64(1)
#: Longer documents are cut into pieces that overlap by one window less one, so every window is in one piece.
PIECE = 1 << 18


def kgrams(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of k consecutive 64-bit values at each position where they exist."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = np.uint64(0xC2B2AE3D27D4EB4F)
    h, span = values * np.uint64(0x9E3779B97F4A7C15), 1
    out, have = None, 0
    while span <= k:
        if k & span:
            part = h[have : have + n]
            out = part.copy() if out is None else out * step + part
            have += span
        if span * 2 <= k:
            h = h[: len(h) - span] * step + (h[span:] ^ (h[span:] >> np.uint64(29)))
        span *= 2
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys, by doubling."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    m, span = keys, 1
    while span * 2 <= width:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    return np.minimum(m[:n], m[width - span : width - span + n])


def runs(values: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of documents given as consecutive ranges of ``values`` (n+1 bounds in ``first``).

    Returns document index, anchor hash, first window's start inside the document, and number of windows.
    """
    empty = np.zeros(0, np.int64)
    grams = kgrams(values, k)
    width = window - k + 1
    if len(grams) < width:
        return empty, np.zeros(0, np.uint64), empty, empty
    keys = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    least = window_minima(keys, width)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(least)]
    start = np.flatnonzero(first[1:][doc] - np.arange(len(least)) >= window)
    if not len(start):
        return empty, np.zeros(0, np.uint64), empty, empty
    v = least[start]
    head = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (start[1:] != start[:-1] + 1))))
    count = np.diff(np.concatenate((head, [len(v)])))
    d = doc[start[head]]
    return d, grams[(v[head] & _POSITION).astype(np.int64)], start[head] - first[d], count


_BASE = 0x9E3779B97F4A7C15 | 1
_UP = powers(np.uint64(_BASE), PIECE + 4096)
_DOWN = powers(np.uint64(pow(_BASE, -1, 1 << 64)), PIECE + 4096)


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each range, from one running sum; at most PIECE + 4096 values."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _UP[: len(values)], dtype=np.uint64)))
    h = (total[end] - total[start]) * _DOWN[start] + (end - start).astype(np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def segments(values: np.ndarray, first: np.ndarray, window: int, k: int):
    """Yield (document, anchor hash, content hash, start, windows) arrays of all segments of a batch."""
    i, n = 0, len(first) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(first, first[i] + PIECE, "right")) - 1)
        j = min(j, n)
        whole, base = values[first[i] : first[j]], first[i : j + 1] - first[i]
        if len(whole) <= PIECE:
            parts = [(0, whole, base)]
        else:
            cuts = range(0, max(1, len(whole) - window + 1), PIECE)
            parts = [(b, p := whole[b : b + PIECE + window - 1], np.array([0, len(p)])) for b in cuts]
        for b, part, at in parts:
            d, m, a, c = runs(part, at, window, k)
            s = at[d] + a
            yield d + i, m, range_hashes(part, s, s + c + window - 1), a + b, c
        i = j
