"""Substring dedup by merged Burrows-Wheeler transforms (operator 9).

Each block of a shard is sorted in two halves; their transforms are merged by refining an
interleave bit by bit: read the symbols in the interleave's order and deal them out stably, and the
order is right one symbol deeper. Where equal runs first part gives the common prefixes, so
intervals of windows with a common prefix of the full length come out without sorting the
suffixes of both halves together. A symbol is the four bytes before a position, in byte order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.repeats import copies, settled, with_spans
from lodestone.llm.textbytes import buffer_of

WINDOW, ANCHOR, SYMBOL = 200, 64, 4

_VALUE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rotations(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of all rotations of a byte text by their first ``depth`` bytes at least, by prefix doubling."""
    n = len(text)
    key, have = text.astype(np.uint64), 1
    while have < 8:
        key = (key << np.uint64(8 * have)) | np.roll(key, -have)
        have *= 2
    while True:
        order = np.argsort(key)
        k = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate(([0], np.cumsum(k[1:] != k[:-1]))).astype(np.uint64)
        if have >= depth or int(rank[order[-1]]) == n - 1:
            return order
        key = (rank << np.uint64(32)) | np.roll(rank, -(have % n))
        have *= 2


def before(text: np.ndarray) -> np.ndarray:
    """The SYMBOL bytes before each position of a circular text, as one number."""
    out = np.zeros(len(text), np.uint32)
    for k in range(SYMBOL, 0, -1):
        out = (out << np.uint32(8)) | np.roll(text, k)
    return out


def merge(left: np.ndarray, right: np.ndarray, rounds: int, last: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of two transforms after so many rounds: whether each place is from the right, and its interval.

    Places with one interval number have rounds * SYMBOL bytes of common prefix. With ``last`` set the first round takes
    only the ``last`` bytes next before a place, which become the end of the prefix: its length is then (rounds - 1) * SYMBOL + last.
    """
    names, both = np.unique(np.concatenate((left, right)), return_inverse=True)
    kind = np.uint16 if len(names) <= 65536 else np.uint32
    both = both.astype(kind)
    a, b = both[: len(left)], both[len(left) :]
    take = np.concatenate((np.zeros(len(a), bool), np.ones(len(b), bool)))
    group = np.zeros(len(take), np.int32)
    symbols = np.empty(len(take), kind)
    # The first bytes of a symbol name come first in its order, so a cut name is a coarser number in the same order.
    cut = (names >> np.uint32(8 * (SYMBOL - last))).astype(np.uint32) if last else None
    for r in range(rounds):
        symbols[~take] = a
        symbols[take] = b
        order = np.argsort(symbols, kind="stable")
        take, group, s = take[order], group[order], symbols[order]
        if r == 0 and cut is not None:
            s = cut[s]
        parts = (s[1:] != s[:-1]) | (group[1:] != group[:-1])
        group = np.concatenate((np.zeros(1, np.int32), np.cumsum(parts, dtype=np.int32)))
    return take, group


def repeated_starts(segments: list[bytes], counts: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each segment, which window starts have a window that occurs twice, counting copies of segments."""
    sides = [list(range(s, len(segments), 2)) for s in (0, 1)]
    flags: list[np.ndarray] = [np.zeros(0, bool)] * len(segments)
    texts, weights, owners = [], [], []
    for side in sides:
        sizes = np.array([len(segments[i]) for i in side], np.int64)
        text = np.frombuffer(b"".join(segments[i] for i in side), np.uint8)
        ends = np.repeat(np.cumsum(sizes), sizes)
        texts.append(text)
        weights.append(np.where(ends - np.arange(len(text)) >= window, np.repeat(counts[side], sizes), 0))
        owners.append((side, sizes))
    orders = [rotations(t, window) for t in texts]
    merged = [before(t)[o] for t, o in zip(texts, orders)]
    take, group = merge(merged[0], merged[1], -(-window // SYMBOL), window % SYMBOL)
    weight = np.empty(len(take), np.int64)
    weight[~take], weight[take] = weights[0][orders[0]], weights[1][orders[1]]
    twice = np.bincount(group, weights=weight)[group] >= 2
    for s, picked in ((0, ~take), (1, take)):
        found = np.zeros(len(texts[s]), bool)
        found[orders[s]] = twice[picked]
        found &= weights[s] > 0
        side, sizes = owners[s]
        for i, part in zip(side, np.split(found, np.cumsum(sizes)[:-1])):
            flags[i] = part
    return flags


def covered(starts: np.ndarray, window: int) -> list[int]:
    """Flat [begin, end) pairs of what windows at ascending ``starts`` cover."""
    if not len(starts):
        return []
    new = np.concatenate(([True], starts[1:] > starts[:-1] + window))
    last = np.concatenate((starts[:-1][new[1:]], starts[-1:]))
    return np.column_stack((starts[new], last + window)).ravel().tolist()


def _settle(window: int):
    def settle(segments, group, counts, low):
        if len(segments) < 2:
            return [[0, len(s)] if n > 1 else [] for s, n in zip(segments, counts)]
        flags = repeated_starts(segments, counts, window)
        return [covered(np.flatnonzero(f), window) for f in flags]

    return settle


def byte_values(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, off = buffer_of(texts)
    return _VALUE[buf], off


def union_spans(flat: list[list[int]]) -> np.ndarray:
    """Maximal [begin, end) spans of a union; touching spans are one."""
    pairs = np.array([p for f in flat for p in zip(f[::2], f[1::2])], np.int64).reshape(-1, 2)
    if not len(pairs):
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate(([True], pairs[1:, 0] > reach[:-1]))
    at = np.flatnonzero(new)
    return np.column_stack((pairs[at, 0], reach[np.concatenate((at[1:], [len(pairs)])) - 1]))


def _remove(window: int, texts: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for d, t, spans, whole in zip(*(batch.column(k).to_pylist() for k in range(4))):
                raw = (t or "").encode()
                if whole and len(raw) >= window:
                    spans = [[0, len(raw)]]
                found = union_spans(spans or [])
                kept, at = [], 0
                for b, e in found.tolist():
                    kept.append(raw[at:b])
                    at = e
                left = b"".join([*kept, raw[at:]])
                row = (d, len(raw), len(raw) - len(left), len(found), hashlib.sha256(left).hexdigest())
                rows.append((*row, left, found.ravel().tolist()) if texts else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
            width = 7 if texts else 5
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(width)], names=names[:width])

    return run


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """Remove each byte covered by a ``window``-byte string that starts anywhere else too, in any document.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row, and with ``texts`` the kept bytes and
    removed spans. Matches never cross documents and are judged on the input; repeated rows are occurrences of
    their own. Null and shorter texts lose nothing; rows with a null doc_id are returned whole and
    are no occurrences. Extra columns are ignored; an empty table gives no rows.
    """
    found = settled(docs, window, min(ANCHOR, -(-window // 3)), byte_values, str.encode, lambda raw, a, n: raw[a : a + n], _settle(window), lambda n, low: covered(np.flatnonzero(n > 1), window), across=False)
    length = F.col("c") * F.col("reps") + (window - 1)
    whole_segment = F.array(F.col("a").cast("long"), (F.col("a") + length).cast("long"))
    spans = F.when(F.col("n") > 1, whole_segment).otherwise(F.transform("answer", lambda x: x + F.col("a")))
    rows = found.select("doc_id", "crc", spans.alias("spans")).where(F.size("spans") > 0)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return with_spans(docs, rows, copies(docs)).mapInArrow(_remove(window, texts), out + (", kept binary, spans array<long>" if texts else ""))
