"""Substring dedup of word windows with a compressed FM-index per shard (operator 5).

Each block of a shard is indexed: the Burrows-Wheeler transform of its words in a wavelet matrix
of packed bits with running counts. Its segments are then streamed against it from right to left,
all at once: a backward step is two ranks for every segment. Matching statistics are cut at the
window length: when a match has that length, its interval is first widened to one word less. The
interval of each full-length match gives the smallest doc_id that holds the window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bwt import union_spans
from lodestone.llm.repeats import copies, settled, with_spans
from lodestone.llm.textbytes import buffer_of, slices, word_hashes, words_of

WINDOW, ANCHOR = 50, 8
#: Bytes of different segments, at 8 bytes a word, up to which an anchor is indexed: an index takes some 80 bytes a word.
INDEXED = 1 << 22


class WaveletMatrix:
    """Ranks over a sequence of small numbers: one packed bit vector with running counts per bit level."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels, self.n = levels, len(seq)
        self.words, self.counts, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bits = ((seq >> level) & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, bool)
            padded[: self.n] = bits
            words = np.packbits(padded.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
            self.words.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))))
            self.zeros.append(self.n - int(bits.sum()))
            seq = np.concatenate((seq[~bits], seq[bits]))

    def walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where prefix [0, i) ends in the last level's order of ``symbol``; differences of walks are ranks."""
        one = np.uint64(1)
        for k in range(self.levels):
            block = i >> 6
            ones = self.counts[k][block] + np.bitwise_count(self.words[k][block] & ((one << (i & 63).astype(np.uint64)) - one))
            i = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i


class FMIndex:
    """An index of a circular sequence of numbers 0..sigma-1, sorted to a depth of at least ``depth``."""

    def __init__(self, text: np.ndarray, depth: int):
        self.n = n = len(text)
        self.depth = depth
        rank, have = text.astype(np.uint32), 1
        ranks = {1: rank}
        while have < depth:
            key = (rank.astype(np.uint64) << np.uint64(32)) | np.roll(rank, -(have % n))
            order = np.argsort(key, kind="stable")
            k = key[order]
            rank = np.empty(n, np.uint32)
            rank[order] = np.concatenate(([0], np.cumsum(k[1:] != k[:-1]))).astype(np.uint32)
            have *= 2
            ranks[have] = rank
        self.order = np.argsort(rank, kind="stable")
        self.ranks = ranks
        sigma = int(text.max()) + 1
        self.levels = max(1, (sigma - 1).bit_length())
        self.matrix = WaveletMatrix(text[self.order - 1], self.levels)
        symbols = np.arange(sigma)
        smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))[:-1]
        self.base = smaller - self.matrix.walk(symbols, np.zeros(sigma, np.int64))

    def intervals(self, depth: int) -> np.ndarray:
        """For each place in the order, the number of its interval of rotations with ``depth`` common numbers."""
        have = max(d for d in self.ranks if d <= depth)
        rank = self.ranks[have]
        a, b = rank[self.order], np.roll(rank, -((depth - have) % self.n))[self.order]
        parts = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return np.concatenate(([0], np.cumsum(parts)))

    def common_prefixes(self) -> np.ndarray:
        """Common prefix of each place in the order with the place before, up to the sorted depth; -1 at both ends."""
        lcp, a, b = np.zeros(self.n - 1, np.int64), self.order[:-1], self.order[1:]
        for d in sorted(self.ranks, reverse=True):
            rank = self.ranks[d]
            lcp += d * (rank[(a + lcp) % self.n] == rank[(b + lcp) % self.n])
        return np.concatenate(([-1], lcp, [-1]))

    def shorten(self, lcp: np.ndarray, symbol: int, lo: int, hi: int) -> tuple[int, int, int]:
        """The longest match of ``symbol`` before a prefix of the interval's match: (lo, hi, length), length 0 if none."""
        depth = -1
        while depth != 0:
            depth = max(int(lcp[lo]), int(lcp[hi]), 0)
            while lo > 0 and lcp[lo] >= depth:
                lo -= 1
            while hi < self.n and lcp[hi] >= depth:
                hi += 1
            l, h = self.base[symbol] + self.matrix.walk(np.array([symbol, symbol]), np.array([lo, hi]))
            if l < h:
                return int(l), int(h), depth + 1
        return 0, self.n, 0

    def matching_intervals(self, queries: list[np.ndarray], window: int) -> list[np.ndarray]:
        """For each query and start of a full window in it, the index's window interval there, or -1.

        These are matching statistics cut at ``window``. Queries must use the index's numbers 0..sigma-1.
        """
        near = self.intervals(window - 1)
        starts = np.flatnonzero(np.concatenate(([True], near[1:] != near[:-1], [True])))
        full = self.intervals(window)
        lcp = None
        sizes = np.array([len(q) for q in queries])
        flat, at = np.concatenate(queries), np.concatenate(([0], np.cumsum(sizes)))
        out = np.full(len(flat), -1, np.int64)
        who = np.argsort(-sizes, kind="stable")
        lo, hi, length = np.zeros(len(who), np.int64), np.full(len(who), self.n, np.int64), np.zeros(len(who), np.int64)
        for t in range(int(sizes.max())):
            active = int(np.searchsorted(-sizes[who], -t, "left"))
            place = at[who[:active]] + sizes[who[:active]] - 1 - t
            c = flat[place]
            ends = self.matrix.walk(np.concatenate((c, c)), np.concatenate((lo[:active], hi[:active])))
            l, h, m = self.base[c] + ends[:active], self.base[c] + ends[active:], length[:active] + 1
            broken = np.flatnonzero(l >= h)
            if len(broken):
                lcp = self.common_prefixes() if lcp is None else lcp
                for q in broken.tolist():
                    l[q], h[q], m[q] = self.shorten(lcp, int(c[q]), int(lo[q]), int(hi[q]))
            whole = m >= window
            out[place[whole]] = full[l[whole]]
            g = near[l[whole]]
            l[whole], h[whole], m[whole] = starts[g], starts[g + 1], window - 1
            lo[:active], hi[:active], length[:active] = l, h, m
        return np.split(out, at[1:-1])


def smallest_holders(segments: list[np.ndarray], low: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each segment and start of a full window in it, the smallest ``low`` of segments with that window."""
    sizes = np.array([len(s) for s in segments])
    text = np.concatenate(segments)
    index = FMIndex(text, window)
    ends = np.repeat(np.cumsum(sizes), sizes)
    holder = np.where(ends - np.arange(len(text)) >= window, np.repeat(low, sizes), np.iinfo(np.int64).max)
    groups = index.intervals(window)
    first = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    least = np.minimum.reduceat(holder[index.order], first)
    return [least[iv[: max(0, len(s) - window + 1)]] for s, iv in zip(segments, index.matching_intervals(segments, window))]


def holder_runs(least: np.ndarray) -> list[int]:
    """Flat (begin, end, smallest doc_id) of runs of windows with one smallest doc_id."""
    new = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    stop = np.concatenate((new[1:], [len(least)]))
    return np.column_stack((new, stop, least[new])).ravel().tolist()


def _settle(window: int):
    def settle(raw, group, counts, low):
        names: dict[bytes, int] = {}
        segments = [np.array([names.setdefault(w, len(names)) for w in s.split(b" ")], np.int64) for s in raw]
        return [holder_runs(least) for least in smallest_holders(segments, low, window)]

    return settle


def word_values(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, off = buffer_of(texts)
    values, first = [], [np.zeros(1, np.int64)]
    total = 0
    for i, j in slices(off):
        part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, f = words_of(part, o)
        values.append(word_hashes(part, starts, ends))
        first.append(f[1:] + total)
        total += len(starts)
    return np.concatenate(values) if values else np.zeros(0, np.uint64), np.concatenate(first)


def _words(text: str) -> list[bytes]:
    return text.encode().split()


def _remove(window: int, texts: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for d, t, spans, whole in zip(*(batch.column(k).to_pylist() for k in range(4))):
                words = (t or "").encode().split()
                if whole and len(words) >= window:
                    spans = [[0, len(words)]]
                found = union_spans(spans or [])
                kept, at = [], 0
                for b, e in found.tolist():
                    kept += words[at:b]
                    at = e
                kept += words[at:]
                left = b" ".join(kept)
                row = (d, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest())
                rows.append((*row, left.decode(), found.ravel().tolist()) if texts else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"]
            width = 6 if texts else 4
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(width)], names=names[:width])

    return run


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """Remove each word covered by a ``window``-word sequence that also starts in a document with a smaller doc_id.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged. Returns (doc_id, n_words, n_removed, kept_sha256)
    for each row, and with ``texts`` the kept text and the removed spans of words. Windows are judged on the
    input. Rows of one doc_id do not count as smaller than each other; null and shorter texts lose nothing;
    rows with a null doc_id are returned whole and are no source. Extra columns are ignored; an
    empty table gives no rows.
    """
    found = settled(docs, window, min(ANCHOR, -(-window // 3)), word_values, _words, lambda words, a, n: b" ".join(words[a : a + n]), _settle(window), lambda n, low: holder_runs(low), across=True, width=8, most=INDEXED)
    a, last = F.col("a").cast("long"), F.lit(window - 1)
    at = F.sequence(F.lit(0), F.greatest(F.floor(F.size("answer") / 3).cast("int") - 1, F.lit(0)))
    runs = F.transform(at, lambda i: F.struct(F.get("answer", i * 3).alias("b"), F.get("answer", i * 3 + 1).alias("e"), F.get("answer", i * 3 + 2).alias("low")))
    older = F.filter(runs, lambda r: r["low"] < F.col("doc_id"))
    shifts = F.transform(F.sequence(F.lit(0), F.col("reps") - 1), lambda k: k * F.col("c") + a)
    mixed = F.flatten(F.transform(shifts, lambda s: F.flatten(F.transform(older, lambda r: F.array(r["b"] + s, r["e"] + s + last)))))
    plain = F.when(F.col("low") < F.col("doc_id"), F.array(a, a + F.col("c") * F.col("reps") + last))
    rows = found.select("doc_id", "crc", F.when(F.col("answer").isNull(), plain).otherwise(mixed).alias("spans")).where(F.size("spans") > 0)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    whole = copies(docs).where("first < doc_id")
    return with_spans(docs, rows, whole).mapInArrow(_remove(window, texts), out + (", kept string, spans array<long>" if texts else ""))
