"""Document fingerprints from content-defined chunks (operator 7).

A gear hash rolls over the bytes; a chunk ends where its masked bits are zero, with a harder mask
before the normal size and an easier one after it, so sizes gather around the normal size and an
edit moves only the chunk ends beside it. A fingerprint is the set of chunk digests with chunk
lengths; likeness is the shared length over the smaller document's length.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shards import _edge_index
from lodestone.llm.textbytes import _STEP, buffer_of, mix64, powers, slices

WINDOW = 16
SMALLEST, NORMAL, LARGEST = 16, 40, 160
HARD, EASY = np.uint32(0xFC000000), np.uint32(0xF0000000)
#: Key ranges that rows are dealt to; each is streamed in order, so this only bounds the driver's list.
RANGE_ROWS, MAX_RANGES = 4000, 4096

_RNG = np.random.default_rng(7)
_GEAR = _RNG.integers(0, 2**32, 256, dtype=np.uint32)
_VALUE = _RNG.integers(1, 2**62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = powers(_STEP, LARGEST + 1)


def gear(buf: np.ndarray) -> np.ndarray:
    """Gear hash of the WINDOW bytes that end at each position, by doubling."""
    h = _GEAR[buf]
    step = 1
    while step < WINDOW:
        wide = h.copy()
        wide[step:] += h[:-step] << np.uint32(step)
        h, step = wide, step * 2
    # Bits that all bytes of the window reach stand at the top after the shift.
    return h


def cut(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all chunks, and for each document the index of its first chunk (n+1 values).

    No chunk ends within SMALLEST = WINDOW bytes of its start, so a hash never reaches into another document.
    """
    h = gear(buf)
    hard = (np.flatnonzero((h & HARD) == 0) + 1).tolist()
    easy = (np.flatnonzero((h & EASY) == 0) + 1).tolist()
    hard.append(1 << 62)
    easy.append(1 << 62)
    starts, first = [], [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        while a < b:
            starts.append(a)
            end = hard[bisect_left(hard, a + SMALLEST)]
            if end > a + NORMAL:
                end = min(easy[bisect_left(easy, a + NORMAL)], a + LARGEST)
            a = end if end < b else b
        first.append(len(starts))
    return np.array(starts, np.int64), np.array(first, np.int64)


def fingerprints(texts: pa.Array) -> list[np.ndarray]:
    """For each text its sorted distinct chunk codes: 48 bits of digest, 16 bits of length."""
    buf, off = buffer_of(texts)
    out: list[np.ndarray] = []
    for i, j in slices(off):
        part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        if not len(part):
            out += [np.zeros(0, np.uint64)] * (j - i)
            continue
        starts, first = cut(part, o)
        lengths = np.diff(np.concatenate((starts, [len(part)])))
        within = np.arange(len(part)) - np.repeat(starts, lengths)
        sums = np.add.reduceat(_VALUE[part] * _POWERS[within], starts)
        codes = (mix64(sums + lengths.astype(np.uint64)) & ~np.uint64(0xFFFF)) | lengths.astype(np.uint64)
        out += [np.unique(codes[first[d] : first[d + 1]]) for d in range(j - i)]
    return out


def as_text(codes: np.ndarray) -> str:
    """A fingerprint as hexadecimal text, 16 digits a chunk, in ascending order."""
    return codes.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Length of the shared chunks over the smaller fingerprint's length; two empty ones are alike."""
    low = np.uint64(0xFFFF)
    least = min(int((a & low).sum()), int((b & low).sum()))
    if not least:
        return float(len(a) == len(b))
    return float((np.intersect1d(a, b, assume_unique=True) & low).sum()) / least


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pair_up(batches):
    held: tuple[int, int | None, str, np.ndarray] | None = None  # range, doc_id, text, fingerprint of the row before

    for batch in batches:
        ranges, tails = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ids, texts = batch.column(2).to_pylist(), [t or "" for t in batch.column(3).to_pylist()]
        prints = fingerprints(pa.array(texts, pa.string()))
        rows, edits = [], []
        for r, tail, d, text, fp in zip(ranges, tails, ids, texts, prints):
            if held is not None and held[0] == r:
                rows.append((held[1], held[2], held[3], fp))
                edits.append(edited(held[2], text))
            held = None if tail else (r, d, text, fp)
        new = fingerprints(pa.array(edits, pa.string()))
        cols = [
            [d for d, *_ in rows],
            [len(t) for _, t, *_ in rows],
            [hashlib.sha256(e.encode()).hexdigest() for e in edits],
            [as_text(fp) for _, _, fp, _ in rows],
            [as_text(e) for e in new],
            [likeness(fp, e) for (_, _, fp, _), e in zip(rows, new)],
            [likeness(fp, nxt) for _, _, fp, nxt in rows],
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in OUT.split(", ")])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint of each whole text, of its edited text, and their likeness, with the next document's too.

    The next document is the one with the next higher doc_id (rows of one doc_id are ordered by
    text); after the last comes the first. Null texts are empty; a null doc_id sorts first; with one
    row the next document is the row itself. Extra columns are ignored; an empty table gives no rows.
    Each row travels once, to its key range; of each range the first row goes to the range before it too.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    count = rows.count()
    if not count:
        return docs.sparkSession.createDataFrame([], OUT)
    n = min(MAX_RANGES, count // RANGE_ROWS + 1)
    shares = [k / n for k in range(1, n)]
    edges = rows.agg(F.percentile_approx("doc_id", shares, 10000)).first()[0] if shares else []
    at = _edge_index(F.col("doc_id"), sorted(set(edges or [])))
    placed = rows.withColumn("range", at)
    heads = sorted(placed.groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("head")).select("range", "head.doc_id").collect())
    before = [(heads[k - 1][0], heads[k][1]) for k in range(len(heads))]
    tails = docs.sparkSession.createDataFrame(before, "range int, head long")
    lent = rows.join(F.broadcast(tails), F.col("doc_id").eqNullSafe(F.col("head"))).select("range", F.lit(1).alias("tail"), "doc_id", "text")
    own = placed.select("range", F.lit(0).alias("tail"), "doc_id", "text")
    dealt = own.unionByName(lent).repartition("range").sortWithinPartitions("range", "tail", "doc_id", "text")
    return dealt.mapInArrow(_pair_up, OUT)
