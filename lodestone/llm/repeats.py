"""Where long windows of the corpus repeat: the Spark side of operators 5 and 9.

Every window is routed by its anchor (see ``anchors``), so all its occurrences meet in one shard.
Segments that are equal as wholes are settled by counting; only anchors with different segments
need an index, and only one copy of each different segment is sent to it. An anchor whose different
segments would not fit an index is settled window by window, so no task holds more than a block and
the largest anchor.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.anchors import range_hashes, segments
from lodestone.llm.textbytes import mix64
from lodestone.runtime import materialize, small, spread_join

#: Bytes of segments after which a task, working through its shard by whole anchors, begins a new index.
BLOCK = 1 << 18

#: A batch of texts as values to look for repeats in: (values, first value of each document).
Values = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
#: The segment [start, start + length) of a text, for an index.
Slice = Callable[[object, int, int], bytes]
#: Settle a block: segments, their anchors' group numbers, row counts and smallest doc_ids -> flat answers by segment.
Settle = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], list[list[int]]]

#: The flat answer of one segment from the row counts and smallest doc_ids of its windows.
Answer = Callable[[np.ndarray, np.ndarray], list[int]]


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, crc, first, n) of texts that more than one row has: the smallest doc_id and the number of rows."""
    h = docs.where("doc_id is not null").select("doc_id", crc(), F.xxhash64("text").alias("h"), F.octet_length("text").alias("l"))
    groups = h.groupBy("h", "crc", "l").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("rows", F.col("n"))
    found = spread_join(h.where("l is not null"), materialize(groups.where("l is not null"), "equal"), ["h", "crc", "l"], "rows", "doc_id")
    return found.select("doc_id", "crc", "first", "n").distinct()


def crc() -> F.Column:
    return F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("crc")


def _segment_rows(values: Values, window: int, k: int):
    def run(batches):
        for batch in batches:
            v, first = values(batch.column(2))
            for d, m, h, a, c in segments(v, first, window, k):
                # A text that repeats itself gives equal segments side by side: they become one row.
                again = (d[1:] == d[:-1]) & (m[1:] == m[:-1]) & (h[1:] == h[:-1]) & (a[1:] == a[:-1] + c[:-1])
                head = np.flatnonzero(np.concatenate((np.ones(min(1, len(d)), bool), ~again)))
                reps = np.diff(np.concatenate((head, [len(d)])))
                at = pa.array(d[head])
                cols = [pa.array(m[head].view(np.int64)), pa.array(h[head].view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)]
                cols += [pa.array(x.astype(np.int32)) for x in (a[head], c[head], reps)]
                yield pa.RecordBatch.from_arrays(cols, names=["m", "h", "doc_id", "crc", "a", "c", "reps"])

    return run


def _cut(window: int, piece: Slice, prepare: Callable[[str], object]):
    def run(batches):
        for batch in batches:
            m, h, n, low, seg = [], [], [], [], []
            for text, wanted in zip(batch.column(0), batch.column(1)):
                source = prepare(text.as_py())
                for w in wanted.as_py():
                    m.append(w["m"])
                    h.append(w["h"])
                    n.append(w["n"])
                    low.append(w["low"])
                    seg.append(piece(source, w["a"], w["c"] + window - 1))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((m, h, n, low, seg), kinds)], names=["m", "h", "n", "low", "seg"])

    return run


def _blocks(settle: Settle):
    def run(batches):
        m, h, n, low, seg = [], [], [], [], []
        size = 0

        def flush():
            group = np.unique(np.array(m, np.int64), return_inverse=True)[1]
            answers = settle(seg, group, np.array(n, np.int64), np.array(low, np.int64))
            out = pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(h, pa.int64()), pa.array(answers, pa.list_(pa.int64()))], names=["m", "h", "answer"])
            for x in (m, h, n, low, seg):
                x.clear()
            return out

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if size >= BLOCK and row[0] != m[-1]:
                    yield flush()
                    size = 0
                for x, value in zip((m, h, n, low, seg), row):
                    x.append(value)
                size += len(row[4])
        if m:
            yield flush()

    return run


def _windows(window: int, values: Values):
    def run(batches):
        for batch in batches:
            v, first = values(batch.column(0))
            parts = []
            for begin, wanted in zip(first, batch.column(1)):
                for w in wanted.as_py():
                    seg = v[begin + w["a"] : begin + w["a"] + w["c"] + window - 1]
                    at = np.arange(w["c"])
                    keys = [range_hashes(x, at, at + window).view(np.int64) for x in (seg, mix64(seg))]
                    parts.append([*(np.full(w["c"], w[x], np.int64) for x in ("m", "h", "n", "low")), at.astype(np.int32), *keys])
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=["m", "h", "n", "low", "i", "k", "k2"])

    return run


def _answers(answer: Answer):
    def run(batches):
        for batch in batches:
            out = []
            for c, own_n, own_low, found in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                n, low = np.full(c, own_n, np.int64), np.full(c, own_low, np.int64)
                for w in found or ():
                    n[w["i"]], low[w["i"]] = w["n"], w["low"]
                out.append(answer(n, low))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["m", "h", "answer"])

    return run


def by_window(segments: DataFrame, texts: DataFrame, window: int, values: Values, answer: Answer) -> DataFrame:
    """(m, h, answer) of ``segments`` (m, h, c, n, low), each window counted by a 128-bit hash over all of them.

    ``texts`` has each text with its wanted segments. One 64-bit hash a window is shuffled, as partial counts; only windows
    whose hash comes again are followed further, the others stand for themselves.
    """
    rows = texts.mapInArrow(_windows(window, values), "m long, h long, n long, low long, i int, k long, k2 long")
    again = materialize(rows.groupBy("k").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").withColumn("hits", F.col("rows")), "again")
    # The hashes that come again are far fewer than the windows; with very many of them the join shuffles.
    hits = materialize(rows.join(small(again.select("k")), "k", "left_semi"), "hits")
    met = hits.groupBy("k", "k2").agg(F.sum("n").alias("all"), F.min("low").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    found = spread_join(hits.select("m", "h", "i", "k", "k2"), materialize(met, "met"), ["k", "k2"], "rows", "h")
    lists = found.groupBy("m", "h").agg(F.collect_list(F.struct("i", F.col("all").alias("n"), F.col("least").alias("low"))).alias("found"))
    return segments.select("m", "h", "c", "n", "low").join(lists, ["m", "h"], "left").mapInArrow(_answers(answer), "m long, h long, answer array<long>")


def settled(docs: DataFrame, window: int, k: int, values: Values, prepare: Callable[[str], object], piece: Slice, settle: Settle, answer: Answer, across: bool, width: int = 1, most: int = BLOCK) -> DataFrame:
    """(doc_id, crc, a, c, reps, low, n, answer): segments with repeated windows, of texts that are first of their copies.

    A row stands for ``reps`` equal segments of ``c`` windows side by side, the first window starting at ``a``.
    Where ``answer`` is null all windows of the segment have ``n`` rows and ``low`` as their smallest doc_id;
    otherwise it is what ``settle`` said. ``across`` keeps only anchors that more than one doc_id has.
    An anchor whose different segments pass ``most`` bytes, at ``width`` bytes a value, is left to ``by_window``.
    """
    again = materialize(copies(docs).where("first < doc_id").select("doc_id", "crc"), "copies")
    own = docs.where("doc_id is not null and text is not null").select("doc_id", crc(), "text").join(small(again), ["doc_id", "crc"], "left_anti")
    rows = own.select("doc_id", "crc", "text").mapInArrow(_segment_rows(values, window, k), "m long, h long, doc_id long, crc long, a int, c int, reps int")
    by_anchor, by_segment = Window.partitionBy("m"), Window.partitionBy("m", "h")
    seen = rows.select(
        "*",
        F.min("h").over(by_anchor).alias("h0"),
        F.max("h").over(by_anchor).alias("h1"),
        F.min("doc_id").over(by_anchor).alias("d0"),
        F.max("doc_id").over(by_anchor).alias("d1"),
        F.sum("reps").over(by_segment).alias("n"),
        F.min("doc_id").over(by_segment).alias("low"),
        F.row_number().over(by_segment.orderBy("doc_id", "crc", "a")).alias("rank"),
    )
    shared = seen.where(F.col("d0") < F.col("d1") if across else (F.col("n") > 1) | (F.col("h0") != F.col("h1")))
    kept = materialize(shared.select("m", "h", "doc_id", "crc", "a", "c", "reps", "n", "low", (F.col("h0") != F.col("h1")).alias("mixed"), (F.col("rank") == 1).alias("head")), "segments")
    heads = kept.where("mixed and head")
    over = materialize(heads.groupBy("m").agg(F.sum((F.col("c") + (window - 1)) * width).alias("size")).where(F.col("size") > most).select("m"), "over")
    n_over = over.count()

    def texts_of(some: DataFrame) -> DataFrame:
        wanted = some.groupBy("doc_id", "crc").agg(F.collect_list(F.struct("m", "h", "n", "low", "a", "c")).alias("wanted"))
        return own.join(wanted, ["doc_id", "crc"]).select("text", "wanted")

    fit = heads.join(small(over), "m", "left_anti") if n_over else heads
    cut = texts_of(fit).mapInArrow(_cut(window, piece, prepare), "m long, h long, n long, low long, seg binary")
    answers = cut.repartition("m").sortWithinPartitions("m", "h").mapInArrow(_blocks(settle), "m long, h long, answer array<long>")
    if n_over:
        wide = materialize(heads.join(small(over), "m", "left_semi"), "wide")
        answers = answers.unionByName(by_window(wide, texts_of(wide), window, values, answer))
    light = ["doc_id", "crc", "a", "c", "reps", "low", "n"]
    plain = kept.where("not mixed").select(*light, F.lit(None).cast("array<long>").alias("answer"))
    return plain.unionByName(kept.where("mixed").select("m", "h", *light).join(materialize(answers, "answers"), ["m", "h"]).select(*light, "answer"))


def with_spans(docs: DataFrame, spans: DataFrame, whole: DataFrame) -> DataFrame:
    """(doc_id, text, spans, whole) for each row of ``docs``: its removed spans, or true if all of it repeats."""
    per_doc = spans.groupBy("doc_id", "crc").agg(F.collect_list("spans").alias("spans"))
    marks = per_doc.join(whole.select("doc_id", "crc", F.lit(True).alias("whole")), ["doc_id", "crc"], "full_outer")
    return docs.select("doc_id", "text", crc()).join(marks, ["doc_id", "crc"], "left").select("doc_id", "text", "spans", F.coalesce("whole", F.lit(False)).alias("whole"))
