"""Sharding by histogram sort, with DataFrame functions only (operator 2).

Rows are ordered by doc_id and cut into shards of near-equal bytes. Splitters are found without
sorting: in each round one job counts the exact bytes below a bounded list of probe keys, and
the probes close in on the splitters until each meets the tolerance or is a single key wide.
Then whole rows move once, to bins of bounded size inside their shard, and are written by shard.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import materialize, fresh_path, small

#: Probe keys for each open splitter in a round: what comes to the driver is at most PROBES * shards rows.
PROBES = 64
#: Rows and bytes of text that one task sorts and writes, and the most bins in all (beyond, bins grow and spill).
BIN_ROWS = 1_000_000
BIN_BYTES = 16_000_000
MAX_BINS = 512


def _digests(text: str) -> tuple[Column, Column]:
    return (
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32): UTF-8 bytes plus 1, and the unsigned CRC-32 (0 for a null text)."""
    return docs.select("doc_id", *_digests("text"))


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.0) -> list[int]:
    """Keys s_1 < ... so that shard j holds keys in [s_j, s_j+1).

    Splitter j is the smallest key with at least j/shards of all bytes at keys up to it, plus one,
    within ``tolerance`` times a shard's bytes. Equal keys stay together.
    """
    lo, hi, total = rows.agg(F.min("doc_id"), F.max("doc_id"), F.sum("size")).first()
    if lo is None:
        return []
    targets = [total * j / shards for j in range(1, shards)]
    slack = tolerance * total / shards
    # Of each splitter: an interval (a, b] of boundaries; bytes at keys below a are known and under the target.
    spans = {j: (lo, hi + 1, 0) for j in range(len(targets))}
    done: dict[int, int] = {}
    while spans:
        cells = sorted({(a, b) for a, b, _ in spans.values()})
        key = F.col("doc_id")
        place = F.when(F.lit(False), F.struct(F.lit(0).alias("cell"), F.lit(0).cast("decimal(20,0)").alias("step")))
        for i, (a, b) in enumerate(cells):
            # Probes stand at a, a + w, a + 2w, ...; decimals, as a difference of two longs may not fit a long.
            step = F.floor((key.cast("decimal(20,0)") - F.lit(a).cast("decimal(20,0)")) / F.lit(_width(a, b)).cast("decimal(20,0)"))
            place = place.when((key >= a) & (key <= b - 1), F.struct(F.lit(i).alias("cell"), step.cast("decimal(20,0)").alias("step")))
        counted = rows.select("size", place.alias("at")).where("at is not null").groupBy("at.cell", "at.step").agg(F.sum("size"))
        counts = {(r[0], int(r[1])): r[2] for r in counted.collect()}
        fresh = {}
        for j, (a, b, below) in spans.items():
            i, w, acc = cells.index((a, b)), _width(a, b), below
            for k in range(PROBES):
                here, left, right = counts.get((i, k), 0), a + k * w, min(b, a + (k + 1) * w)
                if acc + here >= targets[j]:
                    if right - left == 1 or abs(acc + here - targets[j]) <= slack:
                        done[j] = right
                    else:
                        fresh[j] = (left, right, acc)
                    break
                acc += here
        spans = fresh
    return [done[j] for j in range(len(targets))]


def _width(a: int, b: int) -> int:
    return max(1, -(-(b - a) // PROBES))


def _edge_index(key: F.Column, edges: list[int]) -> F.Column:
    """Number of edges at or below ``key`` (0 for a null key), as nested comparisons of logarithmic depth."""
    edges = sorted(edges)

    def pick(lo: int, hi: int) -> F.Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= edges[mid], pick(mid + 1, hi)).otherwise(pick(lo, mid))

    return pick(0, len(edges))


def placed(docs: DataFrame, shards: int = 16, tolerance: float = 0.0) -> DataFrame:
    """(row, slot, shard): each whole row of ``docs``, all its columns in the struct ``row``, with its place.

    Shards are ranges of doc_id whose bytes are as near j/shards of the total as whole keys allow
    (``tolerance`` 0) or within the tolerance. ``slot`` counts a shard's rows from 0 without gaps, by doc_id,
    then size and checksum, then the other columns (maps apart); identical rows take neighbouring slots. Rows with one
    doc_id stay together, so a doc_id with more bytes than a shard's share makes that shard larger (doc_id is a key). A null
    doc_id sorts before all others, in shard 0.
    """
    rows = materialize(sized(docs), "sized")
    known = rows.where("doc_id is not null")
    cuts = splitters(known, shards, tolerance)
    # Bins are finer ranges of keys, found the same way but loosely; counts of bins give the slots.
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = min(MAX_BINS // shards, max(-(-count // (BIN_ROWS * shards)), -(-total // (BIN_BYTES * shards))))
    fine = splitters(known, shards * parts, 0.25) if parts > 1 else []

    def in_bins(frame: DataFrame) -> DataFrame:
        key = F.col("doc_id")
        return frame.withColumn("shard", _edge_index(key, cuts)).withColumn("bin", _edge_index(key, fine))

    counts = in_bins(rows).groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.withColumn("start", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n"), "bins")
    # The one exchange of whole rows.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = in_bins(whole.select("row", F.col("row.doc_id").alias("doc_id"), *_digests("row.text")))
    ties = [f"row.`{name}`" for name, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    within = Window.partitionBy("shard", "bin").orderBy("doc_id", "size", "text_crc32", *ties)
    ranked = keyed.withColumn("rank", F.row_number().over(within) - 1)
    slot = (F.col("start") + F.col("rank")).cast("long").alias("slot")
    return ranked.join(small(starts), ["shard", "bin"]).select("row", slot, F.col("shard").cast("int").alias("shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, tolerance: float = 0.0) -> DataFrame:
    """Write the whole rows of ``docs`` to ``path`` as Parquet, a folder for each shard, files in order of ``slot``.

    Gives what was written, read back, as (row, slot, shard); see ``placed``.
    """
    out = placed(docs, shards, tolerance)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def histogram_sort(docs: DataFrame, shards: int = 16, tolerance: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law ``bytes``, of the rows as they stand in their shards.

    ``docs`` is written by shard to the shared folder and the digests are taken from what was written;
    ``write_shards`` has the rows themselves. grown_shard is null under this law.
    An empty table gives no rows; with fewer keys than shards some shards stay empty.
    """
    rows = write_shards(docs, fresh_path(docs.sparkSession, "shards"), shards, tolerance)
    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        *_digests("row.text"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def oracle(shards: int = 16) -> str:
    """DuckDB SQL for ``histogram_sort`` with tolerance 0: cumulative bytes give the same shards."""
    return f"""
WITH sized AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, text FROM documents),
keys AS (SELECT doc_id, sum(size) AS s FROM sized GROUP BY doc_id),
cum AS (SELECT doc_id, sum(s) OVER (ORDER BY doc_id) - s AS below, sum(s) OVER () AS total FROM keys),
cuts AS (SELECT doc_id, CAST((SELECT count(*) FROM range(1, {shards}) t(j) WHERE below >= total * j / {shards}) AS INTEGER) AS shard FROM cum)
SELECT s.doc_id, s.size, c.shard,
  CAST(row_number() OVER (PARTITION BY c.shard ORDER BY s.doc_id, s.size) - 1 AS BIGINT) AS slot
FROM sized s JOIN cuts c USING (doc_id)"""
