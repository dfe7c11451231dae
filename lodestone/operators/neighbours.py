"""Similar vectors of every row, by an index of random-hyperplane bands.

A band is a run of signs of a vector's products with random planes; two vectors at angle t agree in one sign with
probability 1 - t / pi, so the planes of a band and the number of bands follow from the threshold and the part of links that may be missed.
The planes of a band grow with the logarithm of the rows, so buckets keep about BUCKET_ROWS rows: a product of matrices takes such a block at little cost,
and fewer planes need fewer bands, each of which holds all vectors once. Rows meet in buckets, exact cosines follow.
Pairs are never written: blocks of at most BLOCK_ROWS vectors of a bucket are multiplied in a task, and what a row found there is one
row of counts and best values. A hot bucket is many blocks, met in pairs over all tasks. A pair that several bands bring
together counts in the first of them. Rows with the same content and vector are one in the index, with their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.runtime import discard, materialize, push, spread_join

THRESHOLD = 0.85
#: A link at the threshold is missed with at most this probability.
MISS = 1e-3
LEAST_PLANES, MOST_PLANES = 6, 28
BLOCK_ROWS = 1024
#: Rows of a bucket in random data.
BUCKET_ROWS = 512

FOUND = "rep long, n_links long, similarity double, nearest_at long, nearest string, newest_at long, newest string, newest_similarity double"


def band_shape(rows: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(planes, bands): as many planes as keep random buckets at BUCKET_ROWS or less, and the bands that the threshold then needs."""
    planes = min(MOST_PLANES, max(LEAST_PLANES, math.ceil(math.log2(max(2, rows / BUCKET_ROWS)))))
    agree = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** planes
    return planes, max(1, math.ceil(math.log(miss) / math.log1p(-min(agree, 1 - 1e-12))))


def _units(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors; shorter ones are filled with zeros, a zero vector stays."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(float))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    norm = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norm > 0, norm, 1)[:, None]


def _planes(width: int, planes: int, bands: int) -> np.ndarray:
    return np.random.default_rng(85).standard_normal((width, planes * bands))


def _band_keys(units: np.ndarray, normal: np.ndarray, planes: int, bands: int) -> np.ndarray:
    signs = (units @ normal > 0).reshape(len(units), bands, planes)
    return signs @ (np.int64(1) << np.arange(planes, dtype=np.int64))


def _signed(width: int, planes: int, bands: int):
    normal = _planes(width, planes, bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keys = _band_keys(_units(batch.column("embedding"), width), normal, planes, bands)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "keys"])

    return run


class _Best:
    """What each row of a block found so far: number of links, nearest and newest row."""

    def __init__(self, n: int):
        self.links = np.zeros(n, np.int64)
        self.near: list[tuple | None] = [None] * n
        self.new: list[tuple | None] = [None] * n

    def take(self, i: np.ndarray, j: np.ndarray, similarity: np.ndarray, other: dict) -> None:
        np.add.at(self.links, i, other["n"][j])
        for a, b, s in zip(i.tolist(), j.tolist(), similarity.tolist()):
            at, name = int(other["at"][b]), other["id"][b]
            self.near[a] = max(x for x in (self.near[a], (s, at, name)) if x is not None)
            self.new[a] = max(x for x in (self.new[a], (at, name, s)) if x is not None)

    def rows(self, reps: np.ndarray) -> list[tuple]:
        return [(int(reps[k]), int(self.links[k]), *self.near[k], *self.new[k]) for k in np.flatnonzero(self.links)]


def _compared(width: int, planes: int, bands: int, threshold: float):
    normal = _planes(width, planes, bands)

    def block(rows: pa.Array) -> dict:
        out = {c: rows.field(c).to_numpy(zero_copy_only=False) for c in ("rep", "n", "at", "id", "hash")}
        out["unit"] = _units(rows.field("embedding"), width)
        out["keys"] = _band_keys(out["unit"], normal, planes, bands)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, same, left, right in zip(batch.column("band").to_pylist(), batch.column("same").to_pylist(), batch.column("x"), batch.column("y")):
                x = block(left.values)
                y = x if same else block(right.values)
                near = np.round(x["unit"] @ y["unit"].T, 9)  # so that ties are ties on every machine
                i, j = np.nonzero(near > threshold)
                keep = (x["hash"][i] != y["hash"][j]) & ((i < j) if same else np.ones(len(i), bool))
                i, j = i[keep], j[keep]
                # Only in the first band that brings the two together.
                first = ((x["keys"][i, :band] == y["keys"][j, :band]).sum(axis=1) == 0) if band else np.ones(len(i), bool)
                i, j = i[first], j[first]
                found = _Best(len(x["rep"]))
                back = found if same else _Best(len(y["rep"]))
                found.take(i, j, near[i, j], y)
                back.take(j, i, near[i, j], x)
                rows = found.rows(x["rep"]) + ([] if same else back.rows(y["rep"]))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64()))], names=[f.split()[0] for f in FOUND.split(", ")])

    return run


def neighbours(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(id, n_links, nearest, similarity, newer, newer_similarity) of every row of ``vectors`` (id, block, hash, created_at, embedding).

    Links join rows of one block with another ``hash`` and a cosine above the threshold; one at the threshold is missed with probability
    ``miss`` at most. ``nearest`` is the most similar row (then the newest, then the largest id), ``newer`` the newest row that is newer than
    the row itself (equal times go by id). Rows without links have 0 and nulls. Vectors of unequal length are compared over their common
    part with full norms; null, empty and zero vectors have no links; a null hash differs from none, so such rows have none either.
    """
    rows = vectors.select("id", "block", "hash", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), F.coalesce("embedding", F.array().cast("array<double>")).alias("embedding"))
    rows = rows.withColumn("sig", F.sha2(F.to_json(F.struct("block", "hash", "embedding")), 256))
    grouped = rows.where((F.size("embedding") > 0) & F.col("hash").isNotNull() & F.col("block").isNotNull()).groupBy("sig").agg(
        F.max(F.struct("at", "id")).alias("last"), F.count(F.lit(1)).alias("n"), F.first("block").alias("block"), F.first("hash").alias("hash"), F.first("embedding").alias("embedding")
    )
    reps = materialize(grouped.select("sig", "last.at", "last.id", "n", "block", "hash", "embedding").withColumn("rep", F.monotonically_increasing_id()), "reps")
    size = reps.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).first()
    width = size.width or 1
    planes, bands = band_shape(size.n, threshold, miss)
    held = reps.drop("sig")
    signed = materialize(held.mapInArrow(_signed(width, planes, bands), T.StructType([*held.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))])), "bands")
    bucket = ["block", "band", "key"]
    sizes = signed.select("block", F.posexplode("keys").alias("band", "key")).groupBy(*bucket).agg(F.count(F.lit(1)).alias("c"))
    large = materialize(sizes.where(F.col("c") > BLOCK_ROWS).select(*bucket, F.ceil(F.col("c") / BLOCK_ROWS).cast("int").alias("parts")), "buckets")
    put = signed.select("rep", "block", F.struct("rep", "n", "at", "id", "hash", "embedding").alias("v"), F.posexplode("keys").alias("band", "key"))
    met = push(put, large, bucket, "rep").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    packs = met.groupBy(*bucket, "parts", "part").agg(F.collect_list("v").alias("v"))
    # A block meets itself where it was gathered; only blocks of large buckets are written, and move to meet each other.
    many = materialize(packs.where("parts > 1"), "packs")
    one = packs.where((F.col("parts") == 1) & (F.size("v") > 1)).select("band", "v").unionByName(many.select("band", "v"))
    inside = one.select("band", F.lit(True).alias("same"), F.col("v").alias("x"), F.slice("v", 1, 0).alias("y"))
    x = many.where("part + 1 < parts").select(*bucket, F.col("v").alias("x"), F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("part"))
    across = x.join(many.select(*bucket, "part", F.col("v").alias("y")), [*bucket, "part"]).select("band", F.lit(False).alias("same"), "x", "y")
    compared = _compared(width, planes, bands, threshold)
    found = inside.mapInArrow(compared, FOUND).unionByName(across.mapInArrow(compared, FOUND))
    best = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"), F.max(F.struct("similarity", "nearest_at", "nearest")).alias("near"), F.max(F.struct("newest_at", "newest", "newest_similarity")).alias("new"))
    table = materialize(best.join(reps.select("rep", "sig", "n"), "rep").drop("rep"), "found")
    discard(signed, large, many, reps)
    linked = spread_join(rows.select("id", "at", "sig"), table, ["sig"], "n", "id")
    newer = (F.col("new.newest_at") > F.col("at")) | ((F.col("new.newest_at") == F.col("at")) & (F.col("new.newest") > F.col("id")))
    some = linked.select("id", "n_links", F.col("near.nearest").alias("nearest"), F.col("near.similarity").alias("similarity"), F.when(newer, F.col("new.newest")).alias("newer"), F.when(newer, F.col("new.newest_similarity")).alias("newer_similarity"))
    none = rows.select("id", "sig").join(table.select("sig"), "sig", "left_anti").select("id")
    empty = {"n_links": F.lit(0).cast("long"), "nearest": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double"), "newer": F.lit(None).cast("string"), "newer_similarity": F.lit(None).cast("double")}
    return some.unionByName(none.withColumns(empty))
