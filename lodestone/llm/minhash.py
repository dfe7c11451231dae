"""Near-duplicate classes by b-bit MinHash (operator 1).

One numpy pass makes 128 minima of each document's shingle set. Band keys come from runs of
whole minima; after that only the low two bits of each (mixed) minimum are kept, packed in two
bit planes of 128 bits. Candidates meet in band buckets, their similarity is estimated from the
planes by bit counts with the correction for chance agreement, and those within reach of the
threshold are confirmed on the full shingle sets of their texts.

No bucket is expanded into all pairs. Equal sets are collapsed to one representative first. A
shingle that no other bucket member has cannot be shared, so each member's own shingles bound its
overlap with anyone; members and pairs that this exact bound rules out are dropped. Every member
of a bucket is compared with its most central member (fewest own shingles), components are formed,
and only members of one bucket that are still in different components, within the bound and alike
by their planes are compared again. So a bucket of n copies costs n rows. Buckets of at most FEW
members need no bound. Hot buckets, pivots and groups of equal sets are met by pushed or salted joins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textbytes import LOWER_AZ, buffer_of, mix64, shingle_hashes, slices, word_hashes, words_of
from lodestone.operators.components import connected_components
from lodestone.runtime import HOT_ROWS, SALTS, discard, materialize, small, spread_join

HASHES = 128
LOW_BITS = 2
#: A true link is lost in banding with at most this probability, at the threshold itself.
MISS = 1e-6
#: Standard deviations of the estimate below the threshold that still go to confirmation.
SLACK = 5.0
#: Star pairs this far below the floor are still counted exactly: their overlaps bound other pairs.
REACH = 0.2
#: Members of larger buckets get an exact bound on their overlaps, which costs a row for each shingle.
FEW = 8

_RNG = np.random.default_rng(97)
_MUL = (_RNG.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[None, :]
_ADD = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)[None, :]


def band_shape(threshold: float, hashes: int = HASHES, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands): the most rows a band can have while links at ``threshold`` are missed under ``miss``."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if (1 - threshold**rows) ** bands <= miss:
            return rows, bands
    return 1, hashes


def estimate_floor(threshold: float, hashes: int = HASHES, bits: int = LOW_BITS) -> float:
    """The smallest estimated similarity that is still confirmed."""
    chance = 2.0**-bits
    agree = threshold + (1 - threshold) * chance
    return threshold - SLACK * math.sqrt(agree * (1 - agree) / hashes) / (1 - chance)


def minima_of(shingles: np.ndarray) -> np.ndarray:
    """128 minima of a set of 64-bit shingle hashes."""
    s = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(s), 2048):
        np.minimum(out, (s[i : i + 2048, None] * _MUL + _ADD).min(axis=0), out=out)
    return out


def _signatures(rows: int, bands: int, words: int):
    def run(batches):
        for batch in batches:
            buf, off = buffer_of(batch.column(1))
            low = LOWER_AZ[buf]
            for i, j in slices(off):
                part, o = low[off[i] : off[j]], off[i : j + 1] - off[i]
                starts, ends, first = words_of(part, o)
                sh, at = shingle_hashes(word_hashes(part, starts, ends), first, words)
                n = j - i
                size, f1, f2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                minima = np.zeros((n, HASHES), np.uint32)
                for d in range(n):
                    s = np.unique(sh[at[d] : at[d + 1]])
                    if len(s):
                        size[d], f1[d], f2[d] = len(s), s.sum(), mix64(s ^ np.uint64(0x51ED270B)).sum()
                        minima[d] = minima_of(s)
                wide = minima.astype(np.uint64)
                keys = np.zeros((n, bands), np.uint64)
                for b in range(bands):
                    k = np.full(n, b + 1, np.uint64)
                    for r in range(rows):
                        k = mix64(k * np.uint64(0x9E3779B97F4A7C15) + wide[:, b * rows + r])
                    keys[:, b] = k
                keep = mix64(wide)
                planes = [np.packbits(((keep >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64) for p in range(LOW_BITS)]
                planes = np.concatenate(planes, axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), pa.array(keys.view(np.int64).ravel()))
                cols = [batch.column(0).slice(i, n), pa.array(size), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists]
                cols += [pa.array(np.ascontiguousarray(planes[:, c])) for c in range(planes.shape[1])]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "f1", "f2", "keys", "p0", "p1", "p2", "p3"])

    return run


SIGNATURE_SCHEMA = "id long, n long, f1 long, f2 long, keys array<long>, p0 long, p1 long, p2 long, p3 long"


def signatures(docs: DataFrame, threshold: float, words: int = 5) -> DataFrame:
    """Set size, set fingerprint, band keys and bit planes of each document (columns doc_id, text)."""
    rows, bands = band_shape(threshold)
    return docs.select("doc_id", "text").mapInArrow(_signatures(rows, bands, words), SIGNATURE_SCHEMA)


def estimated(a: str, b: str) -> F.Column:
    """Similarity of two signatures: agreeing low bits, corrected for agreement by chance."""
    differ = [F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}")) for i in range(4)]
    unlike = F.bit_count(differ[0].bitwiseOR(differ[2])) + F.bit_count(differ[1].bitwiseOR(differ[3]))
    chance = 2.0**-LOW_BITS
    return ((1 - unlike / F.lit(float(HASHES))) - chance) / (1 - chance)


def shingle_set(text: str | None, words: int = 5) -> frozenset:
    """The exact shingle set of a text; bytes.lower and bytes.split know A-Z and 0x20, 0x09-0x0D only."""
    w = (text or "").encode().lower().split()
    if len(w) < words:
        return frozenset([tuple(w)] if w else [])
    return frozenset(zip(*(w[k:] for k in range(words))))


def _confirm(words: int):
    def run(batches):
        last, left = None, frozenset()
        for batch in batches:
            a, b, ta, tb = (batch.column(k) for k in range(4))
            both = []
            for k in range(batch.num_rows):
                if a[k].as_py() != last:
                    last, left = a[k].as_py(), shingle_set(ta[k].as_py(), words)
                both.append(len(left & shingle_set(tb[k].as_py(), words)))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(both, pa.int64())], names=["a", "b", "both"])

    return run


def shared_shingles(pairs: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(a, b, both): exact size of the intersection of the full shingle sets of each pair; ``pairs`` is materialised."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = materialize(docs.select("doc_id", "text").join(small(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("rays")), "a")
    rows = spread_join(pairs.join(right, "b"), left, ["a"], "rays", "b").select("a", "b", "ta", "tb").sortWithinPartitions("a", "b")
    return rows.mapInArrow(_confirm(words), "a long, b long, both long")


def near_duplicates(docs: DataFrame, threshold_percent: int = 80, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (columns doc_id, text, others ignored).

    Two documents are linked if 100 * |A ∩ B| >= threshold_percent * |A ∪ B| for their sets of
    distinct shingles; component_id is the smallest doc_id reachable over links.
    Null, empty and word-less texts have the empty set (n_shingles 0) and no links. Texts under
    ``words`` words are one shingle. Repeated rows are one document and keep their rows; doc_id is a key, so
    rows that share one and differ in text are linked as one document by one of their texts.
    A null doc_id takes no part: component_id null, kept true. Empty table: no rows.
    """
    threshold = threshold_percent / 100
    sig = materialize(signatures(docs, threshold, words), "signatures")
    planes = ["p0", "p1", "p2", "p3"]
    sets = sig.where("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min(F.struct("id", "keys", *planes)).alias("r"), F.count(F.lit(1)).alias("copies"))
    reps = materialize(sets.select("r.*", "n", "f1", "f2", "copies"), "representatives")
    rows = reps.select(F.explode("keys").alias("key"), "id")
    shared = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").withColumn("size", F.col("c")), "shared")
    buckets = materialize(spread_join(rows, shared, ["key"], "c", "id"), "buckets")
    bound = overlap_bounds(docs, buckets.where(F.col("size") > FEW).select("id").distinct(), words)
    # The bound holds among members of large buckets only; in small ones a member may share all it has.
    most = F.when(F.col("size") > FEW, F.col("most")).otherwise(F.col("n"))
    held = buckets.join(reps.select("id", "n"), "id").join(bound, "id", "left").withColumn("most", most).where(F.col("most") * 100 >= F.col("n") * threshold_percent)
    held = materialize(held.select("key", "id", "n", "most"), "held")
    central = F.min_by("id", F.struct(F.col("n") - F.col("most"), F.col("id")))
    pivots = materialize(held.groupBy("key").agg(central.alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1"), "pivots")
    members = materialize(spread_join(held.select("key", "id", "most"), pivots, ["key"], "c", "id"), "members")
    sig_of = materialize(reps.select("id", "n", *planes).join(members.select("id").distinct(), "id", "left_semi"), "bounded")
    discard(shared, buckets, held)
    x_of = sig_of.select(F.col("id").alias("a"), F.struct("n", *planes).alias("x"))
    y_of = sig_of.select(F.col("id").alias("b"), F.struct("n", *planes).alias("y"))

    def links_of(pairs: DataFrame) -> DataFrame:
        sizes = pairs.join(x_of.select("a", F.col("x.n").alias("na")), "a").join(y_of.select("b", F.col("y.n").alias("nb")), "b")
        return sizes.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * threshold_percent).select("a", "b")

    star = members.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct().join(y_of, "b")
    pivot_of = x_of.join(pivots.groupBy(F.col("pivot").alias("a")).agg(F.sum("c").alias("rays")), "a")
    near = spread_join(star, pivot_of, ["a"], "rays", "b").where(estimated("x", "y") >= estimate_floor(threshold) - REACH).select("a", "b")
    rays = materialize(shared_shingles(materialize(near, "pairs"), docs, words), "rays")
    links = materialize(links_of(rays), "links")
    parts = connected_components(links, "a", "b")
    # What the stars left apart: members of one bucket in different components. Each member's exact
    # overlap with the pivot bounds its overlap with the others, inside the pivot's set and outside it.
    where = members.join(parts, "id", "left").select("key", "id", "pivot", "most", F.coalesce("component", "id").alias("c"))
    split = where.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi").select("key", "c", F.col("c").alias("left"))
    known = rays.select(F.col("a").alias("pivot"), F.col("b").alias("id"), "both")
    inside = F.when(F.col("id") == F.col("pivot"), F.col("n")).otherwise(F.col("both"))
    rest = spread_join(where, materialize(split, "split"), ["key"], "c", "id").join(sig_of, "id").join(known, ["id", "pivot"], "left").withColumn("inside", inside)
    # Each member of a hot bucket meets the others in one of SALTS parts, its comparisons in all of them.
    hot = F.col("left") > HOT_ROWS
    rest = materialize(rest, "rest")
    x = rest.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0)).alias("x")
    y = rest.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).alias("y")
    apart = (
        x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.c") < F.col("y.c")) & reachable("x", "y", threshold_percent) & (estimated("x", "y") >= estimate_floor(threshold)))
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        .distinct()
        .join(rays.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    )
    more = links_of(shared_shingles(materialize(apart, "pairs"), docs, words))
    joined = connected_components(links.union(materialize(more, "links")), "a", "b")
    class_of = reps.join(joined, "id", "left").select("f1", "f2", "n", F.coalesce("component", "id").alias("set_component"), "copies")
    plain = sig.select("id", "n", "f1", "f2")
    met = spread_join(plain.where("n > 0 and id is not null"), class_of, ["f1", "f2", "n"], "copies", "id")
    out = met.unionByName(plain.where("n = 0 or id is null").withColumn("set_component", F.lit(None).cast("long")))
    component = F.when(F.col("id").isNotNull(), F.coalesce("set_component", "id"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _shingle_rows(words: int):
    def run(batches):
        for batch in batches:
            buf, off = buffer_of(batch.column(1))
            low = LOWER_AZ[buf]
            for i, j in slices(off):
                part, o = low[off[i] : off[j]], off[i : j + 1] - off[i]
                starts, ends, first = words_of(part, o)
                sh, at = shingle_hashes(word_hashes(part, starts, ends), first, words)
                sets = [np.unique(sh[at[d] : at[d + 1]]) for d in range(j - i)]
                ids = batch.column(0).slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), [len(s) for s in sets])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(sets).view(np.int64))], names=["id", "hash"])

    return run


def overlap_bounds(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, most): how many shingles of each document at least one other document of ``ids`` has."""
    ids = materialize(ids.select(F.col("id").alias("doc_id")), "ids")
    among = docs.select("doc_id", "text").join(small(ids), "doc_id", "left_semi")
    rows = among.mapInArrow(_shingle_rows(words), "id long, hash long")
    held = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id"))
    own = held.where("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    sizes = rows.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(own, "id", "left").select("id", (F.col("size") - F.coalesce("own", F.lit(0))).alias("most"))


def reachable(a: str, b: str, percent: int) -> F.Column:
    """Whether two members of a bucket can meet the threshold, by exact bounds on what they share.

    Inside the pivot's set they share at most the smaller ``inside``; outside it only shingles that
    some other document has count. Where an overlap with the pivot is unknown, ``most`` bounds alone.
    """

    def least(u: F.Column, v: F.Column) -> F.Column:
        return F.when(u < v, u).otherwise(v)

    most = least(F.col(f"{a}.most"), F.col(f"{b}.most"))
    split = least(F.col(f"{a}.inside"), F.col(f"{b}.inside")) + least(F.col(f"{a}.most") - F.col(f"{a}.inside"), F.col(f"{b}.most") - F.col(f"{b}.inside"))
    return F.least(most, split) * (100 + percent) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * percent
