"""Deterministic text embeddings, and embedding with a cache."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.boundary import confidential, redacted_for_embedding
from lodestone.operators.ordering import numbered
from lodestone.runtime import materialize, spread_join

DIMENSIONS = 64
WAVE_DIMENSIONS = 384
VECTOR = T.ArrayType(T.DoubleType())
# Fixed values of the 32-bit FNV-1a hash.
FNV_START, FNV_STEP = 0x811C9DC5, 0x01000193


def fnv1a(text: str) -> int:
    h = FNV_START
    for c in text.encode():
        h = (h ^ c) * FNV_STEP & 0xFFFFFFFF
    return h


def _tokens(text: str) -> list[str]:
    apart = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)
    return re.findall(r"[a-z0-9]+", re.sub(r"[_./:-]+", " ", apart).lower())


def _signed_buckets(text: Column) -> Column:
    """Sums by bucket. Bucket and sign only need the low bits of the hash, and those follow from the low bits of each step: the bucket is the hash
    modulo 64, and as ":sign" turns its lowest bit over, odd buckets are only added to and even ones only taken from."""
    apart = F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    tokens = F.regexp_extract_all(F.lower(F.regexp_replace(apart, "[_./:-]+", " ")), F.lit("[a-z0-9]+"), F.lit(0))
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c)) * (FNV_STEP % DIMENSIONS)).bitwiseAND(DIMENSIONS - 1)
    # A character for each token, from "0" on: how often one comes is a difference of lengths.
    marks = F.array_join(F.transform(tokens, lambda t: F.char(F.aggregate(F.split(t, ""), F.lit(FNV_START % DIMENSIONS), step) + 48)), "")
    return F.transform(F.array(marks), lambda m: F.array(*[((F.length(m) - F.length(F.replace(m, F.lit(chr(48 + b))))) * (2 * (b & 1) - 1)).cast("double") for b in range(DIMENSIONS)]))[0]


def bag_embedding(text: Column) -> Column:
    """Each token (a run of a-z and 0-9; camel case and separators part words) adds +1 or -1 to one of 64 buckets.

    FNV-1a picks bucket and sign. The vector has unit length, rounded to six places. Null, token-less
    and cancelling texts have the first unit vector.
    """
    unit = F.array(F.lit(1.0), *[F.lit(0.0)] * (DIMENSIONS - 1))

    def scaled(v: Column) -> Column:
        length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x))
        return F.transform(F.array(length), lambda n: F.when(n > 0, F.transform(v, lambda x: F.round(x / n, 6))).otherwise(unit))[0]

    return F.transform(F.array(_signed_buckets(text)), scaled)[0]


def wave_hash(text: Column) -> Column:
    """The text's signed 32-bit polynomial hash (base 31, UTF-16 units); null counts as empty."""

    def step(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        more = lambda x, unit: (x * 31 + unit).bitwiseAND(0xFFFFFFFF)
        pair = more(more(h, F.shiftright(code - 0x10000, 10) + 0xD800), (code - 0x10000).bitwiseAND(0x3FF) + 0xDC00)
        return F.when(code > 0xFFFF, pair).otherwise(more(h, code))

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), ""), F.lit(0).cast("long"), step, lambda u: u - F.when(u >= 1 << 31, F.lit(1 << 32)).otherwise(F.lit(0)))


def wave(h: Column, i: Column) -> Column:
    """The value i of an embedding, from the text's hash."""
    return F.sin((h * i).cast("double") * 0.001) * 0.5


def wave_embedding(text: Column) -> Column:
    """384 values sin(h * i / 1000) / 2 of the text's hash."""
    return F.transform(F.array(wave_hash(text)), lambda h: F.transform(F.sequence(F.lit(1), F.lit(WAVE_DIMENSIONS)), lambda i: wave(h, i)))[0]


def with_cache(texts: DataFrame, cache: DataFrame, version: str, embed=bag_embedding) -> DataFrame:
    """(id, hash, embedding, cached, redacted) of texts (id, text, boundary_class): cached vectors, and new ones only where the cache has none.

    Confidential texts are redacted before they are hashed and embedded. The cache is (hash, version, embedding).
    """
    said = F.when(confidential(F.col("boundary_class")), redacted_for_embedding(F.col("text"))).otherwise(F.col("text"))
    prepared = texts.select("id", said.alias("said"), (~said.eqNullSafe(F.col("text"))).alias("redacted"))
    hashed = prepared.withColumn("hash", F.sha2(F.coalesce("said", F.lit("")).cast("binary"), 256))
    have = cache.where(F.col("version") == version).select("hash", "embedding").dropDuplicates(["hash"])
    hits = hashed.join(have, "hash").select("id", "hash", "embedding", F.lit(True).alias("cached"), "redacted")
    missed = hashed.join(have, "hash", "left_anti")
    # Equal texts are embedded once.
    fresh = missed.select("hash", "said").dropDuplicates(["hash"]).select("hash", embed(F.col("said")).alias("embedding"))
    return hits.unionByName(missed.join(fresh, "hash").select("id", "hash", "embedding", F.lit(False).alias("cached"), "redacted"))


def hydrated(claims: DataFrame, vectors: DataFrame, embed=bag_embedding) -> DataFrame:
    """(id, embedding, embedded) of claims (id, text): stored vectors (claim_id, embedding), computed ones where none is stored."""
    stored = vectors.select(F.col("claim_id").alias("id"), "embedding")
    have = claims.select("id").join(stored, "id").withColumn("embedded", F.lit(False))
    missing = claims.join(stored, "id", "left_anti").select("id", embed(F.col("text")).alias("embedding"), F.lit(True).alias("embedded"))
    return have.unionByName(missing)


def newest(rows: DataFrame, most: int, at: str = "created_at", tie: str = "hash") -> DataFrame:
    """The ``most`` newest rows, equal times by ``tie``: whole hours from the newest on, and the rest from the hour in which they run out.

    Only hours and their counts come to the driver, and only that one hour's rows are put in order, by range.
    """
    hour = F.date_trunc("hour", at)
    left = most
    counts = rows.where(F.col(at).isNotNull()).groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("hour"))
    for r in counts.toLocalIterator():
        if r.n > left:
            last = F.lit(r.hour).cast(rows.schema[at].dataType)
            some = numbered(rows.where(hour == last), [F.desc(at), F.asc(tie)], "_place").where(F.col("_place") <= left).drop("_place")
            return rows.where(hour > last).unionByName(some)
        left -= r.n
    return rows.where(F.col(at).isNotNull())


def live_cache(cache: DataFrame, now: Column, most: int = 10_000, hours: int = 24) -> DataFrame:
    """Cache rows younger than a day, and of those the newest ``most``."""
    return newest(cache.where(F.col("created_at") >= now - F.expr(f"INTERVAL '{hours}' HOUR")), most)


@dataclass(frozen=True)
class Provider:
    """An embedding under a version; ``embed`` gives null for a text on which it fails."""

    version: str
    embed: Callable[[Column], Column]


@dataclass
class Embedded:
    """What a batch gave (id, hash, embedding, version, cached, redacted, failed), the version in use after it, and the cache (hash, version, embedding, created_at)."""

    rows: DataFrame
    version: str
    cache: DataFrame


def embed_all(texts: DataFrame, cache: DataFrame, version: str, now: Column, primary: Provider | None, fallback: Provider | None = None, most: int = 10_000, hours: int = 24) -> Embedded:
    """Embed a batch of texts (id, text, boundary_class) through a cache, with a second provider for the rows on which the first fails.

    Confidential texts are redacted before they are hashed. The cache is asked first, so rows that it has need no provider: its entries
    of the ``version`` in use that are younger than ``hours``. Equal texts are embedded once. A row on which both fail, or that finds no
    provider, has a null vector and ``failed``. Afterwards the version in use is that of the primary if it served any new row, else of the
    fallback if that did, else it stays; if it changed, all older entries go. New vectors of that version enter the cache, which
    keeps its newest ``most``.
    """
    said = F.when(confidential(F.col("boundary_class")), redacted_for_embedding(F.col("text"))).otherwise(F.col("text"))
    prepared = texts.select("id", said.alias("said"), (~said.eqNullSafe(F.col("text"))).alias("redacted"))
    hashed = prepared.withColumn("hash", F.sha2(F.coalesce("said", F.lit("")).cast("binary"), 256))
    young = cache.where((F.col("version") == version) & (F.col("created_at") >= now - F.expr(f"INTERVAL '{hours}' HOUR")))
    have = young.groupBy("hash").agg(F.max_by("embedding", "created_at").alias("embedding"))
    hits = hashed.join(have, "hash").select("id", "hash", "embedding", F.lit(version).alias("version"), F.lit(True).alias("cached"), "redacted")
    missed = hashed.join(have, "hash", "left_anti")
    fresh = missed.groupBy("hash").agg(F.min("said").alias("said"))
    null = F.lit(None)
    kind = VECTOR
    one = materialize(fresh.select("hash", "said", (primary.embed(F.col("said")) if primary else null).cast(kind).alias("embedding"), F.lit(primary.version if primary else None).cast("string").alias("version")), "first")
    served = one.where("embedding is not null").select("hash", "embedding", "version")
    # The second provider sees only what the first one failed on.
    rest = one.where("embedding is null").select("hash", (fallback.embed(F.col("said")) if fallback else null).cast(kind).alias("embedding"), F.lit(fallback.version if fallback else None).cast("string").alias("version"))
    new = materialize(served.unionByName(rest).withColumn("version", F.when(F.col("embedding").isNotNull(), F.col("version"))), "embedded")
    used = {r.version for r in new.where("version is not null").select("version").distinct().collect()}
    after = next((p.version for p in (primary, fallback) if p and p.version in used), version)
    table = new.join(missed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "hash")
    made = spread_join(missed.select("id", "hash", "redacted"), materialize(table, "made"), ["hash"], "n", "id").withColumn("cached", F.lit(False))
    rows = hits.unionByName(made.select(*hits.columns)).withColumn("failed", F.col("embedding").isNull())
    entered = new.where(F.col("version") == after).select("hash", "version", "embedding", now.alias("created_at"))
    kept = cache.select("hash", "version", "embedding", "created_at").where(F.col("version") == after) if after == version else entered.where("false")
    kept = kept.join(entered.select("hash"), "hash", "left_anti").select(*entered.columns)
    return Embedded(rows, after, newest(kept.unionByName(entered), most))


def cache_stats(cache: DataFrame) -> DataFrame:
    """(version, entries, oldest, newest) of a cache, and one row with a null version for all of it."""
    return cache.rollup("version").agg(F.count(F.lit(1)).alias("entries"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
