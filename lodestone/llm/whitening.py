"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation (operator 12).

The centred rows A of the fit list lie in Parquet as blocks of doubles. Each step multiplies them by a vector and the result
by their transpose, block by block in tasks: u = A v - beta u', then z = A'u - alpha v. As every u is A g for some short g, only
vectors as long as a row are kept, and the products A'u give all inner products of the us; both the us and the vs are
orthogonalised in full, twice, against all before. The singular value decomposition of the small bidiagonal matrix yields the
components and their deviations. Where a step finds nothing new, the next begins with a fresh direction, so equal deviations
are found as often as they are there; the steps end when the variance left outside cannot hold a wanted component.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import materialize

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Scaled entries are held within this range, in which doubles count exactly.
LARGEST = float(1 << 53)
LOW_BITS = 20
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that have only finite entries, of the commonest length (of lengths as common, the larger)."""
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    kept = embeddings.select(F.col("vec_id").cast("long"), "embedding").where(finite)
    size = kept.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = size[0].d if size else 0

    def scaled(e):
        return F.floor(F.least(F.lit(LARGEST), F.greatest(F.lit(-LARGEST), SCALE * e.cast("double")))).cast("long") + SHIFT

    return kept.where(F.size("embedding") == d).select("vec_id", F.transform("embedding", scaled).alias("x"))


def _matrix(col: pa.Array, kind) -> np.ndarray:
    """The lists of a column, all of one length, as rows."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(len(col), -1) if len(col) else np.zeros((0, 0), kind)


def _summed(df: DataFrame, run, kind: str) -> np.ndarray:
    """Add up the numbered values that ``run`` yields for each partition; as many come back as one partition has."""
    rows = df.mapInArrow(run, f"k int, v {kind}").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows), np.int64 if kind == "long" else np.float64)
    for r in rows:
        out[r.k] = r.v
    return out


def _numbered(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["k", "v"])


def _totals(batches):
    """Sums of the high and of the low parts of each dimension, which both fit a long, and the number of vectors."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0), np.int64)
            part = np.concatenate(((x >> LOW_BITS).sum(axis=0), (x & ((1 << LOW_BITS) - 1)).sum(axis=0), [len(x)]))
            total = part if total is None else total + part
    if total is not None:
        yield _numbered(total)


@dataclass
class Centre:
    """The fit list's size and sums, and what centring needs: S = n * whole + rest with 0 <= rest < n."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the integer part is taken off exactly."""
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)^2, exact; null where one does not fit a long."""
        near = x - self.whole
        most = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((near * self.n - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((near.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def _blocks(centre: Centre):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([centre.centred(_matrix(batch.column(0), np.int64)).tobytes()], pa.binary())], names=["block"])

    return run


def _per_block(d: int, work):
    """Sum ``work`` over the blocks of a partition."""

    def run(batches):
        total = None
        for batch in batches:
            for block in batch.column(0):
                part = work(np.frombuffer(block.as_buffer(), np.float64).reshape(-1, d))
                total = part if total is None else total + part
        if total is not None:
            yield _numbered(total)

    return run


def _product(g: np.ndarray):
    """A'(A g), and the squares of A g and of A."""

    def work(a: np.ndarray) -> np.ndarray:
        u = a @ g
        return np.concatenate((a.T @ u, [u @ u, np.einsum("ij,ij->", a, a)]))

    return work


def _moments(q: np.ndarray):
    """The sums of A q and of its products, flat."""

    def work(a: np.ndarray) -> np.ndarray:
        w = a @ q
        return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

    return work


def bidiagonalise(product, d: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(right singular vectors as columns, singular values, squares of all entries) of A, ``wanted`` of them at least if there are so many.

    ``product`` maps g to A'(A g) followed by the squares of A g and of A.
    """
    rng = np.random.default_rng(12)
    vs, gs, ys = np.zeros((0, d)), np.zeros((0, d)), np.zeros((0, d))
    alphas, betas = [], []
    v, beta, squares, held = None, 0.0, 0.0, 0.0
    for step in range(d):
        if v is None:  # a fresh direction
            v, beta = rng.standard_normal(d), 0.0
            for _ in range(2):
                v -= vs.T @ (vs @ v)
            v /= np.linalg.norm(v)
        g = v - (beta * gs[-1] if step else 0.0)
        for _ in range(2):
            g = g - gs.T @ (ys @ g)
        out = product(g)
        y, alpha, squares = out[:d], float(np.sqrt(max(0.0, out[d]))), float(out[d + 1])
        least = np.finfo(float).eps * d * np.sqrt(squares)
        vs = np.vstack((vs, v))
        if step:
            betas.append(beta)
        alphas.append(alpha if alpha > least else 0.0)
        some = alpha > least
        gs, ys = np.vstack((gs, g / alpha if some else 0 * g)), np.vstack((ys, y / alpha if some else 0 * y))
        held += alphas[-1] ** 2 + (betas[-1] ** 2 if step else 0.0)
        z = ys[-1] - alphas[-1] * v
        for _ in range(2):
            z = z - vs.T @ (vs @ z)
        beta = float(np.linalg.norm(z))
        left, sigma, right = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        settled = len(sigma) >= wanted and (beta * np.abs(left[-1, :wanted])).max() <= 4 * np.finfo(float).eps * sigma[0]
        if squares == 0 or (settled and squares - held < 0.5 * sigma[wanted - 1] ** 2):
            break
        v, beta = (z / beta, beta) if beta > least else (None, 0.0)
    return vs.T @ right.T, sigma, squares


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and component up to ``components``.

    Entries become x = floor(64 c) + 1000000. The fit list holds each distinct x vector once: n vectors. Components are numbered from 1 by falling
    variance e; ``deviation`` is the row's exact sum of squares of n x - S (null where that passes a long), ``whitened`` its
    projection over sqrt(e), ``explained`` e over the whole variance, ``identity_error`` the largest entry of the covariance of the fit
    list's whitened rows minus the identity.

    Rows whose vector is null or holds null or non-finite entries are left out, and so are vectors of another than the
    commonest length. Repeated rows and null ids give rows of their own; extra columns are ignored. Directions without variance are no
    components, so one distinct vector alone, like an empty table, gives no rows.
    """
    spark, rows = embeddings.sparkSession, _rows(embeddings)
    fit = materialize(rows.select("x").distinct(), "fit")
    totals = _summed(fit, _totals, "long")
    d = len(totals) // 2
    if not d:
        return spark.createDataFrame([], OUT)
    centre = Centre(int(totals[-1]), [(int(high) << LOW_BITS) + int(low) for high, low in zip(totals[:d], totals[d:])])
    blocks = materialize(fit.mapInArrow(_blocks(centre), "block binary"), "blocks")
    vectors, sigma, squares = bidiagonalise(lambda g: _summed(blocks, _per_block(d, _product(g)), "double"), d, min(components, d))
    k = min(components, int((sigma > np.finfo(float).eps * d * sigma[0]).sum()))
    if not k:
        return spark.createDataFrame([], OUT)
    n, q, variance = centre.n, vectors[:, :k], sigma[:k] ** 2 / centre.n
    q = q / np.linalg.norm(q, axis=0)
    moments = _summed(blocks, _per_block(d, _moments(q)), "double")
    mean = moments[:k] / n
    covariance = (moments[k:].reshape(k, k) / n - np.outer(mean, mean)) / np.sqrt(np.outer(variance, variance))
    error = float(np.abs(covariance - np.eye(k)).max())
    explained = variance * n / squares

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column(1), np.int64)
            white = centre.centred(x) @ q / np.sqrt(variance)
            again = np.repeat(np.arange(m), k)
            cols = [
                batch.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)), pa.array(centre.deviations(x), pa.int64()).take(pa.array(again)),
                pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in OUT.split(", ")])

    return rows.mapInArrow(run, OUT)
