"""Whitening against numpy's eigenvectors of the exact covariance, with odd rows, equal deviations and missing rank."""

from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm import whitening
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, n long, x string, k string, v string, block string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "k", "v", "b") for i, v in rows], SCHEMA).repartition(3)


def scaled(v):
    return tuple(int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v)


def check(got, rows, components=16):
    kept = [(i, scaled(v)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    mean = [Fraction(s, n) for s in sums]
    a = np.array([[float(c - m) for c, m in zip(x, mean)] for x in fit])
    e, q = np.linalg.eigh(a.T @ a / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == len(kept) * k
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation, r.component), []).append(r)
    gap = [min([abs(e[j] - e[m]) for m in range(d) if m != j], default=1.0) / e[0] for j in range(k)]
    signs = {}
    for i, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        z = np.array([float(c - m) for c, m in zip(x, mean)])
        for j in range(k):
            r = by[(i, deviation if deviation < 1 << 63 else None, j + 1)][0]
            assert r.n == n and abs(r.explained - e[j] / e.sum()) <= 1e-9 * r.explained and r.identity_error <= 1e-9
            if gap[j] > 1e-6:
                want = z @ q[:, j] / np.sqrt(e[j])
                if abs(want) > 1e-3:
                    sign = signs.setdefault(j, np.sign(want * r.whitened))
                    assert abs(r.whitened * sign - want) < 1e-12 / gap[j] * (1 + abs(want)) + 1e-10
    return k


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 6)) * [3, 2, 1, 0.5, 0.5, 0.1]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [rows[3], (3, rows[4][1]), (None, rows[5][1]), (70, None), (71, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (72, [float("nan")] + [0.0] * 5), (73, [float("inf")] + [0.0] * 5)]
    got = whitening.whiten(frame(spark, [*rows, (74, [1.0, 2.0]), (75, [])])).collect()
    assert check(got, rows) == 6
    assert check(whitening.whiten(frame(spark, rows), components=2).collect(), rows, 2) == 2


def test_equal_deviations_and_missing_rank(spark):
    cross = [(i, [float(s) * (k == i // 2) for k in range(4)] + [1.0]) for i, s in enumerate([1, -1] * 4)]
    got = whitening.whiten(frame(spark, cross)).collect()
    assert check(got, cross) == 4 and {round(r.explained, 9) for r in got} == {0.25}
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0


def test_large_values_have_exact_or_no_deviation(spark):
    rows = [(i, [float(v), 1e9 * (i % 3)]) for i, v in enumerate([1e9, -1e9, 2.5e8, 7.0, 1e10])]
    check(whitening.whiten(frame(spark, rows)).collect(), rows)


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert check(whitening.whiten(table).collect(), rows) == 16


@pytest.mark.parametrize("decay", [0.3, 1.0])
def test_bidiagonalisation_stops_only_when_nothing_is_left(decay):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(300, 40)) * decay ** np.arange(40)
    calls = []

    def product(g):
        calls.append(1)
        return np.concatenate((a.T @ (a @ g), [(a @ g) @ (a @ g), (a * a).sum()]))

    v, s, _ = whitening.bidiagonalise(product, 40, 5)
    u = np.linalg.svd(a)
    assert np.allclose(s[:5], u[1][:5], rtol=1e-12)
    assert np.allclose(np.abs((v[:, :5] * u[2][:5].T).sum(axis=0)), 1, atol=1e-10)
    assert len(calls) <= (30 if decay < 1 else 40)
