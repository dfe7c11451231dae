"""The index of vectors against all pairs: recall, copies, hot buckets over many blocks, odd rows."""

import datetime

import numpy as np
import pytest

from lodestone.operators import neighbours as N

SCHEMA = "id string, block string, hash string, created_at timestamp_ntz, embedding array<double>"
DAY = datetime.datetime(2024, 1, 1)


def made(n, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 24))
    rows = []
    for i in range(n):
        v = centres[min(11, int(rng.exponential(2)))] + spread * rng.normal(size=24)
        rows.append((f"r{i:05d}", "ab"[i % 2], f"h{i % (n - n // 5)}", DAY + datetime.timedelta(hours=int(rng.integers(40))), v.tolist()))
    return rows


def brute(rows, threshold):
    """The links, and for each id (number, nearest, newer)."""
    width = max(len(r[4] or []) for r in rows)
    m = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        m[k, : len(r[4] or [])] = r[4] or []
    norm = np.sqrt((m * m).sum(axis=1))
    m /= np.where(norm > 0, norm, 1)[:, None]
    s = np.round(m @ m.T, 9)
    out = {}
    for i, a in enumerate(rows):
        near = [(s[i, j], b[3], b[0]) for j, b in enumerate(rows) if i != j and a[1] == b[1] and a[1] and a[2] and b[2] and a[2] != b[2] and s[i, j] > threshold]
        newer = [(t, o, x) for x, t, o in near if (t, o) > (a[3], a[0])]
        out[a[0]] = (len(near), max(near)[2] if near else None, max(newer)[1] if newer else None)
    return out


@pytest.mark.parametrize("threshold,spread", [(0.85, 0.25), (0.7, 0.5)])
def test_recall_and_exact_answers(spark, threshold, spread):
    rows = made(700, 3, spread)
    want = brute(rows, threshold)
    got = {r.id: r for r in N.neighbours(spark.createDataFrame(rows, SCHEMA).repartition(5), threshold).collect()}
    links = sum(w[0] for w in want.values())
    assert links > 3000 and set(got) == set(want)
    assert sum(r.n_links for r in got.values()) >= 0.99 * links and all(got[i].n_links <= want[i][0] for i in want)
    same = [i for i in want if (got[i].n_links, got[i].nearest, got[i].newer) == want[i]]
    assert len(same) >= 0.97 * len(rows)


def test_hot_groups_are_cut_into_blocks(spark, monkeypatch):
    """Three quarters of all rows in one bucket of every band: copies of one vector and of one content, and near copies."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(9)
    base = rng.normal(size=16)
    rows = [(f"c{i:04d}", "a", "same", DAY + datetime.timedelta(hours=i % 7), base.tolist()) for i in range(200)]
    rows += [(f"d{i:04d}", "a", f"h{i}", DAY + datetime.timedelta(hours=i % 5), (base + 0.01 * rng.normal(size=16)).tolist()) for i in range(150)]
    rows += [(f"e{i:04d}", "a", f"g{i}", DAY, rng.normal(size=16).tolist()) for i in range(100)]
    want = brute(rows, 0.85)
    got = {r.id: (r.n_links, r.nearest, r.newer) for r in N.neighbours(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == want


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [("n", "a", "1", DAY, None), ("e", "a", "2", DAY, []), ("z", "a", "3", DAY, [0.0, 0.0]), ("x", "a", "4", DAY, v), ("y", "a", "5", DAY, [*v, 0.1]), ("h", "a", None, DAY, v), ("b", None, "6", DAY, v), ("o", "c", "7", DAY, v), ("s", "a", "4", DAY, v)]
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA + ", key string, band int")
    got = {r.id: (r.n_links, r.nearest, r.newer) for r in N.neighbours(frame).collect()}
    assert got == brute(rows, 0.85) and got["y"] == (2, "x", None) and got["s"] == (1, "y", "y")
    assert N.neighbours(frame.where("false")).count() == 0


def test_bands_are_few_for_many_rows():
    for rows in (10**4, 10**5, 10**6):
        planes, bands = N.band_shape(rows, 0.85)
        assert rows / 2**planes <= N.BUCKET_ROWS and bands <= 70
