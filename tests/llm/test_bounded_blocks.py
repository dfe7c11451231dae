"""No index gets more than a block and the largest anchor that is indexed, however many different segments share an anchor."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import bwt, fm, quality, repeats


def guarded(real, most=2 * repeats.BLOCK):
    def make(window):
        settle = real(window)

        def run(segments, *rest):
            assert sum(map(len, segments)) <= most
            return settle(segments, *rest)

        return run

    return make


@pytest.fixture(scope="module")
def notices(spark):
    """A passage shorter than a window in most documents, and one longer than a window in all of those, between other words."""
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(3000)]
    line, notice = rng.sample(vocab, 20), rng.sample(vocab, 70)
    data = []
    for d in range(6000):
        words = rng.sample(vocab, 60)
        data.append((d, " ".join(words[:30] + (notice if d % 5 == 0 else line) + words[30:])))
    return data, spark.createDataFrame(data, "doc_id long, text string").repartition(8)


@pytest.mark.parametrize("most", [repeats.BLOCK, fm.INDEXED])
def test_words(notices, monkeypatch, most):
    data, docs = notices
    monkeypatch.setattr(fm, "INDEXED", most)
    monkeypatch.setattr(fm, "_settle", guarded(fm._settle, repeats.BLOCK + most))
    got = {r.doc_id: r.n_removed for r in fm.remove_repeated_words(docs).collect()}
    seen, want = set(), {}
    for d, t in data:
        w = t.split()
        keys = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        want[d] = len({j for i, k in enumerate(keys) if k in seen for j in range(i, i + 50)})
        seen.update(keys)
    assert got == want and sum(want.values()) >= 1199 * 70


def test_bytes(notices, monkeypatch):
    data, docs = notices
    monkeypatch.setattr(bwt, "_settle", guarded(bwt._settle))
    got = {r.doc_id: r.n_removed for r in bwt.remove_repeated_bytes(docs).collect()}
    counts = {}
    for _, t in data:
        for i in range(len(t) - 199):
            k = hash(t[i : i + 200])
            counts[k] = counts.get(k, 0) + 1
    for d, t in data:
        assert got[d] == len({j for i in range(len(t) - 199) if counts[hash(t[i : i + 200])] > 1 for j in range(i, i + 200)})


def test_one_anchor_with_ten_thousand_contexts(spark):
    """A passage longer than a window in 10 000 documents, all with other words around it."""
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(3000)]
    notice = rng.sample(vocab, 55)
    data = [(d, " ".join(rng.sample(vocab, 30) + notice + rng.sample(vocab, 30))) for d in range(10_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(8)
    # A word or two beside the passage may be the same by chance.
    assert {r.n_removed for r in fm.remove_repeated_words(docs).where("doc_id > 0").collect()} <= set(range(55, 60))
    got = bwt.remove_repeated_bytes(docs).collect()
    core = len(" ".join(notice))
    assert all(core <= r.n_removed <= core + 24 and r.n_spans == 1 for r in got)


@pytest.mark.parametrize("window", [9, 50, 89, 90, 91, 92, 137])
def test_windows_of_any_length(spark, window):
    rng = random.Random(window)
    base = "".join(rng.choices("abcdefgh ", k=700))
    data = []
    for d in range(40):
        a, n = rng.randrange(500), rng.choice([window - 1, window, window + 5])
        data.append((d, "".join(rng.choices("stuvwxyz", k=60)) + base[a : a + n] + "".join(rng.choices("stuvwxyz", k=60))))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    counts = {}
    for _, t in data:
        for i in range(len(t) - window + 1):
            counts[t[i : i + window]] = counts.get(t[i : i + window], 0) + 1
    got = {r.doc_id: r.n_removed for r in bwt.remove_repeated_bytes(docs, window).collect()}
    for d, t in data:
        assert got[d] == len({j for i in range(len(t) - window + 1) if counts[t[i : i + window]] > 1 for j in range(i, i + window)})


def test_long_texts_have_the_same_features_in_pieces(monkeypatch):
    rng = random.Random(3)
    parts = ["ab", "é", " ", "  ", "\n", "word!", "x" * 700, "7"]
    texts = ["".join(rng.choices(parts, weights=[9, 3, 9, 2, 2, 9, 0.1, 5], k=rng.choice([500, 2000]))) for _ in range(40)]
    whole = quality.features(pa.array(texts))
    monkeypatch.setattr(quality, "SLICE", 300)
    assert np.array_equal(whole, quality.features(pa.array(texts)))
