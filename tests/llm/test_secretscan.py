"""Secret scans: fixed patterns literally, decoding and marginals against all tag sequences, and what a trained field adds."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from lodestone.llm import secretscan as S

SCHEMA = "doc_id long, text string, n_assign long, spans string, kind string, likely string, x string"
HEXES = "0123456789abcdef"


def patterns(text):
    """The patterns as they are stated, matches that fail dropped afterwards."""
    name = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
    out = [(m.start(), 0, m.end()) for m in re.finditer(name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def random_text(rng):
    parts = ["password", "PassWd", "secret", "ſecret", "token", "toKen", "api_key", "APIKEY", " ", "  ", ":", "=", '"', "'", "é", "漢", "\n", "AKIA", "AKIAAKIA", "ABCDEFGH1234", "deadbeef", "0123456789abcdef", "hunter2", "a+b/c==", "word"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))


def test_patterns_literally():
    rng = random.Random(1)
    for _ in range(3000):
        text = random_text(rng)
        assert S.base_spans(text)[0] == patterns(text)
    assert S.base_spans("token=api_key: abcdefghij")[0] == []


def random_field(rng, unsure=0.3):
    emit = rng.normal(size=(S.FEATURES, 3)) * 0.4
    emit[: S.FIRST[1], 0] += np.where(rng.random(S.FIRST[1]) < unsure, 0, 30)
    return S.Field(emit, rng.normal(size=(3, 3)))


def best(score, move):
    def total(tags):
        path = (0, *tags, 0)
        return sum(score[t, y] for t, y in enumerate(tags)) + sum(move[a, b] for a, b in zip(path, path[1:]))

    return max(itertools.product(range(3), repeat=len(score)), key=total)


def test_decoding_is_the_best_of_all_sequences():
    rng, words = np.random.default_rng(4), random.Random(4)
    for round_ in range(30):
        field = random_field(rng, unsure=(0.2, 0.6, 1.0)[round_ % 3])
        texts = [" ".join(words.choice(["ab", "é", "x9", "QQ", "=", "longerword", "7"]) for _ in range(words.randint(0, 7))).encode() for _ in range(6)]
        buf, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        tokens = S.Tokens.of(buf, off)
        tags = field.tag(tokens, chunk=4)
        scores = field.emit[tokens.features(0, len(tokens.starts))].sum(axis=1) if len(tokens.starts) else np.zeros((0, 3))
        for a, b in zip(tokens.first, tokens.first[1:]):
            assert tuple(tags[a:b]) == best(scores[a:b], field.move)


def test_marginals_of_all_sequences():
    rng = np.random.default_rng(6)
    lens, move = np.array([1, 3, 4]), rng.normal(size=(3, 3))
    score, share = rng.normal(size=(3, 4, 3)), np.array([0.2, 0.3, 0.5])
    total, one, moved = S.marginals(score, lens, move, share)
    want_moved = np.zeros((3, 3))
    for r, n in enumerate(lens):
        weights, tags = [], list(itertools.product(range(3), repeat=n))
        for t in tags:
            path = (0, *t, 0)
            weights.append(np.exp(sum(score[r, k, y] for k, y in enumerate(t)) + sum(move[a, b] for a, b in zip(path, path[1:]))))
        p = np.array(weights) / sum(weights)
        assert np.isclose(total[r], np.log(sum(weights)))
        want = np.zeros((4, 3))
        for q, t in zip(p, tags):
            path = (0, *t, 0)
            for k, y in enumerate(t):
                want[k, y] += q
            for a, b in zip(path, path[1:]):
                want_moved[a, b] += q * share[r]
        assert np.allclose(one[r], want)
    assert np.allclose(moved, want_moved)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(vocab) if rng.random() > 0.05 else str(rng.randrange(10**6)) for _ in range(n)) + "."

    def value(chars, n):
        return "".join(rng.choice(chars) for _ in range(n))

    rows = []
    for i in range(300):
        text = prose(40)
        if i % 3 == 0:
            text += f' token = "{value(HEXES, 40)}" ' + prose(30)
        if i % 5 == 0:
            text += f" password: {value('abcdefgh0123456789', 16)} é " + prose(20)
        rows.append((i, text))
    unseen = [(1000 + i, f"{prose(15)} token is {value(HEXES, 28)} {prose(10)}") for i in range(20)]
    clean = [(2000 + i, prose(60)) for i in range(40)]
    odd = [(3000, None), (3001, ""), (3002, " \n\t"), (None, "password=abcdefgh"), (1, rows[1][1]), (3003, "é" * 5 + "AKIA" + "A" * 20 + "漢 " + prose(9000)), (3004, value(HEXES, 100_000))]
    return rows, unseen, clean, odd


def test_field_adds_spans_and_base_spans_stay(spark, corpus):
    rows, unseen, clean, odd = corpus
    everything = rows + unseen + clean + odd
    docs = spark.createDataFrame([(d, t, 1, "s", "k", "l", "x") for d, t in everything], SCHEMA).repartition(4)
    got = S.find_secrets(docs).collect()
    assert len(got) == len(everything)
    by = {r.doc_id: r for r in got}
    for d, t in everything:
        if (d, t) == (1, None):
            continue
        r, base = by[d], patterns(t or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))
        assert r.base_sha256 == hashlib.sha256(S.written(base).encode()).hexdigest()
        spans = [(int(a), S.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert spans == sorted(spans) and [s for s in spans if s[1] < 3] == base
        for a, k, b in spans:
            assert 0 <= a < b <= len(t) and (k < 3 or all(b <= s or e <= a for s, _, e in base))
    found = [d for d, t in unseen if any(t[int(a) : int(b)] == t.split("token is ")[1].split()[0] for k, a, b in (s.split(":") for s in by[d].spans.split(",") if s) if k == "tagged")]
    assert len(found) >= 16
    assert sum(by[d].spans != "" for d, _ in clean) <= 1


def test_nothing_to_learn_from(spark, corpus):
    clean = spark.createDataFrame([(d, t, 1, "s", "k", "l", "x") for d, t in corpus[2]], SCHEMA)
    assert S.train(clean) is None and {r.spans for r in S.find_secrets(clean).collect()} == {""}
    assert S.find_secrets(clean.where("false")).count() == 0
