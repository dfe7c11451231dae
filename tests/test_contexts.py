"""Co-activation with contexts of every size against plain counting, and one context of ten thousand claims."""

import itertools
import random
from collections import Counter, defaultdict

import pytest

from lodestone.operators import graph

SCHEMA = "active_context_id string, claim_id string"


def brute(rows, least):
    held = defaultdict(set)
    for c, claim in rows:
        if c is not None and claim is not None:
            held[c].add(claim)
    n = Counter(p for claims in held.values() for p in itertools.combinations(sorted(claims), 2))
    return {p: k for p, k in n.items() if k >= least}


@pytest.mark.parametrize("least", [2, 3])
def test_heavy_and_light_contexts(spark, monkeypatch, least):
    monkeypatch.setattr(graph, "HEAVY", 6)
    monkeypatch.setattr(graph, "BLOCK_CLAIMS", 7)
    rng = random.Random(least)
    rows = [(None, "c1"), ("x1", None)]
    for x in range(40):
        rows += [(f"x{x:02d}", f"c{rng.randrange(45):02d}") for _ in range(rng.choice([2, 4, 6, 20, 35]))]
    frame = spark.createDataFrame(rows * 2, SCHEMA).repartition(5)
    want = brute(rows, least)
    assert {(r.a, r.b): r.contexts for r in graph.shared_contexts(frame, least).collect()} == want
    pair = graph.coactivation(frame, least).collect()
    assert {(r.a, r.b): r.contexts for r in pair} == want
    assert all(len(r.context_ids.split(",")) == r.contexts for r in pair)


def test_one_context_of_ten_thousand_claims(spark):
    rows = [("all", f"c{i:05d}") for i in range(10_000)]
    rows += [(f"x{k}", f"c{i:05d}") for k in range(2) for i in (1, 2, 7)] + [("y", "c00001"), ("y", "c00009")]
    got = graph.shared_contexts(spark.createDataFrame(rows, SCHEMA))
    assert {(r.a, r.b): r.contexts for r in got.collect()} == {("c00001", "c00002"): 3, ("c00001", "c00007"): 3, ("c00002", "c00007"): 3}
    assert graph.shared_contexts(got.selectExpr("a AS active_context_id", "b AS claim_id").where("false")).count() == 0
