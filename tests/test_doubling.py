"""Depths, cyclic cores and chains by doubling against plain loops, and how many tables a long chain takes."""

import random

from lodestone.operators import graph
from tests.test_functions import chains_by_search, links_of


def depth_by_loop(edges):
    nexts = {}
    for u, v in edges:
        if u != v:
            nexts.setdefault(u, set()).add(v)
    ids, out = {x for e in edges if e[0] != e[1] for x in e}, {}
    while True:
        more = {i: 1 + max((out[v] for v in nexts.get(i, ())), default=-1) for i in ids - set(out) if all(v in out for v in nexts.get(i, ()))}
        if not more:
            return out
        out |= more


def core_by_loop(edges):
    left = {(u, v) for u, v in edges if u != v}
    while True:
        core = {(u, v) for u, v in left if any(w == u for _, w in left) and any(w == v for w, _ in left)}
        if core == left:
            return left
        left = core


def test_random_graphs(spark):
    """Several graphs in one, each with its own names, so that one run covers many shapes."""
    edges = []
    for seed in range(25):
        rng = random.Random(seed)
        n = rng.choice([4, 8, 14])
        for _ in range(rng.choice([n, n * 3 // 2])):
            a, b = rng.randrange(n), rng.randrange(n)
            if seed % 2:
                a, b = min(a, b), max(a, b)
            edges.append((f"{seed:02d}_{a:02d}", f"{seed:02d}_{b:02d}"))
        edges += [(f"{seed:02d}_t{k:02d}", f"{seed:02d}_t{k + 1:02d}") for k in range(rng.randrange(12))] + [(f"{seed:02d}_t05", f"{seed:02d}_00")]
    frame = spark.createDataFrame(sorted(set(edges)), "u string, v string")
    assert {r.id: r.depth for r in graph.depths(frame).collect()} == depth_by_loop(edges)
    assert {(r.u, r.v) for r in graph.cyclic_edges(frame).collect()} == core_by_loop(edges)
    got = {r.root: (r.length, r.chain) for r in graph.longest_chains(links_of(spark, "supersedes", edges)).collect()}
    assert got == chains_by_search({e for e in edges if e[0] != e[1]})


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    tables, real = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: tables.append(name) or real(df, name))
    edges = [(f"v{k:06d}", f"v{k + 1:06d}") for k in range(2000)] + [("side", "v000100")]
    got = {r.root: (r.length, r.chain.split(">")[-1]) for r in graph.longest_chains(links_of(spark, "supersedes", edges)).collect()}
    assert got == {"v000000": (2000, "v002000"), "side": (1901, "v002000")}
    assert sum(t in ("runs", "jumps", "places") for t in tables) < 20


def test_empty_and_one_edge(spark):
    none = links_of(spark, "supersedes", [("a", "b")]).where("false")
    assert graph.longest_chains(none).count() == 0 and graph.cyclic_edges(none.selectExpr("source_claim_id AS u", "target_claim_id AS v")).count() == 0
    assert [tuple(r) for r in graph.longest_chains(links_of(spark, "supersedes", [("a", "b"), ("a", "a")]), least=1).collect()] == [("a", 1, "a>b")]


def test_a_dense_part_is_one_finding(spark):
    dense = [(f"d{i:02d}", f"d{j:02d}") for i in range(14) for j in range(14) if i != j]
    pair = [("x", "y"), ("y", "x"), ("y", "z")]
    got = {(r.cycle, r.length) for r in graph.small_cycles(links_of(spark, "contradicts", dense + pair)).collect()}
    assert got == {("x>y", 2), ("d00...14", 14)}
