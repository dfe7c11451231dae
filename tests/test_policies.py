"""Policy documents: odd values, empty tables, null documents."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import policies as P

GOOD = {
    "version": "1",
    "boundary": {"scopes": {s: {"ttl": "1d"} for s in P.SCOPE_NAMES}, "boundary_classes": {"public": {"allow": ["*"]}}},
}


def errors(spark, *documents):
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "i int, d string")
    found = rows.select("i", P.policy_errors(F.try_parse_json("d")).alias("e")).collect()
    return [r.e for r in sorted(found)]


def test_valid_and_no_documents(spark):
    got = errors(spark, json.dumps(GOOD), json.dumps(GOOD | {"retrieval": {}, "maintenance": {}}), None, "", "3", "null")
    assert got == [[], []] + [["policy must be object"]] * 4


@pytest.mark.parametrize(
    "change, want",
    [
        ({"version": ""}, []),
        ({"version": None}, ["version must be string"]),
        ({"boundary": []}, ["boundary must be object"]),
        ({"boundary": 0}, ["boundary missing", "boundary must be object"]),
        ({"boundary": GOOD["boundary"] | {"boundary_classes": {}}}, []),
        ({"boundary": GOOD["boundary"] | {"boundary_classes": "all"}}, ["boundary_classes must be object"]),
        ({"boundary": GOOD["boundary"] | {"scopes": "all"}}, [f"scopes.{s} missing" for s in sorted(P.SCOPE_NAMES)]),
        ({"retrieval": None}, ["retrieval must be object"]),
        ({"retrieval": {"hybrid": {"topology": {"max_hops": 2.0, "hop_decay": 1, "seed_k": 3.0}}}}, []),
        ({"retrieval": {"hybrid": {"topology": {"max_hops": -1}}}}, ["topology.max_hops must be between 0 and 2"]),
        ({"retrieval": {"hybrid": {"topology": {"max_hops": 2.5}}}}, ["topology.max_hops must be integer"]),
        ({"retrieval": {"hybrid": {"topology": {"mode": None}}}}, ["topology.mode must be one of walk"]),
        ({"retrieval": {"hybrid": {"topology": {"edge_policy": None}}}}, ["topology.edge_policy must be object"]),
        ({"maintenance": {"stale_days": True}}, ["maintenance.stale_days must be number"]),
        ({"other": 1, "a.b": 2}, []),
    ],
)
def test_one_fault(spark, change, want):
    assert errors(spark, json.dumps(GOOD | change)) == [want]


def test_settings_of_odd_documents(spark):
    given = [None, "[]", '{"retrieval": {"hybrid": {"mmr": {"enabled": 1}, "alpha": 1e400, "k_txt": 0.5, "topology": {"enabled": false}}}}']
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(given)], "i int, d string")
    got = [r.s for r in sorted(rows.select("i", P.search_settings(F.try_parse_json("d")).alias("s")).collect())]
    assert got[0] == got[1] and (got[0].alpha, got[0].k_text, got[0].k_vec, got[0].mmr) == (0.65, 128, 256, None)
    assert {k: tuple(e) for k, e in got[0].topology.edges.items()} == P.EDGES
    assert got[2].alpha == 0.65 and got[2].k_text == 1 and got[2].mmr is None and got[2].topology is None
    assert rows.limit(0).select(P.policy_errors(F.try_parse_json("d")).alias("e")).collect() == []
