"""Steps that once held more on disk than their input and result need."""

import datetime
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import runtime
from lodestone.operators import lifecycle, search
from lodestone.operators.promotion import after_promotion


@pytest.fixture
def written(monkeypatch):
    """Names of the intermediate tables that lifecycle writes."""
    names, real = [], runtime.materialize
    monkeypatch.setattr(lifecycle, "materialize", lambda df, name: names.append(name) or real(df, name))
    return names


def test_texts_are_distilled_in_rounds(spark, monkeypatch, written):
    claims = spark.createDataFrame([(f"c{k}", "x" * (k * 10), "fact" if k < 5 else "task", ["evidence", "norm", None][k % 3], ["public", "pii"][k % 2]) for k in range(9)], "id string, text string, kind string, memory_type string, boundary_class string")
    items = spark.createDataFrame([(f"a{i}", k, f"c{(i * k) % 10}") for i in range(40) for k in range(1 + i % 5)], "candidate string, position int, id string")
    evidence = spark.createDataFrame([(f"c{k % 4}", f"e{k}") for k in range(9)], "claim_id string, id string")
    monkeypatch.setattr(lifecycle, "ROUND_BYTES", 1)
    want = lifecycle.distill(items.join(claims, "id"), evidence, 4, 130).withColumn("text", F.md5("text"))
    got = lifecycle.distill_items(items, claims, evidence, 4, 130, lambda text: F.md5(text))
    assert written.count("distilled") > 1
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    none = lifecycle.distill_items(items.limit(0), claims, evidence, 4, 130, lambda text: F.md5(text))
    assert none.count() == 0


def test_shuffle_files_go_with_their_action(spark):
    runtime.bounded(spark)
    root = spark.conf.get("spark.local.dir")

    def files():
        return sum(name.startswith("shuffle_") for _, _, names in os.walk(root) for name in names)

    before = files()
    df = spark.range(1000).repartition(4, "id")
    assert runtime.materialize(df, "dealt").count() == 1000
    for _ in range(100):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert df.count() == df.count() == 1000 and len(df.collect()) == len(df.collect()) == 1000


@pytest.fixture
def promoted(spark, monkeypatch):
    """Claims with vectors of few values, so that cosines tie, in small blocks; every fifth is asked, links go both ways."""
    monkeypatch.setattr(search, "BLOCK_VECTORS", 16)
    rng = np.random.default_rng(5)
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"c{k}", ["p", "q", None][k % 3], [f"h{k // 4}", None][k % 11 == 0], [start + datetime.timedelta(k % 4), None][k % 13 == 0], [float(v) for v in rng.integers(0, 3, 4)], k % 2 == 0) for k in range(200)]
    links = [(f"c{k}", f"c{(k * 7) % 200}") for k in range(0, 200, 3)] * 2 + [(f"c{(k * 3) % 200}", f"c{k}") for k in range(0, 200, 5)]
    table = spark.createDataFrame(rows, "id string, scope string, hash string, created_at timestamp_ntz, embedding array<double>, is_new boolean")
    return rows, set(links), after_promotion(table.where("cast(substring(id, 2) as int) % 5 = 0"), table, spark.createDataFrame(links, "source_claim_id string, target_claim_id string"))


def test_pairs_of_a_promotion_are_those_of_brute_force(promoted):
    rows, links, (alike, free) = promoted
    size = {r[0]: np.sqrt(sum(v * v for v in r[4])) for r in rows}
    close = {(a[0], b[0]): round(float(np.dot(a[4], b[4])) / size[a[0]] / size[b[0]], 9) for a in rows[::5] for b in rows if a[0] != b[0] and size[a[0]] and size[b[0]]}
    at = {r[0]: r for r in rows}
    want = {(a, b, s) for (a, b), s in close.items() if s > 0.85 and at[a][1] and at[a][1] == at[b][1] and at[a][2] and at[b][2] and at[a][2] != at[b][2]}
    assert want and {tuple(r) for r in alike.collect()} == want
    best = {}
    for (a, b), s in close.items():
        if at[a][5] and 0.7 <= (s + 1) / 2 < 0.85 and (a, b) not in links and (b, a) not in links:
            best.setdefault(a, []).append((-s, -at[b][3].timestamp() if at[b][3] else 0, b))
    want = {(a, b, place) for a, found in best.items() for place, (_, _, b) in enumerate(sorted(found)[:5], 1)}
    assert want and {(r.id, r.target, r.place) for r in free.collect()} == want


def test_pairs_of_a_promotion_are_not_written_or_joined(promoted):
    _, _, (alike, free) = promoted
    assert alike._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")
    above = free._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert "Window" in above and "Join" not in above and "Relation" not in above


def test_texts_of_a_promotion_are_compared_by_digests(spark):
    rows = spark.createDataFrame([("a", "pending", "h", "one", "fact", None, "public", False)], "id string, status string, hash string, text string, kind string, memory_type string, boundary_class string, tombstone boolean")
    queue = spark.createDataFrame([], "id string, accepted_claim_id string, status string")
    sources = spark.createDataFrame([], "candidate string, source_type string, source_id string")
    found = lifecycle.promote(rows, rows.where("false"), queue, sources).verdicts
    assert "sha2(" in found._jdf.queryExecution().optimizedPlan().toString() and found.first().verdict == "new"
