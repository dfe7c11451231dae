"""Steps whose moved bytes once grew faster than their input."""

import unicodedata

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import embeddings
from lodestone.functions import text as X
from lodestone.operators import evaluate, exchange, graph, lifecycle, word_index


PYTHON = ("EvalPython", "MapInArrow", "MapInPandas")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spread_of_similarities_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    m = np.vstack([rng.normal(size=(2500, 8)), np.ones((300, 8)), np.zeros((1, 8))])
    rows = [(f"v{i}", v.tolist()) for i, v in enumerate(m)]
    frame = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(5)
    got = {r.id: r for r in evaluate.similarity_spread(frame.where("cast(substring(id, 2) as int) % 200 = 0"), frame, 0.2).collect()}
    unit = m / np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-300)[:, None]
    assert len(got) == 15
    for i in range(0, len(m), 200):
        s = np.sort(np.delete(unit[i] @ unit.T, i))
        r = got[f"v{i}"]
        want = [s.mean(), *[s[min(int(np.floor(len(s) * p)), len(s) - 1)] for p in (0.5, 0.75, 0.9, 1.0)]]
        assert np.allclose([r["mean"], r.p50, r.p75, r.p90, r.p100], want, atol=2e-6) and abs(r.above - (s > 0.2).sum()) <= (abs(s - 0.2) < 1e-9).sum()


def test_made_claims_do_not_gather_the_real_ones(spark):
    golden = spark.range(30).select(F.format_string("c%02d", "id").alias("id"), F.lit("t").alias("text"), F.lit("k").alias("kind"), F.lit("s").alias("scope"))
    fillers = spark.createDataFrame([("e1", "x"), ("e2", "y")], "id string, name string")
    more = evaluate.synthetic_claims(spark, golden, 50, [("a {tech}", "fact", "project")], fillers)
    assert more.count() == 50 and "Limit" not in plan(more)
    few = evaluate.synthetic_claims(spark, golden, 7, [("a {tech}", "fact", "project")], fillers)
    assert sorted(r.id for r in few.collect()) == [f"c{k:02d}" for k in range(7)]


def test_items_are_distilled_like_sources(spark):
    claims = spark.createDataFrame([(f"c{k}", "x" * (k * 10), "fact" if k < 5 else "task", ["evidence", "norm", None][k % 3], ["public", "pii"][k % 2]) for k in range(9)], "id string, text string, kind string, memory_type string, boundary_class string")
    items = spark.createDataFrame([(f"a{i}", i * k % 7, f"c{(i * k) % 10}") for i in range(12) for k in range(1 + i % 5)], "candidate string, position int, id string")
    evidence = spark.createDataFrame([(f"c{k % 4}", f"e{k}") for k in range(9)], "claim_id string, id string")
    want = lifecycle.distill(items.join(claims, "id"), evidence, 4, 130)
    got = lifecycle.distill_items(items, claims, evidence, 4, 130)
    assert 0 < got.count() < items.join(claims, "id").select("candidate").distinct().count()
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_contexts_in_reach_are_counted_from_pairs_of_names(spark):
    reach = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "b"), ("q", "b"), ("z", "n")], "root string, id string")
    items = spark.createDataFrame([("x1", "a", 0.5, "t"), ("x1", "b", float("nan"), "u"), ("x2", "b", 0.7, None), (None, "b", None, "u")], "active_context_id string, claim_id string, score double, layer string")
    found = graph.affected_contexts(reach, items, F.col("layer"))
    assert "Expand" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("q", 2, 3, 1, "u,unknown", 0.7), ("r", 2, 4, 2, "t,u,unknown", 0.7)]


def test_upserts_move_digests_of_texts(spark):
    rows = spark.createDataFrame([("a", "h", "one", 1), ("b", "h", "two", 2), ("b", "h", "one", 3)], "id string, hash string, text string, seq int")
    old = spark.createDataFrame([], "id string, hash string, text string, tombstone boolean")
    queue = spark.createDataFrame([], "id string, accepted_claim_id string, status string")
    got = lifecycle.upsert_claims(rows, old, queue, ["seq"])
    assert "sha2(" in plan(got) and sorted(r.action for r in got.collect()) == ["collision", "existing", "new"]
    tied = rows.withColumn("seq", F.lit(1)).withColumn("id", F.lit("a"))
    assert sorted(tuple(r) for r in lifecycle.upsert_claims(tied, old, queue, ["seq"]).collect()) == [("h", "a", "collision"), ("h", "a", "new"), ("h", "a", "new")]


def test_replicas_are_told_apart_by_digests(spark):
    rows = spark.sql("select 'h' as hash, 'long text' as text, 'fact' as kind, 'project' as scope, 'public' as boundary_class, 'norm' as memory_type, timestamp_ntz '2024-01-01' as created_at")
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    merged = exchange.merge_replicas([rows, rows, rows.withColumn("boundary_class", F.lit("pii"))])
    assert "sha2(" in plan(merged)
    assert [tuple(r) for r in merged.collect()] == [("h", "long text", "fact", "project", "pii", "norm", 2)]


def test_promoted_rows_are_embedded_once(spark):
    from lodestone.plans import promotions
    from lodestone.sources.fixtures import Tables
    from tests.conftest import SF

    for df in promotions.after(Tables(spark, SF)):
        assert "_signed_buckets" not in plan(df)


def test_texts_are_composed_without_python_workers(spark):
    texts = ["plain", "é e\u0301 ü", "u\u0308\u0323", "\u212b \u1100\u1161\u11a8 \U0001d15e", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.composed(F.col("t")).alias("c"), X.content_hash(F.col("t")).alias("h"))
    assert not any(name in plan(rows) for name in PYTHON)
    assert [r.c for r in rows.collect()] == [t if t is None else unicodedata.normalize("NFC", t) for t in texts]


def test_runs_of_texts_are_found_without_python_workers(spark):
    texts = ["abcabc", "ab", "", "a\nb\r\nc", "x\U0001f600yz\U0001f600", "ééé é"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", word_index.runs_of(F.col("t")).alias("r"))
    assert not any(name in plan(rows) for name in PYTHON)
    for r in rows.collect():
        assert sorted(r.r) == sorted({r.t[k : k + 3] for k in range(len(r.t) - 2)})
    whole = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = word_index.matches(whole, word_index.build(whole, 4), ["BCA", "\U0001f600y"])
    assert sorted(r.id for r in found.collect()) == [0, 4]


def test_texts_are_embedded_without_python_workers(spark):
    texts = ["two words", "camelCase a_b x/y.z:w-v", "a " * 300 + "b9", "\u212aelvin \u0130 \U0001f600 0", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", embeddings.bag_embedding(F.col("t")).alias("v"))
    assert not any(name in plan(rows) for name in PYTHON)
    for r in rows.collect():
        v = np.zeros(64)
        for token in embeddings._tokens(r.t or ""):
            v[embeddings.fnv1a(token) % 64] += 1 - 2 * (embeddings.fnv1a(token + ":sign") & 1)
        length = np.sqrt((v * v).sum())
        assert np.allclose(r.v, v / length if length else np.eye(64)[0], atol=1e-6)


def test_waves_that_are_not_read_are_not_made(spark):
    from lodestone import plans
    from tests.conftest import SF

    text = plan(plans.load()[0]["x22_wave_embeddings"](spark, SF))
    assert not any(name in text for name in PYTHON) and "transform(" not in text


def test_relations_are_imported_without_being_joined_to_themselves(spark):
    entities = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = [("1", "a", "b", "T", '{"x":1,"y":2}'), ("2", "a", "b", "T", '{"x":1}'), ("3", "a", "z", "T", None), ("4", "a", "b", "T", "{}"), ("5", "a", "b", None, "no"), ("6", "b", "a", "U", "{}")]
    old = [("1", "a", "b", "T", '{"y": 2, "x": 1}'), ("2", "a", "b", "T", '{"x":2}'), ("4", "a", "b", "T", None), ("5", "a", "b", None, "none"), ("6", "b", "a", "T", "{}")]
    schema = "id string, src_id string, dst_id string, type string, props string"
    got = exchange.import_relations(spark.createDataFrame(rows, schema), spark.createDataFrame(old, schema), entities)
    assert plan(got).count("Join ") == 3
    want = {"1": "skipped_duplicate", "2": "relation_content_diff", "3": "missing_reference", "4": "skipped_duplicate", "5": "skipped_duplicate", "6": "relation_content_diff"}
    assert {r.id: r.action for r in got.collect()} == want


def test_pages_of_one_request_share_one_search_and_one_walk(spark, monkeypatch):
    from lodestone.operators import activate
    from lodestone.plans import load

    calls, real = [], activate.hybrid_search
    monkeypatch.setattr(activate, "hybrid_search", lambda *a: calls.append(1) or real(*a))
    assert load()[0]["r19_second_page"](spark, "/root/testdata/sf0.001").count() == 12
    assert len(calls) == 1


def test_relations_are_scanned_once_for_both_ways(spark):
    from lodestone.runtime import materialize

    rows = [("r1", "a", "b"), ("r2", "b", "a"), ("r3", "a", "a"), ("r4", "c", "b"), ("r5", "d", "e"), ("r6", None, "b")]
    relations = materialize(spark.createDataFrame(rows, "id string, src_id string, dst_id string"), "relations")
    held = materialize(spark.createDataFrame([("a",), ("b",)], "u string"), "held")
    want = {("a", "b", "r1"), ("b", "a", "r1"), ("b", "a", "r2"), ("a", "b", "r2"), ("a", "a", "r3"), ("b", "c", "r4"), ("b", None, "r6")}
    got = graph._hops(relations, held)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert plan(got).count("Relation [") == 3  # the relations and, twice, the few entities


def test_an_audit_makes_each_finding_once(spark):
    from lodestone.plans import graphs
    from lodestone.runtime import bounded
    from lodestone.sources.fixtures import Tables

    found = plan(graphs.findings(Tables(bounded(spark), "/root/testdata/sf0.001")))
    assert "Join" not in found and "Aggregate" not in found  # what is capped and counted is read, not made again


def test_components_have_claims_alone_as_vertices(spark, monkeypatch):
    seen, real = [], graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda e: seen.append({tuple(sorted(r)) for r in e.collect()}) or real(e))
    claims = spark.createDataFrame([(f"c{k:04}",) for k in range(1210)], "id string")
    # One entity with 1 200 claims, one with a single claim, and related entities of which one has no claim.
    held = [(f"c{k:04}", "hot") for k in range(1200)] + [("c1201", "x"), ("c1202", "y"), ("c1203", "y"), ("gone", "y"), ("c1204", "z"), ("c1205", None), ("c1206", None)]
    ce = spark.createDataFrame(held, "claim_id string, entity_id string")
    links = spark.createDataFrame([("c1207", "c1208"), ("c1208", "gone"), ("c1209", "gone")], "source_claim_id string, target_claim_id string")
    relations = spark.createDataFrame([("x", "y"), ("z", "none"), ("none", "x"), (None, "x")], "src_id string, dst_id string")
    got = {r.id: r.component for r in graph.claim_components(claims, links, ce, relations).collect()}
    want = {f"c{k:04}": "c0000" if k < 1200 else f"c{k:04}" for k in range(1210)} | {"c1202": "c1201", "c1203": "c1201", "c1208": "c1207"}
    assert got == want
    assert {v for pair in seen[0] for v in pair} <= set(want) and len(seen[0]) <= 1203


def test_generic_labels_are_told_without_splitting_long_texts(spark):
    texts = {"": True, "two words": True, "one two three": False, "x" * 25: False, "_" * 300: True, "some long sentence of words with a Note in it": True, "some long sentence of words with a notebook in it": False,
             "- " * 150 + "ab": True, "some long sentence with\nfoo_TODO-bar inside": True, "some long sentence with a note. inside": False}
    frame = spark.createDataFrame([*texts.items(), (None, None)], "label string, want boolean")
    assert frame.where(~X.generic_label(F.col("label")).eqNullSafe(F.col("want"))).count() == 0
    long = spark.createDataFrame([("word " * 400000,)], "label string")
    tree = plan(long.select(X.generic_label(F.col("label"))))
    assert "arrays_overlap" not in tree


def test_a_summary_forms_components_once_and_beside_the_findings(spark, monkeypatch):
    import threading

    from lodestone.plans import graphs
    from lodestone.runtime import bounded
    from lodestone.sources.fixtures import Tables

    calls, real = [], graphs.components
    monkeypatch.setattr(graphs, "components", lambda t: calls.append(threading.current_thread()) or real(t))
    monkeypatch.setattr(graphs, "findings", lambda t, component: component().selectExpr("'all' AS kind", "id AS subject"))
    rows = {r.kind: r.n for r in graphs.g11s(Tables(bounded(spark), "/root/testdata/sf0.001")).collect()}
    assert rows["all"] == rows["claims"] and len(calls) == 1
    assert calls[0] is not threading.main_thread()
