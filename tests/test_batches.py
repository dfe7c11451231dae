"""Upserts, imports, merges and folds against a loop over the rows, one after another: keys that repeat inside a batch, hot keys."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import exchange as E
from lodestone.operators import lifecycle as L

CLAIM = "id string, hash string, text string, kind string, scope string, boundary_class string, memory_type string, tombstone boolean, created_at timestamp_ntz, seq long"


def claims(spark, rows):
    names = [f.split()[0] for f in CLAIM.split(", ")]
    full = [{"kind": "fact", "scope": "project", "boundary_class": "internal", "memory_type": None, "tombstone": False, "created_at": None, "seq": 0, "text": "t"} | r for r in rows]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], CLAIM)


@pytest.fixture(scope="module")
def queue(spark):
    return spark.createDataFrame([("p", "o_h1", "rolled_back")], "id string, accepted_claim_id string, status string")


def test_upserts_see_earlier_rows_of_the_batch(spark, queue):
    rng = random.Random(1)
    old = [{"id": f"o_h{k}", "hash": f"h{k}", "text": "a", "tombstone": k == 0} for k in range(4)]
    batch = [{"id": f"n{i}", "hash": f"h{rng.randrange(9)}", "text": rng.choice("aab"), "seq": i} for i in range(120)]
    held = {r["hash"]: [r["id"], r["text"], r["id"] not in ("o_h0", "o_h1")] for r in old}
    want = []
    for r in batch:
        if r["hash"] not in held:
            held[r["hash"]] = [r["id"], r["text"], True]
            action = "new"
        elif held[r["hash"]][1] != r["text"]:
            action = "collision"
        else:
            action = "existing" if held[r["hash"]][2] else "revived"
            held[r["hash"]][2] = True
        want.append((r["hash"], held[r["hash"]][0], action))
    got = L.upsert_claims(claims(spark, batch).repartition(3), claims(spark, old), queue, ["seq"])
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert {a for _, _, a in want} == {"new", "existing", "revived", "collision"}
    assert L.upsert_claims(claims(spark, batch).where("false"), claims(spark, old), queue, ["seq"]).count() == 0


def test_links_and_values_keep_the_last_write(spark):
    schema = "id string, source_claim_id string, target_claim_id string, link_type string, confidence double, created_by string, evidence_claim_id string, seq int"
    rng = random.Random(2)
    old = [("old", "a", "b", "related", 0.4, "import", "e0", 0)]
    batch = [(f"n{i}", "a", rng.choice("bc"), "related", rng.choice([None, float("nan"), 2.0, 0.3, -1.0]), rng.choice("xy"), rng.choice([None, f"e{i}"]), i) for i in range(40)]
    held = {r[1:4]: list(r) for r in old}
    for r in batch:
        c = 1.0 if r[4] is None or r[4] != r[4] else min(1.0, max(0.0, r[4]))
        was = held.get(r[1:4])
        held[r[1:4]] = [was[0] if was else r[0], *r[1:4], c, r[5], r[6] or (was[6] if was else None)]
    got = L.upsert_links(spark.createDataFrame(old, schema), spark.createDataFrame(batch, schema).repartition(4), ["seq"])
    assert sorted(tuple(r) for r in got.select("id", "source_claim_id", "target_claim_id", "link_type", "confidence", "created_by", "evidence_claim_id").collect()) == sorted(tuple(v[:7]) for v in held.values())
    values = spark.createDataFrame([("k", 1, 1), ("k", 9, 0), ("k", 5, 2), ("m", 3, 0), ("m", 4, 0)], "key string, v int, seq int")
    assert {r.key: r.v for r in L.overwrite(values.select("key", "v").limit(1), values, "key", ["v"], ["seq"]).collect()} == {"k": 5, "m": 4}


ORDER = {c: k for k, c in enumerate(E.CLASSES)}


def test_imports_never_weaken_a_class(spark, queue):
    rng = random.Random(3)
    old = [{"id": f"o_h{k}", "hash": f"h{k}", "boundary_class": rng.choice(E.CLASSES[:3]), "memory_type": rng.choice([None, "norm"]), "tombstone": k == 0} for k in range(5)]
    batch = [
        {"id": "x", "hash": f"h{rng.randrange(12)}", "text": f"t{i}", "kind": rng.choice(["fact", "task"]), "scope": rng.choice(["project"] * 5 + ["session"]), "boundary_class": rng.choice(E.CLASSES),
         "memory_type": rng.choice([None, None, "norm", "evidence"]), "tombstone": rng.random() < 0.1, "seq": i}
        for i in range(150)
    ]
    held = {r["hash"]: dict(r, dead=r["id"] in ("o_h0", "o_h1")) for r in old}
    want, inserted = [], {}
    for r in batch:
        h = held.get(r["hash"])
        barred = "skipped_scope" if r["scope"] == "session" else "skipped_duplicate" if r["boundary_class"] == "secret" else "skipped_tombstone" if r["tombstone"] else None
        if barred:
            # The id is that of a local claim; one that this batch inserts has none before it.
            want.append((r["hash"], barred, r["boundary_class"], r["memory_type"], h["id"] if h and h["id"][0] == "o" else None))
            continue
        if h is None:
            h = held[r["hash"]] = dict(r, id="clm_" + r["hash"], dead=False)
            inserted[r["hash"]] = h
            action = "new"
        elif h["dead"]:
            action = "skipped_duplicate"
        else:
            action = "upgraded_boundary" if ORDER[r["boundary_class"]] > ORDER[h["boundary_class"]] else "skipped_duplicate"
            h["boundary_class"] = max(h["boundary_class"], r["boundary_class"], key=ORDER.get)
            h["memory_type"] = h["memory_type"] or r["memory_type"]
        want.append((r["hash"], action, h["boundary_class"], h["memory_type"], h["id"]))
    new, local = claims(spark, batch).repartition(3), claims(spark, old)
    got = E.import_claims(new, local, queue, ["seq"])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    rows = E.inserted_claims(new, local, queue, ["seq"]).collect()
    assert {(r.hash, r.id, r.text, r.kind, r.boundary_class, r.memory_type) for r in rows} == {(k, h["id"], h["text"], h["kind"], h["boundary_class"], h["memory_type"]) for k, h in inserted.items()}


def test_replicas_merge_in_any_order(spark):
    import datetime

    rng = random.Random(4)
    parts = []
    for k in range(5):
        rows = [{"id": "x", "hash": f"h{rng.randrange(15)}", "text": rng.choice("ab"), "kind": rng.choice(["fact", "task"]), "boundary_class": rng.choice(E.CLASSES), "memory_type": rng.choice([None, "norm", "evidence"]), "created_at": datetime.datetime(2024, 1, rng.randrange(1, 4))} for _ in range(12)]
        parts.append(claims(spark, rows))
    first = sorted(map(repr, map(tuple, E.merge_replicas(parts).collect())))
    for order in itertools.islice(itertools.permutations(range(5)), 7, 120, 29):
        again = [parts[i] for i in order] + [parts[order[0]], parts[order[2]]]
        assert sorted(map(repr, map(tuple, E.merge_replicas(again).collect()))) == first
    halves = E.merge_replicas(parts[:3]).withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    classes = {r.hash: r.boundary_class for r in E.merge_replicas(parts).collect()}
    assert all(ORDER[r.boundary_class] <= ORDER[classes[r.hash]] for r in halves.collect())


def test_a_fold_splits_one_key(spark, monkeypatch):
    """Places come from ranges, so one claim's events are folded by many tasks; the result is that of a loop."""
    monkeypatch.setattr(L, "CHUNK", 16)
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.9 else f"c{rng.randrange(5)}", rng.randrange(500), i, rng.choice([0.4, -0.3, 0.05, -0.6])) for i in range(3000)]
    got = {r.key: r for r in L.clamped_fold(spark.createDataFrame(rows, "key string, ts long, seq long, d double").repartition(6), "key", ["ts", "seq"], F.col("d"), 0.0, 1.0).collect()}
    for key in {r[0] for r in rows}:
        x = 0.35
        for _, _, d in sorted((ts, seq, d) for k, ts, seq, d in rows if k == key):
            x = min(1.0, max(0.0, x + d))
        r = got[key]
        assert abs(min(r.u, max(r.l, 0.35 + r.s)) - x) < 1e-9


def test_embedding_fails_over_and_the_cache_keeps_its_newest(spark):
    import datetime

    from lodestone.functions import embeddings as M

    noon = datetime.datetime(2024, 1, 2, 12)
    texts = spark.createDataFrame([(f"t{i}", f"text {i % 30}", "internal") for i in range(60)] + [("null", None, "public"), ("pii", "a@b.org", "pii")], "id string, text string, boundary_class string")
    cache = texts.where("id in ('t0', 't1')").select(F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.lit("v1").alias("version"), F.array(F.lit(5.0)).alias("embedding"), F.lit(noon - datetime.timedelta(hours=30)).cast("timestamp_ntz").alias("created_at"))
    n = F.regexp_extract
    third = M.Provider("v1", lambda c: F.when(n(c, r"(\d+)$", 1).try_cast("int") % 3 != 0, F.array(F.lit(1.0))))
    other = M.Provider("v2", lambda c: F.when(~c.endswith("9"), F.array(F.lit(2.0))))
    now = F.lit(noon).cast("timestamp_ntz")
    out = M.embed_all(texts, cache, "v1", now, third, other, most=12)
    rows = {r.id: r for r in out.rows.collect()}
    assert len(rows) == 62 and out.version == "v1" and not any(r.cached for r in rows.values())
    for i in range(60):
        k = i % 30
        want = "v1" if k % 3 else "v2" if k % 10 != 9 else None
        assert (rows[f"t{i}"].version, rows[f"t{i}"].failed) == (want, want is None)
    assert rows["pii"].redacted and rows["null"].failed
    left = out.cache.collect()
    assert len(left) == 12 and {r.version for r in left} == {"v1"} and all(r.created_at == noon for r in left)
    again = M.embed_all(texts, out.cache, "v1", now, None, other)
    assert again.version == "v2" and {r.version for r in again.cache.collect()} == {"v2"}
    assert sum(r.cached for r in again.rows.collect()) == 24
    assert M.embed_all(texts, cache.where("false"), "v1", now, None).rows.where("not failed").count() == 0
