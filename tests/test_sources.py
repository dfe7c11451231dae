"""Record files, policies and streams."""

import datetime
import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import checks, embeddings
from lodestone.sources import records
from lodestone.streaming import jobs
from tests.conftest import SF


def test_record_directory_keeps_bad_files_as_rows(spark, tmp_path):
    for scope in ("project", "principle"):
        (tmp_path / "claims" / scope).mkdir(parents=True)
    (tmp_path / "claims/project/a.json").write_text(json.dumps({"text": "x", "kind": "fact", "scope": "project", "boundary_class": "public"}, indent=2))
    (tmp_path / "claims/principle/b.json").write_text("{ not json")
    rows = records.read_records(spark, str(tmp_path / "claims"), records.CLAIM).collect()
    assert sorted((r.text or "", r.bad) for r in rows) == [("", True), ("x", False)]
    status = {r.folder: r.files for r in records.folder_status(spark, str(tmp_path / "claims")).collect()}
    assert status == {"project": 1, "principle": 1}


def test_audit_appends(spark, tmp_path):
    rows = spark.createDataFrame([("observe", True)], "op string, ok boolean")
    for _ in range(2):
        records.append_audit(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_policy():
    assert records.retrieval_policy({}).alpha == 0.65
    assert records.retrieval_policy({"retrieval": {"max_hops": 9, "k_text": 0}}).max_hops == 2
    for bad in ({"retrieval": {"typo": 1}}, {"retrieval": {"alpha": 2}}, {"retrieval": {"hop_decay": 0}}):
        with pytest.raises(ValueError):
            records.retrieval_policy(bad)


def test_latest_policy_and_reconcile(spark):
    p = spark.createDataFrame([("a", "1", "2024-01-01"), ("b", "2", "2024-02-01")], "id string, version string, created_at string")
    assert records.latest_policy(p).first().version == "2"
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
    assert [tuple(r) for r in records.reconcile(p, schema, {"n": 7}).orderBy("id").collect()] == [("a", 7), ("b", 7)]


def test_rejects(spark):
    rows = spark.createDataFrame([("ok", "fact", "project", "public", None), (None, "odd", "session", "secret", "norm")], "text string, kind string, scope string, boundary_class string, memory_type string")
    got = [r.reasons for r in checks.rejected(rows, checks.claim_rules()).collect()]
    assert got == [[], ["text", "kind", "scope", "boundary_class"]]


def test_stream_equals_batch(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = jobs.stream_of(spark, f"{SF}/events.parquet", events.schema)
    want = {(r.start, r.event_type): r.n for r in jobs.windowed_counts(events, "1 day").collect()}
    got = {(r.start, r.event_type): r.n for r in jobs.run_once(jobs.windowed_counts(stream, "1 day", "60 days"), "windows", "update", ["start", "event_type"]).collect()}
    assert got == want


def test_update_mode_keeps_the_last_state_of_a_window(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for k in range(4):
        events.where(f"event_id % 4 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    got = jobs.run_once(jobs.windowed_counts(stream, "1 day", "60 days"), "windows", "update", ["start", "event_type"]).collect()
    want = {(r.start, r.event_type): (r.n, r.total) for r in jobs.windowed_counts(events, "1 day").collect()}
    assert len(got) == len(want) and {(r.start, r.event_type): (r.n, pytest.approx(r.total)) for r in got} == want
    with pytest.raises(ValueError):
        jobs.run_once(stream, "windows", "update")


def test_bag_embedding(spark):
    rows = spark.createDataFrame([("two words",), ("words two",), ("",), (None,), ("camelCase a_b",)], "t string")
    a, b, c, d, e = [r[0] for r in rows.select(embeddings.bag_embedding(rows.t)).collect()]
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-4
    assert c == d == [1.0] + [0.0] * 63
    assert embeddings._tokens("camelCase a_b") == ["camel", "case", "a", "b"] and e != a
    assert embeddings.fnv1a("") == 0x811C9DC5 and embeddings.fnv1a("a") == 0xE40C292C


def test_wave_embedding(spark):
    text = "Ab\U0001f600"
    h = 0
    for k in range(0, len(text.encode("utf-16-le")), 2):
        h = (h * 31 + int.from_bytes(text.encode("utf-16-le")[k : k + 2], "little")) & 0xFFFFFFFF
    h -= (h >> 31) << 32
    rows = spark.createDataFrame([(text,), (None,)], "t string").select(embeddings.wave_embedding(F.col("t")).alias("v")).collect()
    assert rows[0].v == pytest.approx([math.sin(h * i * 0.001) * 0.5 for i in range(1, 385)]) and rows[1].v == [0.0] * 384


def test_cached_vectors_are_not_made_again(spark):
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def counted(texts: pd.Series) -> pd.Series:
        made.add(len(texts))
        return pd.Series([[float(len(t))] for t in texts])

    texts = spark.createDataFrame([("a", "x", "public"), ("b", "yy", "public"), ("c", "yy", "internal"), ("d", "m@x.org", "secret")], "id string, text string, boundary_class string")
    cache = texts.where("id = 'a'").select(F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.lit("v").alias("version"), F.array(F.lit(9.0)).alias("embedding"))
    got = {r.id: (r.embedding, r.cached, r.redacted) for r in embeddings.with_cache(texts, cache, "v", counted).collect()}
    assert got == {"a": ([9.0], True, False), "b": ([2.0], False, False), "c": ([2.0], False, False), "d": ([10.0], False, True)}
    assert made.value == 2


def test_record_files_and_manifest(spark, tmp_path):
    base = f"file://{tmp_path}"
    rows = spark.createDataFrame([("claims/project/a.json", '{"text":"x","kind":"fact"}'), ("claims/principle/b.json", '{"text":"y"}')], "file string, document string")
    assert records.write_files(rows, base).count() == 2
    assert (tmp_path / "claims/project/a.json").read_text() == '{\n  "text": "x",\n  "kind": "fact"\n}\n'
    assert {r.text for r in records.read_records(spark, f"{base}/claims", records.CLAIM).collect()} == {"x", "y"}
    at = datetime.datetime(2024, 2, 1, tzinfo=datetime.UTC)
    assert records.read_manifest(base) is None and records.pull_manifest(base, at) is None
    records.push_manifest(base, at, "1")
    assert records.pull_manifest(base, at)["last_pull_at"] == at.isoformat()
    again = records.push_manifest(base, at, "2", "p")
    assert again["last_pull_at"] == at.isoformat() and again["last_push_policy_version"] == "p"
    (tmp_path / "manifest.json").write_text('{"version": "9"}')
    assert records.read_manifest(base) is None


def test_policy_documents_and_limits(tmp_path):
    (tmp_path / "p.json").write_text('{"retrieval": {"alpha": 0.5}}')
    assert records.retrieval_policy(records.read_policy(f"file://{tmp_path}/p.json")).alpha == 0.5
    yaml = pytest.importorskip("yaml")
    (tmp_path / "p.yaml").write_text(yaml.safe_dump({"retrieval": {"max_hops": 1}}))
    assert records.retrieval_policy(records.read_policy(f"file://{tmp_path}/p.yaml")).max_hops == 1
    assert [records.limit_or(v, 10) for v in (None, float("nan"), float("inf"), "3", True, -4, 0, 7.9)] == [10, 10, 10, 10, 10, 1, 1, 7]
