"""The word index and laid-out tables: the same rows as a scan, and what is read for them."""

import os
import random
import re
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import word_index as W
from lodestone.sources.layout import lay_out


def size(df):
    return sum(os.path.getsize(unquote(urlparse(f).path)) for f in df.inputFiles())


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(6)
    parts = ["error", "timeout", "Über", "naïve", "漢字テスト", "a b", "x", "%", "_", "retry", "İstanbul", "the the", "q" * 50]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randint(0, 6)))) for i in range(400)] + [(900, None), (901, ""), (902, "ab"), (903, "rare needle here")]
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "id long, text string, run string, part int")


def test_the_index_finds_what_a_scan_finds(texts):
    index = W.build(texts, parts=16)
    for words in (["needle"], ["TIMEOUT", "naïve"], ["漢字テ"], ["a b x"], ["nowhere"], ["ab"], ["x"], ["err", "x"], ["t%"], ["über"], ["qqqqqqqq"], ["the the"], []):
        want = {r.id for r in texts.where(X.any_word(F.col("text"), words)).collect()}
        assert {r.id for r in W.matches(texts, index, words).collect()} == want, words


def test_only_the_partitions_of_rare_runs_are_read(texts):
    index = W.build(texts, parts=16)
    posted, n = W.postings_of(index, "needle")
    # inputFiles of a filtered scan names all files, so what is read is told by the scan's own count of files.
    posted.collect()
    scan = posted._jdf.queryExecution().executedPlan().toString()
    assert n == 3 and "PartitionFilters: [isnotnull" in scan or "PartitionFilters: [part" in scan
    read = posted.select(F.input_file_name()).distinct().count()
    parts = {r.part for r in posted.select("part").distinct().collect()}
    assert len(parts) <= 3 and read < len(index.postings.inputFiles()) / 2
    assert W.postings_of(index, "zzz")[0].count() == 0
    assert W.build(texts.where("false")).postings.count() == 0


def test_scans_open_what_they_need_and_joins_need_no_exchange(spark):
    rng = random.Random(7)
    schema = "id string, scope string, created_at timestamp_ntz, `a.b` int"
    import datetime

    rows = [(f"c{i}", rng.choice(["project", "session", None]), None if i % 50 == 0 else datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randrange(4000)), i) for i in range(600)]
    frame = spark.createDataFrame(rows, schema)
    claims, values = lay_out(frame, "id", "month", 4), lay_out(frame.select("id", F.col("`a.b`").alias("v")), "id", buckets=4)
    at = F.lit(datetime.datetime(2024, 4, 10, 7)).cast("timestamp_ntz")
    some = claims.since(at, "project")
    want = {r[0] for r in rows if r[1] == "project" and r[2] and r[2] >= datetime.datetime(2024, 4, 10, 7)}
    assert {r.id for r in some.collect()} == want and claims.rows().count() == 600
    read = {unquote(r[0]) for r in some.select(F.input_file_name()).distinct().collect()}
    assert all("scope=project" in f for f in read) and len({f.split("_span=")[1][:7] for f in read}) <= 4
    joined = claims.since(at).join(values.rows().hint("merge"), "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and len(re.findall("Bucketed: true", plan)) == 2
    assert joined.count() == sum(bool(r[2]) and r[2] >= datetime.datetime(2024, 4, 10, 7) for r in rows)
    claims.drop()
    assert not spark.catalog.tableExists(claims.name)
