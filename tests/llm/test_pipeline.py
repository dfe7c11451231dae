"""Stages of the corpus pipeline against their operators and brute force, on the smallest tables."""

import duckdb

import corpus_pipeline
from tests.conftest import SF


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert sorted(out.columns) == sorted(docs.columns)
        rows = {r.doc_id: r for r in out.collect()}
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        assert set(rows) <= before
        if name.startswith("quality"):
            good = {r[0] for r in duckdb.sql(f"select doc_id from '{SF}/labels.parquet' where quality = 1").fetchall()}
            assert good <= set(rows)
        if name == "PII":
            assert set(rows) == before and all(r.n_chars == len(r.text) for r in rows.values())
        kept = spark.createDataFrame(list(rows.values()), out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert last.count() == kept.count()


def test_any_column_names_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).selectExpr("*", "lang AS `a.b`", "map('k', source) AS `x``y`", "1 AS `count`", "2 AS `r`")
    kept = docs.union(docs.limit(3))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert rows and all(r["a.b"] == r.lang and r["x`y"] == {"k": r.source} and (r["count"], r["r"]) == (1, 2) for r in rows)
        kept = spark.createDataFrame(rows, kept.schema)
    corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()


def test_odd_rows_pass(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (1, "a b", "en", "s", 3), (2, None, None, "s", None), (3, "word " * 300, "en", "s", 1500)]
    docs = spark.createDataFrame(rows, schema)
    for data in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, data, SF).collect()
    once = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in once) == ["1", "2", "3", "None"]
