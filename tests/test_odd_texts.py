"""Queries over documents with empty texts and without a text give the same rows as their SQL."""

import duckdb
import pytest

from lodestone import plans

QUERIES, ORACLES = plans.load()
TEXTS = ["'plain'", "''", "NULL", "repeat('x', 10000)", "repeat('x', 10001)"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    texts = " ".join(f"WHEN {k} THEN {text}" for k, text in enumerate(TEXTS))
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT doc_id, CASE doc_id // 20 {texts} END AS text, 'en' AS lang, 'web' AS source, CAST(coalesce(length(text), 0) AS INT) AS n_chars FROM range({20 * len(TEXTS)}) t(doc_id)")
    con.execute(f"COPY documents TO '{path}/documents.parquet' (FORMAT parquet)")
    return path, con


@pytest.mark.parametrize("name", ["f16_claim_records"])
def test_odd_texts(spark, odd, name):
    path, con = odd
    df = QUERIES[name](spark, path)
    names = ", ".join(f'"{c}"' for c in df.columns)
    want = con.sql(f"SELECT {names} FROM ({ORACLES[name]}) q").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
