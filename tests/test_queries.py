"""Every registered query with a DuckDB text gives the same rows as DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lodestone import plans
from tests.conftest import SF

QUERIES, ORACLES = plans.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in ORACLES:
        assert len(set(got)) > 0
        return
    names = ", ".join(f'"{c}"' for c in cols)
    want = duck.sql(f"select {names} from ({ORACLES[name]}) q").fetchall()
    assert got == sorted(repr([plain(v) for v in r]) for r in want)
