"""Intermediate tables, measured broadcasts and joins with hot keys."""

import os
import types

import pytest
from pyspark.sql import functions as F

from lodestone import runtime
from lodestone.operators.components import connected_components


def test_tables_go_with_their_scope(spark):
    with runtime.scope():
        t = runtime.materialize(spark.range(5).toDF("id"), "t")
        path = t._lodestone_path.removeprefix("file://")
        assert t.count() == 5 and os.path.isdir(path)
        with runtime.scope(keep=True):
            u = runtime.materialize(spark.range(2).toDF("id"), "u")
        assert u.count() == 2
        gone = runtime.materialize(spark.range(3).toDF("id"), "v")
        runtime.discard(gone)
        assert not os.path.isdir(gone._lodestone_path.removeprefix("file://"))
    assert not os.path.isdir(path) and not os.path.isdir(u._lodestone_path.removeprefix("file://"))


def test_cluster_without_shared_folder_is_refused():
    empty = types.SimpleNamespace(get=lambda k, d=None: d)
    context = types.SimpleNamespace(getConf=lambda: empty, master="spark://somewhere:7077")
    with pytest.raises(ValueError, match="share"):
        runtime.shared_dir(types.SimpleNamespace(sparkContext=context, conf=empty))


def test_measured_counts_values(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, None)], "a long, b string")
    assert runtime.measured(df) == 2 * (runtime.ROW_BYTES + 8) + 4
    assert runtime.measured(df.where("false")) == 0


@pytest.mark.parametrize("limit", [0, 8 << 20])
@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_hot_keys_give_the_same_rows(spark, monkeypatch, limit, how):
    monkeypatch.setattr(runtime, "HOT_ROWS", 20)
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", limit)
    rows = spark.range(300).select("id", F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 40).alias("k"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("k % 3 = 1")
    got = runtime.spread_join(rows, table, ["k"], "n", "id", how)
    want = rows.join(table.drop("n"), "k", how).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("limit", [0, 8 << 20])
def test_components_of_stars_and_chains(spark, monkeypatch, limit):
    from lodestone.operators import components

    monkeypatch.setattr(components, "HOT_ROWS", 10)
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", limit)
    edges = [(1000, k) for k in range(100, 160)] + [(k, k + 1) for k in range(300, 330)] + [(159, 300), (7, 7), (None, 8), (5, 6), (6, 5)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    big = {1000, *range(100, 160), *range(300, 331)}
    assert got == {**{k: 100 for k in big}, 7: 7, 5: 5, 6: 5}


def test_broadcasts_follow_bytes_of_rows_not_of_files(spark):
    from lodestone.plans.common import Registry
    from tests.conftest import SF

    wide = runtime.materialize(spark.range(100_000).select("id", F.lit("x" * 200).alias("v")), "wide")
    registry = Registry()
    registry.add("q")(lambda t: wide.join(wide.select("id", F.col("v").alias("w")), "id"))
    df = registry.queries["q"](spark, SF)
    assert df.agg(F.count(F.lit(1))).first()[0] == 100_000
    df.write.format("noop").mode("overwrite").save()
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    runtime.discard(wide)
