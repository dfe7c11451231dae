"""Row numbers, ranks and pages over a total order, without gathering rows in one task or a few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import materialize, spread_join


def numbered(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """``df`` with each row's place (from 1) in ``order``, which must be total.

    Rows are dealt by range and written once; places inside a range are moved by the sizes of the ranges before.
    """
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ordered")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    # One row for each range: a window over all of them is bounded by the number of tasks.
    before = sizes.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_within", within).join(F.broadcast(before), "_range").select(*df.columns, (F.col("_within") + F.col("_before")).cast("long").alias(name))


def nearest_rank(df: DataFrame, group: str, value: str, shares: dict[str, float], tie: str) -> DataFrame:
    """Percentiles of each group: the value at index floor(n * share) in ascending order, by places in one order over all groups."""
    rows = numbered(df.select(group, value, tie), [F.asc(group), F.asc(value), F.asc(tie)])
    ends = rows.groupBy(group).agg(F.min("rn").alias("first"), F.count(F.lit(1)).alias("n"))
    wanted = ends.select(group, "first", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.floor(F.col("n") * s).alias("at")) for k, s in shares.items()])).alias("w"))
    wanted = wanted.select(group, "first", F.col("w.name").alias("name"), (F.col("first") + F.least("w.at", F.col("n") - 1)).alias("rn"))
    picked = rows.join(F.broadcast(wanted), [group, "rn"]).groupBy(group).agg(*[F.round(F.max(F.when(F.col("name") == k, F.col(value))), 6).alias(k) for k in shares])
    return picked.select(group, *shares)


def average_ranks(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``df`` with the descending rank of ``value`` in its group; ties share the mean of their places.

    Equal values are counted first, so places are given to distinct values only.
    """
    ties = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("ties"))
    placed = numbered(ties, [F.asc(group), F.desc(value)], "place")
    # Rows above a value: a running sum over distinct values, cut into ranges like the places.
    running = running_sum(placed, "place", "ties", "upto")
    first = running.groupBy(group).agg(F.min(F.col("upto") - F.col("ties")).alias("zero"))
    rank = (F.col("upto") - F.col("zero") - (F.col("ties") - 1) / 2).alias(name)
    table = running.join(F.broadcast(first), group).select(group, value, "ties", rank)
    return spread_join(df, table, [group, value], "ties", "id")


def running_sum(df: DataFrame, place: str, amount: str, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows up to its own ``place``."""
    dealt = materialize(df.repartitionByRange(place).withColumn("_range", F.spark_partition_id()), "ordered")
    totals = dealt.groupBy("_range").agg(F.sum(amount).alias("n"))
    before = totals.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum(amount).over(Window.partitionBy("_range").orderBy(place))
    return dealt.withColumn("_within", within).join(F.broadcast(before), "_range").select(*df.columns, (F.col("_within") + F.col("_before")).alias(name))
