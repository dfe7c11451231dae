"""Record tables laid out for their reads: partitioned by scope and time, bucketed by id.

A scan for a scope or since an instant opens only the partitions it needs, and two tables bucketed alike are joined on their id without
an exchange. The files lie in the shared folder; the tables are known to the session by name until they are dropped.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.runtime import fresh_path

BUCKETS = 16


@dataclass(frozen=True)
class Laid:
    """A table of the session; ``unit`` is the span of time of a partition, null without one."""

    spark: SparkSession
    name: str
    unit: str | None

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop("_span")

    def since(self, instant: Column, scope: str | None = None) -> DataFrame:
        """Rows created at or after ``instant``, of one scope if given; earlier spans and other scopes are not opened."""
        rows = self.spark.table(self.name).where((F.col("_span") >= F.date_trunc(self.unit, instant).cast("date")) & (F.col("created_at") >= instant))
        return (rows.where(F.col("scope") == scope) if scope else rows).drop("_span")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def lay_out(rows: DataFrame, key: str, unit: str | None = None, buckets: int = BUCKETS) -> Laid:
    """Write ``rows`` bucketed and sorted by ``key``; with a ``unit`` (day, month, ...) also partitioned by scope and span of created_at.

    Each task writes one bucket, so a partition has a file for each bucket and no more. A null scope or time has a partition of its own.
    """
    spark = rows.sparkSession
    name = f"laid_{uuid.uuid4().hex}"
    if unit:
        rows = rows.withColumn("_span", F.date_trunc(unit, "created_at").cast("date"))
    out = rows.repartition(buckets, key).write.format("parquet").option("compression", "zstd").option("path", fresh_path(spark, "laid")).bucketBy(buckets, key).sortBy(key)
    (out.partitionBy("scope", "_span") if unit else out).saveAsTable(name)
    return Laid(spark, name, unit)
