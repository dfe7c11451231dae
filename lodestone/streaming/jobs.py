"""Structured Streaming versions of the time-driven parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.lifecycle import observe
from lodestone.runtime import fresh_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
TURNS = "conv_id long, turn long, role string, text string"


def stream_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of Parquet files; ``path`` is a file or a folder of part files, so it is given as a pattern."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by tumbling window and type, for batch or stream; rows later than ``late`` are dropped by a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    agg = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return agg.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    """Sessions of each user, closed by a pause of ``gap``."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", gap) if events.isStreaming else timed
    agg = timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return agg.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def run_once(df: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Drive a stream over all that is there, into a table in the shared folder, and read it back.

    In update mode a row may be given again by a later micro-batch: ``keys`` say which rows are the same, and the
    last one counts. A micro-batch that runs again overwrites its own files.
    """
    if mode not in ("append", "update") or (mode == "update") != bool(keys):
        raise ValueError("append without keys, or update with keys")
    spark = df.sparkSession
    base = fresh_path(spark, name)
    out = f"{base}/rows"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(df.schema).parquet(out).select(*df.columns)
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, batch long").option("basePath", out).parquet(out)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "batch").alias("r")).select("r.*")


def observe_stream(turns: DataFrame) -> DataFrame:
    """Classified and redacted observations of a stream of conversation turns."""
    rows = turns.select(F.concat_ws("_", F.lit("obs"), "conv_id", "turn").alias("id"), F.col("text").alias("content"))
    return observe(rows)
