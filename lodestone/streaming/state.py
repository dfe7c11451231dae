"""Streams that keep state by groups of keys: a rate window for each bucket, and an expiry time for each observation.

State lives in Spark's RocksDB store, whose folder is the query's checkpoint; a query that starts again from it goes on where the last one
ended. Event time drives everything, so a replay gives the same rows. A row later than the watermark is dropped by Spark; one that is older than
rows already seen, but not that late, is taken when it comes.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.runtime import fresh_path

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How late a row may be.
LATE = "10 minutes"
#: Keys are dealt into so many groups, whose state is read and written as one: a call of a key costs some milliseconds.
GROUPS = 1024


class RateWindow(StatefulProcessor):
    """A fixed window of ``seconds`` for each bucket: it starts with the first call at or after the last one's end, and admits ``cap`` calls.

    The buckets of one of GROUPS groups are held together, so a micro-batch costs a step a group, not a bucket. The state has, by bucket, the window's
    start and the calls it admitted; windows that event time has passed are left out when the state is written, and a timer at the group's last
    end clears it, so idle buckets hold none. Calls of one micro-batch go by time, then seq, and a group's are held together, so a source
    should bound its micro-batches. A call older than the window's start counts in that window.
    """

    def __init__(self, cap: int, seconds: float):
        self.cap, self.seconds = cap, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getValueState("windows", "bucket array<long>, known array<boolean>, start array<double>, used array<long>, timer long")

    def _end(self, start: float) -> int:
        return int((start + self.seconds) * 1000) + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["time", "seq"], kind="stable")
        held = self.windows.get()
        before = held[4] if held else None
        windows = {(b, k): (s, u) for b, k, s, u in zip(*held[:4])} if held else {}
        allowed = []
        for bucket, known, t in zip(calls["bucket"].tolist(), calls["known"].tolist(), calls["time"].tolist()):
            start, used = windows.get((bucket, known), (None, 0))
            if start is None or t - start >= self.seconds:
                start, used = t, 0
            allowed.append(used < self.cap)
            windows[bucket, known] = start, used + allowed[-1]
        timer = max(self._end(start) for start, _ in windows.values())
        if before != timer:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(timer)
        mark = timerValues.getCurrentWatermarkInMs()
        live = [(*b, *w) for b, w in windows.items() if self._end(w[0]) > mark]
        self.windows.update((*([row[k] for row in live] for k in range(4)), timer))
        yield calls[["bucket", "known", "seq"]].assign(allowed=allowed)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.windows.clear()
        yield pd.DataFrame({"bucket": [], "known": [], "seq": [], "allowed": []}).astype({"bucket": "int64", "known": "bool", "seq": "int64", "allowed": "bool"})

    def close(self) -> None:
        pass


class Expiry(StatefulProcessor):
    """An observation is stored when it comes and scrubbed, its content gone, when event time passes its expiry; one that comes expired is scrubbed at once.

    The ids of one of GROUPS groups are held together. The state has the expiry times by id, and a timer at the first of them; a later row of
    the same id sets a new one. Ids without an expiry keep no state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expiries = handle.getValueState("expiries", "id array<string>, at array<long>, timer long")

    def _keep(self, expiries: dict, before: int | None) -> None:
        """Write the state, with a timer at its first expiry; ``before`` is the timer that is set."""
        first = min(expiries.values(), default=None)
        if before is not None and before != first:
            self.handle.deleteTimer(before)
        if first is None:
            self.expiries.clear()
            return
        if first != before:
            self.handle.registerTimer(first)
        self.expiries.update((list(expiries), list(expiries.values()), first))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows)).sort_values("time", kind="stable").drop_duplicates("id", keep="last")
        held = self.expiries.get()
        expiries = dict(zip(held[0], held[1])) if held else {}
        mark = timerValues.getCurrentWatermarkInMs()
        gone = []
        for name, expires, at in zip(came["id"], came["expires"].notna(), came["at_ms"].tolist()):
            expiries.pop(name, None)
            gone.append(bool(expires and at <= mark))
            if expires and at > mark:
                expiries[name] = at
        self._keep(expiries, held[2] if held else None)
        yield pd.DataFrame({"id": came["id"].to_numpy(), "scrubbed": gone, "content": [None if g else c for g, c in zip(gone, came["content"])]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.expiries.get()
        mark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        expiries = dict(zip(held[0], held[1])) if held else {}
        due = [name for name, at in expiries.items() if at <= mark]
        # The timer that is running out goes by itself.
        self._keep({name: at for name, at in expiries.items() if at > mark}, None)
        yield pd.DataFrame({"id": pd.Series(due, dtype=object), "scrubbed": [True] * len(due), "content": pd.Series([None] * len(due), dtype=object)})

    def close(self) -> None:
        pass


def limit_rate_stream(calls: DataFrame, cap: int, seconds: float, late: str = LATE) -> DataFrame:
    """(bucket, seq, allowed) of a stream of calls (bucket, seq, ts)."""
    at, known = F.col("ts").cast("timestamp"), F.col("bucket").isNotNull()
    rows = calls.select(_group("bucket"), F.coalesce("bucket", F.lit(0)).cast("long").alias("bucket"), known.alias("known"), "seq", at.alias("at"), (F.unix_micros(at) / 1e6).alias("time")).withWatermark("at", late)
    out = rows.groupBy("group").transformWithStateInPandas(RateWindow(cap, seconds), "bucket long, known boolean, seq long, allowed boolean", "Append", "EventTime")
    return out.select(F.when(F.col("known"), F.col("bucket")).alias("bucket"), "seq", "allowed")


def expire_stream(observations: DataFrame, late: str = LATE) -> DataFrame:
    """(id, scrubbed, content) of a stream of observations (id, content, created_at, expires_at): a row when one comes, another when it expires."""
    at = F.col("created_at").cast("timestamp")
    expires = F.unix_millis(F.col("expires_at").cast("timestamp"))
    rows = observations.select(_group("id"), "id", "content", expires.alias("expires"), F.coalesce(expires, F.lit(0)).alias("at_ms"), F.unix_micros(at).alias("time"), at.alias("at")).withWatermark("at", late)
    return rows.groupBy("group").transformWithStateInPandas(Expiry(), "id string, scrubbed boolean, content string", "Append", "EventTime")


def _group(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int").alias("group")


@contextlib.contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that these streams need, while they run."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def run_in_steps(build: Callable[[DataFrame], DataFrame], parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Everything that the stream ``build`` gives while its source grows by one of ``parts`` after another, with the number ``batch`` of the micro-batch.

    The query is stopped after each part and started again from its checkpoint in the shared folder. A micro-batch that runs
    again overwrites its own rows.
    """
    base, out = None, None
    for part in parts:
        spark = part.sparkSession
        if base is None:
            base, schema = fresh_path(spark, name), part.schema
        part.write.mode("append").parquet(f"{base}/source")
        stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{base}/source"))
        out = stream.schema

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

        with _rocks(spark):
            stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    if base is None:
        raise ValueError("no parts")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.fields)
    return spark.read.schema(f"{fields}, batch long").option("basePath", f"{base}/rows").parquet(f"{base}/rows")


def latest(rows: DataFrame, key: str) -> DataFrame:
    """Of the rows of each key those of its last micro-batch."""
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("r.*")
