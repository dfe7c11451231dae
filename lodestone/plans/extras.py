"""Registered queries: validation, files, streams and engine extras that Spark gives natively."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.plans.common import Registry, r6
from lodestone.plans.lifecycle import CLEAN, KEYS, PII, RATE_SQL
from lodestone.runtime import fresh_path
from lodestone.sources import records
from lodestone.sources.fixtures import Tables
from lodestone.streaming import jobs, state

R = Registry()


@R.add("s09_s10_file_round_trip", "SELECT kind, scope, boundary_class, sha256(text) AS text FROM claims", "claims")
def s09(t: Tables):
    path = fresh_path(t.spark, "export")
    records.write_claims(t.claims.select("text", "kind", "scope", "boundary_class"), path)
    back = t.spark.read.schema("text string, kind string, boundary_class string, scope string").json(f"{path}/claims")
    return back.select("kind", "scope", "boundary_class", F.sha2(F.col("text").cast("binary"), 256).alias("text"))


@R.add("st_windowed_counts", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windows(t: Tables):
    return jobs.windowed_counts(t.events)


@R.add("st_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(t: Tables):
    return jobs.sessions(t.events)


@R.add("st_observe_stream", f"""WITH o AS (SELECT concat('obs_', conv_id, '_', turn) AS id, text AS c, {KEYS.format(c='text')} AS k, {PII.format(c='text')} AS p FROM conversations)
SELECT id, CASE WHEN k THEN 'secret' WHEN p THEN 'pii' ELSE 'internal' END AS boundary_class, CASE WHEN k THEN NULL WHEN p THEN sha256({CLEAN.format(c='c')}) ELSE sha256(c) END AS content, length(c) AS length FROM o""")
def observe_stream(t: Tables):
    turns = t.conversations
    stream = jobs.stream_of(t.spark, f"{t.sf_dir}/conversations.parquet", turns.schema)
    return jobs.run_once(jobs.observe_stream(stream), "observe").select("id", "boundary_class", F.sha2(F.col("content").cast("binary"), 256).alias("content"), "length")


DAYS = ["2024-01-07", "2024-01-13", "2024-01-19", "2024-01-25"]


def spans(rows, column: str):
    """The rows in order of time, cut at DAYS."""
    at = F.col(column)
    edges = [None, *DAYS, None]
    for low, high in zip(edges[:-1], edges[1:]):
        part = rows if low is None else rows.where(at >= F.lit(low).cast("timestamp_ntz"))
        yield part if high is None else part.where(at < F.lit(high).cast("timestamp_ntz"))


@R.add("p11_rate_stream", RATE_SQL)
def rate_stream(t: Tables):
    """Five runs of one query, each from the checkpoint of the one before; the result is that of the batch limiter."""
    calls = t.events.select(F.col("user_id").alias("bucket"), F.col("event_id").alias("seq"), "ts")
    rows = state.run_in_steps(lambda s: state.limit_rate_stream(s, 2, 86400.0), spans(calls, "ts"), "rates")
    return rows.select("bucket", "seq", "allowed")


@R.add("p02_expiry_stream", """, o AS (SELECT id, content, created_at, created_at + INTERVAL '1' HOUR * CAST(24 + length(content) % 480 AS INT) AS expires_at FROM observations), w AS (SELECT max(created_at) - INTERVAL '10' MINUTE AS mark FROM o)
SELECT id, expires_at <= mark AS scrubbed, CASE WHEN expires_at > mark THEN sha256(content) END AS content FROM o, w""", "observations")
def expiry_stream(t: Tables):
    """Observations that come in order of time and are scrubbed when event time passes their expiry."""
    hours = F.make_dt_interval(F.lit(0), (F.lit(24) + F.length("content") % 480).cast("int"))
    o = t.observations.select("id", F.col("content"), "created_at", (F.col("created_at") + hours).alias("expires_at"))
    rows = state.latest(state.run_in_steps(state.expire_stream, spans(o, "created_at"), "expiry"), "id")
    return rows.select("id", "scrubbed", F.sha2(F.col("content").cast("binary"), 256).alias("content"))


@R.add("x_rollup", "SELECT kind, scope, count(*) AS n, round(avg(utility), 6) AS utility FROM claims GROUP BY ROLLUP (kind, scope)", "claims")
def rollup(t: Tables):
    return t.claims.rollup("kind", "scope").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("utility"), 6).alias("utility"))


@R.add("x_previous_value", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS change FROM events")
def previous(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", r6(F.col("value") - F.lag("value").over(w), "change"))


@R.add("x_asof_feedback", """SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts < e.ts
 AND p.ts = (SELECT max(q.ts) FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'purchase' AND q.ts < e.ts)) AS last_purchase FROM events e WHERE e.event_type = 'error'""")
def asof(t: Tables):
    """The last purchase before each error, by one ordered pass over both kinds."""
    e = t.events.where("event_type in ('purchase', 'error')")
    before = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    bought = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    timed = e.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    return timed.withColumn("last", F.max(bought).over(before)).where("event_type = 'error'").select("event_id", F.col("last.event_id").alias("last_purchase"))
