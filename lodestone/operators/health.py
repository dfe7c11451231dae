"""Health and maintenance reports over all claims, tombstoned ones included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scoring import days_between

SIGNALS = ("helpful", "harmful", "outdated", "duplicate", "completed")


def bands(claims: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return claims.agg(
        F.count_if(c >= 0.7).alias("high"), F.count_if((c >= 0.3) & (c < 0.7)).alias("medium"), F.count_if(c < 0.3).alias("low")
    )


def last_helpful_ages(claims: DataFrame, feedback: DataFrame, now: Column) -> DataFrame:
    """Claims by the age of their last helpful feedback: within 30 days, within 90, older, never."""
    last = feedback.where("signal = 'helpful'").groupBy(F.col("claim_id").alias("id")).agg(F.max("ts").alias("last"))
    age = days_between(now, F.col("last"))
    rows = claims.select("id").join(last, "id", "left")
    return rows.agg(
        F.count_if(age <= 30).alias("within_30"), F.count_if((age > 30) & (age <= 90)).alias("within_90"),
        F.count_if(age > 90).alias("older"), F.count_if(F.col("last").isNull()).alias("never"),
    )


def never_activated(claims: DataFrame, items: DataFrame, now: Column, digits: int | None = 6) -> DataFrame:
    """By age bucket: claims, and the share that no context has ever held, rounded unless ``digits`` is none."""
    used = items.select(F.col("claim_id").alias("id")).distinct().withColumn("used", F.lit(True))
    age = days_between(now, F.col("created_at"))
    bucket = F.when(age < 30, "0-30").when(age < 90, "30-90").otherwise("90+")
    rows = claims.select("id", bucket.alias("bucket")).join(used, "id", "left")
    share = F.avg(F.when(F.col("used").isNull(), 1.0).otherwise(0.0))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), (F.round(share, digits) if digits is not None else share).alias("ratio"))


def utility_spread(claims: DataFrame) -> DataFrame:
    def at(p: float) -> Column:
        return F.coalesce(F.percentile("utility", p), F.lit(0.0))

    return claims.agg(*[F.round(c, 6).alias(n) for n, c in (("mean", F.coalesce(F.avg("utility"), F.lit(0.0))), ("median", at(0.5)), ("p10", at(0.1)), ("p90", at(0.9)))])


def signal_counts(feedback: DataFrame) -> DataFrame:
    """Counts of all five signals, absent ones as zero, and their total."""
    counts = [F.count_if(F.col("signal") == s).alias(s) for s in SIGNALS]
    return feedback.agg(*counts, F.count(F.lit(1)).alias("total"))


def duplicate_ratio(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.round(F.coalesce(F.avg(F.when(F.col("signal") == "duplicate", 1.0).otherwise(0.0)), F.lit(0.0)), 6).alias("ratio"))


def stale_candidates(claims: DataFrame, items: DataFrame, now: Column, days: int = 30, limit: int = 10) -> DataFrame:
    """Oldest claims past ``days`` that no context ever held: the report's top ``limit``."""
    old = claims.where(days_between(now, F.col("created_at")) > days)
    return old.join(items.select(F.col("claim_id").alias("id")), "id", "left_anti").orderBy("created_at", "id").limit(limit)


def unrewarded(claims: DataFrame, feedback: DataFrame, threshold: int = 5, limit: int = 10) -> DataFrame:
    """Most retrieved claims without any feedback: the report's top ``limit``."""
    often = claims.where(F.col("retrieval_count") > threshold)
    return often.join(feedback.select(F.col("claim_id").alias("id")), "id", "left_anti").orderBy(F.desc("retrieval_count"), "id").limit(limit)


def stale_working_state(claims: DataFrame, feedback: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Active working state older than ``days`` without feedback in that time becomes stale."""
    recent = feedback.where(days_between(now, F.col("ts")).between(0, days)).select(F.col("claim_id").alias("id")).distinct().withColumn("recent", F.lit(True))
    stale = (F.col("memory_type") == "working_state") & (F.col("status") == "active") & (days_between(now, F.col("created_at")) > days) & F.col("recent").isNull()
    return claims.join(recent, "id", "left").withColumn("status", F.when(F.coalesce(stale, F.lit(False)), "stale").otherwise(F.col("status"))).drop("recent")
