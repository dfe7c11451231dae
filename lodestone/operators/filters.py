"""Predicates that every retrieval operator shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE_STATES = ("stale", "completed")
TRANSIENT = ("session",)


def rolled_back(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'rolled_back'").select(F.col("accepted_claim_id").alias("id")).distinct()


def active(claims: DataFrame, queue: DataFrame) -> DataFrame:
    """Claims neither tombstoned nor rolled back."""
    alive = claims.where(~F.coalesce(F.col("tombstone"), F.lit(False))) if "tombstone" in claims.columns else claims
    return alive.join(rolled_back(queue), "id", "left_anti")


def one_of(col: str, values: Sequence[str] | None) -> Column:
    """None: no filter; empty: nothing passes."""
    if values is None:
        return F.lit(True)
    kept = [v for v in dict.fromkeys(values) if v]
    return F.col(col).isin(kept) if kept else F.lit(False)


def settled_state(excluded: Sequence[str] | None = STALE_STATES) -> Column:
    """Working state in an excluded status is left out; other memory types pass."""
    if excluded is None:
        return F.lit(True)
    other = F.col("memory_type").isNull() | (F.col("memory_type") != "working_state")
    status = F.coalesce(F.col("status"), F.lit("active"))
    return other | (~status.isin(list(excluded)) if excluded else F.lit(False))


def claim_filter(scopes: Sequence[str] | None = None, classes: Sequence[str] | None = None, kinds: Sequence[str] | None = None, memory_types: Sequence[str] | None = None, excluded: Sequence[str] | None = None) -> Column:
    return one_of("scope", scopes) & one_of("boundary_class", classes) & one_of("kind", kinds) & one_of("memory_type", memory_types) & settled_state(excluded)


def live(now: Column) -> Column:
    """Observations with content that have not expired."""
    return F.col("content").isNotNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def durable(df: DataFrame) -> DataFrame:
    """Rows that stand for lasting claims: not transient, not observations, with a claim id and text."""
    return df.where((F.col("scope") != "session") & (F.col("kind") != "observation") & F.col("id").startswith("clm_") & (F.length(F.trim("text")) > 0))
