"""Validation as reject reasons: each row keeps the list of rules it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.documents import json_object
from lodestone.functions.text import content_hash

# Fixed domains.
ENTITY_TYPES = ["Actor", "Artifact", "Event", "Concept"]
KINDS = ["fact", "preference", "task", "policy_hint"]
SCOPES = ["session", "project", "principle"]
CLASSES = ["public", "internal", "pii", "secret"]
MEMORY_TYPES = ["evidence", "working_state", "knowledge", "procedure", "norm"]
SIGNALS = ["helpful", "harmful", "outdated", "duplicate", "completed"]
HASH = r"^sha256:[0-9a-f]{64}$"
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def valid_instant(value: Column) -> Column:
    """ISO-8601 with a zone and a date that exists."""
    return F.coalesce(value.rlike(INSTANT) & F.try_to_timestamp(value).isNotNull(), F.lit(False))


def too_far_ahead(value: Column, now: Column, seconds: int = 300) -> Column:
    """A valid instant more than ``seconds`` after now."""
    at = F.try_to_timestamp(F.when(valid_instant(value), value))
    return F.coalesce(F.unix_micros(at) > F.unix_micros(now) + seconds * 1_000_000, F.lit(False))


def climbs(path: Column) -> Column:
    """A ``..`` segment, as written or percent-encoded."""
    plain = F.coalesce(F.try_url_decode(path), path)
    return path.rlike(r"(^|[/\\])\.\.([/\\]|$)") | plain.rlike(r"(^|[/\\])\.\.([/\\]|$)")


def rejected(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``reasons``: names of the rules that do not hold (a rule that is null does not hold)."""
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))


def claim_rules(most: int = 5000, hashed: bool = False) -> dict[str, Column]:
    """Rules for a claim; with ``hashed`` a given content_hash must be that of the text."""
    text = F.col("text")
    rules = {
        "text": (F.length(F.trim(text)) > 0) & (F.length(text) <= most),
        "kind": F.col("kind").isin(KINDS),
        "scope": F.col("scope").isin("project", "principle"),
        "boundary_class": F.col("boundary_class").isin("public", "internal", "pii"),
        "memory_type": F.col("memory_type").isNull() | F.col("memory_type").isin(MEMORY_TYPES),
    }
    if hashed:
        rules["content_hash"] = F.col("content_hash").isNull() | (F.col("content_hash") == content_hash(text))
    return rules


# The characters of a tag, and the sources of observations.
TAG = r"^[\w\-:.@/]+$"
SOURCE_TYPES = ["chat", "tool", "file", "http", "system"]


def observation_rules(most_bytes: int = 65_536, most_tags: int = 32, tag_length: int = 256) -> dict[str, Column]:
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return {
        "size": F.octet_length("content") <= most_bytes,
        "source_type": F.col("source_type").isin(SOURCE_TYPES),
        "tags": F.size(tags) <= most_tags,
        "tag_length": F.forall(tags, lambda t: F.length(t) <= tag_length),
        "tag_characters": F.forall(tags, lambda t: t.rlike(TAG)),
        "ttl_days": F.col("ttl_days").isNull() | (F.col("ttl_days") >= 1),
    }


def claim_record_rules(least: int = 1) -> dict[str, Column]:
    """Rules for a claim as it is exchanged; no text counts as an empty one, which only ``least`` 0 lets pass."""
    return {
        "text": F.length(F.coalesce("text", F.lit(""))).between(least, 10_000),
        "kind": F.col("kind").isin(KINDS),
        "scope": F.col("scope").isin(SCOPES),
        "boundary_class": F.col("boundary_class").isin(CLASSES),
        "memory_type": F.col("memory_type").isNull() | F.col("memory_type").isin(MEMORY_TYPES),
        "content_hash": F.col("content_hash").rlike(HASH),
    }


def _object_or_none(name: str) -> Column:
    return F.col(name).isNull() | json_object(F.col(name)).isNotNull()


def entity_record_rules() -> dict[str, Column]:
    return {"id": F.length("id").between(1, 256), "type": F.col("type").isin(ENTITY_TYPES), "name": F.length("name").between(1, 1024), "attrs": _object_or_none("attrs")}


def relation_record_rules() -> dict[str, Column]:
    return {**{c: F.length(c).between(1, 256) for c in ("id", "src_id", "dst_id", "type")}, "props": _object_or_none("props")}
