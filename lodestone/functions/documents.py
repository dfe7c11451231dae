"""JSON documents in columns: comparison, masking and tolerant parsing."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import REDACTED

# Fixed list: a field whose name holds one of these, in any case, is masked.
SENSITIVE_FIELDS = ("email", "phone", "password", "secret", "token", "authorization", "api_key", "apikey", "credential", "private_key", "privatekey")


def _load(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def _dump(value) -> str | None:
    return None if value is None else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def _stable(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _dump(_load(t)))


def stable_json(document: Column) -> Column:
    """The document with the keys of all its objects sorted, without spaces, for equality; null if it is none."""
    return _stable(document)


def _mask(value):
    if isinstance(value, list):
        return [_mask(v) for v in value]
    if isinstance(value, dict):
        return {k: REDACTED if any(s in k.lower() for s in SENSITIVE_FIELDS) else _mask(v) for k, v in value.items()}
    return value


@F.pandas_udf(T.StringType())
def _masked(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _dump(_mask(_load(t))))


def masked_json(document: Column) -> Column:
    """The document with sensitive fields replaced at every depth, keys sorted; null if it is none."""
    return _masked(document)


def safe_payload(payload: Column, metadata: Column) -> Column:
    """struct(payload_digest, payload_length, metadata) for an audit log: no content, masked metadata."""
    digest = F.concat(F.lit("sha256:"), F.sha2(payload.cast("binary"), 256))
    return F.struct(digest.alias("payload_digest"), F.length(payload).cast("long").alias("payload_length"), masked_json(metadata).alias("metadata"))


def parsed_tags(document: Column) -> Column:
    """A JSON array of strings as an array; null for anything else."""
    kind = F.schema_of_variant(F.try_parse_json(document))
    return F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.from_json(document, "array<string>"))


def csv_tags(value: Column) -> Column:
    """Tags of the older comma-separated form: trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(value, ","), F.trim), lambda t: t != "")


def json_object(document: Column) -> Column:
    """The document if it is a JSON object, else null (the row stays)."""
    return F.when(F.schema_of_variant(F.try_parse_json(document)).startswith("OBJECT"), document)


def finite(value: Column, other: float) -> Column:
    """The value, or ``other`` where it is null, not a number or infinite."""
    v = value.cast("double")
    return F.coalesce(F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v), F.lit(other))
