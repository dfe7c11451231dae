"""Boundary policies: which classes a request may see, and what is redacted for it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import EMAIL, REDACTED

# Patterns a policy may name, the default policy, and the patterns of last resort before embedding.
PATTERNS = {"email": EMAIL, "phone": r"\b\d{2,4}[- ]?\d{2,4}[- ]?\d{3,4}\b"}
SIXTEEN_DIGITS = r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b"
SCOPES = ("session", "project", "principle")
ALLOW = {"public": ["*"], "internal": ["answer:task", "tool:*"], "pii": ["tool:contact-lookup"], "secret": []}
REDACT = {"pii": ["email", "phone"]}


@dataclass
class Boundary:
    """Allowed tags and named redactions of each class, and the known scopes."""

    allow: dict[str, list[str]] = field(default_factory=lambda: dict(ALLOW))
    redact: dict[str, list[str]] = field(default_factory=lambda: dict(REDACT))
    scopes: tuple[str, ...] = SCOPES


def tag_matches(pattern: Column, tag: Column) -> Column:
    """``*`` on either side, a trailing ``*`` as a prefix on either side, or equality; the pattern's wildcard goes first."""

    def prefix(p: Column, t: Column) -> Column:
        return t.startswith(F.substring(p, F.lit(1), F.length(p) - 1))

    return F.when((pattern == "*") | (tag == "*"), True).when(pattern.endswith("*"), prefix(pattern, tag)).when(tag.endswith("*"), prefix(tag, pattern)).otherwise(pattern == tag)


def class_allowed(tags: Column, patterns: list[str]) -> Column:
    """Whether any of the request's ``tags`` matches any of a class's patterns."""
    if not patterns:
        return F.lit(False)
    return F.coalesce(F.exists(tags, lambda t: reduce(lambda a, p: a | tag_matches(F.lit(p), t), patterns[1:], tag_matches(F.lit(patterns[0]), t))), F.lit(False))


def validated(text: Column, tags: Column, scope: Column, policy: Boundary | None = None) -> Column:
    """struct(allowed, reason, redacted): a request with no matching class is denied, an unknown scope refused.

    The redactions of all matching classes are applied, in the order the policy names them.
    """
    policy = policy or Boundary()
    matched = {name: class_allowed(tags, patterns) for name, patterns in policy.allow.items()}
    some = reduce(lambda a, b: a | b, matched.values(), F.lit(False))
    known = scope.isin(*policy.scopes)
    out = text
    for pattern in dict.fromkeys(p for name in policy.allow for p in policy.redact.get(name, []) if p in PATTERNS):
        wanted = reduce(lambda a, b: a | b, [matched[name] for name in policy.allow if pattern in policy.redact.get(name, [])])
        out = F.when(wanted, F.regexp_replace(out, PATTERNS[pattern], REDACTED)).otherwise(out)
    reason = F.when(~some, "BOUNDARY_DENIED").when(~F.coalesce(known, F.lit(False)), "SCOPE_UNKNOWN")
    return F.struct(reason.isNull().alias("allowed"), reason.alias("reason"), F.when(reason.isNull(), out).alias("redacted"))


def confidential(boundary_class: Column) -> Column:
    """Classes whose texts are redacted before anything is derived from them."""
    return F.coalesce(~boundary_class.isin("public", "internal"), F.lit(True))


def redacted_for_embedding(text: Column, policy: Boundary | None = None) -> Column:
    """A confidential text as it may be embedded: every redaction of the policy, or the patterns of last resort if it denies all."""
    policy = policy or Boundary()
    checked = validated(text, F.array(F.lit("*")), F.lit("session"), policy)
    last = reduce(lambda t, p: F.regexp_replace(t, p, REDACTED), [*PATTERNS.values(), SIXTEEN_DIGITS], text)
    return F.coalesce(checked["redacted"], last)
