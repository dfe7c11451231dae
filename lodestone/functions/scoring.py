"""Ranking factors as Column expressions; ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking model.
HALF_LIFE_DAYS = {"fact": 120.0, "task": 14.0, "preference": 90.0, "policy_hint": 365.0}
OTHER_HALF_LIFE_DAYS = 30.0
DECAY = 0.693147
LEAST_DEVIATION = 0.001
RECENCY_WEIGHT = {"resume_task": 1.6, "debug_incident": 1.8, "design_decision": 0.65, "policy_check": 0.25}
KIND_BOOST = {"resume_task": {"task": 1.3}, "policy_check": {"policy_hint": 1.2}}
MEMORY_BOOST = {
    "resume_task": {"working_state": 1.35, "knowledge": 1.05},
    "debug_incident": {"evidence": 1.4, "knowledge": 1.1, "procedure": 1.05},
    "design_decision": {"knowledge": 1.2, "norm": 1.2, "procedure": 1.1},
    "policy_check": {"norm": 1.4, "knowledge": 1.05},
}
POLICY_CHECK_TASK_PENALTY = 0.1
FEEDBACK_WEIGHTS = {"helpful": 0.25, "harmful": -0.35, "outdated": -0.18, "duplicate": -0.12}
FEEDBACK_RANGE = (0.45, 1.65)
USAGE_DAYS, USAGE_DECAY, LEAST_USAGE = 30.0, 0.5, 0.5
RETRIEVAL_WEIGHT, MOST_RETRIEVAL, COUNTED_FROM = 0.1, 2.0, 10


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def days_between(now: Column, ts: Column) -> Column:
    """Days from ``ts`` to ``now`` with microseconds kept; both without a zone."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return micros.cast("double") / F.lit(8.64e10)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def norm_cos(s: Column) -> Column:
    return (s + 1) / 2


def hybrid(text: Column, vec: Column, alpha: float) -> Column:
    return F.lit(alpha) * vec + F.lit(1 - alpha) * text


def lookup(key: Column, values: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def half_life(kind: Column) -> Column:
    return lookup(kind, HALF_LIFE_DAYS, OTHER_HALF_LIFE_DAYS)


def recency(ts: Column, half_life_days: Column, now: Column) -> Column:
    """Exponential decay of age; the future counts as now, no timestamp or half-life as oldest."""
    age = F.greatest(F.lit(0.0), days_between(now, ts))
    decay = F.exp(F.lit(-DECAY) * age / F.when(half_life_days > 0, half_life_days))
    return F.coalesce(F.when(ts.isNotNull(), decay), F.lit(0.0))


def utility_term(utility: Column, mean: Column, deviation: Column) -> Column:
    return F.lit(0.6) + F.lit(0.4) * sigmoid((utility - mean) / F.greatest(deviation, F.lit(LEAST_DEVIATION)))


def confidence_term(confidence: Column) -> Column:
    return F.lit(0.5) + F.lit(0.5) * clamp(confidence, 0.0, 1.0)


def recency_term(decay: Column, weight: float = 1.0) -> Column:
    """0.3 to 1; an intent's weight bends the decay."""
    safe = weight if weight > 0 else 1.0
    return F.lit(0.3) + F.lit(0.7) * F.pow(clamp(decay, 0.0, 1.0), F.lit(safe))


def intent_boost(intent: str | None, kind: Column, memory_type: Column) -> Column:
    if intent is None:
        return F.lit(1.0)
    boost = lookup(kind, KIND_BOOST.get(intent, {}), 1.0) * F.coalesce(lookup(memory_type, MEMORY_BOOST.get(intent, {}), 1.0), F.lit(1.0))
    if intent == "policy_check":
        doing = (kind == "task") | F.coalesce(memory_type == "working_state", F.lit(False))
        boost = boost * F.when(doing, F.lit(POLICY_CHECK_TASK_PENALTY)).otherwise(F.lit(1.0))
    return boost


def provenance_quality(evidence: Column, actor_note: Column, lineage: Column) -> Column:
    def step(flag: Column, value: float) -> Column:
        return F.when(flag, F.lit(value)).otherwise(F.lit(1.0))

    return step(evidence > 0, 1.1) * step(actor_note, 1.05) * step(lineage, 1.05)


def feedback_boost(counts: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for signal, weight in FEEDBACK_WEIGHTS.items():
        total = total + F.lit(weight) * F.log1p(F.greatest(counts[signal], F.lit(0)).cast("double"))
    return clamp(F.exp(total), *FEEDBACK_RANGE)


def usage_term(count: Column, last_retrieved: Column, now: Column) -> Column:
    days = F.greatest(F.lit(0.0), days_between(now, last_retrieved))
    decay = F.coalesce(clamp(F.lit(1.0) - days / USAGE_DAYS * USAGE_DECAY, LEAST_USAGE, 1.0), F.lit(1.0))
    counted = F.when(count >= COUNTED_FROM, count).otherwise(F.lit(0))
    return F.when(last_retrieved.isNull(), F.lit(1.0)).otherwise(decay) * clamp(F.lit(1.0) + F.log2(counted + 1.0) * RETRIEVAL_WEIGHT, 1.0, MOST_RETRIEVAL)


def combined(base: Column, more: Column) -> Column:
    """Probabilistic sum of two scores."""
    return base + more * (F.lit(1.0) - base)
