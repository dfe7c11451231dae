"""Registered queries by family."""

from __future__ import annotations

import importlib

FAMILIES = ("retrieval", "analytics", "graphs", "lifecycle", "exchange", "evaluation", "extras", "catalogue", "records", "activation", "policies", "promotions")


def load() -> tuple[dict, dict]:
    """All queries and their DuckDB texts."""
    queries, oracles = {}, {}
    for family in FAMILIES:
        registry = importlib.import_module(f"lodestone.plans.{family}").R
        queries |= registry.queries
        oracles |= registry.oracles
    return queries, oracles
