"""Registration of queries: a name, a Spark plan over the tables and its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.runtime import bounded
from lodestone.sources.fixtures import NOW, Tables, sql_views

Plan = Callable[[Tables], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, views: str = "") -> Callable[[Plan], Plan]:
        """Register a plan; ``sql`` starts after the WITH clause of the space-separated ``views`` (a leading comma adds more)."""

        def register(plan: Plan) -> Plan:
            self.queries[name] = lambda spark, sf_dir: plan(Tables(bounded(spark), sf_dir))
            if sql is not None:
                self.oracles[name] = (sql_views(*views.split()) + "\n" if views else "") + sql.replace("{NOW}", f"TIMESTAMP '{NOW}'")
            return plan

        return register


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def r6(x: Column | str, name: str | None = None) -> Column:
    col = F.col(x) if isinstance(x, str) else x
    return F.round(col, 6).alias(name or (x if isinstance(x, str) else "value"))


#: The active-claim condition in DuckDB.
ACTIVE = "NOT coalesce(c.tombstone, false) AND NOT EXISTS (SELECT 1 FROM promotion_queue p WHERE p.accepted_claim_id = c.id AND p.status = 'rolled_back')"
