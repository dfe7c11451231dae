"""Pages of ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBSERVATION_SHARE = 0.3
GRAPH_SOURCES = ("graph", "claim_link", "topology")


def newest_first(score: str = "score") -> list[Column]:
    """Order of candidates: score, then creation, both descending; the id settles ties."""
    return [F.desc(score), F.desc("created_at"), F.asc("id")]


def last_changed(columns: list[str]) -> Column:
    return F.coalesce("updated_at", "created_at") if "updated_at" in columns else F.col("created_at")


def final_order(columns: list[str]) -> list[Column]:
    """Total order of final results: score, then last change (creation where unknown), then id, all descending."""
    return [F.desc("score"), F.desc(last_changed(columns)), F.desc("id")]


def page(ranked: DataFrame, cursor: DataFrame | None, size: int) -> DataFrame:
    """The ``size`` rows after the row whose id is the one-row ``cursor``, with their places ``rn`` in the candidate order.

    An unknown cursor starts at the first page. Rows are compared with the cursor's, so only the page is sorted.
    """
    if cursor is None:
        rest, skipped = ranked, None
    else:
        at = ranked.join(F.broadcast(cursor), F.col("id") == F.col("cursor")).agg(F.first(F.struct("score", "created_at", "id")).alias("at"))
        here, there = F.struct("score", "created_at"), F.struct(F.col("at.score").alias("score"), F.col("at.created_at").alias("created_at"))
        after = F.col("at").isNull() | (here < there) | (here.eqNullSafe(there) & (F.col("id") > F.col("at.id")))
        marked = ranked.join(F.broadcast(at)).withColumn("_after", after)
        skipped = marked.agg(F.count_if(~F.col("_after")).alias("_skipped"))
        rest = marked.where("_after").drop("at", "_after")
    rows = rest.orderBy(*newest_first()).limit(size)
    place = F.row_number().over(Window.orderBy(*newest_first())).cast("long")  # over one page
    if skipped is None:
        return rows.withColumn("rn", place)
    return rows.withColumn("rn", place).join(F.broadcast(skipped)).withColumn("rn", F.col("rn") + F.col("_skipped")).drop("_skipped")


def with_graph_presence(shown: DataFrame, results: DataFrame, size: int) -> DataFrame:
    """A page (id, score, created_at, source, path_score, ...) with the best graph row of all ``results`` in an open slot.

    Only where the page has an open slot, ``size`` is two or more and no row on it is from the graph; the best
    is by path score, then the final order. The cursor is taken from the page before.
    """
    if size < 2:
        return shown
    graph = F.col("source").isin(*GRAPH_SOURCES)
    counts = shown.agg(F.count(F.lit(1)).alias("_n"), F.count_if(graph).alias("_g"))
    spare = results.where(graph).join(shown.select("id"), "id", "left_anti").orderBy(F.desc_nulls_last("path_score"), *final_order(results.columns)).limit(1)
    extra = spare.join(F.broadcast(counts)).where((F.col("_n") < size) & (F.col("_g") == 0)).select(*shown.columns)
    return shown.unionByName(extra)


def durable_first(durable: DataFrame, observations: DataFrame, size: int) -> DataFrame:
    """A page of durable rows, then observations in the open slots, at most 30 % of the page; ``rn`` counts in each class.

    Only the best rows of each class that a page can hold are sorted.
    """

    def top(rows: DataFrame, most: int, name: str) -> DataFrame:
        best = rows.orderBy(*newest_first()).limit(most)
        return best.select("id", "score", F.lit(name).alias("class"), F.row_number().over(Window.orderBy(*newest_first())).cast("long").alias("rn"))

    own = top(durable, size, "durable")
    open_slots = own.agg((F.lit(size) - F.count(F.lit(1))).alias("open"))
    most = int(OBSERVATION_SHARE * size)
    some = top(observations, most, "observation").join(F.broadcast(open_slots)).where(F.col("rn") <= F.col("open"))
    return own.unionByName(some.select("id", "score", "class", "rn"))
