"""Activation: search, walk the graph from what was found, add observations, page, and explain the choice."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import filters, graph, paging, search
from lodestone.operators.ordering import numbered
from lodestone.runtime import materialize, small

SEED_MULTIPLIER = 3
FRESHNESS = 0.85


@dataclass
class Collection:
    """The tables that activation reads."""

    claims: DataFrame
    queue: DataFrame
    critic: DataFrame
    vectors: DataFrame
    evidence: DataFrame
    feedback: DataFrame
    links: DataFrame
    claim_entities: DataFrame
    relations: DataFrame
    observations: DataFrame


@dataclass
class Request:
    """What is asked: words and a one-row vector (column q) or neither, filters, and switches of the ranking."""

    now: Column
    words: list[str] | None = None
    vector: DataFrame | None = None
    scopes: tuple[str, ...] = ("session", "project", "principle")
    where: Column | None = None
    top_k: int = 12
    seed_k: int = 6
    hops: int = 2
    alpha: float = search.ALPHA
    threshold: float = search.THRESHOLD
    rerank: bool = True
    intent: str | None = None
    feedback: bool = False
    diversify: bool = False
    observations: bool = False
    freshness: float = FRESHNESS
    cursor: DataFrame | None = None


def candidate_limit(top_k: int, seed_k: int, cursor: bool) -> int | None:
    """How many search results are fetched for a page: enough for the page after it and for the seeds; all behind a cursor."""
    return None if cursor else max(top_k + 1, top_k * SEED_MULTIPLIER, seed_k * SEED_MULTIPLIER)


def hybrid_search(data: Collection, ask: Request, limit: int | None) -> DataFrame:
    """(id, score, created_at) by the request's path, the best ``limit``.

    With a vector: text and vector candidates are fused, and reranked unless that is off. Without one: text results alone,
    reranked if an intent or feedback is asked for, else times their usage, or raw if reranking is off.
    Without words all claims match, and no threshold applies.
    """
    where = filters.one_of("scope", list(ask.scopes)) & (ask.where if ask.where is not None else F.lit(True))
    threshold = ask.threshold if ask.words is not None else float("-inf")
    found = search.text_candidates(data.claims, data.queue, data.critic, ask.words, where, search.TEXT_LIMIT if ask.words is not None else limit)
    created = data.claims.select("id", "created_at")

    def reranked(fused: DataFrame, least: float) -> DataFrame:
        fused = materialize(fused, "fused")
        features = search.candidate_features(small(fused.select("id")), data.claims, data.evidence, data.queue, data.feedback)
        stats = search.utility_stats(data.claims, data.queue, where)
        return search.rerank(fused, features, stats, ask.now, ask.intent, ask.feedback, least).select("id", "score", "created_at")

    if ask.vector is not None and ask.words is not None:
        fused = search.fuse(found, search.vector_candidates(data.claims, data.queue, data.vectors, ask.vector, where), ask.alpha)
        if ask.rerank:
            out = reranked(fused, threshold)
        else:
            out = fused.where(F.col("s") >= threshold).select("id", F.col("s").alias("score")).join(created, "id")
    elif ask.rerank and (ask.intent is not None or ask.feedback):
        alone = found.select("id", F.col("score").alias("s_text"), F.lit(0.0).alias("s_vec"), F.col("score").alias("s"))
        out = reranked(alone, threshold)
    elif ask.rerank:
        out = search.usage_only(found, ask.now, threshold).orderBy("rank").select("id", "score", "created_at", "rank")
    else:
        out = found.where(F.col("score") >= threshold).select("id", "score", "created_at")
    if ask.diversify and ask.words is not None:
        rows = materialize(out, "ranked")
        size = max(limit or 0, search.MMR_HEAD)
        texts = rows.join(data.claims.select("id", "text"), "id").join(data.vectors.select(F.col("claim_id").alias("id"), "embedding"), "id", "left")
        place = search.diversify(texts, size)
        return rows.join(place, "id").where(F.col("position") <= limit) if limit is not None else rows.join(place, "id")
    if limit is None:
        return out
    if "rank" in out.columns:
        return out.where(F.col("rank") <= limit)
    return out.orderBy(*paging.newest_first()).limit(limit)


def activate_page(durable: DataFrame, observations: DataFrame | None, size: int, cursor: DataFrame | None) -> DataFrame:
    """The page of ``size`` rows after the cursor: durable rows first, then observations, at most 30 % of the page, in open slots.

    Rows are (id, score, created_at, source, ...). An unknown cursor starts at the first page; one that is an
    observation's skips all durable rows.
    """
    key = F.struct("score", paging.last_changed(durable.columns).alias("at"), "id")

    def rest(rows: DataFrame, at: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(at)).where(F.col("at").isNull() | (key < F.col("at"))).drop("at")

    def place(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(cursor), F.col("id") == F.col("cursor")).agg(F.first(key).alias("at"))

    if cursor is not None:
        if observations is not None:
            seen = place(observations)
            durable = rest(durable, place(durable)).join(F.broadcast(seen)).where("at is null").drop("at")
            observations = rest(observations, seen)
        else:
            durable = rest(durable, place(durable))
    own = durable.orderBy(*paging.final_order(durable.columns)).limit(size)
    if observations is None:
        return own
    most = int(paging.OBSERVATION_SHARE * size)
    own = materialize(own, "page")
    more = observations.orderBy(*paging.final_order(observations.columns)).limit(min(most, max(0, size - own.count())))
    return own.unionByName(more.select(*own.columns))


def selection_reason(intent: str | None) -> Column:
    """Why a row was chosen, as ``name=value`` parts."""
    parts = [
        F.concat(F.lit("rank="), "rank"), F.concat(F.lit("layer="), X.layer(F.col("scope"))), F.concat(F.lit("source="), "source"),
        F.concat(F.lit("score="), F.format_string("%.4f", "score")), F.concat(F.lit("kind="), "kind"), F.concat(F.lit("memory_type="), "memory_type"),
        F.lit(f"intent={intent}") if intent else F.lit(None).cast("string"),
        F.when(F.col("depth").isNotNull(), F.concat(F.lit("topology_kind="), "way")), F.when(F.col("depth").isNotNull(), F.concat(F.lit("topology_depth="), "depth")),
        F.when(F.col("conflicts") > 0, F.concat(F.lit("topology_conflicts="), "conflicts")),
    ]
    return F.concat_ws("; ", *parts)


def gather(data: Collection, ask: Request) -> DataFrame:
    """All results of a request before paging: search results merged with what a walk from the best of them reaches; superseded ones leave, derived ones join."""
    found = materialize(hybrid_search(data, ask, candidate_limit(ask.top_k, ask.seed_k, ask.cursor is not None)).select("id", "score", "created_at"), "found")
    allowed = filters.active(data.claims, data.queue).where(filters.one_of("scope", list(ask.scopes)))
    if ask.where is not None:
        allowed = allowed.where(ask.where)
    seeds = found.orderBy(*paging.newest_first()).limit(ask.seed_k).select("id", "score")
    walked = graph.walk(seeds, data.links, data.claim_entities, data.relations, allowed, ask.hops)
    return materialize(graph.merge_walk(found, walked, data.claims).withColumnRenamed("kind", "way"), "merged")


def activate(data: Collection, ask: Request, merged: DataFrame | None = None) -> DataFrame:
    """(rank, id, score, source, stale, reason): one page for a request.

    Pages of the same request may share the results ``merged`` that ``gather`` made for one with a cursor.
    Observations take open slots if asked for, their scores scaled below the best claim. An open slot goes to a graph
    result if the page has none. Rows with a newer similar claim come last.
    """
    merged = gather(data, ask) if merged is None else merged
    seen = None
    if ask.observations:
        scored = search.observation_scores(data.observations, ask.words or [], ask.now, filters.live(ask.now))
        extra = [F.lit(None).cast(kind).alias(c) for c, kind in (("path_score", "double"), ("way", "string"), ("depth", "int"))]
        seen = search.scaled_observations(merged, scored).select("id", "score", "created_at", F.lit("observation").alias("source"), *extra, F.lit(0).cast("long").alias("conflicts"))
        seen = seen.select(*merged.columns)
    shown = materialize(activate_page(merged, seen, ask.top_k, ask.cursor), "shown")
    shown = materialize(paging.with_graph_presence(shown, merged, ask.top_k), "shown")
    about = data.claims.join(F.broadcast(shown.select("id")), "id", "left_semi").select("id", "kind", "scope", "memory_type", F.col("created_at").alias("since"))
    own = about.join(data.vectors, F.col("id") == F.col("claim_id")).select("id", "scope", "embedding")
    others = filters.active(data.claims, data.queue).join(data.vectors, F.col("id") == F.col("claim_id")).select("id", "scope", "embedding")
    newer = search.newer_similar(search.similar_to_page(materialize(own, "own"), others, ask.freshness, "scope"), data.claims)
    rows = shown.join(about, "id", "left").join(newer.select("id", "newer"), "id", "left").withColumn("stale", F.col("newer").isNotNull())
    rows = rows.withColumn("scope", F.coalesce("scope", F.lit("session"))).withColumn("kind", F.coalesce("kind", F.lit("observation")))
    ranked = numbered(rows, [F.asc("stale"), *paging.final_order(rows.columns)], "rank")
    return ranked.select("rank", "id", "score", "source", "stale", selection_reason(ask.intent).alias("reason"))


def next_page(ask: Request, page: DataFrame) -> Request:
    """The request for the page after ``page`` (rank, id, ...): its last row is the cursor."""
    return replace(ask, cursor=page.orderBy(F.desc("rank")).limit(1).select(F.col("id").alias("cursor")))
