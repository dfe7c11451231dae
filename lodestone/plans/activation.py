"""Registered queries: the search paths and the whole activation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lodestone.operators import graph, paging
from lodestone.operators.activate import Collection, Request, activate, activate_page, gather, hybrid_search
from lodestone.operators.ordering import numbered
from lodestone.plans.common import Registry, now, r6
from lodestone.plans.graphs import ENTITY, STEPS, WALK_AFTER_SEEDS
from lodestone.plans.retrieval import FB, FUSED, INTENTS, OBS, PAIRS, RANKED, SCOPES, TEXT, VEC, WORDS, query_vector
from lodestone.sources.fixtures import Tables

R = Registry()
VIEWS = "claims promotion_queue evidence feedback critic claim_vectors claim_links relations claim_entities observations"
CREATED = "(SELECT created_at FROM claims c WHERE c.id = {x}.id)"


def collection(t: Tables) -> Collection:
    return Collection(t.claims, t.promotion_queue, t.critic, t.claim_vectors, t.evidence, t.feedback, t.claim_links, t.claim_entities, t.relations, t.observations)


def asked(t: Tables, **more) -> Request:
    return Request(**{"now": now(), "words": WORDS, "vector": query_vector(t), "scopes": tuple(SCOPES), **more})


def reranked_sql(fused: str, intent: str | None, feedback: bool, threshold: str = "0.15") -> str:
    """RANKED up to the CTE rk (id, score, created_at), over another way to get ``fused``."""
    weight, boost = INTENTS.get(intent or "", (1.0, "1"))
    sql = RANKED.replace(TEXT + VEC + FUSED, fused).replace("{W}", str(weight)).replace("{INTENT}", boost).replace("{FB}", FB if feedback else "1")
    head, tail = sql.rsplit("SELECT u.id, round(", 1)
    score, rest = tail.split(", 6) AS score FROM", 1)
    return f"{head.rstrip()}, rk AS (SELECT u.id, {score} AS score, fac.created_at AS created_at FROM{rest.rsplit('>=', 1)[0]}>= {threshold})"


BEST = " SELECT id, round(score, 6) AS score FROM rk ORDER BY score DESC, created_at DESC, id LIMIT 36"
ALL_TEXT = TEXT.split("WHERE")[0].replace("0.5", "0") + "WHERE c.scope IN ('project', 'principle') AND NOT coalesce(c.tombstone, false) AND NOT EXISTS (SELECT 1 FROM promotion_queue p WHERE p.accepted_claim_id = c.id AND p.status = 'rolled_back') ORDER BY score DESC, c.created_at DESC, c.id LIMIT 36)"
ALONE = ", fused AS (SELECT id, score AS s_text, 0.0 AS s_vec, score AS s FROM txt)"


@R.add("r08_embedded_reranked", reranked_sql(TEXT + VEC + FUSED, "resume_task", True) + BEST, VIEWS)
def r08a(t: Tables):
    return hybrid_search(collection(t), asked(t, intent="resume_task", feedback=True), 36).select("id", r6("score"))


@R.add("r08_embedded_plain", TEXT + VEC + FUSED + f", rk AS (SELECT id, s AS score, {CREATED.format(x='fused')} AS created_at FROM fused WHERE s >= 0.15)" + BEST, VIEWS)
def r08b(t: Tables):
    return hybrid_search(collection(t), asked(t, rerank=False), 36).select("id", r6("score"))


@R.add("r08_text_reranked", reranked_sql(TEXT + ALONE, "debug_incident", False) + BEST, VIEWS)
def r08c(t: Tables):
    return hybrid_search(collection(t), asked(t, vector=None, intent="debug_incident"), 36).select("id", r6("score"))


@R.add("r08_text_raw", TEXT + ", rk AS (SELECT id, score, created_at FROM txt WHERE score >= 0.15)" + BEST, VIEWS)
def r08d(t: Tables):
    return hybrid_search(collection(t), asked(t, vector=None, rerank=False), 36).select("id", r6("score"))


@R.add("r08_without_query", reranked_sql(ALL_TEXT + ALONE, "policy_check", True, "-1e9") + BEST, VIEWS)
def r08e(t: Tables):
    """No words: all claims, by critic, are candidates; no threshold."""
    return hybrid_search(collection(t), asked(t, words=None, vector=None, intent="policy_check", feedback=True), 36).select("id", r6("score"))


FOUND = reranked_sql(TEXT + VEC + FUSED, "resume_task", True) + ", found AS (SELECT id, score, created_at FROM rk ORDER BY score DESC, created_at DESC, id LIMIT 36)"
MERGED = (FOUND + ENTITY + STEPS.rstrip() + ", seeds AS (SELECT id, score FROM found ORDER BY score DESC, created_at DESC, id LIMIT 6)" + WALK_AFTER_SEEDS.rstrip()
          + f""", sh AS (SELECT DISTINCT via AS id FROM ways WHERE kind = 'supersession'), cf AS (SELECT seed AS id, count(DISTINCT (id, via)) AS conflicts FROM ways WHERE kind = 'conflict' GROUP BY 1),
mg AS (SELECT coalesce(f.id, d.id) AS id, coalesce(f.score, d.path_score) AS score, coalesce(f.created_at, {CREATED.format(x='d')}) AS created_at, CASE WHEN f.id IS NOT NULL THEN 'search' WHEN contains(d.edges, 'r_') THEN 'topology' ELSE 'claim_link' END AS source,
 d.path_score, d.kind AS way, d.depth, CASE WHEN f.id IS NULL THEN 0 ELSE coalesce(cf.conflicts, 0) END AS conflicts FROM (SELECT * FROM found WHERE id NOT IN (SELECT id FROM sh)) f FULL JOIN derived d ON d.id = f.id LEFT JOIN cf ON cf.id = coalesce(f.id, d.id))
""")


@R.add("r13_merged", MERGED + "SELECT id, round(score, 6) AS score, source, way, depth, conflicts FROM mg", VIEWS)
def r13(t: Tables):
    data, ask = collection(t), asked(t, intent="resume_task", feedback=True)
    found = hybrid_search(data, ask, 36)
    allowed = graph_allowed(t)
    walked = graph.walk(found.orderBy(*paging.newest_first()).limit(6).select("id", "score"), data.links, data.claim_entities, data.relations, allowed)
    return graph.merge_walk(found, walked, data.claims).select("id", r6("score"), "source", F.col("kind").alias("way"), "depth", "conflicts")


def graph_allowed(t: Tables):
    from lodestone.operators import filters

    return filters.active(t.claims, t.promotion_queue).where(filters.one_of("scope", SCOPES))


REASON = """concat_ws('; ', 'rank=' || rank, 'layer=' || CASE scope WHEN 'principle' THEN 'macro' WHEN 'project' THEN 'meso' ELSE 'micro' END, 'source=' || source, 'score=' || printf('%.4f', score), 'kind=' || kind, 'memory_type=' || memory_type, 'intent=resume_task',
 CASE WHEN depth IS NOT NULL THEN 'topology_kind=' || way END, CASE WHEN depth IS NOT NULL THEN 'topology_depth=' || depth END, CASE WHEN conflicts > 0 THEN 'topology_conflicts=' || conflicts END)"""
FRESH = PAIRS.replace(" AND CAST(substr(a.id, 5) AS BIGINT) % 50 = 0", "").replace("WHERE CAST(substr(a.id, 5) AS BIGINT) % 50 = 0", "").rstrip()
#: From a page pg (id, score, created_at, source, way, depth, conflicts) to the answer.
ANSWER = FRESH + f""", an AS (SELECT pg.*, coalesce(c.scope, 'session') AS scope, coalesce(c.kind, 'observation') AS kind, c.memory_type, pg.id IN (SELECT id FROM newer) AS stale FROM pg LEFT JOIN claims c ON c.id = pg.id),
rn AS (SELECT *, row_number() OVER (ORDER BY stale, score DESC, created_at DESC, id DESC) AS rank FROM an)
SELECT rank, id, round(score, 6) AS score, source, stale, {REASON} AS reason FROM rn"""
ORDERED = "ORDER BY score DESC, created_at DESC, id DESC"


def whole(t: Tables, **more):
    return asked(t, intent="resume_task", feedback=True, freshness=0.3, **more)


def shown(page):
    return page.withColumn("score", F.round("score", 6))


@R.add("r19_activate", MERGED + f", pg AS (SELECT * FROM mg {ORDERED} LIMIT 12)" + ANSWER, VIEWS)
def r19(t: Tables):
    return shown(activate(collection(t), whole(t)))


@R.add("r19_activate_observations", MERGED.replace("id LIMIT 36)", "id LIMIT 1500)", 1) + OBS + f""", mx AS (SELECT (SELECT max(score) FROM mg) AS d, (SELECT max(score) FROM obs) AS o),
ob2 AS (SELECT id, score * CASE WHEN d > 0 AND o > d * 0.98 THEN d * 0.98 / o ELSE 1 END AS score, created_at FROM obs, mx),
du AS (SELECT * FROM mg {ORDERED} LIMIT 500), pg AS (SELECT * FROM du UNION ALL SELECT id, score, created_at, 'observation', NULL, NULL, NULL, 0 FROM (SELECT * FROM ob2 {ORDERED} LIMIT (SELECT least(150, greatest(0, 500 - count(*))) FROM du)))""" + ANSWER, VIEWS)
def r19o(t: Tables):
    """A page of 500, so that durable results leave slots open."""
    return shown(activate(collection(t), whole(t, top_k=500, seed_k=6, observations=True)))


@R.add("r19_second_page", MERGED.replace("ORDER BY score DESC, created_at DESC, id LIMIT 36)", ")", 1) + f", nb AS (SELECT *, row_number() OVER ({ORDERED}) AS p FROM mg), pg AS (SELECT * EXCLUDE (p) FROM nb WHERE p > 5 AND p <= 17)" + ANSWER, VIEWS)
def r19p(t: Tables):
    """The page after the fifth row of everything that is found without a limit."""
    # The first page needs no ranks by freshness: its last row in the final order is the cursor.
    data, ask = collection(t), whole(t, cursor=t.spark.createDataFrame([("none",)], "cursor string"))
    merged = gather(data, ask)
    first = numbered(activate_page(merged, None, 5, ask.cursor), paging.final_order(merged.columns), "place")
    last = first.where("place = 5").select(F.col("id").alias("cursor"))
    return shown(activate(data, replace(ask, cursor=last), merged))
