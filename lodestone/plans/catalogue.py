"""Registered queries: the remaining single operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import checks, embeddings
from lodestone.functions import scoring as S
from lodestone.functions import text as X
from lodestone.functions import vectors as V
from lodestone.operators import filters, graph, paging, search
from lodestone.operators.ordering import numbered
from lodestone.plans.common import ACTIVE, Registry, now, r6
from lodestone.plans.retrieval import PAIRS, TEXT, asked, cos_sql, near, scoped_vectors, texts
from lodestone.sources.fixtures import Tables

R = Registry()


@R.add("f17_syncable", "SELECT id, scope <> 'session' AND boundary_class <> 'secret' AS syncable FROM claims", "claims")
def f17(t: Tables):
    return t.claims.select("id", ((F.col("scope") != "session") & (F.col("boundary_class") != "secret")).alias("syncable"))


@R.add("f19_domain_checks", "SELECT id, kind IN ('fact', 'preference', 'task', 'policy_hint') AND scope IN ('session', 'project', 'principle') AS ok FROM claims", "claims")
def f19(t: Tables):
    return t.claims.select("id", (F.col("kind").isin(checks.KINDS) & F.col("scope").isin(checks.SCOPES)).alias("ok"))


@R.add("j08_full_outer", TEXT + ", k AS (SELECT claim_id AS id, score FROM critic) SELECT coalesce(t.id, k.id) AS id, round(coalesce(t.score, 0), 6) AS a, round(coalesce(k.score, 0), 6) AS b FROM txt t FULL JOIN k ON k.id = t.id", "claims promotion_queue critic")
def j08(t: Tables):
    k = t.critic.select(F.col("claim_id").alias("id"), F.col("score").alias("b"))
    both = texts(t).select("id", F.col("score").alias("a")).join(k, "id", "full_outer")
    return both.select("id", F.round(F.coalesce("a", F.lit(0.0)), 6).alias("a"), F.round(F.coalesce("b", F.lit(0.0)), 6).alias("b"))


@R.add("j11_co_claims", ", s AS (SELECT entity_id FROM claim_entities WHERE claim_id = 'clm_4') SELECT DISTINCT claim_id FROM claim_entities WHERE entity_id IN (SELECT entity_id FROM s) AND claim_id <> 'clm_4'", "claim_entities")
def j11(t: Tables):
    mine = t.claim_entities.where("claim_id = 'clm_4'").select("entity_id")
    return t.claim_entities.join(mine, "entity_id", "left_semi").where("claim_id <> 'clm_4'").select("claim_id").distinct()


@R.add("j13_json_unnest", "SELECT active_context_id, claim_id FROM active_context_items", "active_context_items")
def j13(t: Tables):
    """Contexts written with their claims as JSON and read back."""
    packed = t.active_context_items.groupBy("active_context_id").agg(F.to_json(F.collect_list(F.struct(F.col("claim_id").alias("id")))).alias("claims"))
    return packed.select("active_context_id", F.explode(F.from_json("claims", "array<struct<id:string>>")).alias("c")).select("active_context_id", F.col("c.id").alias("claim_id"))


@R.add("l06_graph_presence", TEXT + """, d AS (SELECT * FROM txt ORDER BY score DESC, created_at DESC, id LIMIT 7),
g AS (SELECT target_claim_id AS id, max(confidence) AS path_score FROM claim_links JOIN d ON d.id = source_claim_id WHERE target_claim_id NOT IN (SELECT id FROM d) GROUP BY 1)
SELECT id, 'search' AS source FROM d UNION ALL SELECT * FROM (SELECT g.id, 'graph' FROM g JOIN claims c ON c.id = g.id ORDER BY path_score DESC, path_score DESC, created_at DESC, g.id DESC LIMIT 1)""", "claims promotion_queue critic claim_links")
def l06(t: Tables):
    """Seven search rows leave slots open on a page of ten; what they link to competes for one of them."""
    found = texts(t).orderBy(*search.newest_first()).limit(7).select("id", "score", "created_at", F.lit("search").alias("source"), F.lit(None).cast("double").alias("path_score"))
    ways = t.claim_links.join(F.broadcast(found.select(F.col("id").alias("source_claim_id"))), "source_claim_id", "left_semi").groupBy(F.col("target_claim_id").alias("id")).agg(F.max("confidence").alias("path_score"))
    others = ways.join(t.claims.select("id", "created_at"), "id").select("id", F.col("path_score").alias("score"), "created_at", F.lit("graph").alias("source"), "path_score")
    return paging.with_graph_presence(found, found.unionByName(others), 10).select("id", "source")


@R.add("l07_durable_first", TEXT + """, o AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS rn FROM observations), d AS (SELECT id, row_number() OVER (ORDER BY score DESC, created_at DESC, id) AS rn FROM (SELECT * FROM txt ORDER BY score DESC, created_at DESC, id LIMIT 7))
SELECT id, 'durable' AS class, rn FROM d UNION ALL SELECT id, 'observation', rn FROM o WHERE rn <= 3""", "claims promotion_queue critic observations")
def l07(t: Tables):
    top = texts(t).orderBy(*search.newest_first()).limit(7)
    obs = t.observations.withColumn("score", F.lit(0.5)).select("id", "score", "created_at")
    return paging.durable_first(top.select("id", "score", "created_at"), obs, 10).select("id", "class", "rn")


@R.add("x02_cosines", f", q AS (SELECT embedding AS q FROM claim_vectors WHERE claim_id = 'clm_0') SELECT claim_id, round({cos_sql('embedding', 'q')}, 6) AS cosine, round(greatest(0, least(1, ({cos_sql('embedding', 'q')} + 1) / 2)), 6) AS moved, round(greatest(0, least(1, {cos_sql('embedding', 'q')})), 6) AS clamped FROM claim_vectors, q", "claim_vectors")
def x02(t: Tables):
    one = t.claim_vectors.where("claim_id = 'clm_0'").select(F.col("embedding").alias("q"))
    e, q = F.col("embedding"), F.col("q")
    return t.claim_vectors.join(F.broadcast(one)).select("claim_id", r6(V.cosine(e, q), "cosine"), r6(V.diversity_cosine(e, q), "moved"), r6(V.pair_cosine(e, q), "clamped"))


HL = "CASE kind WHEN 'fact' THEN 120 WHEN 'task' THEN 14 WHEN 'preference' THEN 90 WHEN 'policy_hint' THEN 365 ELSE 30 END"


@R.add("x07_x08_recency", f"SELECT id, round(exp(-0.693147 * greatest(0, epoch({{NOW}} - created_at) / 86400.0) / {HL}), 6) AS recency FROM claims", "claims")
def x07(t: Tables):
    return t.claims.select("id", r6(S.recency(F.col("created_at"), S.half_life(F.col("kind")), now()), "recency"))


@R.add("x09_g_factor", f"SELECT id, round((0.6 + 0.4 / (1 + exp(-(utility - 0.5) / 0.25))) * (0.5 + 0.5 * confidence) * (0.3 + 0.7 * exp(-0.693147 * greatest(0, epoch({{NOW}} - created_at) / 86400.0) / {HL})), 6) AS g FROM claims", "claims")
def x09(t: Tables):
    g = S.utility_term(F.col("utility"), F.lit(0.5), F.lit(0.25)) * S.confidence_term(F.least("confidence", F.lit(1.0))) * S.recency_term(S.recency(F.col("created_at"), S.half_life(F.col("kind")), now()))
    return t.claims.select("id", r6(g, "g"))


@R.add("x13_feedback_boost", ", f AS (SELECT claim_id, count(*) FILTER (signal = 'helpful') AS h, count(*) FILTER (signal = 'harmful') AS x, count(*) FILTER (signal = 'outdated') AS o, count(*) FILTER (signal = 'duplicate') AS d FROM feedback GROUP BY 1) SELECT claim_id, round(greatest(0.45, least(1.65, exp(0.25 * ln(1 + h) - 0.35 * ln(1 + x) - 0.18 * ln(1 + o) - 0.12 * ln(1 + d)))), 6) AS boost FROM f", "feedback")
def x13(t: Tables):
    counts = t.feedback.groupBy("claim_id").agg(*[F.count_if(F.col("signal") == s).alias(s) for s in S.FEEDBACK_WEIGHTS])
    return counts.select("claim_id", r6(S.feedback_boost({s: F.col(s) for s in S.FEEDBACK_WEIGHTS}), "boost"))


@R.add("x14_usage_term", "SELECT id, round(greatest(0.5, least(1, 1 - greatest(0, epoch({NOW} - created_at) / 86400.0) / 30 * 0.5)) * greatest(1, least(2, 1 + 0.1 * log2(CASE WHEN retrieval_count >= 10 THEN retrieval_count ELSE 0 END + 1))), 6) AS usage FROM claims", "claims")
def x14(t: Tables):
    return t.claims.select("id", r6(S.usage_term(F.col("retrieval_count"), F.col("created_at"), now()), "usage"))


@R.add("w06_live_cache", "SELECT id FROM claims WHERE created_at >= {NOW} - INTERVAL '720' HOUR ORDER BY created_at DESC, id LIMIT 10000", "claims")
def w06(t: Tables):
    cache = t.claims.withColumn("hash", F.col("id"))
    return embeddings.live_cache(cache, now(), hours=720).select("id")


@R.add("r13_without_shadowed", TEXT + " SELECT id FROM txt WHERE id NOT IN (SELECT target_claim_id FROM claim_links WHERE link_type = 'supersedes')", "claims promotion_queue critic claim_links")
def r13(t: Tables):
    shadowed = t.claim_links.where("link_type = 'supersedes'").select(F.col("target_claim_id").alias("id"))
    return texts(t).join(shadowed, "id", "left_anti").select("id")


@R.add("r14_freshness_order", PAIRS.rstrip() + """, a AS (SELECT u.id, u.created_at, u.id IN (SELECT id FROM newer) AS stale FROM u WHERE CAST(substr(u.id, 5) AS BIGINT) % 50 = 0)
SELECT id, stale, row_number() OVER (ORDER BY stale, created_at DESC, id DESC) AS rank FROM a""", "claims promotion_queue claim_vectors")
def r14(t: Tables):
    """Stale rows last, then the final order (all scores are equal here)."""
    stale = search.newer_similar(near(t), t.claims).select("id", F.lit(True).alias("stale"))
    rows = asked(scoped_vectors(t)).select("id", "created_at", F.lit(1.0).alias("score")).join(stale, "id", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))
    return numbered(rows, [F.asc("stale"), *paging.final_order(rows.columns)], "rank").select("id", "stale", "rank")


@R.add("r17_combined_scores", "SELECT id, round(utility + confidence * 0.5 * (1 - utility), 6) AS score FROM claims", "claims")
def r17(t: Tables):
    return t.claims.select("id", r6(S.combined(F.col("utility"), F.col("confidence") * 0.5), "score"))


@R.add("p15_source_text", "SELECT id, CASE WHEN trim(content) <> '' THEN content ELSE sha256(content) END AS source FROM observations", "observations")
def p15(t: Tables):
    c = F.col("content")
    return t.observations.select("id", F.when(F.trim(c) != "", c).otherwise(F.sha2(c.cast("binary"), 256)).alias("source"))


@R.add("x36_observation_claims", "SELECT id, 'observation' AS kind, 'session' AS scope, content AS text FROM observations WHERE content <> ''", "observations")
def x36(t: Tables):
    return t.observations.where("content <> ''").select("id", F.lit("observation").alias("kind"), F.lit("session").alias("scope"), F.col("content").alias("text"))


@R.add("x35_canonical_cycles", ", e AS (SELECT a.source_claim_id AS x, a.target_claim_id AS y, b.target_claim_id AS z FROM claim_links a JOIN claim_links b ON b.source_claim_id = a.target_claim_id) SELECT x, y, z, least(concat(x, '>', y, '>', z), concat(y, '>', z, '>', x), concat(z, '>', x, '>', y)) AS least FROM e", "claim_links")
def x35(t: Tables):
    a = t.claim_links.select(F.col("source_claim_id").alias("x"), F.col("target_claim_id").alias("y"))
    e = a.join(t.claim_links.select(F.col("source_claim_id").alias("y"), F.col("target_claim_id").alias("z")), "y")
    return e.select("x", "y", "z", F.array_join(X.least_rotation(F.array("x", "y", "z")), ">").alias("least"))


@R.add("g02_shadowing_steps", "SELECT target_claim_id AS u, source_claim_id AS v, id AS edge FROM claim_links WHERE link_type = 'supersedes'", "claim_links")
def g02(t: Tables):
    return graph.walk_steps(t.claim_links).where("kind = 'supersession'").select("u", "v", "edge")


@R.add("p04_promotion_evidence", f"SELECT c.id, count(e.id) AS evidence FROM claims c LEFT JOIN evidence e ON e.claim_id = c.id WHERE c.id IN (SELECT accepted_claim_id FROM promotion_queue WHERE status = 'accepted') AND {ACTIVE} GROUP BY c.id", "claims promotion_queue evidence")
def p04(t: Tables):
    accepted = t.promotion_queue.where("status = 'accepted'").select(F.col("accepted_claim_id").alias("id"))
    rows = filters.active(t.claims, t.promotion_queue).join(accepted, "id", "left_semi").select("id")
    n = t.evidence.groupBy(F.col("claim_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("evidence"))
