"""Registered queries: filters, joins, scores and the retrieval pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import scoring as S
from lodestone.functions import text as X
from lodestone.functions import vectors as V
from lodestone.operators import filters, search, word_index
from lodestone.operators.neighbours import neighbours
from lodestone.operators.ordering import numbered
from lodestone.plans.common import ACTIVE, Registry, now, r6
from lodestone.sources.fixtures import Tables
from lodestone.sources.layout import lay_out

R = Registry()
CORE = "claims promotion_queue"
WORDS = ["haing", "thand"]
OR = " OR ".join(f"text ILIKE '%{w}%'" for w in WORDS)
COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])) / nullif(sqrt(list_sum(list_transform({a}, lambda x: x * x))), 0) / nullif(sqrt(list_sum(list_transform({b}, lambda x: x * x))), 0)"
SCOPES = ["project", "principle"]
IN_SCOPE = "c.scope IN ('project', 'principle')"


def cos_sql(a: str, b: str) -> str:
    return COS.format(a=a, b=b)


def query_vector(t: Tables):
    return t.claim_vectors.where("claim_id = 'clm_0'").select(F.col("embedding").alias("q"))


@R.add("f01_active_claims", f"SELECT c.id, c.kind, c.scope FROM claims c WHERE {ACTIVE}", CORE)
def f01(t: Tables):
    return filters.active(t.claims, t.promotion_queue).select("id", "kind", "scope")


@R.add("f02_scope_filter", f"SELECT c.id FROM claims c WHERE {IN_SCOPE} AND {ACTIVE}", CORE)
def f02(t: Tables):
    return filters.active(t.claims, t.promotion_queue).where(filters.one_of("scope", SCOPES)).select("id")


@R.add("f03_boundary_kind_filter", "SELECT id, boundary_class, kind FROM claims WHERE boundary_class IN ('public', 'internal') AND kind IN ('fact', 'task')", "claims")
def f03(t: Tables):
    return t.claims.where(filters.claim_filter(classes=["public", "internal", "public", ""], kinds=["fact", "task"])).select("id", "boundary_class", "kind")


@R.add("f03_empty_filter", "SELECT id FROM claims WHERE 1 = 0", "claims")
def f03e(t: Tables):
    return t.claims.where(filters.claim_filter(kinds=[])).select("id")


@R.add("f04_working_state_filter", "SELECT id, status FROM claims WHERE memory_type IS NULL OR memory_type <> 'working_state' OR coalesce(status, 'active') NOT IN ('stale', 'completed')", "claims")
def f04(t: Tables):
    return t.claims.where(filters.settled_state()).select("id", "status")


@R.add("f05_word_match", f"SELECT id FROM claims WHERE {OR}", "claims")
def f05(t: Tables):
    return t.claims.where(X.any_word(F.col("text"), WORDS)).select("id")


@R.add("f06_row_filter", "SELECT id FROM claims WHERE kind = 'fact' AND memory_type IN ('knowledge', 'norm')", "claims")
def f06(t: Tables):
    return t.claims.where(filters.claim_filter(kinds=["fact"], memory_types=["knowledge", "norm"])).select("id")


@R.add("f07_live_observations", "SELECT id FROM observations WHERE content IS NOT NULL AND (expires_at IS NULL OR expires_at > {NOW})", "observations")
def f07(t: Tables):
    return t.observations.where(filters.live(now())).select("id")


@R.add("f09_durable_claims", "SELECT id FROM claims WHERE scope <> 'session' AND kind <> 'observation' AND starts_with(id, 'clm_') AND length(trim(text)) > 0", "claims")
def f09(t: Tables):
    return filters.durable(t.claims).select("id")


@R.add("f10_valid_embeddings", "SELECT claim_id, len(embedding) BETWEEN 1 AND 4096 AND list_max(list_transform(embedding, lambda x: abs(x))) <= 10 AS valid FROM claim_vectors", "claim_vectors")
def f10(t: Tables):
    return t.claim_vectors.select("claim_id", V.valid_embedding(F.col("embedding")).alias("valid"))


@R.add("f18_unprocessed_observations", "SELECT count(*) AS n FROM observations WHERE content IS NOT NULL AND (expires_at IS NULL OR expires_at > {NOW})", "observations")
def f18(t: Tables):
    return t.observations.where(filters.live(now())).agg(F.count(F.lit(1)).alias("n"))


@R.add("s03_filtered_scan", f"""SELECT c.id, c.scope, EXISTS (SELECT 1 FROM promotion_queue p WHERE p.accepted_claim_id = c.id AND p.status = 'rolled_back') AS rolled_back
FROM claims c WHERE {IN_SCOPE} AND c.created_at >= {{NOW}} - INTERVAL '60' DAY""", CORE)
def s03(t: Tables):
    gone = filters.rolled_back(t.promotion_queue).withColumn("rolled_back", F.lit(True))
    rows = t.claims.where(filters.one_of("scope", SCOPES) & (F.col("created_at") >= now() - F.expr("INTERVAL '60' DAY")))
    return rows.join(gone, "id", "left").select("id", "scope", F.coalesce("rolled_back", F.lit(False)).alias("rolled_back"))


@R.add("s03_laid_out_scan", "SELECT id, kind FROM claims WHERE scope = 'project' AND created_at >= {NOW} - INTERVAL '45' DAY", "claims")
def s03l(t: Tables):
    """Claims by scope and month: other scopes and earlier months are not opened."""
    return lay_out(t.claims, "id", "month").since(now() - F.expr("INTERVAL '45' DAY"), "project").select("id", "kind")


@R.add("y01_laid_out_export", "SELECT c.id, c.scope, len(v.embedding) AS width FROM claims c JOIN claim_vectors v ON v.claim_id = c.id WHERE c.scope <> 'session' AND c.created_at >= {NOW} - INTERVAL '100' DAY", "claims claim_vectors")
def y01l(t: Tables):
    """Claims and vectors bucketed by id meet without an exchange."""
    claims, vectors = lay_out(t.claims, "id", "month"), lay_out(t.claim_vectors.withColumnRenamed("claim_id", "id"), "id")
    rows = claims.since(now() - F.expr("INTERVAL '100' DAY")).where("scope <> 'session'").join(vectors.rows().hint("merge"), "id")
    return rows.select("id", "scope", F.size("embedding").alias("width"))


@R.add("s05_point_lookup", "SELECT id, type FROM entities WHERE lower(name) = lower('1-URGENT') ORDER BY id DESC LIMIT 1", "entities")
def s05(t: Tables):
    return t.entities.where(F.lower("name") == "1-urgent").orderBy(F.desc("id")).limit(1).select("id", "type")


@R.add("s07_evidence_by_claim", "SELECT claim_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM evidence GROUP BY claim_id", "evidence")
def s07(t: Tables):
    return t.evidence.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))


@R.add("s08_entity_query", "SELECT DISTINCT e.id, e.name FROM entities e JOIN claim_entities x ON x.entity_id = e.id WHERE e.type = 'Artifact'", "entities claim_entities")
def s08(t: Tables):
    return t.entities.where("type = 'Artifact'").join(t.claim_entities, F.col("id") == F.col("entity_id"), "left_semi").select("id", "name")


@R.add("s19_vectors_or_missing", "SELECT c.id, v.embedding IS NULL AS missing FROM claims c LEFT JOIN claim_vectors v ON v.claim_id = c.id", "claims claim_vectors")
def s19(t: Tables):
    return t.claims.join(t.claim_vectors, F.col("id") == F.col("claim_id"), "left").select("id", F.col("embedding").isNull().alias("missing"))


@R.add("j01_claims_critic", "SELECT c.id, k.score FROM claims c LEFT JOIN critic k ON k.claim_id = c.id", "claims critic")
def j01(t: Tables):
    return t.claims.join(t.critic, F.col("id") == F.col("claim_id"), "left").select("id", "score")


@R.add("j02_claims_vectors", "SELECT c.id, len(v.embedding) AS dims FROM claims c JOIN claim_vectors v ON v.claim_id = c.id", "claims claim_vectors")
def j02(t: Tables):
    return t.claims.join(t.claim_vectors, F.col("id") == F.col("claim_id")).select("id", F.size("embedding").cast("long").alias("dims"))


FEATURES = """, e AS (SELECT claim_id, count(DISTINCT id) AS n FROM evidence GROUP BY 1),
l AS (SELECT DISTINCT accepted_claim_id FROM promotion_queue WHERE status = 'accepted'),
f AS (SELECT claim_id, count(*) FILTER (signal = 'helpful') AS helpful, count(*) FILTER (signal = 'harmful') AS harmful,
 count(*) FILTER (signal = 'outdated') AS outdated, count(*) FILTER (signal = 'duplicate') AS duplicate FROM feedback GROUP BY 1),
feat AS (SELECT c.*, coalesce(e.n, 0) AS evidence_count, l.accepted_claim_id IS NOT NULL AS lineage,
 coalesce(helpful, 0) AS helpful, coalesce(harmful, 0) AS harmful, coalesce(outdated, 0) AS outdated, coalesce(duplicate, 0) AS duplicate
 FROM claims c LEFT JOIN e ON e.claim_id = c.id LEFT JOIN l ON l.accepted_claim_id = c.id LEFT JOIN f ON f.claim_id = c.id)
"""


def features(t: Tables, ids=None):
    return search.candidate_features(ids if ids is not None else t.claims.select("id"), t.claims, t.evidence, t.promotion_queue, t.feedback)


@R.add("j03_candidate_features", FEATURES + "SELECT id, evidence_count, lineage, helpful, harmful, outdated, duplicate FROM feat", "claims promotion_queue evidence feedback")
def j03(t: Tables):
    return features(t).select("id", "evidence_count", "lineage", "helpful", "harmful", "outdated", "duplicate")


#: Pairs are asked of the claims whose number is divisible by 50, against all.
PAIRS = f""", u AS (SELECT c.id, c.scope, c.created_at, v.embedding FROM claims c JOIN claim_vectors v ON v.claim_id = c.id WHERE {ACTIVE}),
near AS (SELECT * FROM (SELECT a.id, b.id AS other, {cos_sql('a.embedding', 'b.embedding')} AS similarity FROM u a JOIN u b ON a.scope = b.scope AND a.id <> b.id WHERE CAST(substr(a.id, 5) AS BIGINT) % 50 = 0) WHERE similarity > 0.3),
newer AS (SELECT near.id, arg_max(other, row(n.created_at, similarity, other)) AS newer, arg_max(similarity, row(n.created_at, similarity, other)) AS similarity FROM near JOIN u o ON o.id = near.id JOIN u n ON n.id = other
 WHERE n.created_at > o.created_at OR (n.created_at = o.created_at AND n.id > o.id) GROUP BY near.id)
"""


def scoped_vectors(t: Tables):
    return filters.active(t.claims, t.promotion_queue).join(t.claim_vectors, F.col("id") == F.col("claim_id")).select("id", "scope", "created_at", "embedding")


def asked(vectors):
    return vectors.where(F.substring("id", 5, 20).cast("long") % 50 == 0)


def near(t: Tables):
    u = scoped_vectors(t)
    return search.similar_to(asked(u), u, 0.3, "scope")


@R.add("j06_similar_claims", PAIRS + "SELECT id, other, round(similarity, 6) AS similarity FROM near", "claims promotion_queue claim_vectors")
def j06(t: Tables):
    return near(t).select("id", "other", r6("similarity"))


@R.add("j07_newer_similar", PAIRS + "SELECT id, newer, round(similarity, 6) AS similarity FROM newer", "claims promotion_queue claim_vectors")
def j07(t: Tables):
    return search.newer_similar(near(t), t.claims).select("id", "newer", r6("similarity"))


@R.add("j05_unlinked_pairs", PAIRS + """SELECT p.id, p.other FROM near p WHERE NOT EXISTS (SELECT 1 FROM claim_links l
 WHERE (l.source_claim_id = p.id AND l.target_claim_id = p.other) OR (l.source_claim_id = p.other AND l.target_claim_id = p.id))""", "claims promotion_queue claim_vectors claim_links")
def j05(t: Tables):
    l = t.claim_links
    linked = l.select(F.col("source_claim_id").alias("id"), F.col("target_claim_id").alias("other")).union(l.select("target_claim_id", "source_claim_id"))
    return near(t).join(linked, ["id", "other"], "left_anti").select("id", "other")


#: Active claims and a later version of each that has a successor, whose vector leans to the successor's.
VERSIONS = f""", v0 AS (SELECT c.id, c.scope AS block, sha256(c.text) AS hash, c.created_at, CAST(substr(c.id, 5) AS BIGINT) AS k, v.embedding AS e FROM claims c JOIN claim_vectors v ON v.claim_id = c.id WHERE {ACTIVE}),
u AS (SELECT id, block, hash, created_at, e FROM v0 UNION ALL SELECT 'ver_' || a.id, a.block, sha256('v' || a.hash), a.created_at + INTERVAL '1' DAY * CAST(a.k % 5 - 2 AS INT), list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] + 0.1 * CAST(a.k % 5 AS DOUBLE) * coalesce(b.e[i], 0.0)) FROM v0 a JOIN v0 b ON b.k = a.k + 1),
n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM u),
p AS (SELECT a.id, a.created_at AS t0, b.id AS other, b.created_at AS t1, list_sum(list_transform(range(1, least(len(a.e), len(b.e)) + 1), lambda i: a.e[i] * b.e[i])) / a.norm / b.norm AS s FROM n a JOIN n b ON a.block = b.block AND a.id <> b.id AND a.hash <> b.hash),
g AS (SELECT id, count(*) AS n_links, arg_max(other, {{'s': round(s, 9), 't': t1, 'o': other}}) AS nearest, max(s) AS similarity FROM p WHERE s > 0.85 GROUP BY 1),
w AS (SELECT id, arg_max(other, {{'t': t1, 'o': other}}) AS newer, arg_max(s, {{'t': t1, 'o': other}}) AS newer_similarity FROM p WHERE s > 0.85 AND (t1 > t0 OR t1 = t0 AND other > id) GROUP BY 1)
"""


def versions(t: Tables):
    # Texts are hashed where they are read and move no further.
    claims = t.claims.select("id", "scope", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "created_at", "tombstone")
    c = filters.active(claims, t.promotion_queue).join(t.claim_vectors, F.col("id") == F.col("claim_id"))
    v = c.select("id", F.col("scope").alias("block"), "hash", "created_at", F.substring("id", 5, 20).cast("long").alias("k"), "embedding")
    after = v.select((F.col("k") - 1).alias("k"), F.col("embedding").alias("next"))
    leaning = F.transform("embedding", lambda x, i: x + 0.1 * (F.col("k") % 5).cast("double") * F.coalesce(F.get("next", i), F.lit(0.0)))
    days = F.make_dt_interval((F.col("k") % 5 - 2).cast("int"))
    later = v.join(after, "k").select(F.concat(F.lit("ver_"), "id").alias("id"), "block", F.sha2(F.concat(F.lit("v"), "hash").cast("binary"), 256).alias("hash"), (F.col("created_at") + days).alias("created_at"), leaning.alias("embedding"))
    return v.select("id", "block", "hash", "created_at", "embedding").unionByName(later)


@R.add("j06_all_neighbours", VERSIONS + "SELECT u.id, coalesce(n_links, 0) AS n_links, nearest, round(similarity, 6) AS similarity FROM u LEFT JOIN g ON g.id = u.id", "claims promotion_queue claim_vectors")
def j06all(t: Tables):
    """Every claim and version against all of its scope, through the index."""
    return neighbours(versions(t)).select("id", "n_links", "nearest", r6("similarity"))


@R.add("j07_all_newer", VERSIONS + "SELECT id, newer, round(newer_similarity, 6) AS similarity FROM w", "claims promotion_queue claim_vectors")
def j07all(t: Tables):
    return neighbours(versions(t)).where("newer is not null").select("id", "newer", r6("newer_similarity", "similarity"))


@R.add("r14_all_freshness", VERSIONS + "SELECT u.id, w.newer IS NOT NULL AS stale, row_number() OVER (ORDER BY w.newer IS NOT NULL, created_at DESC, u.id DESC) AS rank FROM u LEFT JOIN w ON w.id = u.id", "claims promotion_queue claim_vectors")
def r14all(t: Tables):
    """All rows, those with a newer similar one last."""
    rows = versions(t)
    stale = neighbours(rows).select("id", F.col("newer").isNotNull().alias("stale"))
    return numbered(rows.select("id", "created_at").join(stale, "id"), [F.asc("stale"), F.desc("created_at"), F.desc("id")], "rank").select("id", "stale", "rank")


@R.add("r16_link_suggestions", f""", u AS (SELECT c.id, v.embedding FROM claims c JOIN claim_vectors v ON v.claim_id = c.id WHERE {ACTIVE}),
s AS (SELECT a.id AS source, b.id AS target, ({cos_sql('a.embedding', 'b.embedding')} + 1) / 2 AS score FROM (SELECT claim_id AS id, embedding FROM claim_vectors WHERE claim_id = 'clm_0') a JOIN u b ON a.id <> b.id),
k AS (SELECT s.*, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rn FROM s WHERE score >= 0.6 AND score < 0.85 AND NOT EXISTS (SELECT 1 FROM claim_links l
 WHERE (l.source_claim_id = s.source AND l.target_claim_id = s.target) OR (l.source_claim_id = s.target AND l.target_claim_id = s.source)))
SELECT source, target, round(score, 4) AS score FROM k WHERE rn <= 5""", "claims promotion_queue claim_vectors claim_links")
def r16(t: Tables):
    u = scoped_vectors(t)
    one = query_vector(t)
    score = S.norm_cos(V.cosine(F.col("embedding"), F.col("q")))
    s = u.where("id <> 'clm_0'").join(F.broadcast(one)).select(F.lit("clm_0").alias("source"), F.col("id").alias("target"), score.alias("score")).where("score >= 0.6 and score < 0.85")
    l = t.claim_links
    linked = l.select(F.col("source_claim_id").alias("source"), F.col("target_claim_id").alias("target")).union(l.select("target_claim_id", "source_claim_id"))
    best = s.join(linked, ["source", "target"], "left_anti").orderBy(F.desc("score"), "target").limit(5)
    return best.select("source", "target", F.round("score", 4).alias("score"))


@R.add("a08_utility_stats", f"SELECT round(coalesce(avg(utility), 0), 6) AS mean, round(coalesce(nullif(stddev_samp(utility), 0), 1), 6) AS deviation FROM claims c WHERE {IN_SCOPE} AND {ACTIVE}", CORE)
def a08(t: Tables):
    return search.utility_stats(t.claims, t.promotion_queue, filters.one_of("scope", SCOPES)).select(r6("mean"), r6("deviation"))


TEXT = f""", txt AS (SELECT c.id, c.created_at, coalesce(k.score, 0.5) AS score FROM claims c LEFT JOIN critic k ON k.claim_id = c.id
 WHERE {IN_SCOPE} AND {ACTIVE} AND ({OR.replace('text', 'c.text')}) ORDER BY score DESC, c.created_at DESC, c.id LIMIT 128)"""
VEC = f""", vec AS (SELECT c.id, c.created_at, ({cos_sql('v.embedding', 'q.embedding')} + 1) / 2 AS score FROM claims c JOIN claim_vectors v ON v.claim_id = c.id,
 (SELECT embedding FROM claim_vectors WHERE claim_id = 'clm_0') q WHERE {IN_SCOPE} AND {ACTIVE} ORDER BY score DESC, c.created_at DESC, c.id LIMIT 256)"""
FUSED = """, fused AS (SELECT coalesce(t.id, v.id) AS id, coalesce(t.score, 0) AS s_text, coalesce(v.score, 0) AS s_vec,
 0.65 * coalesce(v.score, 0) + (1 - 0.65) * coalesce(t.score, 0) AS s FROM txt t FULL JOIN vec v ON t.id = v.id)"""
HYBRID_VIEWS = "claims promotion_queue critic claim_vectors"


def texts(t: Tables):
    return search.text_candidates(t.claims, t.promotion_queue, t.critic, WORDS, filters.one_of("scope", SCOPES))


def vecs(t: Tables):
    return search.vector_candidates(t.claims, t.promotion_queue, t.claim_vectors, query_vector(t), filters.one_of("scope", SCOPES))


@R.add("r01_text_search", TEXT + " SELECT id, round(score, 6) AS score FROM txt", "claims promotion_queue critic")
def r01(t: Tables):
    return texts(t).select("id", r6("score"))


@R.add("r01_indexed_search", TEXT + " SELECT id, round(score, 6) AS score FROM txt", "claims promotion_queue critic")
def r01i(t: Tables):
    """The same search through an index of three-letter runs: only the postings of the words' rarest runs are read."""
    found = word_index.matches(t.claims, word_index.build(t.claims), WORDS)
    return search.text_candidates(found, t.promotion_queue, t.critic, WORDS, filters.one_of("scope", SCOPES)).select("id", r6("score"))


@R.add("f05_indexed_match", "SELECT id FROM claims WHERE text ILIKE '%haing%' OR text ILIKE '%THe H%'", "claims")
def f05i(t: Tables):
    return word_index.matches(t.claims, word_index.build(t.claims), ["haing", "THe H"]).select("id")


@R.add("r02_all_claims", f"SELECT c.id, round(coalesce(k.score, 0), 6) AS score FROM claims c LEFT JOIN critic k ON k.claim_id = c.id WHERE {IN_SCOPE} AND {ACTIVE}", "claims promotion_queue critic")
def r02(t: Tables):
    return search.text_candidates(t.claims, t.promotion_queue, t.critic, None, filters.one_of("scope", SCOPES), None).select("id", r6("score"))


@R.add("r04_vector_search", VEC + " SELECT id, round(score, 6) AS score FROM vec", "claims promotion_queue claim_vectors")
def r04(t: Tables):
    return vecs(t).select("id", r6("score"))


@R.add("r05_fused", TEXT + VEC + FUSED + " SELECT id, round(s_text, 6) AS s_text, round(s_vec, 6) AS s_vec, round(s, 6) AS s FROM fused WHERE s >= 0.15", HYBRID_VIEWS)
def r05(t: Tables):
    return search.fuse(texts(t), vecs(t)).where(F.col("s") >= search.THRESHOLD).select("id", r6("s_text"), r6("s_vec"), r6("s"))


RANKED = (
    FEATURES.rstrip()
    + TEXT
    + VEC
    + FUSED
    + f""", st AS (SELECT coalesce(avg(utility), 0) AS mean, coalesce(nullif(stddev_samp(utility), 0), 1) AS dev FROM claims c WHERE {IN_SCOPE} AND {ACTIVE}),
fac AS (SELECT f.*, (0.6 + 0.4 / (1 + exp(-(utility - mean) / greatest(dev, 0.001)))) * (0.5 + 0.5 * greatest(0, least(1, confidence)))
 * (0.3 + 0.7 * power(greatest(0, least(1, exp(-0.693147 * greatest(0, epoch({{NOW}} - created_at) / 86400.0) / CASE kind WHEN 'fact' THEN 120 WHEN 'task' THEN 14 WHEN 'preference' THEN 90 WHEN 'policy_hint' THEN 365 ELSE 30 END))), {{W}})) AS g,
 {{INTENT}} AS ib, (CASE WHEN evidence_count > 0 THEN 1.1 ELSE 1 END) * (CASE WHEN lineage THEN 1.05 ELSE 1 END) AS pq,
 {{FB}} AS fb FROM feat f, st)
SELECT u.id, round(u.s * coalesce(g, 1) * coalesce(ib, 1) * coalesce(pq, 1) * coalesce(fb, 1), 6) AS score FROM fused u LEFT JOIN fac ON fac.id = u.id
WHERE u.s * coalesce(g, 1) * coalesce(ib, 1) * coalesce(pq, 1) * coalesce(fb, 1) >= 0.15"""
)
INTENTS = {
    "resume_task": (1.6, "(CASE WHEN kind = 'task' THEN 1.3 ELSE 1 END) * (CASE memory_type WHEN 'working_state' THEN 1.35 WHEN 'knowledge' THEN 1.05 ELSE 1 END)"),
    "debug_incident": (1.8, "(CASE memory_type WHEN 'evidence' THEN 1.4 WHEN 'knowledge' THEN 1.1 WHEN 'procedure' THEN 1.05 ELSE 1 END)"),
    "design_decision": (0.65, "(CASE memory_type WHEN 'knowledge' THEN 1.2 WHEN 'norm' THEN 1.2 WHEN 'procedure' THEN 1.1 ELSE 1 END)"),
    "policy_check": (0.25, "(CASE WHEN kind = 'policy_hint' THEN 1.2 ELSE 1 END) * (CASE memory_type WHEN 'norm' THEN 1.4 WHEN 'knowledge' THEN 1.05 ELSE 1 END) * (CASE WHEN kind = 'task' OR memory_type = 'working_state' THEN 0.1 ELSE 1 END)"),
}
FB = "greatest(0.45, least(1.65, exp(0.25 * ln(1 + helpful) - 0.35 * ln(1 + harmful) - 0.18 * ln(1 + outdated) - 0.12 * ln(1 + duplicate))))"


def ranked(t: Tables, intent: str | None = None, feedback: bool = False):
    fused = search.fuse(texts(t), vecs(t))
    stats = search.utility_stats(t.claims, t.promotion_queue, filters.one_of("scope", SCOPES))
    return search.rerank(fused, features(t, fused.select("id")), stats, now(), intent, feedback)


def _add_ranked(name: str, intent: str | None, feedback: bool) -> None:
    weight, boost = INTENTS.get(intent or "", (1.0, "1"))
    sql = RANKED.replace("{W}", str(weight)).replace("{INTENT}", boost).replace("{FB}", FB if feedback else "1")
    R.add(name, sql, "claims promotion_queue evidence feedback critic claim_vectors")(lambda t: ranked(t, intent, feedback).select("id", r6("score")))


_add_ranked("r07_reranked", None, False)
_add_ranked("r07_reranked_feedback", None, True)
for _intent in INTENTS:
    _add_ranked(f"r07_reranked_{_intent}", _intent, True)


@R.add("r08_usage_only", TEXT + """ SELECT id, row_number() OVER (ORDER BY score DESC, created_at DESC, id) AS rank,
 round(score * greatest(1, least(2, 1 + 0.1 * log2(CASE WHEN retrieval_count >= 10 THEN retrieval_count ELSE 0 END + 1))), 6) AS score
 FROM (SELECT t.id, t.score, t.created_at, c.retrieval_count FROM txt t JOIN claims c USING (id)) WHERE score >= 0.15""", "claims promotion_queue critic")
def r08(t: Tables):
    return search.usage_only(texts(t), now()).select("id", "rank", r6("score"))


MMR = """, mr AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS p FROM rk),
hd AS MATERIALIZED (SELECT p, mr.id, score, list_distinct(list_filter(regexp_split_to_array(lower(c.text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 2)) AS tok, v.embedding AS e FROM mr JOIN claims c ON c.id = mr.id LEFT JOIN claim_vectors v ON v.claim_id = mr.id WHERE p <= 48),
sm AS MATERIALIZED (SELECT a.p AS a, b.p AS b, greatest(CASE WHEN len(a.tok) = 0 OR len(b.tok) = 0 THEN 0 ELSE len(list_intersect(a.tok, b.tok)) / CAST(len(a.tok) + len(b.tok) - len(list_intersect(a.tok, b.tok)) AS DOUBLE) END,
 CASE WHEN ({COS}) IS NULL THEN 0 ELSE greatest(0, least(1, ({COS} + 1) / 2)) END) AS s FROM hd a JOIN hd b ON a.p <> b.p),
rl AS MATERIALIZED (SELECT p, score, (score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 1e-6) AS r FROM hd),
pk(n, picked) AS (SELECT 0, CAST([] AS BIGINT[]) UNION ALL SELECT n + 1, list_append(picked, (SELECT rl.p FROM rl WHERE NOT list_contains(picked, rl.p)
 ORDER BY round(0.72 * r - 0.28 * coalesce((SELECT max(s) FROM sm WHERE sm.a = rl.p AND list_contains(picked, sm.b)), 0), 12) DESC, score DESC, rl.p LIMIT 1)) FROM pk WHERE n < (SELECT count(*) FROM hd)),
od AS (SELECT unnest(picked) AS p, generate_subscripts(picked, 1) AS position FROM (SELECT picked FROM pk ORDER BY n DESC LIMIT 1))
SELECT mr.id, CAST(coalesce(od.position, mr.p) AS BIGINT) AS position FROM mr LEFT JOIN od ON od.p = mr.p"""


def diversified_sql() -> str:
    """The reranked rows as rk, then a greedy choice in a recursive query."""
    sql = RANKED.replace("{W}", "1.0").replace("{INTENT}", "1").replace("{FB}", "1")
    head, tail = sql.rsplit("SELECT u.id, round(", 1)
    score, rest = tail.split(", 6) AS score FROM", 1)
    return f"{head.rstrip()}, rk AS (SELECT u.id, {score} AS score FROM{rest})" + MMR.replace("{COS}", cos_sql("a.e", "b.e"))


@R.add("x12_provenance", FEATURES + """, q AS (SELECT *, CAST(substr(id, 5) AS BIGINT) AS k FROM feat)
SELECT id, round(CAST(1 AS DOUBLE) * (CASE WHEN evidence_count > 0 THEN 1.1 ELSE 1 END) * (CASE WHEN k % 3 = 0 AND k % 5 <> 0 THEN 1.05 ELSE 1 END) * (CASE WHEN lineage THEN 1.05 ELSE 1 END), 6) AS quality FROM q""", "claims promotion_queue evidence feedback")
def x12(t: Tables):
    """Provenance documents with an actor in every third row and an empty note in every fifth."""
    k = F.substring("id", 5, 20).cast("long")
    document = F.concat(F.lit("{"), F.when(k % 3 == 0, '"actor":"a",').otherwise(""), F.lit('"note":"'), F.when(k % 5 == 0, "").otherwise("n"), F.lit('"}'))
    rows = features(t).withColumn("provenance", document)
    return rows.select("id", r6(S.provenance_quality(F.col("evidence_count"), search.provenance_given(rows), F.col("lineage")), "quality"))


@R.add("r18_page_similarity", TEXT + """, hd AS (SELECT txt.id, list_distinct(list_filter(regexp_split_to_array(lower(c.text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 2)) AS tok, v.embedding AS e FROM txt JOIN claims c ON c.id = txt.id LEFT JOIN claim_vectors v ON v.claim_id = txt.id)
SELECT a.id AS a, b.id AS b, round(greatest(CASE WHEN len(a.tok) = 0 OR len(b.tok) = 0 THEN 0 ELSE len(list_intersect(a.tok, b.tok)) / CAST(len(a.tok) + len(b.tok) - len(list_intersect(a.tok, b.tok)) AS DOUBLE) END, CASE WHEN ({COS}) IS NULL THEN 0 ELSE greatest(0, least(1, ({COS} + 1) / 2)) END), 6) AS alike FROM hd a JOIN hd b ON a.id < b.id""".replace("{COS}", cos_sql("a.e", "b.e")), "claims promotion_queue critic claim_vectors")
def r18(t: Tables):
    """Likeness inside one page of text results: the larger of the vectors' and the words'."""
    rows = texts(t).select("id", X.token_set(F.col("text")).alias("tok")).join(t.claim_vectors.select(F.col("claim_id").alias("id"), F.col("embedding").alias("e")), "id", "left")
    a, b = (rows.select(*[F.col(c).alias(f"{side}_{c}") for c in rows.columns]) for side in "ab")
    vectors = F.coalesce(F.when(F.col("a_e").isNotNull() & F.col("b_e").isNotNull(), V.diversity_cosine(F.col("a_e"), F.col("b_e"))), F.lit(0.0))
    alike = F.greatest(X.jaccard(F.col("a_tok"), F.col("b_tok")), vectors)
    return a.join(b, F.col("a_id") < F.col("b_id")).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), r6(alike, "alike"))


@R.add("r09_diversified", diversified_sql(), "claims promotion_queue evidence feedback critic claim_vectors")
def r09(t: Tables):
    best = ranked(t).join(t.claims.select("id", "text"), "id").join(t.claim_vectors.withColumnRenamed("claim_id", "id"), "id", "left")
    return search.diversify(best, 12)


@R.add("r10_query_expansion", """, w AS (SELECT id, name, created_at, (CASE WHEN lower(name) = 'red widget' THEN 8 ELSE 0 END) + (CASE WHEN contains(lower(name), 'red widget') THEN 4 ELSE 0 END)
 + (CASE WHEN contains(lower(name), 'red') THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(name), 'widget') THEN 2 ELSE 0 END) + (CASE WHEN lower(canonical_key) = 'red widget' THEN 10 ELSE 0 END) + (CASE WHEN contains(lower(canonical_key), 'red widget') THEN 5 ELSE 0 END)
 + (CASE WHEN contains(lower(canonical_key), 'red') THEN 3 ELSE 0 END) + (CASE WHEN contains(lower(canonical_key), 'widget') THEN 3 ELSE 0 END) AS weight FROM ek),
seed AS (SELECT * FROM w WHERE weight > 0 ORDER BY weight DESC, created_at DESC, id LIMIT 3),
rel AS (SELECT DISTINCT v FROM (SELECT src_id AS u, dst_id AS v FROM relations UNION ALL SELECT dst_id, src_id FROM relations) WHERE u IN (SELECT id FROM seed) AND v NOT IN (SELECT id FROM seed)),
co AS (SELECT DISTINCT entity_id AS v FROM claim_entities WHERE claim_id IN (SELECT claim_id FROM claim_entities WHERE entity_id IN (SELECT id FROM seed)) AND entity_id NOT IN (SELECT id FROM seed)),
o AS (SELECT name, 'seed' AS source, CAST(weight AS DOUBLE) AS weight FROM seed
 UNION ALL SELECT * FROM (SELECT e.name, 'relation', CAST(0 AS DOUBLE) FROM rel JOIN ek e ON e.id = v ORDER BY v LIMIT 8)
 UNION ALL SELECT * FROM (SELECT e.name, 'claim', CAST(0 AS DOUBLE) FROM co JOIN ek e ON e.id = v ORDER BY v LIMIT 8))
SELECT nullif(trim(regexp_replace(name, '[-_]+', ' ', 'g')), '') AS term, source, weight FROM o WHERE nullif(trim(regexp_replace(name, '[-_]+', ' ', 'g')), '') IS NOT NULL""".replace(", w AS", ", ek AS (SELECT id, name, created_at, coalesce(CASE WHEN type = 'Artifact' AND canonical_key IS NOT NULL THEN 'key of red things' ELSE canonical_key END, '') AS canonical_key FROM entity_rows), w AS", 1), "entity_rows relations claim_entities")
def r10(t: Tables):
    """Artifacts that have a key get one with a word of the query in it."""
    key = F.when((F.col("type") == "Artifact") & F.col("canonical_key").isNotNull(), "key of red things").otherwise(F.col("canonical_key"))
    return search.expand_query("red widget", t.entity_rows.withColumn("canonical_key", key), t.relations, t.claim_entities)


OBS = f""", obs AS (SELECT id, created_at, (CASE WHEN content ILIKE '%{WORDS[0]}%' THEN 1.0 ELSE 0 END + CASE WHEN content ILIKE '%{WORDS[1]}%' THEN 1.0 ELSE 0 END) / 2
 * least(exp(-0.693147 * greatest(0, epoch({{NOW}} - created_at) / 86400.0)), 0.8) AS score FROM observations
 WHERE content IS NOT NULL AND (expires_at IS NULL OR expires_at > {{NOW}}) AND ({' OR '.join(f"content ILIKE '%{w}%'" for w in WORDS)}))"""


def observed(t: Tables):
    return search.observation_scores(t.observations, WORDS, now(), filters.live(now()))


@R.add("r11_observation_search", OBS + " SELECT id, round(score, 6) AS score FROM obs", "observations")
def r11(t: Tables):
    return observed(t).select("id", r6("score"))


@R.add("r12_scaled_observations", TEXT + OBS + """, m AS (SELECT (SELECT max(score) FROM txt) AS d, (SELECT max(score) FROM obs) AS o)
SELECT id, round(score * CASE WHEN d > 0 AND o > d * 0.98 THEN d * 0.98 / o ELSE 1 END, 6) AS score FROM obs, m""", "claims promotion_queue critic observations")
def r12(t: Tables):
    return search.scaled_observations(texts(t), observed(t)).select("id", r6("score"))


@R.add("l05_page_two", TEXT + " SELECT id, CAST(row_number() OVER (ORDER BY score DESC, created_at DESC, id) AS BIGINT) AS rn FROM txt QUALIFY rn > 10 AND rn <= 20", "claims promotion_queue critic")
def l05(t: Tables):
    from lodestone.operators.paging import page

    ordered = texts(t)
    first = page(ordered, None, 10)
    cursor = first.orderBy(F.desc("rn")).limit(1).select(F.col("id").alias("cursor"))
    return page(ordered, cursor, 10).select("id", "rn")


def flagship(t: Tables):
    """The twelve best claims for two words and a vector, with their factors."""
    return ranked(t, "resume_task", True).orderBy(F.desc("score"), "id").limit(12)
