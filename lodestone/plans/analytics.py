"""Registered queries: health, maintenance, counts and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import filters, health
from lodestone.plans.common import ACTIVE, Registry, now, r6
from lodestone.plans.retrieval import cos_sql
from lodestone.sources.fixtures import Tables

R = Registry()


@R.add("a01_counts", f"SELECT (SELECT count(*) FROM claims) AS total, (SELECT count(*) FROM claims c WHERE {ACTIVE}) AS active", "claims promotion_queue")
def a01(t: Tables):
    alive = filters.active(t.claims, t.promotion_queue).agg(F.count(F.lit(1)).alias("active"))
    return t.claims.agg(F.count(F.lit(1)).alias("total")).join(alive)


@R.add("a02_by_kind_scope", "SELECT kind, scope, count(*) AS n FROM claims GROUP BY ALL", "claims")
def a02(t: Tables):
    return t.claims.groupBy("kind", "scope").agg(F.count(F.lit(1)).alias("n"))


@R.add("a02_signal_counts", "SELECT " + ", ".join(f"count(*) FILTER (signal = '{s}') AS {s}" for s in health.SIGNALS) + ", count(*) AS total FROM feedback", "feedback")
def a02s(t: Tables):
    return health.signal_counts(t.feedback)


@R.add("a03_confidence_bands", "SELECT count(*) FILTER (confidence >= 0.7) AS high, count(*) FILTER (confidence >= 0.3 AND confidence < 0.7) AS medium, count(*) FILTER (confidence < 0.3) AS low FROM claims", "claims")
def a03(t: Tables):
    return health.bands(t.claims)


@R.add("a04_last_helpful", """, l AS (SELECT claim_id, max(ts) AS last FROM feedback WHERE signal = 'helpful' GROUP BY 1),
a AS (SELECT epoch({NOW} - last) / 86400.0 AS age FROM claims LEFT JOIN l ON claim_id = id)
SELECT count(*) FILTER (age <= 30) AS within_30, count(*) FILTER (age > 30 AND age <= 90) AS within_90, count(*) FILTER (age > 90) AS older, count(*) FILTER (age IS NULL) AS never FROM a""", "claims feedback")
def a04(t: Tables):
    return health.last_helpful_ages(t.claims, t.feedback, now())


@R.add("a05_duplicate_ratio", "SELECT round(coalesce(avg(CASE WHEN signal = 'duplicate' THEN 1.0 ELSE 0 END), 0), 6) AS ratio FROM feedback", "feedback")
def a05(t: Tables):
    return health.duplicate_ratio(t.feedback)


@R.add("a06_never_activated", """, a AS (SELECT id, epoch({NOW} - created_at) / 86400.0 AS age FROM claims)
SELECT CASE WHEN age < 30 THEN '0-30' WHEN age < 90 THEN '30-90' ELSE '90+' END AS bucket, count(*) AS n,
 round(avg(CASE WHEN id NOT IN (SELECT claim_id FROM active_context_items) THEN 1.0 ELSE 0 END), 6) AS ratio FROM a GROUP BY 1""", "claims active_context_items")
def a06(t: Tables):
    return health.never_activated(t.claims, t.active_context_items, now())


@R.add("a07_utility_spread", "SELECT round(avg(utility), 6) AS mean, round(median(utility), 6) AS median, round(quantile_cont(utility, 0.1), 6) AS p10, round(quantile_cont(utility, 0.9), 6) AS p90 FROM claims", "claims")
def a07(t: Tables):
    return health.utility_spread(t.claims)


@R.add("a10_stale_candidates", "SELECT id FROM claims WHERE epoch({NOW} - created_at) / 86400.0 > 30 AND id NOT IN (SELECT claim_id FROM active_context_items) ORDER BY created_at, id LIMIT 10", "claims active_context_items")
def a10(t: Tables):
    return health.stale_candidates(t.claims, t.active_context_items, now()).select("id")


@R.add("a12_coactivation", """SELECT a.claim_id AS a, b.claim_id AS b, count(DISTINCT a.active_context_id) AS contexts, string_agg(DISTINCT a.active_context_id, ',' ORDER BY a.active_context_id) AS context_ids FROM active_context_items a
JOIN active_context_items b ON a.active_context_id = b.active_context_id AND a.claim_id < b.claim_id GROUP BY ALL HAVING count(DISTINCT a.active_context_id) >= 3""", "active_context_items")
def a12(t: Tables):
    from lodestone.operators.graph import coactivation

    return coactivation(t.active_context_items)


@R.add("a15_context_rollup", "SELECT claim_id, count(*) AS items, count(DISTINCT active_context_id) AS contexts, round(max(score), 6) AS best FROM active_context_items GROUP BY claim_id", "active_context_items")
def a15(t: Tables):
    return t.active_context_items.groupBy("claim_id").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("active_context_id").alias("contexts"), F.round(F.max("score"), 6).alias("best"))


@R.add("a16_strictest_class", """SELECT scope, CASE max(CASE boundary_class WHEN 'public' THEN 0 WHEN 'internal' THEN 1 WHEN 'pii' THEN 2 ELSE 3 END) WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'pii' ELSE 'secret' END AS boundary_class
FROM claims GROUP BY scope""", "claims")
def a16(t: Tables):
    from lodestone.operators.exchange import strictest

    return t.claims.groupBy("scope").agg(strictest("boundary_class").alias("boundary_class"))


@R.add("a17_normalised", """, k AS (SELECT id, score FROM claims JOIN critic ON claim_id = id) SELECT id, round((score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 1e-6), 6) AS relevance FROM k""", "claims critic")
def a17(t: Tables):
    k = t.claims.join(t.critic, F.col("id") == F.col("claim_id")).select("id", "score")
    ends = k.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return k.join(F.broadcast(ends)).select("id", r6((F.col("score") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6)), "relevance"))


@R.add("a18_latency_ranks", """, v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(max(value) FILTER (i = floor(n * 0.5)), 6) AS p50, round(max(value) FILTER (i = floor(n * 0.95)), 6) AS p95, round(max(value) FILTER (i = floor(n * 0.99)), 6) AS p99 FROM v GROUP BY 1""".replace(", v", "WITH v", 1))
def a18(t: Tables):
    from lodestone.operators.ordering import nearest_rank

    return nearest_rank(t.events, "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "event_id")


@R.add("a19_vector_table_stats", "SELECT len(embedding) AS dims, count(*) AS n, min(claim_id) AS first, max(claim_id) AS last FROM claim_vectors GROUP BY 1", "claim_vectors")
def a19(t: Tables):
    return t.claim_vectors.groupBy(F.size("embedding").cast("long").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.min("claim_id").alias("first"), F.max("claim_id").alias("last"))


@R.add("wn03_cap_per_kind", "SELECT id, kind FROM claims QUALIFY row_number() OVER (PARTITION BY kind ORDER BY utility DESC, id) <= 20", "claims")
def wn03(t: Tables):
    rn = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("utility"), "id"))
    return t.claims.withColumn("rn", rn).where("rn <= 20").select("id", "kind")


@R.add("wn04_average_ranks", """, r AS (SELECT id, scope, rank() OVER (PARTITION BY scope ORDER BY utility DESC) AS r, count(*) OVER (PARTITION BY scope, utility) AS ties FROM claims) SELECT id, round(r + (ties - 1) / 2.0, 6) AS avg_rank FROM r""", "claims")
def wn04(t: Tables):
    from lodestone.operators.ordering import average_ranks

    return average_ranks(t.claims.select("id", "scope", "utility"), "scope", "utility", "avg_rank").select("id", r6("avg_rank"))


@R.add("p09_stale_working_state", """, f AS (SELECT DISTINCT claim_id FROM feedback WHERE epoch({NOW} - ts) / 86400.0 BETWEEN 0 AND 14)
SELECT id, CASE WHEN coalesce(memory_type = 'working_state' AND status = 'active' AND epoch({NOW} - created_at) / 86400.0 > 14 AND id NOT IN (SELECT claim_id FROM f), false) THEN 'stale' ELSE status END AS status FROM claims""", "claims feedback")
def p09(t: Tables):
    return health.stale_working_state(t.claims, t.feedback, now()).select("id", "status")


X_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2))"


@R.add("x16_token_counts", f"SELECT id, len({X_TOKENS.format(c='text')}) AS n FROM claims", "claims")
def x16(t: Tables):
    return t.claims.select("id", F.size(X.token_set(F.col("text"))).cast("long").alias("n"))


@R.add("x17_jaccard_linked", f""", k AS (SELECT id, {X_TOKENS.format(c='text')} AS t FROM claims)
SELECT l.id, round(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t)) / CAST(len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) AS DOUBLE) END, 6) AS jaccard
FROM claim_links l JOIN k a ON a.id = source_claim_id JOIN k b ON b.id = target_claim_id""", "claims claim_links")
def x17(t: Tables):
    k = t.claims.select("id", X.token_set(F.col("text")).alias("t"))
    a, b = k.select(F.col("id").alias("source_claim_id"), F.col("t").alias("a")), k.select(F.col("id").alias("target_claim_id"), F.col("t").alias("b"))
    return t.claim_links.join(a, "source_claim_id").join(b, "target_claim_id").select("id", r6(X.jaccard(F.col("a"), F.col("b")), "jaccard"))


@R.add("x18_previews", r""", f AS (SELECT id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS f FROM claims) SELECT id, CASE WHEN length(f) <= 120 THEN f ELSE concat(substring(f, 1, 117), '...') END AS preview FROM f""", "claims")
def x18(t: Tables):
    return t.claims.select("id", X.preview(F.col("text")).alias("preview"))


@R.add("x19_layers", "SELECT id, CASE scope WHEN 'principle' THEN 'macro' WHEN 'project' THEN 'meso' ELSE 'micro' END AS layer FROM claims", "claims")
def x19(t: Tables):
    return t.claims.select("id", X.layer(F.col("scope")).alias("layer"))


GENERIC = "(f = '' OR (len(w) <= 2 AND length(f) <= 24) OR len(list_intersect(w, [" + ", ".join(f"'{x}'" for x in X.GENERIC_WORDS) + "])) > 0)"


@R.add("x20_generic_labels", f""", n AS (SELECT id, trim(regexp_replace(lower(name), '[_-]+', ' ', 'g')) AS f FROM entities),
k AS (SELECT id, f, list_filter(regexp_split_to_array(f, '[ \\t\\n]+'), lambda x: x <> '') AS w FROM n) SELECT id, {GENERIC} AS generic FROM k""", "entities")
def x20(t: Tables):
    return t.entities.select("id", X.generic_label(F.col("name")).alias("generic"))


@R.add("x21_redacted", r"""SELECT id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[REDACTED]', 'g'), '\b\+?\d{1,3}[- ]?\d{2,4}[- ]?\d{2,4}[- ]?\d{3,4}\b', '[REDACTED]', 'g'), '\b(?:\d[ -]*?){13,19}\b', '[REDACTED]', 'g') AS text FROM claims""", "claims")
def x21(t: Tables):
    return t.claims.select("id", X.redact(F.col("text")).alias("text"))


@R.add("x25_scrubbed_paths", r"SELECT url, regexp_replace(url, '/\S+', '[PATH]', 'g') AS scrubbed FROM pages")
def x25(t: Tables):
    return t.pages.select("url", X.scrub_paths(F.col("url")).alias("scrubbed"))


@R.add("x26_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def x26(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@R.add("x34_default_types", """SELECT id, CASE kind WHEN 'fact' THEN 'knowledge' WHEN 'task' THEN 'working_state' WHEN 'policy_hint' THEN 'norm' END AS default_type,
CASE WHEN kind = 'policy_hint' OR coalesce(memory_type = 'norm', false) THEN 'principle' ELSE 'project' END AS durable_scope FROM claims""", "claims")
def x34(t: Tables):
    return t.claims.select("id", X.memory_type_of_kind(F.col("kind")).alias("default_type"), X.durable_scope(F.col("kind"), F.col("memory_type")).alias("durable_scope"))


@R.add("x38_iso_instants", "SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS instant FROM claims", "claims")
def x38(t: Tables):
    return t.claims.select("id", X.iso_instant(F.col("created_at")).alias("instant"))


@R.add("x39_audit_digest", "SELECT id, 'sha256:' || sha256(text) AS digest, length(text) AS length FROM claims", "claims")
def x39(t: Tables):
    return t.claims.select("id", X.digest(F.col("text")).alias("digest"), F.length("text").cast("long").alias("length"))


@R.add("x01_content_hash", r"SELECT id, 'sha256:' || sha256(trim(regexp_replace(nfc_normalize(text), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS hash FROM claims", "claims")
def x01(t: Tables):
    return t.claims.select("id", X.content_hash(F.col("text")).alias("hash"))


R15_PAGE = "pg AS (SELECT c.id, v.embedding AS e FROM claims c JOIN claim_vectors v ON v.claim_id = c.id WHERE c.scope <> 'session' AND length(trim(c.text)) > 0 ORDER BY utility DESC, c.id LIMIT 50)"


@R.add("r15_maintenance_hints", f""", {R15_PAGE}, sp AS (SELECT concat(a.id, '+', b.id) AS id FROM pg a JOIN pg b ON a.id < b.id WHERE {cos_sql('a.e', 'b.e')} > 0.2 ORDER BY {cos_sql('a.e', 'b.e')} DESC, a.id, b.id LIMIT 10)
SELECT 'stale' AS hint, id FROM (SELECT id FROM claims WHERE epoch({{NOW}} - created_at) / 86400.0 > 30 AND id NOT IN (SELECT claim_id FROM active_context_items) ORDER BY created_at, id LIMIT 10)
UNION ALL SELECT 'unrewarded', id FROM (SELECT id FROM claims WHERE retrieval_count > 5 AND id NOT IN (SELECT claim_id FROM feedback) ORDER BY retrieval_count DESC, id LIMIT 10)
UNION ALL SELECT 'similar', id FROM sp
UNION ALL SELECT 'unprocessed', CAST(count(*) AS VARCHAR) FROM observations WHERE content IS NOT NULL AND (expires_at IS NULL OR expires_at > {{NOW}})""", "claims active_context_items feedback observations claim_vectors")
def r15(t: Tables):
    """Similar pairs are looked for on the page that was returned, here the 50 most useful durable claims."""
    from lodestone.operators import search

    stale = health.stale_candidates(t.claims, t.active_context_items, now()).select(F.lit("stale").alias("hint"), "id")
    often = health.unrewarded(t.claims, t.feedback).select(F.lit("unrewarded").alias("hint"), "id")
    waiting = t.observations.where(filters.live(now())).agg(F.count(F.lit(1)).cast("string").alias("id")).select(F.lit("unprocessed").alias("hint"), "id")
    page = filters.durable(t.claims).join(t.claim_vectors, F.col("id") == F.col("claim_id")).orderBy(F.desc("utility"), "id").limit(50).select("id", "embedding")
    pairs = search.page_pairs(page, 0.2).orderBy(F.desc("similarity"), "a", "b").limit(10).select(F.lit("similar").alias("hint"), F.concat_ws("+", "a", "b").alias("id"))
    return stale.unionByName(often).unionByName(pairs).unionByName(waiting)
