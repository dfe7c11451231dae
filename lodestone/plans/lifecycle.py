"""Registered queries: record lifecycle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.operators import lifecycle as L
from lodestone.plans.common import Registry, now, r6
from lodestone.sources.fixtures import NOW, Tables

R = Registry()


def case(values: dict[str, float]) -> str:
    return "CASE signal " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE 0 END"


def fold_sql(values: dict[str, float], start: str, low: float, high: float) -> str:
    return f"list_reduce(list_prepend({start}, d), lambda x, y: least({high}, greatest({low}, x + y)))"


@R.add("p06_feedback_fold", f""", f AS (SELECT claim_id, sum({case(L.UTILITY)}) AS du, list(CAST({case(L.CONFIDENCE)} AS DOUBLE) ORDER BY ts, seq) AS d, bool_or(signal = 'completed') AS done FROM feedback GROUP BY 1)
SELECT id, round(utility + coalesce(du, 0), 6) AS utility, round(CASE WHEN d IS NULL THEN confidence ELSE {fold_sql(L.CONFIDENCE, 'confidence', 0.0, 1.0)} END, 6) AS confidence,
 CASE WHEN done THEN 'completed' ELSE status END AS status FROM claims LEFT JOIN f ON claim_id = id""", "claims feedback")
def p06(t: Tables):
    return L.apply_feedback(t.claims, t.feedback).select("id", r6("utility"), r6("confidence"), "status")


@R.add("p07_critic_fold", f""", f AS (SELECT claim_id, list(CAST({case(L.CRITIC)} AS DOUBLE) ORDER BY ts, seq) AS d FROM feedback GROUP BY 1)
SELECT coalesce(k.claim_id, f.claim_id) AS claim_id, round(CASE WHEN d IS NULL THEN coalesce(score, 0) ELSE {fold_sql(L.CRITIC, 'coalesce(score, 0.0)', 0.0, 5.0)} END, 6) AS score FROM critic k FULL JOIN f ON f.claim_id = k.claim_id""", "critic feedback")
def p07(t: Tables):
    return L.apply_critic(t.critic, t.feedback).select("claim_id", r6("score"))


@R.add("p08_retrieval_counts", """, n AS (SELECT claim_id, count(DISTINCT active_context_id) AS more FROM active_context_items GROUP BY 1)
SELECT id, CAST(retrieval_count + coalesce(more, 0) AS INTEGER) AS retrieval_count FROM claims LEFT JOIN n ON claim_id = id""", "claims active_context_items")
def p08(t: Tables):
    return L.count_retrievals(t.claims, t.active_context_items).select("id", "retrieval_count")


@R.add("p02_scrubbed_observations", "SELECT id, coalesce(expires_at <= {NOW}, false) AS scrubbed, CASE WHEN NOT coalesce(expires_at <= {NOW}, false) THEN content END AS content FROM observations", "observations")
def p02(t: Tables):
    return L.scrub_expired(t.observations, now()).select("id", "scrubbed", "content")


HASHED = ", h AS (SELECT *, sha256(text) AS hash FROM claims), old AS (SELECT * FROM h WHERE utility < 0.5 QUALIFY row_number() OVER (PARTITION BY hash ORDER BY id) = 1)"


def hashed(t: Tables):
    h = t.claims.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))
    first = h.where("utility < 0.5").groupBy("hash").agg(F.min("id").alias("id"))
    return h, h.where("utility < 0.5").join(first, ["hash", "id"], "left_semi")


#: Claims twice over, the second time in reverse; every fifth row of either has another text under the same hash.
BATCH = HASHED + """, b AS (SELECT id, hash, CASE WHEN CAST(substr(id, 5) AS BIGINT) % 5 = 2 THEN text || '!' ELSE text END AS text, CAST(substr(id, 5) AS BIGINT) AS seq FROM h
 UNION ALL SELECT 'again_' || id, hash, CASE WHEN CAST(substr(id, 5) AS BIGINT) % 5 = 3 THEN text || '?' ELSE text END, 100000000 - CAST(substr(id, 5) AS BIGINT) FROM h),
st AS (SELECT b.*, o.id AS oid, o.id IS NOT NULL AS known, coalesce(o.text, first_value(b.text) OVER w) AS held, coalesce(o.id, first_value(b.id) OVER w) AS kept,
 o.id IS NOT NULL AND NOT coalesce(o.tombstone, false) AND NOT EXISTS (SELECT 1 FROM promotion_queue p WHERE p.accepted_claim_id = o.id AND p.status = 'rolled_back') AS alive
 FROM b LEFT JOIN old o ON o.hash = b.hash WINDOW w AS (PARTITION BY b.hash ORDER BY b.seq))
"""


@R.add("w03_upsert_claims", BATCH + """SELECT hash, kept AS id, CASE WHEN text <> held THEN 'collision' WHEN alive OR count(*) FILTER (text = held) OVER (PARTITION BY hash ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'existing'
 WHEN known THEN 'revived' ELSE 'new' END AS action FROM st""", "claims promotion_queue")
def w03(t: Tables):
    """Hashes come again inside the batch, with equal and with other texts."""
    h, old = hashed(t)
    n = F.substring("id", 5, 20).cast("long")
    once = h.select("id", "hash", F.when(n % 5 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), n.alias("seq"))
    again = h.select(F.concat(F.lit("again_"), "id").alias("id"), "hash", F.when(n % 5 == 3, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"), (F.lit(100_000_000) - n).alias("seq"))
    return L.upsert_claims(once.unionByName(again), old, t.promotion_queue, ["seq"])


@R.add("w04_vector_upsert", """, f AS (SELECT claim_id, score FROM feedback QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY ts DESC, id DESC) = 1)
SELECT coalesce(v.claim_id, f.claim_id) AS claim_id, CASE WHEN f.claim_id IS NOT NULL THEN f.score ELSE CAST(len(v.embedding) AS DOUBLE) END AS value FROM claim_vectors v FULL JOIN f ON f.claim_id = v.claim_id""", "claim_vectors feedback")
def w04(t: Tables):
    """Each claim comes in many times; the last value in time stays."""
    old = t.claim_vectors.select("claim_id", F.size("embedding").cast("double").alias("value"))
    return L.overwrite(old, t.feedback.select("claim_id", F.col("score").alias("value"), "ts", "id"), "claim_id", ["value"], ["ts", "id"])


LINKS = """, n AS (SELECT *, CAST(substr(id, 5) AS BIGINT) AS k, CASE WHEN CAST(substr(id, 5) AS BIGINT) % 4 = 0 THEN 'old evidence' END AS evidence_claim_id FROM claim_links),
i AS (SELECT 'a_' || id AS id, source_claim_id, target_claim_id, link_type, confidence * 2 AS confidence, 1 AS seq, CASE WHEN k % 3 = 0 THEN 'first' END AS evidence_claim_id, 'client' AS created_by FROM n WHERE k % 2 = 0
 UNION ALL SELECT 'b_' || id, source_claim_id, target_claim_id, link_type, CASE WHEN k % 7 = 0 THEN NULL ELSE confidence / 2 END, 2, CASE WHEN k % 5 = 0 THEN 'second' END, 'daemon' FROM n WHERE k % 3 <> 1),
f AS (SELECT *, row_number() OVER (PARTITION BY source_claim_id, target_claim_id, link_type ORDER BY seq) AS rn, row_number() OVER (PARTITION BY source_claim_id, target_claim_id, link_type ORDER BY seq DESC) AS back,
 last_value(evidence_claim_id IGNORE NULLS) OVER (PARTITION BY source_claim_id, target_claim_id, link_type ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e FROM i),
e AS (SELECT * FROM n WHERE k % 5 <> 4),
l AS (SELECT a.source_claim_id, a.target_claim_id, a.link_type, a.id AS first_id, z.confidence, z.created_by, a.e FROM f a JOIN f z ON a.rn = 1 AND z.back = 1 AND (a.source_claim_id, a.target_claim_id, a.link_type) = (z.source_claim_id, z.target_claim_id, z.link_type))
"""


@R.add("w05_link_upsert", LINKS + """SELECT coalesce(e.id, l.first_id) AS id, coalesce(e.source_claim_id, l.source_claim_id) AS source_claim_id, coalesce(e.target_claim_id, l.target_claim_id) AS target_claim_id, coalesce(e.link_type, l.link_type) AS link_type,
 round(CASE WHEN l.first_id IS NULL THEN e.confidence ELSE greatest(0.0, least(1.0, coalesce(l.confidence, 1.0))) END, 6) AS confidence, CASE WHEN l.first_id IS NULL THEN 'import' ELSE l.created_by END AS created_by, coalesce(l.e, e.evidence_claim_id) AS evidence_claim_id
 FROM e FULL JOIN l ON (e.source_claim_id, e.target_claim_id, e.link_type) = (l.source_claim_id, l.target_claim_id, l.link_type)""", "claim_links")
def w05(t: Tables):
    """Links come in twice with other confidences, evidence and authors; some have no old row, some no confidence."""
    k = F.substring("id", 5, 20).cast("long")
    n = t.claim_links.withColumn("k", k).withColumn("evidence_claim_id", F.when(k % 4 == 0, "old evidence"))
    key = ["source_claim_id", "target_claim_id", "link_type"]
    first = n.where("k % 2 = 0").select(F.concat(F.lit("a_"), "id").alias("id"), *key, (F.col("confidence") * 2).alias("confidence"), F.lit(1).alias("seq"), F.when(F.col("k") % 3 == 0, "first").alias("evidence_claim_id"), F.lit("client").alias("created_by"))
    second = n.where("k % 3 <> 1").select(F.concat(F.lit("b_"), "id").alias("id"), *key, F.when(F.col("k") % 7 != 0, F.col("confidence") / 2).alias("confidence"), F.lit(2).alias("seq"), F.when(F.col("k") % 5 == 0, "second").alias("evidence_claim_id"), F.lit("daemon").alias("created_by"))
    old = n.where("k % 5 <> 4").select("id", *key, "confidence", F.lit("import").alias("created_by"), "evidence_claim_id")
    return L.upsert_links(old, first.unionByName(second), ["seq"]).withColumn("confidence", F.round("confidence", 6))


@R.add("w07_bulk_update", "SELECT id, CASE WHEN id IN (SELECT accepted_claim_id FROM promotion_queue) THEN 'secret' ELSE boundary_class END AS boundary_class FROM claims", "claims promotion_queue")
def w07(t: Tables):
    hit = t.promotion_queue.select(F.col("accepted_claim_id").alias("id")).distinct().withColumn("boundary_class", F.lit("secret"))
    return L.overwrite(t.claims.select("id", "boundary_class"), hit, "id", ["boundary_class"])


@R.add("w08_first_wins", "SELECT id, row_number() OVER (PARTITION BY claim_id ORDER BY id) = 1 AS accepted FROM evidence", "evidence")
def w08(t: Tables):
    return L.first_claim_wins(t.evidence, "claim_id", ["id"]).select("id", "accepted")


@R.add("p05_rollback_append", """SELECT id, accepted_claim_id, status FROM promotion_queue UNION ALL SELECT concat('rb_', id), id, 'rolled_back' FROM claims c WHERE tombstone""", "claims promotion_queue")
def p05(t: Tables):
    gone = t.claims.where("tombstone").select(F.concat(F.lit("rb_"), "id").alias("id"), F.col("id").alias("accepted_claim_id"), F.lit("rolled_back").alias("status"))
    return t.promotion_queue.unionByName(gone)


RATE_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, event_id, rn, tm AS began, 1 AS used, true AS allowed FROM e WHERE rn = 1
 UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.tm - r.began >= 86400 THEN e.tm ELSE r.began END, CASE WHEN e.tm - r.began >= 86400 THEN 1 WHEN r.used < 2 THEN r.used + 1 ELSE r.used END, e.tm - r.began >= 86400 OR r.used < 2
 FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id AS bucket, event_id AS seq, allowed FROM r"""


@R.add("p11_rate_limit", RATE_SQL)
def p11(t: Tables):
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")
    return L.limit_rate(t.events.select(F.col("user_id").alias("bucket"), F.col("event_id").alias("seq"), at), 2, 86400.0)


@R.add("p14_promotion_conflicts", """, h AS (SELECT *, sha256(text) AS hash FROM claims), g AS (SELECT hash, count(DISTINCT kind) AS kinds, count(DISTINCT coalesce(memory_type, '-')) AS types, count(*) AS n FROM h GROUP BY 1)
SELECT hash, n, kinds > 1 OR types > 1 AS conflict FROM g WHERE n > 1""", "claims")
def p14(t: Tables):
    h, _ = hashed(t)
    g = h.groupBy("hash").agg(F.count_distinct("kind").alias("kinds"), F.count_distinct(F.coalesce("memory_type", F.lit("-"))).alias("types"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 1").select("hash", "n", ((F.col("kinds") > 1) | (F.col("types") > 1)).alias("conflict"))


PII = r"regexp_matches({c}, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b') OR regexp_matches({c}, '\b\+?\d{{1,3}}[- ]?\d{{2,4}}[- ]?\d{{2,4}}[- ]?\d{{3,4}}\b') OR regexp_matches({c}, '\b(?:\d[ -]*?){{13,19}}\b')"
KEYS = r"regexp_matches({c}, '-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----|\bsk-[A-Za-z0-9]{{20,}}\b|\b(?:gh[pousr]_[A-Za-z0-9]{{20,}}|github_pat_[A-Za-z0-9_]{{20,}})\b|\bxox[baprs]-[A-Za-z0-9-]{{10,}}\b|\beyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\b|\bAKIA[0-9A-Z]{{16}}\b')"
CLEAN = r"regexp_replace(regexp_replace(regexp_replace({c}, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b', '[REDACTED]', 'g'), '\b\+?\d{{1,3}}[- ]?\d{{2,4}}[- ]?\d{{2,4}}[- ]?\d{{3,4}}\b', '[REDACTED]', 'g'), '\b(?:\d[ -]*?){{13,19}}\b', '[REDACTED]', 'g')"
NUM = "CAST(substr(id, 5) AS BIGINT)"
OBSERVE = f""", o AS (SELECT id, text AS c, boundary_class AS asked, {NUM} % 120 AS ttl, {KEYS.format(c='text')} AS k, {PII.format(c='text')} AS p FROM claims),
cl AS (SELECT *, CASE WHEN k OR asked = 'secret' THEN 'secret' WHEN p OR asked = 'pii' THEN 'pii' ELSE asked END AS cls FROM o)
"""


def to_observe(t: Tables):
    return t.claims.select("id", F.col("text").alias("content"), "boundary_class", (F.substring("id", 5, 20).cast("long") % 120).alias("ttl_days"))


@R.add("p01_observe", OBSERVE + f"""SELECT id, cls AS boundary_class, CASE WHEN cls = 'secret' THEN NULL WHEN p THEN sha256({CLEAN.format(c='c')}) ELSE sha256(c) END AS content,
 'sha256:' || CASE WHEN cls = 'secret' THEN sha256('secret') ELSE sha256(c) END AS digest, length(c) AS length, strftime({{NOW}} + INTERVAL '1' DAY * CAST(least(ttl, 90) AS INT), '%Y-%m-%d') AS expires FROM cl""", "claims")
def p01(t: Tables):
    o = L.observe(to_observe(t), now())
    return o.select("id", "boundary_class", F.sha2(F.col("content").cast("binary"), 256).alias("content"), "digest", "length", F.date_format("expires_at", "yyyy-MM-dd").alias("expires"))


@R.add("p01_observe_modes", OBSERVE + "SELECT cls AS boundary_class, count(*) AS n, count(*) FILTER (cls <> 'secret') AS raw, 0 AS digest_only FROM cl GROUP BY 1", "claims")
def p01m(t: Tables):
    raw, none = L.observe(to_observe(t), mode="raw"), L.observe(to_observe(t), mode="digest_only").select("id", F.col("content").alias("nothing"))
    return raw.join(none, "id").groupBy("boundary_class").agg(F.count(F.lit(1)).alias("n"), F.count("content").alias("raw"), F.count("nothing").cast("int").alias("digest_only"))


DISTILL = r""", s AS (SELECT active_context_id AS candidate, rank AS position, c.* FROM active_context_items JOIN claims c ON c.id = claim_id),
ds AS (SELECT candidate, count(*) AS n, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position, text, id) AS text, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'fact' END AS kind,
 CASE WHEN min(memory_type) = max(memory_type) AND min(memory_type) <> 'evidence' THEN min(memory_type) END AS common,
 ['public', 'internal', 'pii', 'secret'][max(list_position(['public', 'internal', 'pii', 'secret'], boundary_class))] AS boundary_class FROM s GROUP BY 1),
dt AS (SELECT *, coalesce(common, CASE kind WHEN 'fact' THEN 'knowledge' WHEN 'task' THEN 'working_state' WHEN 'policy_hint' THEN 'norm' END) AS memory_type FROM ds WHERE n <= 64 AND octet_length(encode(text)) <= 16384)
"""


def distilled(t: Tables, shown: Callable[[Column], Column] | None = None):
    items = t.active_context_items.select(F.col("active_context_id").alias("candidate"), F.col("rank").alias("position"), F.col("claim_id").alias("id"))
    return L.distill_items(items, t.claims, t.evidence, most_bytes=16_384, shown=shown)


@R.add("p03_distilled", DISTILL + """, ev AS (SELECT candidate, string_agg(DISTINCT e.id, ',' ORDER BY e.id) AS ids FROM s JOIN evidence e ON e.claim_id = s.id GROUP BY 1)
SELECT dt.candidate, n, sha256(text) AS text_sha256, kind, memory_type, boundary_class, CASE WHEN kind = 'policy_hint' OR coalesce(memory_type = 'norm', false) THEN 'principle' ELSE 'project' END AS scope, coalesce(ids, '') AS evidence_ids FROM dt LEFT JOIN ev ON ev.candidate = dt.candidate""", "claims active_context_items evidence")
def p03(t: Tables):
    """With a limit of 16 384 bytes, which some contexts pass."""
    rows = distilled(t, lambda text: F.sha2(text.cast("binary"), 256))
    return rows.select("candidate", "n", F.col("text").alias("text_sha256"), "kind", "memory_type", "boundary_class", "scope", "evidence_ids")


PROMOTE = """, h AS (SELECT *, sha256(text) AS hash, CAST(substr(id, 5) AS BIGINT) AS num FROM claims), loc AS (SELECT * FROM h WHERE num % 3 = 0 QUALIFY row_number() OVER (PARTITION BY hash ORDER BY id) = 1),
cand AS (SELECT concat('pq_', num) AS id, CASE WHEN num % 11 = 0 THEN 'accepted' ELSE 'pending' END AS status, hash, CASE WHEN num % 13 = 0 THEN text || '!' ELSE text END AS text, kind, memory_type, boundary_class FROM h),
lead AS (SELECT * FROM cand WHERE status = 'pending' AND boundary_class <> 'secret' QUALIFY row_number() OVER (PARTITION BY hash ORDER BY id) = 1),
v AS (SELECT c.id, CASE WHEN c.status <> 'pending' THEN 'not_pending' WHEN c.boundary_class = 'secret' THEN 'secret' WHEN o.id IS NOT NULL AND (c.text <> o.text OR c.kind <> o.kind OR c.memory_type IS DISTINCT FROM o.memory_type) THEN 'conflict'
 WHEN o.id IS NOT NULL THEN CASE WHEN NOT coalesce(o.tombstone, false) AND NOT EXISTS (SELECT 1 FROM promotion_queue p WHERE p.accepted_claim_id = o.id AND p.status = 'rolled_back') THEN 'existing' ELSE 'revived' END
 WHEN c.id = l.id THEN 'new' WHEN c.text <> l.text OR c.kind <> l.kind OR c.memory_type IS DISTINCT FROM l.memory_type THEN 'conflict' ELSE 'existing' END AS verdict, o.id AS old, l.id AS lead FROM cand c LEFT JOIN loc o ON o.hash = c.hash LEFT JOIN lead l ON l.hash = c.hash)
"""


def promotion(t: Tables):
    """Every claim's text as a candidate; a third of the claims is there already, some candidates say something else under the same hash."""
    num = F.substring("id", 5, 20).cast("long")
    h = t.claims.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256)).withColumn("num", num)
    some = h.where("num % 3 = 0")
    local = some.join(some.groupBy("hash").agg(F.min("id").alias("id")), ["hash", "id"], "left_semi")
    text = F.when(F.col("num") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    candidates = h.select(F.concat(F.lit("pq_"), "num").alias("id"), F.when(F.col("num") % 11 == 0, "accepted").otherwise("pending").alias("status"), "hash", text.alias("text"), "kind", "memory_type", "boundary_class")
    sources = h.select(F.concat(F.lit("pq_"), "num").alias("candidate"), F.explode(F.array(F.struct(F.lit("claim").alias("t"), F.col("id").alias("i")), F.struct(F.lit("active_context").alias("t"), F.concat(F.lit("ac_"), "num").alias("i")))).alias("s"))
    return L.promote(candidates, local, t.promotion_queue, sources.select("candidate", F.col("s.t").alias("source_type"), F.col("s.i").alias("source_id")))


@R.add("p04_promoted", PROMOTE + "SELECT id, verdict, CASE WHEN verdict IN ('existing', 'revived', 'new') THEN coalesce(old, 'clm_of_' || lead) END AS accepted_claim_id FROM v", "claims promotion_queue")
def p04v(t: Tables):
    return promotion(t).verdicts


@R.add("p04_evidence", PROMOTE + "SELECT 'clm_of_' || lead AS claim_id, t AS source_type, CASE t WHEN 'claim' THEN 'clm_' || substr(id, 4) ELSE 'ac_' || substr(id, 4) END AS source_id FROM v, (SELECT unnest(['claim', 'active_context']) AS t) WHERE verdict = 'new'", "claims promotion_queue")
def p04e(t: Tables):
    return promotion(t).evidence.select("claim_id", "source_type", "source_id")


LINKS = """, rq AS (SELECT id, source_claim_id, CASE WHEN num % 7 = 0 THEN source_claim_id WHEN num % 7 = 1 THEN 'clm_none' ELSE target_claim_id END AS target_claim_id, CASE WHEN num % 5 = 0 THEN 'likes' ELSE link_type END AS link_type, CASE WHEN num % 11 = 0 THEN confidence + 1 ELSE confidence / 2 END AS confidence FROM (SELECT *, CAST(substr(id, 5) AS BIGINT) AS num FROM claim_links)),
ck AS (SELECT *, CASE WHEN link_type = 'likes' THEN 'link_type' WHEN source_claim_id = target_claim_id THEN 'same_claim' WHEN confidence > 1 THEN 'confidence' WHEN target_claim_id = 'clm_none' THEN 'missing_claim' END AS reason FROM rq)
"""


def link_requests(t: Tables):
    num = F.substring("id", 5, 20).cast("long")
    rows = t.claim_links.withColumn("num", num)
    target = F.when(F.col("num") % 7 == 0, F.col("source_claim_id")).when(F.col("num") % 7 == 1, "clm_none").otherwise(F.col("target_claim_id"))
    confidence = F.when(F.col("num") % 11 == 0, F.col("confidence") + 1).otherwise(F.col("confidence") / 2)
    requests = rows.select("id", "source_claim_id", target.alias("target_claim_id"), F.when(F.col("num") % 5 == 0, "likes").otherwise(F.col("link_type")).alias("link_type"), confidence.alias("confidence"))
    return L.confirm_links(requests, t.claims, t.claim_links)


@R.add("p16_link_requests", LINKS + "SELECT id, reason FROM ck", "claims claim_links")
def p16(t: Tables):
    return link_requests(t)[0]


@R.add("p16_confirmed_links", LINKS + "SELECT l.id, round(coalesce(c.confidence, l.confidence), 6) AS confidence FROM claim_links l LEFT JOIN ck c ON c.id = l.id AND c.reason IS NULL", "claims claim_links")
def p16l(t: Tables):
    return link_requests(t)[1].select("id", r6("confidence"))


@R.add("p12_attached_graph", """, n AS (SELECT id FROM claims WHERE utility < 0.5), e AS (SELECT claim_id, entity_id, CASE WHEN entity_id LIKE '%5' THEN NULL ELSE 'x' END AS type FROM claim_entities WHERE claim_id IN (SELECT id FROM n))
SELECT n.id AS claim_id, count(*) FILTER (e.type IS NOT NULL) AS entities, count(*) FILTER (e.entity_id IS NOT NULL AND e.type IS NULL) AS entity_errors, (SELECT count(*) FROM claim_links l WHERE l.source_claim_id = n.id) AS relations FROM n LEFT JOIN e ON e.claim_id = n.id GROUP BY n.id""", "claims claim_entities claim_links")
def p12(t: Tables):
    """Claims of low utility are new; entities whose id ends in 5 come without a type."""
    claims = t.claims.select("id", (F.col("utility") < 0.5).alias("is_new"))
    entities = t.claim_entities.select("claim_id", F.col("entity_id").alias("id"), F.when(~F.col("entity_id").endswith("5"), "x").alias("type"))
    relations = t.claim_links.select(F.col("source_claim_id").alias("claim_id"), "id", F.col("link_type").alias("type"))
    counts, _ = L.attach_graph(claims, entities, relations, t.claim_entities.where("false"))
    return counts.select("claim_id", "entities", "entity_errors", "relations")


MIGRATED = """, mt AS (SELECT id, kind, boundary_class, memory_type AS was, coalesce(memory_type, CASE kind WHEN 'fact' THEN 'knowledge' WHEN 'task' THEN 'working_state' WHEN 'policy_hint' THEN 'norm' END) AS memory_type,
CASE WHEN scope = 'session' AND tombstone THEN 'ended' WHEN scope = 'session' AND epoch({NOW} - created_at) / 86400.0 > 30 THEN 'tombstone' WHEN scope = 'session' THEN 'candidate' ELSE 'keep' END AS fate FROM claims)
"""


@R.add("p10_type_migration", MIGRATED + "SELECT id, memory_type, fate FROM mt", "claims")
def p10(t: Tables):
    return L.migrate_types(t.claims, now()).select("id", "memory_type", "fate")


@R.add("p10_migration_report", MIGRATED + """SELECT unnest(['memory_type_backfilled', 'memory_type_already_set', 'ambiguous_preferences', 'session_claims_scanned', 'session_claims_already_tombstoned', 'session_claims_tombstoned', 'session_queue_candidates_created']) AS item,
 unnest([count(*) FILTER (was IS NULL AND memory_type IS NOT NULL), count(*) FILTER (was IS NOT NULL), count(*) FILTER (was IS NULL AND kind = 'preference'), count(*) FILTER (fate <> 'keep'), count(*) FILTER (fate = 'ended'), count(*) FILTER (fate IN ('tombstone', 'candidate')), count(*) FILTER (fate = 'candidate')]) AS n FROM mt""", "claims")
def p10r(t: Tables):
    return L.migration_report(L.migrate_types(t.claims, now()))


@R.add("p10_migration_queue", MIGRATED + "SELECT 'pq_session_' || id AS id, '[\"' || id || '\"]' AS source_ids, kind AS proposed_kind, 'project' AS proposed_scope, boundary_class AS proposed_boundary_class, 'pending' AS status FROM mt WHERE fate = 'candidate'", "claims")
def p10q(t: Tables):
    rows = L.migration_candidates(L.migrate_types(t.claims, now()))
    return rows.select("id", "source_ids", "proposed_kind", "proposed_scope", "proposed_boundary_class", "status")
