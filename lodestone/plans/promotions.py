"""Registered queries: what follows a promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import filters
from lodestone.operators.promotion import after_promotion, with_vectors
from lodestone.plans.common import Registry, now, r6
from lodestone.plans.lifecycle import PROMOTE, promotion
from lodestone.plans.records import BAG, E_MAIL, SHORT_PHONE
from lodestone.runtime import materialize
from lodestone.sources.fixtures import Tables

R = Registry()
SAFE = f"CASE WHEN boundary_class IN ('public', 'internal') THEN text ELSE regexp_replace(regexp_replace(text, '{E_MAIL}', '[REDACTED]', 'g'), '{SHORT_PHONE}', '[REDACTED]', 'g') END"
#: Claims after the batch: those that were there and are active, and the new ones; pairs of the asked ones (number divisible by 50) with all.
AFTER = PROMOTE + f""", fr AS (SELECT 'clm_of_' || v.lead AS id, c.text, c.boundary_class, c.hash, CASE WHEN kind = 'policy_hint' OR coalesce(memory_type = 'norm', false) THEN 'principle' ELSE 'project' END AS scope FROM v JOIN cand c ON c.id = v.id WHERE verdict = 'new'),
al AS (SELECT id, {SAFE} AS text, hash, scope, created_at, false AS is_new, num % 50 = 0 AS asked FROM loc c WHERE NOT coalesce(tombstone, false) AND NOT EXISTS (SELECT 1 FROM promotion_queue p WHERE p.accepted_claim_id = c.id AND p.status = 'rolled_back')
 UNION ALL SELECT id, {SAFE}, hash, scope, {{NOW}}, true, CAST(substr(id, 11) AS BIGINT) % 50 = 0 FROM fr)""" + BAG.replace("{FROM}", "al") + """,
ln AS (SELECT id, sqrt(sum(value * value)) AS norm FROM bag GROUP BY 1),
pr AS (SELECT a.id, b.id AS other, round(sum(a.value * b.value) / any_value(x.norm) / any_value(y.norm), 9) AS similarity FROM bag a JOIN al q ON q.id = a.id AND q.asked JOIN bag b ON a.dim = b.dim AND a.id <> b.id
 JOIN ln x ON x.id = a.id JOIN ln y ON y.id = b.id GROUP BY ALL),
lk AS (SELECT 'clm_of_pq_' || substr(source_claim_id, 5) AS s, target_claim_id AS t FROM claim_links)
"""
VIEWS = "claims promotion_queue claim_links"


def after(t: Tables):
    num = F.substring("id", 5, 20).cast("long")
    h = t.claims.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256)).withColumn("num", num).drop("text")
    some = h.where("num % 3 = 0")
    local = some.join(some.groupBy("hash").agg(F.min("id").alias("id")), ["hash", "id"], "left_semi")
    old = filters.active(local, t.promotion_queue).select("id", "num", "hash", "scope", "created_at", F.lit(False).alias("is_new"))
    new = promotion(t).verdicts.where("verdict = 'new'").select(F.col("accepted_claim_id").alias("id"), F.substring("id", 4, 20).cast("long").alias("num"))
    said = h.select("num", "hash", X.durable_scope(F.col("kind"), F.col("memory_type")).alias("scope"))
    rows = old.unionByName(new.join(said, "num").withColumns({"created_at": now(), "is_new": F.lit(True)}))
    # Texts are moved once, when it is known which claims are there.
    text = F.when(F.col("is_new") & (F.col("num") % 13 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    rows = rows.join(t.claims.select(num.alias("num"), "text", "boundary_class"), "num").withColumn("text", text)
    # Written once: each of the later steps would redact and embed all texts again.
    rows = materialize(with_vectors(rows), "rows")
    links = t.claim_links.select(F.concat(F.lit("clm_of_pq_"), F.substring("source_claim_id", 5, 20)).alias("source_claim_id"), "target_claim_id")
    return after_promotion(rows.where("num % 50 = 0"), rows, links)


@R.add("p04_similar", AFTER + "SELECT p.id, other, round(similarity, 6) AS similarity FROM pr p JOIN al a ON a.id = p.id JOIN al b ON b.id = other WHERE similarity > 0.85 AND a.scope = b.scope AND a.hash <> b.hash", VIEWS)
def p04s(t: Tables):
    """Similar claims of the accepted and new ones whose number is divisible by 50."""
    return after(t)[0].select("id", "other", r6("similarity"))


@R.add("p04_suggested_links", AFTER + """SELECT id, target, round(score, 4) AS score, 'related' AS link_type, place FROM (SELECT p.id, other AS target, (similarity + 1) / 2 AS score, CAST(row_number() OVER (PARTITION BY p.id ORDER BY similarity DESC, b.created_at DESC, other) AS INTEGER) AS place
 FROM pr p JOIN al a ON a.id = p.id JOIN al b ON b.id = other WHERE a.is_new AND (similarity + 1) / 2 >= 0.7 AND (similarity + 1) / 2 < 0.85 AND NOT EXISTS (SELECT 1 FROM lk WHERE (s = p.id AND t = other) OR (s = other AND t = p.id))) WHERE place <= 5""", VIEWS)
def p04l(t: Tables):
    """Links to suggest for the new claims whose number is divisible by 50."""
    return after(t)[1]
