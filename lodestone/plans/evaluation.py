"""Registered queries: ranking quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import evaluate, filters, search
from lodestone.plans.common import Registry, now, r6
from lodestone.plans.retrieval import COS, RANKED, SCOPES, features, texts, vecs
from lodestone.sources.fixtures import Tables

R = Registry()

RANKS = """, rk AS (SELECT scope AS query, id, row_number() OVER (PARTITION BY scope ORDER BY utility DESC, id) AS rn FROM claims),
jd AS (SELECT scope AS query, id, CAST(least(3, floor(score)) AS INTEGER) AS grade FROM claims JOIN critic ON claim_id = id)"""


def ranks(t: Tables):
    rn = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("utility"), "id"))
    return t.claims.select(F.col("scope").alias("query"), "id", rn.alias("rn"))


def judged(t: Tables):
    return t.claims.join(t.critic, F.col("id") == F.col("claim_id")).select(F.col("scope").alias("query"), "id", F.least(F.lit(3), F.floor("score")).cast("int").alias("grade"))


@R.add("e01_e02_e04_quality_at_10", RANKS + """, h AS (SELECT rk.query, rn, coalesce(grade, 0) AS grade FROM rk LEFT JOIN jd USING (query, id) WHERE rn <= 10),
p AS (SELECT *, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY rn) AS found FROM h),
s AS (SELECT query, count(*) FILTER (grade > 0) AS hits, min(rn) FILTER (grade > 0) AS first, sum((power(2.0, grade) - 1) / log2(rn + 1)) AS dcg, sum(CASE WHEN grade > 0 THEN found / CAST(rn AS DOUBLE) ELSE 0 END) AS ap FROM p GROUP BY 1),
i AS (SELECT query, count(*) AS relevant, sum(CASE WHEN place <= 10 THEN (power(2.0, grade) - 1) / log2(place + 1) ELSE 0 END) AS ideal FROM (SELECT query, grade, row_number() OVER (PARTITION BY query ORDER BY grade DESC, id) AS place FROM jd WHERE grade > 0) GROUP BY 1)
SELECT query, round(coalesce(hits / 10.0, 0), 6) AS precision, round(coalesce(hits / CAST(relevant AS DOUBLE), 0), 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS mrr,
 round(coalesce(ap / least(relevant, 10), 0), 6) AS map, round(coalesce(dcg, 0), 6) AS dcg, round(coalesce(dcg / ideal, 0), 6) AS ndcg,
 CAST(round(coalesce(2.0 * hits / (10 + relevant), 0), 6) AS DOUBLE) AS f1, CAST(CASE WHEN hits > 0 THEN 1 ELSE 0 END AS DOUBLE) AS hit, CAST(first AS DOUBLE) AS first_useful FROM i LEFT JOIN s USING (query)""", "claims critic")
def quality(t: Tables):
    return evaluate.at_k(ranks(t), judged(t), 10)


@R.add("e03_spearman", """, k AS (SELECT scope, utility, score FROM claims JOIN critic ON claim_id = id),
r AS (SELECT scope, rank() OVER (PARTITION BY scope ORDER BY utility DESC) + (count(*) OVER (PARTITION BY scope, utility) - 1) / 2.0 AS a, rank() OVER (PARTITION BY scope ORDER BY score DESC) + (count(*) OVER (PARTITION BY scope, score) - 1) / 2.0 AS b FROM k)
SELECT scope, round(coalesce(corr(a, b), 0), 6) AS rho FROM r GROUP BY scope""", "claims critic")
def e03(t: Tables):
    return evaluate.spearman(t.claims.join(t.critic, F.col("id") == F.col("claim_id")), "scope", "utility", "score")


@R.add("e05_diversity", RANKS + " SELECT query, count(DISTINCT kind) AS kinds FROM rk JOIN claims USING (id) WHERE rn <= 20 GROUP BY query", "claims critic")
def e05(t: Tables):
    return ranks(t).where("rn <= 20").join(t.claims.select("id", "kind"), "id").groupBy("query").agg(F.count_distinct("kind").alias("kinds"))


QUERY_WORDS = [("q1", ["haing", "thand"]), ("q2", ["the", "and"]), ("q3", ["qqqq"]), ("q4", ["Tion"])]


@R.add("e07_text_overlap", """, q AS (SELECT * FROM (VALUES ('q1', ['haing', 'thand']), ('q2', ['the', 'and']), ('q3', ['qqqq']), ('q4', ['tion'])) v(query, words)),
g AS (SELECT lower(text) AS text, id IN (SELECT claim_id FROM critic) AS golden FROM claims),
m AS (SELECT query, golden FROM q JOIN g ON len(list_filter(words, lambda w: contains(text, w))) > 0)
SELECT query, (SELECT count(*) FROM m WHERE m.query = q.query AND golden) AS golden, (SELECT count(*) FROM m WHERE m.query = q.query AND NOT golden) AS other,
 round((SELECT count(*) FROM m WHERE m.query = q.query AND NOT golden) / CAST(nullif((SELECT count(*) FROM m WHERE m.query = q.query), 0) AS DOUBLE), 2) AS ratio FROM q""", "claims critic")
def e07(t: Tables):
    """Claims with a critic count as golden."""
    docs = t.claims.join(t.critic.select(F.col("claim_id").alias("id"), F.lit(True).alias("golden")), "id", "left").select("text", F.coalesce("golden", F.lit(False)).alias("golden"))
    return evaluate.match_overlap(t.spark.createDataFrame(QUERY_WORDS, "query string, words array<string>"), docs)


VARIANTS = """, rk AS (SELECT scope AS query, v AS variant, id, CASE WHEN CAST(substr(id, 5) AS BIGINT) % 4 = 0 AND v = 'walk' THEN 'topology' ELSE 'search' END AS source,
 row_number() OVER (PARTITION BY scope, v ORDER BY CASE v WHEN 'plain' THEN utility ELSE utility + CASE WHEN CAST(substr(id, 5) AS BIGINT) % 4 = 0 THEN 0.2 ELSE 0 END END DESC, id) AS rn FROM claims, (SELECT unnest(['plain', 'walk']) AS v)),
rl AS (SELECT DISTINCT scope AS query, id FROM claims JOIN critic ON claim_id = id WHERE score > 2),
ms AS (SELECT rk.query, variant, count(rl.id) AS hits, count(*) - count(rl.id) AS noise, count(*) FILTER (source = 'topology') AS graph FROM rk LEFT JOIN rl ON rl.query = rk.query AND rl.id = rk.id WHERE rn <= 20 GROUP BY ALL),
mm AS (SELECT ms.*, hits / 20.0 AS p, hits / CAST((SELECT count(*) FROM rl WHERE rl.query = ms.query) AS DOUBLE) AS r FROM ms)
"""


def measured(t: Tables):
    """Two rankings of each scope: by utility, and with every fourth claim lifted as if a walk had found it."""
    k = F.substring("id", 5, 20).cast("long") % 4 == 0
    both = t.claims.select(F.col("scope").alias("query"), "id", "utility", F.explode(F.array(F.lit("plain"), F.lit("walk"))).alias("variant"))
    lifted = F.col("utility") + F.when(k & (F.col("variant") == "walk"), 0.2).otherwise(0.0)
    rn = F.row_number().over(Window.partitionBy("query", "variant").orderBy(F.desc("value"), "id"))
    ranked = both.withColumn("value", lifted).withColumn("rn", rn).where("rn <= 20")
    results = ranked.withColumn("source", F.when(k & (F.col("variant") == "walk"), "topology").otherwise("search"))
    good = t.claims.join(t.critic.where("score > 2"), F.col("id") == F.col("claim_id")).select(F.col("scope").alias("query"), "id")
    return evaluate.noise_at_k(results, good, 20)


@R.add("e06_noise_at_20", VARIANTS + "SELECT query, variant, CAST(round(p, 6) AS DOUBLE) AS precision, round(r, 6) AS recall, noise, graph, CAST(round(graph / 20.0, 3) AS DOUBLE) AS graph_share FROM mm", "claims critic")
def e06(t: Tables):
    return measured(t)


E06 = VARIANTS + ", dl AS (SELECT a.query, CAST(round(b.p - a.p, 3) AS DOUBLE) AS precision, round(round(b.r, 6) - round(a.r, 6), 3) AS recall, b.noise - a.noise AS noise, b.graph - a.graph AS graph FROM mm a JOIN mm b ON a.query = b.query AND a.variant = 'plain' AND b.variant = 'walk') "


@R.add("e06_deltas", E06 + "SELECT * FROM dl", "claims critic")
def e06d(t: Tables):
    return evaluate.noise_deltas(measured(t), "plain", "walk")


@R.add("e06_sweep_summary", E06 + "SELECT count(*) AS cases, count(*) FILTER (precision < 0) AS precision_drops, count(*) FILTER (recall < 0) AS recall_drops, count(*) FILTER (noise > 0) AS noisier, round(greatest(0.0, -min(precision)), 3) AS largest_drop FROM dl", "claims critic")
def e06s(t: Tables):
    return evaluate.sweep_summary(evaluate.noise_deltas(measured(t), "plain", "walk"))


@R.add("e08_similarity_spread", f""", g AS (SELECT claim_id AS id, embedding FROM claim_vectors WHERE CAST(substr(claim_id, 5) AS BIGINT) % 50 = 0),
p AS (SELECT g.id, {COS.format(a='g.embedding', b='v.embedding')} AS s, row_number() OVER (PARTITION BY g.id ORDER BY {COS.format(a='g.embedding', b='v.embedding')}, v.claim_id) - 1 AS i, count(*) OVER (PARTITION BY g.id) AS n FROM g JOIN claim_vectors v ON v.claim_id <> g.id)
SELECT id, round(avg(s), 6) AS mean, count(*) FILTER (s > 0.2) AS above, round(max(s) FILTER (i = floor(n * 0.5)), 6) AS p50, round(max(s) FILTER (i = floor(n * 0.75)), 6) AS p75, round(max(s) FILTER (i = floor(n * 0.9)), 6) AS p90, round(max(s), 6) AS p100 FROM p GROUP BY 1""", "claim_vectors")
def e08(t: Tables):
    """Vectors whose number is divisible by 50 against all others."""
    rows = t.claim_vectors.select(F.col("claim_id").alias("id"), "embedding")
    golden = rows.where(F.substring("id", 5, 20).cast("long") % 50 == 0)
    return evaluate.similarity_spread(golden, rows, 0.2)


@R.add("e10_k_sensitivity", RANKS + """, ks AS (SELECT unnest([5, 10, 20, 50]) AS k) SELECT k, query, CAST(count(*) FILTER (grade > 0) AS DOUBLE) / k AS precision, count(*) FILTER (grade > 0) AS hits FROM ks JOIN rk ON rn <= k LEFT JOIN jd USING (query, id) GROUP BY k, query""", "claims critic")
def e10k(t: Tables):
    """One pass: each ranked row counts for every k it lies within."""
    ks = [5, 10, 20, 50]
    hits = evaluate.ranked_hits(ranks(t).where(F.col("rn") <= max(ks)), judged(t))
    rows = hits.select("query", "grade", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rn"))).alias("k"))
    return rows.groupBy("k", "query").agg((F.count_if(F.col("grade") > 0) / F.col("k")).alias("precision"), F.count_if(F.col("grade") > 0).alias("hits"))


@R.add("e10_ablation_grid", """, g AS (SELECT alpha, threshold FROM (SELECT unnest([0.0, 0.5, 0.65, 1.0]) AS alpha), (SELECT unnest([0.0, 0.15, 0.5]) AS threshold)),
s AS (SELECT utility AS t, confidence AS v FROM claims) SELECT CAST(alpha AS DOUBLE) AS alpha, CAST(threshold AS DOUBLE) AS threshold, count(*) AS kept FROM g, s WHERE CAST(alpha AS DOUBLE) * v + (1 - CAST(alpha AS DOUBLE)) * t >= CAST(threshold AS DOUBLE) GROUP BY ALL""", "claims")
def e10a(t: Tables):
    """A grid of twelve settings over all claims: how many pass."""
    g = evaluate.grid(t.spark, alpha=[0.0, 0.5, 0.65, 1.0], threshold=[0.0, 0.15, 0.5])
    mixed = F.col("alpha") * F.col("confidence") + (1 - F.col("alpha")) * F.col("utility")
    return t.claims.join(F.broadcast(g)).where(mixed >= F.col("threshold")).groupBy("alpha", "threshold").agg(F.count(F.lit(1)).alias("kept"))


TEMPLATES = [("We use {tech} for storage", "fact", "project"), ("Prefer {tech}", "preference", "principle"), ("Migrate to {tech}", "task", "session")]


@R.add("e11_synthetic_claims", """, n AS (SELECT count(*) AS n FROM claims), m AS (SELECT i FROM n, range(0, n) r(i)), f AS (SELECT name, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS several FROM entities WHERE type <> 'Event')
SELECT id, text, kind, scope FROM claims UNION ALL SELECT 'synth-' || lpad(CAST(i AS VARCHAR), 5, '0'), replace(['We use {tech} for storage', 'Prefer {tech}', 'Migrate to {tech}'][i % 3 + 1], '{tech}', name), ['fact', 'preference', 'task'][i % 3 + 1], ['project', 'principle', 'session'][i % 3 + 1] FROM m JOIN f ON k = i % several""", "claims entities")
def e11(t: Tables):
    """As many made claims as there are real ones, filled with the names of all entities but events."""
    return evaluate.synthetic_claims(t.spark, t.claims, 2 * t.claims.count(), TEMPLATES, t.entities.where("type <> 'Event'"))


@R.add("e09_score_separation", "SELECT round(min(score) FILTER (quality = 1) - max(score) FILTER (quality = 0), 6) AS gap FROM (SELECT quality, k.score FROM labels JOIN critic k ON k.claim_id = concat('clm_', doc_id))", "critic")
def e09(t: Tables):
    rows = t.labels.select(F.concat(F.lit("clm_"), "doc_id").alias("claim_id"), "quality").join(t.critic, "claim_id")
    return rows.agg(F.round(F.min(F.when(F.col("quality") == 1, F.col("score"))) - F.max(F.when(F.col("quality") == 0, F.col("score"))), 6).alias("gap"))


@R.add("e10_threshold_grid", "SELECT s.v AS threshold, count(*) AS kept FROM (SELECT CAST(i AS DOUBLE) / 10 AS v FROM range(0, 10) r(i)) s JOIN claims c ON c.utility >= s.v GROUP BY 1", "claims")
def e10(t: Tables):
    steps = F.explode(F.sequence(F.lit(0), F.least(F.lit(9), F.floor(F.round(F.col("utility") * 1000) / 100).cast("int"))))
    return t.claims.select(steps.alias("i")).groupBy((F.col("i") / 10).alias("threshold")).agg(F.count(F.lit(1)).alias("kept"))


# The settings that a perturbation run compares.
SETTINGS = [("baseline", 0.65, True, 10), ("no-rerank", 0.65, False, 10), ("alpha-0.5", 0.5, True, 10), ("alpha-0.8", 0.8, True, 10), ("top_k-5", 0.65, True, 5), ("top_k-20", 0.65, True, 20)]
PERTURBED = RANKED.split("SELECT u.id, round(")[0].replace("{W}", "1.0").replace("{INTENT}", "1").replace("{FB}", "1").rstrip() + """, cfg AS (SELECT * FROM (VALUES """ + ", ".join(f"('{n}', CAST({a} AS DOUBLE), {str(r).lower()}, {k})" for n, a, r, k in SETTINGS) + """) v(config, alpha, rerank, top_k)),
sc AS (SELECT config, top_k, u.id, c.created_at, round((alpha * u.s_vec + (1 - alpha) * u.s_text) * CASE WHEN rerank THEN coalesce(g, 1) * coalesce(pq, 1) ELSE 1 END, 9) AS score FROM cfg, fused u LEFT JOIN fac ON fac.id = u.id LEFT JOIN claims c ON c.id = u.id),
rk AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY score DESC, created_at DESC, id) AS rank FROM sc WHERE score >= 0.15), top AS (SELECT * FROM rk WHERE rank <= top_k)
SELECT t.config, count(*) AS shown, count(*) FILTER (t.id IN (SELECT id FROM top WHERE config = 'baseline')) AS kept, string_agg(t.id, ',' ORDER BY t.rank) AS ids FROM top t GROUP BY t.config"""


@R.add("e10_perturbation", PERTURBED, "claims promotion_queue evidence feedback critic claim_vectors")
def e10p(t: Tables):
    """One pool of candidates under each setting: what is shown, and how much of it the baseline shows too."""
    fused = search.fuse(texts(t), vecs(t))
    stats = search.utility_stats(t.claims, t.promotion_queue, filters.one_of("scope", SCOPES))
    pool = search.rerank(fused, features(t, fused.select("id")), stats, now(), threshold=float("-inf"))
    settings = t.spark.createDataFrame(SETTINGS, "config string, alpha double, rerank boolean, top_k int")
    return evaluate.perturbed(pool, settings, search.THRESHOLD)
