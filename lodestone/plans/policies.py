"""Registered queries: policy documents, checked and resolved. One document for each claim, put together from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import policies as P
from lodestone.plans.common import Registry
from lodestone.sources.fixtures import Tables

R = Registry()
K = "CAST(substr(id, 5) AS BIGINT)"

SCOPED = '"scopes":{"session":{"ttl":"7d"},"project":{"ttl":"90d"},"principle":{"ttl":"infinite"}}'
CLASSED = '"boundary_classes":{"public":{"allow":["*"]},"pii":{"allow":["tool:contact-lookup"],"redact":["email"]}}'
#: Parts of a document, and what is wrong with each.
PARTS: list[list[tuple[str, list[str]]]] = [
    [('"version":"1.1"', []), ('"version":2', ["version must be string"]), ('"note":true', ["version must be string"])],
    [
        ('"boundary":{%s,%s}' % (SCOPED, CLASSED), []),
        ('"boundary":{"scopes":{"session":{"ttl":7},"project":{}},%s}' % CLASSED, ["scopes.session.ttl must be string", "scopes.project.ttl must be string", "scopes.principle missing"]),
        ('"boundary":{%s,"boundary_classes":{"public":{"allow":"*"},"pii":{"allow":[],"redact":"email"},"secret":{"allow":[],"redact":""},"odd":null}}' % SCOPED,
         ["boundary_classes.public.allow must be array", "boundary_classes.pii.redact must be array", "boundary_classes.odd.allow must be array"]),
        ('"boundary":null', ["boundary missing", "boundary must be object"]),
        ('"boundary":{"scopes":null}', ["scopes missing", "boundary_classes missing"]),
    ],
    [
        ('"kept":1', []),
        ('"retrieval":[]', ["retrieval must be object"]),
        ('"retrieval":{"graph":{},"hybrid":3}', ["retrieval.graph is not allowed", "retrieval.hybrid must be object"]),
        ('"retrieval":{"hybrid":{"alpha":0.5,"threshold":"high","k_txt":12,"k_vec":null,"fast":true,"mmr":[],"topology":{"max_hops":1,"hop_decay":0.5,"edge_policy":{"related":{"weight":0.2,"direction":"forward","action":"boost"}}}}}',
         ["retrieval.hybrid.threshold must be number", "retrieval.hybrid.k_vec must be number", "retrieval.hybrid.fast is not allowed", "retrieval.hybrid.mmr must be object"]),
        ('"retrieval":{"hybrid":{"topology":{"enabled":"no","mode":"jump","seed_k":2.5,"max_hops":3,"hop_decay":0,"include_paths":1,"depth":4}}}',
         ["topology.enabled must be boolean", "topology.mode must be one of walk", "topology.seed_k must be integer", "topology.max_hops must be between 0 and 2",
          "topology.hop_decay must be greater than 0 and at most 1", "topology.include_paths must be boolean", "retrieval.hybrid.topology.depth is not allowed"]),
        ('"retrieval":{"hybrid":{"topology":{"edge_policy":{"supports":{"weight":"big","direction":"back","action":"hide","note":1},"likes":{},"related":4}}}}',
         ["topology.edge_policy.supports.weight must be number", "topology.edge_policy.supports.direction must be one of forward, both", "topology.edge_policy.supports.action must be one of boost, flag_conflict, shadow_old",
          "topology.edge_policy.supports.note is not allowed", "topology.edge_policy.likes is not allowed", "topology.edge_policy.related must be object"]),
        ('"retrieval":{"hybrid":{"k_txt":0,"k_vec":-3,"mmr":{"enabled":true,"lambda":0.3,"max_candidates":9.7},"query_expansion":{"enabled":true,"max_seed_entities":0,"max_expansion_terms":2},"feedback_boost":{"enabled":true,"harmful_weight":-0.5},"topology":{"enabled":false}}}', []),
    ],
    [
        ('"more":0', []),
        ('"maintenance":{"hints_enabled":false,"similarity_threshold":0.9,"stale_days":30}', []),
        ('"maintenance":{"hints_enabled":"yes","stale_days":"x"}', ["maintenance.hints_enabled must be boolean", "maintenance.stale_days must be number"]),
        ('"maintenance":0', ["maintenance must be object"]),
    ],
]
#: Documents that are no object: a list, and no JSON.
ODD = f"CASE WHEN {K} % 13 = 0 THEN '[]' WHEN {K} % 17 = 0 THEN '{{' END"


def _choice(part: int, values: list[str]) -> str:
    n = len(values)
    return f"CASE {K} % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


DOCUMENT = f"coalesce({ODD}, '{{' || " + " || ',' || ".join(_choice(i, [f"'{text}'" for text, _ in part]) for i, part in enumerate(PARTS)) + " || '}')"
SAID = [_choice(i, ["[" + ", ".join(f"'{e}'" for e in errors) + "]::VARCHAR[]" for _, errors in part]) for i, part in enumerate(PARTS)]


def documents(t: Tables):
    return t.claims.select("id", F.try_parse_json(F.expr(DOCUMENT)).alias("document"))


@R.add("s15_policy_errors", f"""SELECT id, len(e) AS n, array_to_string(e, '|') AS errors FROM (SELECT id, CASE WHEN {ODD} IS NOT NULL THEN ['policy must be object']
ELSE list_sort(list_concat({SAID[0]}, {SAID[1]}, {SAID[2]}, {SAID[3]})) END AS e FROM claims)""", "claims")
def s15(t: Tables):
    errors = P.policy_errors(F.col("document"))
    return documents(t).select("id", errors.alias("e")).select("id", F.size("e").cast("long").alias("n"), F.array_join("e", "|").alias("errors"))


@R.add("s15_valid_policies", f"SELECT count(*) AS n, count(*) FILTER ({ODD} IS NULL AND {K} % 3 = 0 AND {K} % 5 = 0 AND {K} % 7 IN (0, 6) AND {K} % 4 IN (0, 1)) AS valid FROM claims", "claims")
def s15v(t: Tables):
    return documents(t).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(P.policy_errors(F.col("document"))) == 0).alias("valid"))


@R.add("x32_search_settings", f"""SELECT id, CAST(CASE WHEN r = 3 THEN 0.5 ELSE 0.65 END AS DOUBLE) AS alpha, CAST(0.15 AS DOUBLE) AS threshold, CASE WHEN r = 3 THEN 12 ELSE 128 END AS k_text, 256 AS k_vec,
CAST(CASE WHEN r = 6 THEN 0.3 END AS DOUBLE) AS share, CASE WHEN r = 6 THEN 9 END AS candidates, CASE WHEN r = 6 THEN '3,8,2' END AS expansion, CAST(CASE WHEN r = 6 THEN -0.5 END AS DOUBLE) AS harmful, CAST(NULL AS DOUBLE) AS helpful,
CASE WHEN r = 4 THEN 2 WHEN r <> 6 THEN 6 END AS seed_k, CASE WHEN r = 3 THEN 1 WHEN r <> 6 THEN 2 END AS max_hops, CAST(CASE WHEN r = 3 THEN 0.5 WHEN r <> 6 THEN 0.75 END AS DOUBLE) AS hop_decay, CASE WHEN r <> 6 THEN true END AS include_paths,
CASE WHEN r = 3 THEN '0.9 forward boost|0.2 forward boost|0.15 both flag_conflict|1.0 forward shadow_old' WHEN r <> 6 THEN '0.9 forward boost|0.35 both boost|0.15 both flag_conflict|1.0 forward shadow_old' END AS edges
FROM (SELECT id, CASE WHEN {ODD} IS NOT NULL THEN 0 ELSE {K} % 7 END AS r FROM claims)""", "claims")
def x32(t: Tables):
    s = documents(t).select("id", P.search_settings(F.col("document")).alias("s"))
    walk = "s.topology."

    def edge(kind: str):
        e = F.col(walk + "edges")[kind]
        return F.concat_ws(" ", e["weight"].cast("string"), e["direction"], e["action"])

    kinds = ("supports", "related", "contradicts", "supersedes")
    return s.select(
        "id", "s.alpha", "s.threshold", "s.k_text", "s.k_vec", "s.mmr.share", "s.mmr.candidates",
        F.when(F.col("s.expansion").isNotNull(), F.concat_ws(",", "s.expansion.max_seed_entities", "s.expansion.max_related_entities", "s.expansion.max_expansion_terms")).alias("expansion"),
        F.col("s.feedback.harmful_weight").alias("harmful"), F.col("s.feedback.helpful_weight").alias("helpful"),
        walk + "seed_k", walk + "max_hops", walk + "hop_decay", walk + "include_paths", F.when(F.col("s.topology").isNotNull(), F.concat_ws("|", *map(edge, kinds))).alias("edges"),
    )
