"""Registered queries: graph walks, impact and audit."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import filters, graph
from lodestone.operators.exchange import referenced
from lodestone.plans.analytics import GENERIC
from lodestone.plans.common import ACTIVE, Registry
from lodestone.plans.retrieval import SCOPES, TEXT, texts
from lodestone.runtime import materialize
from lodestone.sources.fixtures import Tables

R = Registry()

W = "CASE link_type WHEN 'supports' THEN 0.9 WHEN 'extends' THEN 0.7 WHEN 'related' THEN 0.35 WHEN 'contradicts' THEN 0.15 ELSE 1.0 END * confidence"
K = "CASE link_type WHEN 'contradicts' THEN 'conflict' WHEN 'supersedes' THEN 'supersession' ELSE 'support' END"
ENTITY = """, hops AS (SELECT DISTINCT * FROM (SELECT src_id AS u, dst_id AS v, id FROM relations UNION ALL SELECT dst_id, src_id, id FROM relations)),
ent AS (SELECT a.claim_id AS u, b.claim_id AS v, h.id AS edge FROM hops h JOIN claim_entities a ON a.entity_id = h.u JOIN claim_entities b ON b.entity_id = h.v WHERE a.claim_id <> b.claim_id)"""
STEPS = f""", steps AS (SELECT source_claim_id AS u, target_claim_id AS v, id AS edge, {W} AS weight, {K} AS kind FROM claim_links WHERE link_type <> 'supersedes'
 UNION ALL SELECT target_claim_id, source_claim_id, id, {W}, {K} FROM claim_links WHERE link_type IN ('related', 'contradicts', 'supersedes')
 UNION ALL SELECT u, v, edge, 0.45, 'support' FROM ent)"""
OK = f"(SELECT c.id FROM claims c WHERE c.scope IN ('project', 'principle') AND {ACTIVE})"


WALK_AFTER_SEEDS = f""", h1 AS (SELECT v AS id, s.id AS seed, s.score AS ss, s.id AS via, edge, kind, 1 AS depth, 1.0 * weight AS p, round(s.score * (1.0 * weight) * 0.75, 6) AS path_score, concat(s.id, '>', v) AS path, edge AS edges
 FROM seeds s JOIN steps ON u = s.id WHERE v <> s.id AND v IN {OK}),
f1 AS (SELECT * FROM h1 WHERE kind <> 'conflict' QUALIFY row_number() OVER (PARTITION BY id ORDER BY path_score DESC, seed, via, edge) = 1),
h2 AS (SELECT v AS id, seed, ss, f.id AS via, s.edge, s.kind, 2 AS depth, p * weight AS p, round(ss * (p * weight) * 0.5625, 6) AS path_score, concat(f.path, '>', v) AS path, concat(f.edge, '>', s.edge) AS edges
 FROM f1 f JOIN steps s ON s.u = f.id WHERE v <> seed AND v <> f.id AND v IN {OK}),
ways AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2),
derived AS (SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY id ORDER BY path_score DESC, depth, seed, via, edge) = 1)
"""
WALK = (TEXT + ENTITY + STEPS).rstrip() + ", seeds AS (SELECT id, score FROM txt ORDER BY score DESC, created_at DESC, id LIMIT 6)" + WALK_AFTER_SEEDS
WALK_VIEWS = "claims promotion_queue critic claim_links relations claim_entities"


def walked(t: Tables):
    seeds = texts(t).orderBy(F.desc("score"), F.desc("created_at"), "id").limit(6).select("id", "score")
    return graph.walk(seeds, t.claim_links, t.claim_entities, t.relations, filters.active(t.claims, t.promotion_queue).where(filters.one_of("scope", SCOPES)))


@R.add("g01_walk", WALK + "SELECT id, seed, kind, depth, path_score FROM derived", WALK_VIEWS)
def g01(t: Tables):
    return walked(t).derived().select("id", "seed", "kind", "depth", "path_score")


@R.add("g01_shadowed", WALK + "SELECT DISTINCT via AS id FROM ways WHERE kind = 'supersession'", WALK_VIEWS)
def g01s(t: Tables):
    return walked(t).shadowed()


@R.add("g01_conflicts", WALK + "SELECT DISTINCT seed, id, via FROM ways WHERE kind = 'conflict'", WALK_VIEWS)
def g01c(t: Tables):
    return walked(t).conflicts()


@R.add("g14_walk_paths", WALK + "SELECT id, path, edges FROM derived", WALK_VIEWS)
def g14w(t: Tables):
    edges = F.array_join(F.transform("segments", lambda x: x["edge"]), ">").alias("edges")
    return walked(t).derived().select("id", F.array_join("path", ">").alias("path"), edges)


BLAST = ENTITY + f""", steps AS (SELECT source_claim_id AS u, target_claim_id AS v, id AS edge, {W} AS weight, {K} AS kind, 'claim_links' AS source FROM claim_links UNION ALL SELECT target_claim_id, source_claim_id, id, {W}, {K}, 'claim_links' FROM claim_links
 UNION ALL SELECT u, v, edge, 0.45, 'support', 'entity_graph' FROM ent),
roots AS (SELECT DISTINCT accepted_claim_id AS id FROM promotion_queue WHERE status = 'rolled_back'),
h1 AS (SELECT r.id AS root, v AS id, kind, 1.0 * weight * 0.75 AS score, 1 AS depth, r.id AS via, edge, source FROM roots r JOIN steps ON u = r.id WHERE v <> r.id AND v IN (SELECT id FROM claims)),
f1 AS (SELECT root, id, max(score) AS score FROM h1 GROUP BY ALL),
h2 AS (SELECT root, v AS id, kind, score * weight * 0.75 AS score, 2 AS depth, f1.id AS via, edge, source FROM f1 JOIN steps ON u = f1.id WHERE v <> root AND v IN (SELECT id FROM claims)),
prop AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2),
best AS (SELECT * FROM prop QUALIFY row_number() OVER (PARTITION BY root, id ORDER BY score DESC, depth, kind, via, edge) = 1)
"""
BLAST_VIEWS = "claims promotion_queue claim_links relations claim_entities"


def blast(t: Tables):
    return graph.blast_radius(filters.rolled_back(t.promotion_queue), t.claim_links, t.claim_entities, t.relations, t.claims)


@R.add("g03_blast_radius", BLAST + "SELECT root, id, round(score, 6) AS score, depth FROM best", BLAST_VIEWS)
def g03(t: Tables):
    return blast(t).best().select("root", "id", F.round("score", 6).alias("score"), "depth")


@R.add("g03_best_by_kind", BLAST + "SELECT root, id, kind, round(score, 6) AS score, depth FROM prop QUALIFY row_number() OVER (PARTITION BY root, id, kind ORDER BY score DESC, depth, via, edge) = 1", BLAST_VIEWS)
def g03k(t: Tables):
    return blast(t).best("kind").select("root", "id", "kind", F.round("score", 6).alias("score"), "depth")


@R.add("g03_linked_entities", BLAST + "SELECT DISTINCT root, entity_id FROM best JOIN claim_entities ON claim_id = best.id", BLAST_VIEWS)
def g03e(t: Tables):
    return blast(t).best().join(t.claim_entities, F.col("id") == F.col("claim_id")).select("root", "entity_id").distinct()


@R.add("g14_blast_paths", BLAST + "SELECT root, id, source, via, edge FROM best", BLAST_VIEWS)
def g14b(t: Tables):
    last = F.element_at("segments", -1)
    return blast(t).best().select("root", "id", last["source"].alias("source"), last["from_claim"].alias("via"), last["edge"].alias("edge"))


@R.add("a15_affected_contexts", BLAST + """, it AS (SELECT *, coalesce(CASE WHEN rank < 3 THEN 'top' WHEN rank < 6 THEN 'rest' END, 'unknown') AS layer FROM active_context_items)
SELECT root, count(DISTINCT active_context_id) AS contexts, count(*) AS items, count(DISTINCT it.claim_id) AS claims, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers, max(it.score) AS best FROM best JOIN it ON it.claim_id = best.id GROUP BY root""", BLAST_VIEWS + " active_context_items")
def a15b(t: Tables):
    layer = F.when(F.col("rank") < 3, "top").when(F.col("rank") < 6, "rest")
    return graph.affected_contexts(blast(t).best(), t.active_context_items, layer)


COMPONENTS = """, e AS (SELECT source_claim_id AS a, target_claim_id AS b FROM claim_links
 UNION SELECT x.claim_id, y.claim_id FROM claim_entities x JOIN claim_entities y ON x.entity_id = y.entity_id AND x.claim_id <> y.claim_id
 UNION SELECT x.claim_id, y.claim_id FROM relations r JOIN claim_entities x ON x.entity_id = r.src_id JOIN claim_entities y ON y.entity_id = r.dst_id),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(id, r) AS (SELECT id, id FROM claims UNION SELECT reach.id, s.b FROM reach JOIN s ON s.a = reach.r),
comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id)
"""
GRAPH_VIEWS = "claims claim_links claim_entities relations"


def components(t: Tables):
    return graph.claim_components(t.claims, t.claim_links, t.claim_entities, t.relations)


@R.add("g04_components", COMPONENTS + "SELECT id, component FROM comp", GRAPH_VIEWS)
def g04(t: Tables):
    return components(t)


@R.add("g05_orphan_claims", "SELECT id FROM claims WHERE id NOT IN (SELECT claim_id FROM claim_entities) AND id NOT IN (SELECT source_claim_id FROM claim_links) AND id NOT IN (SELECT target_claim_id FROM claim_links)", "claims claim_links claim_entities")
def g05(t: Tables):
    return graph.orphan_claims(t.claims, t.claim_links, t.claim_entities)


@R.add("g05_orphan_entities", "SELECT id FROM entities WHERE id NOT IN (SELECT src_id FROM relations) AND id NOT IN (SELECT dst_id FROM relations) AND id NOT IN (SELECT entity_id FROM claim_entities)", "entities relations claim_entities")
def g05e(t: Tables):
    return graph.orphan_entities(t.entities, t.relations, t.claim_entities)


@R.add("g06_cycles", """, e AS (SELECT DISTINCT source_claim_id AS u, target_claim_id AS v FROM claim_links WHERE link_type = 'contradicts'),
p AS (SELECT [u, v] AS path FROM e WHERE u < v UNION ALL SELECT list_append(path, v) FROM p JOIN e ON e.u = path[-1] WHERE v > path[1] AND NOT list_contains(path, v))
SELECT array_to_string(path, '>') AS cycle, CAST(len(path) AS INTEGER) AS length FROM p JOIN e ON e.u = path[-1] AND e.v = path[1]""", "claim_links")
def g06(t: Tables):
    return graph.cycles(t.claim_links)


@R.add("g06_cyclic_parts", """, e AS (SELECT DISTINCT source_claim_id AS u, target_claim_id AS v FROM claim_links),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
m AS (SELECT a.u AS id, min(a.v) AS part FROM r a JOIN r b ON a.u = b.v AND a.v = b.u GROUP BY 1)
SELECT id, part, count(*) OVER (PARTITION BY part) AS size FROM m QUALIFY count(*) OVER (PARTITION BY part) > 1""", "claim_links")
def g06p(t: Tables):
    """Parts of the whole directed link graph whose claims reach each other."""
    return graph.strong_components(t.claim_links.select(F.col("source_claim_id").alias("u"), F.col("target_claim_id").alias("v")).distinct())


@R.add("g07_chains", """, e AS (SELECT DISTINCT source_claim_id AS u, target_claim_id AS v FROM claim_links WHERE link_type = 'supersedes'),
p AS (SELECT u AS root, [u] AS path FROM e WHERE u NOT IN (SELECT v FROM e) UNION SELECT root, list_append(path, v) FROM p JOIN e ON e.u = path[-1] WHERE NOT list_contains(path, v))
SELECT root, CAST(len(path) - 1 AS INTEGER) AS length, array_to_string(path, '>') AS chain FROM p WHERE len(path) > 3 QUALIFY row_number() OVER (PARTITION BY root ORDER BY len(path) DESC, path) = 1""", "claim_links")
def g07(t: Tables):
    return graph.longest_chains(t.claim_links)


@R.add("g08_scope_holes", COMPONENTS + """, z AS (SELECT component, count(*) AS size, bool_or(scope = 'principle') AS pr, bool_or(scope = 'project') AS pj, bool_or(scope = 'session') AS se FROM comp JOIN claims USING (id) GROUP BY 1)
SELECT component, size, CASE WHEN pj AND NOT pr THEN 'project_without_principle' WHEN se AND NOT pj AND NOT pr THEN 'session_without_durable' END AS hole FROM z WHERE (pj AND NOT pr) OR (se AND NOT pj AND NOT pr)""", GRAPH_VIEWS)
def g08(t: Tables):
    return graph.scope_holes(components(t), t.claims)


UNLINKED = """, p AS (SELECT a.claim_id AS a, b.claim_id AS b, count(DISTINCT a.active_context_id) AS contexts FROM active_context_items a
 JOIN active_context_items b ON a.active_context_id = b.active_context_id AND a.claim_id < b.claim_id GROUP BY ALL HAVING count(DISTINCT a.active_context_id) >= 3),
un AS (SELECT a, b, contexts FROM p WHERE NOT EXISTS (SELECT 1 FROM claim_links l WHERE (l.source_claim_id = a AND l.target_claim_id = b) OR (l.source_claim_id = b AND l.target_claim_id = a))
 AND NOT EXISTS (SELECT 1 FROM claim_entities x JOIN claim_entities y ON x.entity_id = y.entity_id WHERE x.claim_id = a AND y.claim_id = b)
 AND NOT EXISTS (SELECT 1 FROM relations r JOIN claim_entities x ON x.entity_id = r.src_id JOIN claim_entities y ON y.entity_id = r.dst_id WHERE (x.claim_id = a AND y.claim_id = b) OR (x.claim_id = b AND y.claim_id = a)))
"""


def unlinked(t: Tables):
    return graph.unlinked_coactivation(t.active_context_items, t.claim_links, t.claim_entities, t.relations)


@R.add("g09_unlinked_coactivation", UNLINKED + "SELECT a, b, contexts FROM un", "active_context_items claim_links claim_entities relations")
def g09(t: Tables):
    return unlinked(t).select("a", "b", "contexts")


HUBS = f""", d AS (SELECT e.id, e.name, (SELECT count(DISTINCT claim_id) FROM claim_entities x WHERE x.entity_id = e.id) + coalesce(r.n, 0) AS degree
 FROM entities e LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT src_id AS id FROM relations UNION ALL SELECT dst_id FROM relations) GROUP BY 1) r ON r.id = e.id),
n AS (SELECT id, degree, trim(regexp_replace(lower(name), '[_-]+', ' ', 'g')) AS f FROM d), k AS (SELECT id, degree, f, list_filter(regexp_split_to_array(f, '[ \\t\\n]+'), lambda x: x <> '') AS w FROM n),
hubs AS (SELECT id, degree FROM k WHERE degree >= 4 AND {GENERIC})
"""


def hubs(t: Tables):
    d = graph.entity_degrees(t.entities, t.claim_entities, t.relations).where("degree >= 4")
    return d.join(t.entities.where(X.generic_label(F.col("name"))).select("id"), "id", "left_semi")


@R.add("g10_generic_hubs", HUBS + "SELECT id, degree FROM hubs", "entities claim_entities relations")
def g10(t: Tables):
    return hubs(t)


NEIGHBOURS = ENTITY + """, nb AS (SELECT * FROM (SELECT source_claim_id AS id, target_claim_id AS other, 'claim_link' AS reason FROM claim_links UNION ALL SELECT target_claim_id, source_claim_id, 'claim_link' FROM claim_links
 UNION ALL SELECT x.claim_id, y.claim_id, 'shared_entity' FROM claim_entities x JOIN claim_entities y ON x.entity_id = y.entity_id UNION ALL SELECT u, v, 'relation' FROM ent) WHERE id <> other {WHO})
"""
ASKED = "CAST(substr({c}, 5) AS BIGINT) % 50 = 0"


def asked_ids(t: Tables):
    return materialize(t.claims.where(F.substring("id", 5, 20).cast("long") % 50 == 0).select("id"), "ids")


@R.add("g13_claim_neighbours", NEIGHBOURS.replace("{WHO}", "AND " + ASKED.format(c="id")) + "SELECT id, other, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM nb GROUP BY ALL", "claim_links relations claim_entities")
def g13(t: Tables):
    """Neighbours of the claims whose number is divisible by 50, with the reasons."""
    return graph.neighbours(asked_ids(t), t.claim_links, t.claim_entities, t.relations)


GENERIC_CLAIMS = f""", gn AS (SELECT id, trim(regexp_replace(lower(text), '[_-]+', ' ', 'g')) AS f FROM claims), gk AS (SELECT id, f, list_filter(regexp_split_to_array(f, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM gn),
gc AS (SELECT id FROM gk WHERE {GENERIC}), cd AS (SELECT id, count(DISTINCT other) AS degree FROM nb WHERE id IN (SELECT id FROM gc) GROUP BY 1 HAVING count(DISTINCT other) >= 4)
"""
FINDINGS = (
    COMPONENTS.rstrip() + HUBS.rstrip() + NEIGHBOURS.replace("{WHO}", "").rstrip() + GENERIC_CLAIMS.rstrip() + UNLINKED.rstrip()
    + """, ce1 AS (SELECT DISTINCT source_claim_id AS u, target_claim_id AS v FROM claim_links WHERE link_type = 'contradicts'),
cp AS (SELECT [u, v] AS path FROM ce1 WHERE u < v UNION ALL SELECT list_append(path, v) FROM cp JOIN ce1 ON ce1.u = path[-1] WHERE v > path[1] AND NOT list_contains(path, v)),
se1 AS (SELECT DISTINCT source_claim_id AS u, target_claim_id AS v FROM claim_links WHERE link_type = 'supersedes'),
sp AS (SELECT u AS root, [u] AS path FROM se1 WHERE u NOT IN (SELECT v FROM se1) UNION SELECT root, list_append(path, v) FROM sp JOIN se1 ON se1.u = path[-1] WHERE NOT list_contains(path, v)),
z AS (SELECT component, bool_or(scope = 'principle') AS pr, bool_or(scope = 'project') AS pj, bool_or(scope = 'session') AS se FROM comp JOIN claims USING (id) GROUP BY 1),
f AS (SELECT 'orphan_claim' AS kind, id AS subject FROM claims WHERE id NOT IN (SELECT claim_id FROM claim_entities) AND id NOT IN (SELECT source_claim_id FROM claim_links) AND id NOT IN (SELECT target_claim_id FROM claim_links)
 UNION ALL SELECT 'orphan_entity', id FROM entities WHERE id NOT IN (SELECT src_id FROM relations) AND id NOT IN (SELECT dst_id FROM relations) AND id NOT IN (SELECT entity_id FROM claim_entities)
 UNION ALL SELECT 'contradiction_cycle', array_to_string(path, '>') FROM cp JOIN ce1 ON ce1.u = path[-1] AND ce1.v = path[1]
 UNION ALL SELECT 'supersession_chain', chain FROM (SELECT array_to_string(path, '>') AS chain FROM sp WHERE len(path) > 3 QUALIFY row_number() OVER (PARTITION BY root ORDER BY len(path) DESC, path) = 1)
 UNION ALL SELECT 'scope_hole', component FROM z WHERE (pj AND NOT pr) OR (se AND NOT pj AND NOT pr)
 UNION ALL SELECT 'repeated_coactivation', concat(a, '::', b) FROM un
 UNION ALL SELECT 'generic_hub', id FROM hubs UNION ALL SELECT 'generic_hub', id FROM cd)
"""
)
AUDIT_VIEWS = "claims claim_links entities claim_entities relations active_context_items"


def generic_claims(t: Tables):
    """Claims with a generic text and four neighbours or more."""
    ids = materialize(t.claims.where(X.generic_label(F.col("text"))).select("id"), "ids")
    return graph.neighbours(ids, t.claim_links, t.claim_entities, t.relations).groupBy("id").agg(F.count(F.lit(1)).alias("degree")).where("degree >= 4")


def make_views(t: Tables) -> None:
    """Views are made once, before the threads."""
    for name in AUDIT_VIEWS.split():
        getattr(t, name)


def findings(t: Tables, component=None):
    """(kind, subject) of all seven kinds of finding; the parts are planned and run side by side, each once, and written.

    ``component`` is a function that gives the components, if others need them too.
    """
    parts = {
        "orphan_claim": lambda: graph.orphan_claims(t.claims, t.claim_links, t.claim_entities).select("id"),
        "orphan_entity": lambda: graph.orphan_entities(t.entities, t.relations, t.claim_entities).select("id"),
        "contradiction_cycle": lambda: graph.cycles(t.claim_links).select("cycle"),
        "supersession_chain": lambda: graph.longest_chains(t.claim_links).select("chain"),
        "scope_hole": lambda: graph.scope_holes(component() if component else components(t), t.claims).select("component"),
        "repeated_coactivation": lambda: unlinked(t).select(F.concat_ws("::", "a", "b")),
        "generic_hub": lambda: hubs(t).select("id").union(generic_claims(t).select("id")),
    }
    make_views(t)
    with ThreadPoolExecutor(len(parts)) as pool:
        rows = list(pool.map(inheritable_thread_target(t.spark)(lambda part: materialize(part[1]().toDF("subject").select(F.lit(part[0]).alias("kind"), "subject"), "findings")), parts.items()))
    return reduce(DataFrame.union, rows)


@R.add("g11_audit", FINDINGS + "SELECT kind, subject, count(*) OVER (PARTITION BY kind) AS total FROM f", AUDIT_VIEWS)
def g11(t: Tables):
    """All findings, each with the number of its kind."""
    return graph.counted(findings(t)).select("kind", "subject", "total")


SCAN_LIMIT = 100_000


@R.add("g11_summary", FINDINGS + f""", tally AS (SELECT 'claims' AS kind, count(*) AS n FROM claims UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'relations', count(*) FROM relations
 UNION ALL SELECT 'claim_links', count(*) FROM claim_links UNION ALL SELECT 'components', count(DISTINCT component) FROM comp UNION ALL SELECT kind, count(*) FROM f GROUP BY kind)
SELECT kind, n, kind IN ('claims', 'entities', 'relations') AND n > {SCAN_LIMIT} AS over_scan_limit FROM tally""", AUDIT_VIEWS)
def g11s(t: Tables):
    """Uncapped counts; the flag tells which tables a scan limit of 100 000 rows would have cut (nothing is cut here)."""
    make_views(t)
    with ThreadPoolExecutor(1) as one:  # components are formed once, beside the other findings
        forming = one.submit(inheritable_thread_target(t.spark)(components), t)
        found = findings(t, forming.result)
    label = forming.result()
    counted = {"claims": t.claims, "entities": t.entities, "relations": t.relations, "claim_links": t.claim_links, "components": label.select("component").distinct()}
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in counted.items()]
    n = reduce(DataFrame.unionByName, rows).unionByName(found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
    return n.select("kind", "n", (F.col("kind").isin("claims", "entities", "relations") & (F.col("n") > SCAN_LIMIT)).alias("over_scan_limit"))


@R.add("a14_scope_counts", COMPONENTS + "SELECT component, count(*) FILTER (scope = 'principle') AS principle, count(*) FILTER (scope = 'project') AS project, count(*) FILTER (scope = 'session') AS session FROM comp JOIN claims USING (id) GROUP BY 1", GRAPH_VIEWS)
def a14(t: Tables):
    counts = {s: F.count_if(F.col("scope") == s).alias(s) for s in ("principle", "project", "session")}
    return components(t).join(t.claims.select("id", "scope"), "id").groupBy("component").agg(*counts.values())


@R.add("j10_entity_steps", ENTITY + f" SELECT u, v, count(*) AS ways FROM ent WHERE {ASKED.format(c='u')} GROUP BY ALL", "relations claim_entities")
def j10(t: Tables):
    """From the claims whose number is divisible by 50."""
    return graph.entity_steps(asked_ids(t), t.claim_entities, t.relations).groupBy("u", "v").agg(F.count(F.lit(1)).alias("ways"))


@R.add("j12_entities_of_claims", "SELECT x.claim_id, e.id AS entity_id, e.type FROM claim_entities x JOIN entities e ON e.id = x.entity_id", "entities claim_entities")
def j12(t: Tables):
    return t.claim_entities.join(t.entities, F.col("entity_id") == F.col("id")).select("claim_id", "entity_id", "type")


@R.add("j14_inner_links", f"SELECT id, link_type FROM claim_links WHERE source_claim_id IN {OK} AND target_claim_id IN {OK}", "claims promotion_queue claim_links")
def j14(t: Tables):
    ok = filters.active(t.claims, t.promotion_queue).where(filters.one_of("scope", SCOPES)).select(F.col("id").alias("c"))
    l = t.claim_links
    return l.join(ok, l["source_claim_id"] == ok["c"], "left_semi").join(ok, l["target_claim_id"] == ok["c"], "left_semi").select("id", "link_type")


@R.add("j16_one_hop", "SELECT source_claim_id AS seed, target_claim_id AS other, link_type FROM claim_links UNION ALL SELECT target_claim_id, source_claim_id, link_type FROM claim_links", "claim_links")
def j16(t: Tables):
    return graph.symmetric(t.claim_links, "source_claim_id", "target_claim_id", "link_type").select(F.col("u").alias("seed"), F.col("v").alias("other"), "link_type")


@R.add("j17_shared_entities", """, g AS (SELECT entity_id, min(claim_id) AS representative, count(DISTINCT claim_id) AS n_claims FROM claim_entities GROUP BY 1 HAVING count(DISTINCT claim_id) > 1)
SELECT claim_id, entity_id, representative, n_claims FROM claim_entities JOIN g USING (entity_id)""", "claim_entities")
def j17(t: Tables):
    return graph.shared_entities(t.claim_entities)


@R.add("j18_missing_references", """SELECT id, src_id NOT IN (SELECT id FROM entities) AS src_missing, dst_id NOT IN (SELECT id FROM entities) AS dst_missing FROM relations""", "relations entities")
def j18(t: Tables):
    return referenced(t.relations, t.entities)
