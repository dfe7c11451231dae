"""Registered queries: exchange of record sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import exchange as E
from lodestone.plans.common import ACTIVE, Registry
from lodestone.sources.fixtures import Tables

R = Registry()
OUT = f"(SELECT c.id FROM claims c WHERE {ACTIVE} AND c.scope <> 'session' AND c.boundary_class <> 'secret')"


@R.add("y01_export_claims", f"SELECT id, scope, boundary_class FROM claims WHERE id IN {OUT}", "claims promotion_queue")
def y01(t: Tables):
    return E.exportable(t.claims, t.promotion_queue).select("id", "scope", "boundary_class")


@R.add("y01_export_entities", f"SELECT id, type FROM entities WHERE id IN (SELECT entity_id FROM claim_entities WHERE claim_id IN {OUT})", "claims promotion_queue entities claim_entities")
def y01e(t: Tables):
    return E.export_entities(t.entities, t.claim_entities, E.exportable(t.claims, t.promotion_queue)).select("id", "type")


@R.add("y01_export_relations", f""", e AS (SELECT entity_id FROM claim_entities WHERE claim_id IN {OUT}) SELECT id, type FROM relations WHERE src_id IN (SELECT entity_id FROM e) OR dst_id IN (SELECT entity_id FROM e)""", "claims promotion_queue claim_entities entities relations")
def y01r(t: Tables):
    entities = E.export_entities(t.entities, t.claim_entities, E.exportable(t.claims, t.promotion_queue))
    return E.export_relations(t.relations, entities).select("id", "type")


SEV = "list_position(['public', 'internal', 'pii', 'secret'], {c})"
#: Everything comes in twice, the second time in reverse order, with other classes, types, kinds and some tombstones.
IMPORT = f""", loc AS (SELECT *, sha256(text) AS hash FROM claims WHERE retrieval_count < 15 QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY id) = 1),
h AS (SELECT *, sha256(text) AS hash, CAST(substr(id, 5) AS BIGINT) AS n FROM claims),
inc AS (SELECT hash, CASE WHEN utility > 0.8 THEN 'session' ELSE 'project' END AS scope, CASE WHEN utility < 0.3 THEN 'pii' ELSE boundary_class END AS boundary_class, CASE WHEN utility > 0.5 THEN 'norm' ELSE memory_type END AS memory_type, kind, text, n AS seq, n % 13 = 5 AS tombstone FROM h
 UNION ALL SELECT hash, 'project', CASE n % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'pii' ELSE boundary_class END, CASE WHEN n % 3 = 0 THEN 'evidence' END, 'other', text || '~', 100000000 - n, false FROM h),
j AS (SELECT i.*, l.id AS lid, l.boundary_class AS old, l.memory_type AS old_type, l.id IN (SELECT c.id FROM claims c WHERE {ACTIVE}) AS alive,
 CASE WHEN i.scope = 'session' THEN 'skipped_scope' WHEN i.boundary_class = 'secret' THEN 'skipped_duplicate' WHEN i.tombstone THEN 'skipped_tombstone' END AS barred FROM inc i LEFT JOIN loc l ON l.hash = i.hash),
kk AS (SELECT *, row_number() OVER w AS turn, max({SEV.format(c='boundary_class')}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max({SEV.format(c='boundary_class')}) OVER (w ROWS UNBOUNDED PRECEDING) AS upto,
 first_value(memory_type IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS typed FROM j WHERE barred IS NULL WINDOW w AS (PARTITION BY hash ORDER BY seq)),
a AS (SELECT hash, barred AS action, boundary_class, memory_type, lid AS id, kind, seq FROM j WHERE barred IS NOT NULL
 UNION ALL SELECT hash, CASE WHEN lid IS NOT NULL AND NOT alive THEN 'skipped_duplicate' WHEN lid IS NULL AND turn = 1 THEN 'new' WHEN {SEV.format(c='boundary_class')} > greatest(coalesce(before, 0), coalesce({SEV.format(c='old')}, 0)) THEN 'upgraded_boundary' ELSE 'skipped_duplicate' END,
 CASE WHEN lid IS NOT NULL AND NOT alive THEN old ELSE ['public', 'internal', 'pii', 'secret'][greatest(upto, coalesce({SEV.format(c='old')}, 0))] END, CASE WHEN lid IS NOT NULL AND NOT alive THEN old_type ELSE coalesce(old_type, typed) END, coalesce(lid, 'clm_' || hash), kind, seq FROM kk)
"""


def incoming_claims(t: Tables):
    n = F.substring("id", 5, 20).cast("long")
    h = t.claims.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256)).withColumn("n", n)
    memory = F.when(F.col("utility") > 0.5, "norm").otherwise(F.col("memory_type"))
    once = h.select("hash", "text", "kind", F.when(F.col("utility") > 0.8, "session").otherwise("project").alias("scope"), F.when(F.col("utility") < 0.3, "pii").otherwise(F.col("boundary_class")).alias("boundary_class"), memory.alias("memory_type"), F.col("n").alias("seq"), (F.col("n") % 13 == 5).alias("tombstone"))
    turned = F.when(F.col("n") % 4 == 0, "public").when(F.col("n") % 4 == 1, "internal").when(F.col("n") % 4 == 2, "pii").otherwise(F.col("boundary_class"))
    again = h.select("hash", F.concat("text", F.lit("~")).alias("text"), F.lit("other").alias("kind"), F.lit("project").alias("scope"), turned.alias("boundary_class"), F.when(F.col("n") % 3 == 0, "evidence").alias("memory_type"), (F.lit(100_000_000) - F.col("n")).alias("seq"), F.lit(False).alias("tombstone"))
    return once.unionByName(again)


def local_claims(t: Tables):
    some = t.claims.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256)).where("retrieval_count < 15")
    return some.join(some.groupBy("hash").agg(F.min("id").alias("id")), ["hash", "id"], "left_semi")


def imported(t: Tables):
    return E.import_claims(incoming_claims(t), local_claims(t), t.promotion_queue, ["seq"])


@R.add("y02_import_claims", IMPORT + "SELECT hash, action, boundary_class, memory_type, id FROM a", "claims promotion_queue")
def y02(t: Tables):
    return imported(t)


@R.add("y02_inserted_claims", IMPORT + f"""SELECT 'clm_' || hash AS id, hash, first(kind ORDER BY seq) AS kind, ['public', 'internal', 'pii', 'secret'][max({SEV.format(c='boundary_class')})] AS boundary_class, first(memory_type ORDER BY seq) FILTER (memory_type IS NOT NULL) AS memory_type,
 sha256(first(text ORDER BY seq)) AS text, 'active' AS status, CAST(0.5 AS DOUBLE) AS confidence FROM kk WHERE lid IS NULL GROUP BY hash""", "claims promotion_queue")
def y02i(t: Tables):
    new = E.inserted_claims(incoming_claims(t), local_claims(t), t.promotion_queue, ["seq"])
    return new.select("id", "hash", "kind", "boundary_class", "memory_type", F.sha2(F.col("text").cast("binary"), 256).alias("text"), "status", "confidence")


@R.add("y05_dry_run_counts", IMPORT + "SELECT action, count(*) AS n FROM a GROUP BY 1", "claims promotion_queue")
def y05(t: Tables):
    return imported(t).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


LOCAL_E = "(type <> 'Artifact')"


def entities_in(t: Tables):
    """Local entities without artifacts, and all entities coming in: the concepts under new names, every seventh row's attributes in another key order."""
    rows = t.entity_rows
    turned = F.concat(F.lit('{"tags":'), F.get_json_object("attrs", "$.tags"), F.lit(', "n": '), F.get_json_object("attrs", "$.n"), F.lit("}"))
    changed = F.when(F.col("type") == "Event", F.lit('{"n":99}')).otherwise(turned)
    incoming = rows.withColumn("name", F.when(F.col("type") == "Concept", F.concat("name", F.lit("!"))).otherwise(F.col("name"))).withColumn("attrs", changed)
    return incoming, rows.where("type <> 'Artifact'")


@R.add("y03_import_entities", "SELECT id, CASE type WHEN 'Artifact' THEN 'new' WHEN 'Actor' THEN 'skipped_duplicate' ELSE 'entity_content_diff' END AS action FROM entity_rows", "entity_rows")
def y03(t: Tables):
    """Key order is no difference, other values are."""
    return E.import_entities(*entities_in(t))


RELATIONS_IN = """, k AS (SELECT id FROM entities WHERE id NOT LIKE 'part%7'), rr AS (SELECT id, type, CAST(json_extract_string(props, '$.w') AS INT) AS w, src_id IN (SELECT id FROM k) AND dst_id IN (SELECT id FROM k) AS whole FROM relation_rows),
ra AS (SELECT id, CASE WHEN NOT whole THEN 'missing_reference' WHEN w = 0 THEN 'new' WHEN w = 1 THEN 'relation_content_diff' ELSE 'skipped_duplicate' END AS action FROM rr)"""


def relations_in(t: Tables):
    """A fifth of the relations is not there yet, another fifth has other properties; artifacts that end in 7 are unknown."""
    rows = t.relation_rows
    w = F.get_json_object("props", "$.w").cast("int")
    incoming = rows.withColumn("props", F.when(w == 1, F.lit('{"w":7}')).otherwise(F.col("props")))
    return E.import_relations(incoming, rows.where(w != 0), t.entities.where("id not like 'part%7'"))


@R.add("y03_import_relations", RELATIONS_IN + "SELECT id, action FROM ra", "relation_rows entities")
def y03r(t: Tables):
    return relations_in(t)


@R.add("y04_conflicts", IMPORT.rstrip() + RELATIONS_IN + """, cf AS (SELECT 'boundary_upgrade' AS type, hash AS id FROM a WHERE action = 'upgraded_boundary' UNION ALL SELECT 'entity_content_diff', id FROM entity_rows WHERE type IN ('Concept', 'Event')
 UNION ALL SELECT action, id FROM ra WHERE action IN ('missing_reference', 'relation_content_diff'))
SELECT type, resolution, count(*) AS n, min(id) AS first FROM (SELECT *, CASE WHEN type = 'boundary_upgrade' THEN 'auto_resolved' ELSE 'skipped' END AS resolution FROM cf) GROUP BY ALL""", "claims promotion_queue entity_rows relation_rows entities")
def y04(t: Tables):
    c = E.conflicts(imported(t), E.import_entities(*entities_in(t)), relations_in(t))
    return c.groupBy("type", "resolution").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@R.add("y06_exported_documents", """SELECT id, json_object('text', text, 'kind', kind, 'scope', scope, 'boundary_class', boundary_class) AS document FROM claims WHERE memory_type IS NULL
UNION ALL SELECT id, json_object('text', text, 'kind', kind, 'scope', scope, 'boundary_class', boundary_class, 'memory_type', memory_type) FROM claims WHERE memory_type IS NOT NULL""", "claims")
def y06(t: Tables):
    rows = t.claims.select(F.lit(None).cast("string").alias("content_hash"), "text", "kind", "scope", "boundary_class", "memory_type", "id")
    return rows.select("id", E.claim_document().alias("document"))


@R.add("y06_entity_round_trip", "SELECT id, type, name, canonical_key, attrs, CAST(json_extract_string(attrs, '$.n') AS INTEGER) AS n FROM entity_rows", "entity_rows")
def y06e(t: Tables):
    """Entities written as documents and read back: nothing is lost, nested attributes are JSON again."""
    back = E.imported_documents(E.exported_entities(t.entity_rows), "id string, type string, name string, canonical_key string, attrs string")
    return back.select("*", F.get_json_object("attrs", "$.n").cast("int").alias("n"))


@R.add("y06_relation_round_trip", "SELECT id, src_id, dst_id, type, props FROM relation_rows", "relation_rows")
def y06r(t: Tables):
    return E.imported_documents(E.exported_relations(t.relation_rows), "id string, src_id string, dst_id string, type string, props string")


@R.add("u05_grow_only_union", "SELECT id, CASE WHEN type = 'PLACED' THEN 'old' ELSE 'a' END AS note FROM relation_rows", "relation_rows")
def u05(t: Tables):
    """Everything comes in twice, and what is there already under another note: existing rows stay, new ones come once."""
    r = t.relation_rows.select("id", "type")
    incoming = r.select("id", F.lit("b").alias("note")).union(r.select("id", F.lit("a").alias("note")))
    return E.grow(r.where("type = 'PLACED'").select("id", F.lit("old").alias("note")), incoming)


CLASS_OF = "CASE (n + {k}) % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'pii' ELSE boundary_class END"
REPLICAS = " UNION ALL ".join(
    f"SELECT hash, text, CASE WHEN n % {k + 2} = 0 THEN 'fact' ELSE kind END AS kind, scope, {CLASS_OF.format(k=k)} AS boundary_class, CASE WHEN (n + {k}) % 3 = 0 THEN memory_type END AS memory_type, created_at + INTERVAL '1' DAY * CAST((n * {k + 1}) % 7 AS INT) AS created_at FROM h WHERE n % 5 <> {k}"
    for k in range(5)
)


def replicas(t: Tables):
    """Five replicas: each lacks a fifth of the claims and has other classes, kinds, types and times."""
    n = F.substring("id", 5, 20).cast("long")
    h = t.claims.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256)).withColumn("n", n)
    parts = []
    for k in range(5):
        days = F.make_dt_interval(((F.col("n") * (k + 1)) % 7).cast("int"))
        parts.append(h.where(F.col("n") % 5 != k).select("hash", "text", F.when(F.col("n") % (k + 2) == 0, "fact").otherwise(F.col("kind")).alias("kind"), "scope", F.expr(CLASS_OF.format(k=k)).alias("boundary_class"), F.when((F.col("n") + k) % 3 == 0, F.col("memory_type")).alias("memory_type"), (F.col("created_at") + days).alias("created_at")))
    return parts


@R.add("u05_merged_replicas", f""", h AS (SELECT *, sha256(text) AS hash, CAST(substr(id, 5) AS BIGINT) AS n FROM claims), u AS (SELECT DISTINCT * FROM ({REPLICAS}))
SELECT hash, sha256(first(text ORDER BY created_at, text, kind, scope)) AS text, first(kind ORDER BY created_at, text, kind, scope) AS kind, first(scope ORDER BY created_at, text, kind, scope) AS scope,
 ['public', 'internal', 'pii', 'secret'][max({SEV.format(c='boundary_class')})] AS boundary_class, first(memory_type ORDER BY created_at, memory_type) FILTER (memory_type IS NOT NULL) AS memory_type, count(*) AS copies FROM u GROUP BY hash""", "claims")
def u05r(t: Tables):
    return E.merge_replicas(replicas(t)).withColumn("text", F.sha2(F.col("text").cast("binary"), 256))
