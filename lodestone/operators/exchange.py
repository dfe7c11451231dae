"""Merging exported record sets: grow-only unions, conflict reports and export filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.documents import stable_json
from lodestone.operators.filters import active
from lodestone.runtime import materialize, spread_join

# Fixed order of boundary classes, from open to closed.
CLASSES = ["public", "internal", "pii", "secret"]


def severity(boundary_class: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CLASSES]), boundary_class)


def class_at(level: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(c) for c in CLASSES]), (level - 1).cast("int")), F.lit("internal"))


def strictest(col: str) -> Column:
    """Aggregate: the most restrictive class; internal if there is none."""
    return class_at(F.max(severity(F.col(col))))


def stricter(a: Column, b: Column) -> Column:
    """Join of two classes: associative, commutative, idempotent."""
    return class_at(F.greatest(severity(a), severity(b)))


def referenced(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Which ends of each relation are missing among the entities."""
    known = entities.select(F.col("id").alias("k")).distinct()
    s = known.select(F.col("k").alias("src_id"), F.lit(True).alias("s"))
    d = known.select(F.col("k").alias("dst_id"), F.lit(True).alias("d"))
    rows = relations.join(s, "src_id", "left").join(d, "dst_id", "left")
    return rows.select("id", F.col("s").isNull().alias("src_missing"), F.col("d").isNull().alias("dst_missing"))


def exportable(claims: DataFrame, queue: DataFrame) -> DataFrame:
    """Active claims that may leave: no session scope, no secrets."""
    return active(claims, queue).where((F.col("scope") != "session") & (F.col("boundary_class") != "secret"))


def export_entities(entities: DataFrame, claim_entities: DataFrame, exported: DataFrame) -> DataFrame:
    """Entities attached to an exported claim."""
    held = claim_entities.join(exported.select(F.col("id").alias("claim_id")), "claim_id", "left_semi").select(F.col("entity_id").alias("id"))
    return entities.join(held, "id", "left_semi")


def export_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with either end among the exported entities."""
    e = entities.select(F.col("id").alias("e")).distinct()
    s, d = e.select(F.col("e").alias("src_id"), F.lit(True).alias("s")), e.select(F.col("e").alias("dst_id"), F.lit(True).alias("d"))
    rows = relations.join(s, "src_id", "left").join(d, "dst_id", "left")
    return rows.where(F.coalesce("s", "d", F.lit(False))).select(*relations.columns)


def _admitted(boundary: tuple[str, ...], columns: list[str]) -> Column:
    """What keeps a record out before anything is compared, or null."""
    gone = F.coalesce("tombstone", F.lit(False)) if "tombstone" in columns else F.lit(False)
    return F.when(F.col("scope") == "session", "skipped_scope").when(~F.col("boundary_class").isin(*boundary), "skipped_duplicate").when(gone, "skipped_tombstone")


def _states(incoming: DataFrame, local: DataFrame, queue: DataFrame, order: list[str], boundary: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Incoming rows with their place ``at`` and what keeps them out (``barred``), and one row for each of their hashes.

    Places of the first row of each severity tell what any row found when it came: a few levels, so a few minima do.
    """
    rows = incoming.withColumn("barred", _admitted(boundary, incoming.columns)).withColumn("at", F.struct(*order, "boundary_class", "memory_type"))
    level, at = severity(F.col("boundary_class")), F.when(F.col("barred").isNull(), F.col("at"))
    typed = F.when(F.col("memory_type").isNotNull(), at)
    fresh = F.struct(*[c for c in ("text", "kind", "scope", "status", "provenance") if c in incoming.columns])
    sums = rows.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.min_by(fresh, at).alias("given"), F.max(F.when(at.isNotNull(), level)).alias("top"),
        *[F.min(F.when(level >= k, at)).alias(f"at{k}") for k in range(1, len(CLASSES) + 1)], F.min(typed).alias("at_type"), F.min_by("memory_type", typed).alias("new_type"),
    )
    alive = active(local, queue).select("id", F.lit(True).alias("alive"))
    have = local.join(alive, "id", "left").groupBy("hash").agg(F.min_by(F.struct("id", "boundary_class", "memory_type", "alive"), F.struct(F.col("alive").isNull(), "id")).alias("old"))
    return rows, sums.join(have, "hash", "left")


def import_claims(incoming: DataFrame, local: DataFrame, queue: DataFrame, order: list[str], boundary: tuple[str, ...] = ("public", "internal", "pii")) -> DataFrame:
    """(hash, action, boundary_class, memory_type, id) of incoming claims (hash, scope, boundary_class, memory_type, ``order``) against local ones.

    Rows come one after another in ``order`` (ties by class and type), each to what those before left: skipped_scope (session),
    skipped_duplicate (class not in ``boundary``, or nothing to raise, or an inactive claim has the hash), skipped_tombstone (where incoming rows
    have such a mark), upgraded_boundary, or new. Class and type are those of the claim after the row; a class only ever gets
    stricter, a type is filled in only where there is none. A new claim's id holds the whole hash. A row that is kept out changes nothing
    and has its own class and type, and the id of the claim, if there is one.
    """
    rows, states = _states(incoming, local, queue, order, boundary)
    states = materialize(states.drop("given", "top"), "states")
    x = spread_join(rows.select("hash", "at", "barred", F.col("boundary_class").alias("own"), F.col("memory_type").alias("own_type")), states, ["hash"], "n", "at")
    at, level = F.col("at"), severity(F.col("own"))
    base = F.coalesce(severity(F.col("old.boundary_class")), F.lit(0))
    # The strictest level that a row up to this one had.
    reached = F.greatest(base, *[F.when(F.col(f"at{k}") <= at, F.lit(k)).otherwise(F.lit(0)) for k in range(1, len(CLASSES) + 1)])
    raised = (level > base) & (F.element_at(F.array(*[F.col(f"at{k}") for k in range(1, len(CLASSES) + 1)]), level.cast("int")) == at)
    dead = F.col("old").isNotNull() & F.col("old.alive").isNull()
    barred = F.col("barred").isNotNull()
    action = (
        F.when(barred, F.col("barred")).when(dead, "skipped_duplicate").when(F.col("old").isNull() & (at == F.col("first")), "new")
        .when(raised, "upgraded_boundary").otherwise("skipped_duplicate")
    )
    cls = F.when(barred, F.col("own")).when(dead, F.col("old.boundary_class")).otherwise(class_at(reached))
    filled = F.coalesce("old.memory_type", F.when(F.col("at_type") <= at, F.col("new_type")))
    memory = F.when(barred, F.col("own_type")).when(dead, F.col("old.memory_type")).otherwise(filled)
    fresh = F.when(~barred, F.concat(F.lit("clm_"), "hash"))
    return x.select("hash", action.alias("action"), cls.alias("boundary_class"), memory.alias("memory_type"), F.coalesce("old.id", fresh).alias("id"))


def inserted_claims(incoming: DataFrame, local: DataFrame, queue: DataFrame, order: list[str], boundary: tuple[str, ...] = ("public", "internal", "pii")) -> DataFrame:
    """The claims that an import inserts, as they are after its last row: the first row's fields, the strictest class, the first memory type."""
    _, states = _states(incoming, local, queue, order, boundary)
    new = states.where("old is null and first is not null").select(F.concat(F.lit("clm_"), "hash").alias("id"), "hash", "given.*", class_at(F.col("top")).alias("boundary_class"), F.col("new_type").alias("memory_type"))
    status = F.coalesce("status", F.lit("active")) if "status" in new.columns else F.lit("active")
    return new.withColumn("status", status).select("*", F.lit(0.0).alias("utility"), F.lit(0.5).alias("confidence"), F.lit(0).alias("retrieval_count"))


def merge_replicas(replicas: list[DataFrame]) -> DataFrame:
    """(hash, text, kind, scope, boundary_class, memory_type, copies) of any number of replicas of a claim set, merged at once.

    Existence only grows; the class is the strictest of all; the memory type is that of the earliest copy that has one; text, kind and scope are the
    earliest copy's (created_at, then the values themselves). Each part is a least upper bound, so neither the order of the replicas nor a
    repeated one matters; ``copies`` counts different rows.
    """
    fields = ["hash", "text", "kind", "scope", "boundary_class", "memory_type", "created_at"]
    rows = reduce(DataFrame.unionByName, [r.select(*fields) for r in replicas])
    # Texts are moved once, for the earliest copy; different rows are told apart by the digest.
    first = rows.groupBy("hash").agg(F.min(F.struct("created_at", "text", "kind", "scope")).alias("first"))
    merged = rows.withColumn("text", F.sha2(F.col("text").cast("binary"), 256)).distinct().groupBy("hash").agg(
        strictest("boundary_class").alias("boundary_class"),
        F.min_by("memory_type", F.when(F.col("memory_type").isNotNull(), F.struct("created_at", "memory_type"))).alias("memory_type"), F.count(F.lit(1)).alias("copies"),
    )
    return first.withColumnRenamed("hash", "h").join(merged, F.col("h").eqNullSafe(F.col("hash"))).select("hash", "first.text", "first.kind", "first.scope", "boundary_class", "memory_type", "copies")


def claim_document() -> Column:
    """A claim as an exchange document: no id, scores or times; nulls are left out."""
    return F.to_json(F.struct("text", "kind", "scope", "boundary_class", "memory_type", "content_hash"))


def exported_entities(entities: DataFrame) -> DataFrame:
    """(id, document) of entities; nulls are left out, attrs are nested as JSON."""
    attrs = F.try_parse_json("attrs").alias("attrs")
    return entities.select("id", F.to_json(F.struct("id", "type", "name", "canonical_key", attrs)).alias("document"))


def exported_relations(relations: DataFrame) -> DataFrame:
    props = F.try_parse_json("props").alias("props")
    return relations.select("id", F.to_json(F.struct("id", "src_id", "dst_id", "type", props)).alias("document"))


def imported_documents(documents: DataFrame, schema: str) -> DataFrame:
    """Columns of exchange documents (id, document); a nested object stays JSON text, an unreadable one gives nulls."""
    return documents.select(F.from_json("document", schema).alias("d")).select("d.*")


def _content_diff(incoming: DataFrame, local: DataFrame, plain: list[str], nested: str) -> DataFrame:
    """Incoming rows with their action: new, skipped_duplicate, or diff if any field differs (key order aside)."""
    old = local.select("id", F.struct(*plain, nested).alias("old"))
    rows = incoming.join(old, "id", "left")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"old.{c}")) for c in plain])
    a, b = F.col(nested), F.col(f"old.{nested}")
    # Only documents whose texts differ go to a Python worker to have their keys sorted.
    unlike = F.col("old").isNotNull() & same & ~a.eqNullSafe(b)
    sorted_a, sorted_b = (F.coalesce(stable_json(F.when(unlike, x)), F.lit("{}")) for x in (a, b))
    action = F.when(F.col("old").isNull(), "new").when(same & (a.eqNullSafe(b) | (sorted_a == sorted_b)), "skipped_duplicate").otherwise("diff")
    return rows.withColumn("diff", action).drop("old")


def import_entities(incoming: DataFrame, local: DataFrame) -> DataFrame:
    """(id, action) of incoming entities (id, type, name, canonical_key, attrs): existing ones win, a differing one is reported and left alone."""
    rows = _content_diff(incoming, local, ["type", "name", "canonical_key"], "attrs")
    return rows.select("id", F.when(F.col("diff") == "diff", "entity_content_diff").otherwise(F.col("diff")).alias("action"))


def import_relations(incoming: DataFrame, local: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, action) of incoming relations (id, src_id, dst_id, type, props) after the entities came in: both ends must exist."""
    # Rows meet the local ones first, while both lie by id; after that only ends and actions are moved, and each row once.
    rows = _content_diff(incoming, local, ["src_id", "dst_id", "type"], "props").select("id", "src_id", "dst_id", "diff")
    known = entities.select(F.col("id").alias("k")).distinct()
    for end in ("src_id", "dst_id"):
        rows = rows.join(known.select(F.col("k").alias(end), F.lit(True).alias(f"has_{end}")), end, "left")
    missing = F.col("has_src_id").isNull() | F.col("has_dst_id").isNull()
    action = F.when(missing, "missing_reference").when(F.col("diff") == "diff", "relation_content_diff").otherwise(F.col("diff"))
    return rows.select("id", action.alias("action"))


# How each kind of conflict is settled.
RESOLUTION = {"boundary_upgrade": "auto_resolved", "entity_content_diff": "skipped", "relation_content_diff": "skipped", "missing_reference": "skipped"}


def conflicts(claims: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(type, id, resolution): what an import of claims, entities and relations (id or hash, action) ran into."""
    found = claims.where("action = 'upgraded_boundary'").select(F.lit("boundary_upgrade").alias("type"), F.col("hash").alias("id"))
    for rows in (entities, relations):
        found = found.unionByName(rows.where(F.col("action").isin(*RESOLUTION)).select(F.col("action").alias("type"), "id"))
    resolution = F.create_map(*[F.lit(x) for pair in RESOLUTION.items() for x in pair])
    return found.withColumn("resolution", F.try_element_at(resolution, F.col("type")))


def grow(local: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Grow-only union: existing rows win unchanged, new keys are added once (the smallest of several)."""
    fresh = incoming.join(local.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(*local.columns)).alias("r"))
    return local.unionByName(fresh.select("r.*"))
