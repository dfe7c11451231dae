"""Walks, impact and audits over the claim graph and the entity graph."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.components import connected_components
from lodestone.runtime import discard, materialize, small, spread_join

# Fixed values of the edge policy: weight of each link type and of a path over related entities.
LINK_WEIGHT = {"supports": 0.9, "extends": 0.7, "related": 0.35, "contradicts": 0.15, "supersedes": 1.0}
FORWARD = ("supports", "extends")
BOTH_WAYS = ("related", "contradicts")
ENTITY_WEIGHT = 0.45
HOP_DECAY = 0.75
#: The steps of a way, from its start.
SEGMENTS = "array<struct<source:string,from_claim:string,to_claim:string,weight:double,edge:string>>"


def kind_of(link_type: Column) -> Column:
    return F.when(link_type == "contradicts", "conflict").when(link_type == "supersedes", "supersession").otherwise("support")


def weight_of(link_type: Column) -> Column:
    out = F.lit(0.0)
    for name, w in LINK_WEIGHT.items():
        out = F.when(link_type == name, F.lit(w)).otherwise(out)
    return out


def symmetric(edges: DataFrame, a: str, b: str, *keep: str) -> DataFrame:
    """Both orientations as (u, v)."""
    return edges.select(F.col(a).alias("u"), F.col(b).alias("v"), *keep).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"), *keep))


def _hops(relations: DataFrame, held: DataFrame) -> DataFrame:
    """(u, v, id): relations from the materialised entities ``held`` (u), either way round; a self-relation once.

    Where the entities are small enough for a broadcast, the relations are scanned once for both ways.
    """
    near = small(held)
    if near is held:
        ahead = relations.join(held, F.col("src_id") == F.col("u"), "left_semi").select(F.col("src_id").alias("u"), F.col("dst_id").alias("v"), "id")
        back = relations.join(held, F.col("dst_id") == F.col("u"), "left_semi").select(F.col("dst_id").alias("u"), F.col("src_id").alias("v"), "id")
        return ahead.unionByName(back).distinct()
    mine = {c: F.broadcast(held.select(F.col("u").alias(f"_{c}"))) for c in ("src", "dst")}
    met = relations.join(mine["src"], F.col("src_id") == F.col("_src"), "left").join(mine["dst"], F.col("dst_id") == F.col("_dst"), "left").where("_src is not null or _dst is not null")
    ways = F.array(F.when(F.col("_src").isNotNull(), F.struct(F.col("_src").alias("u"), F.col("dst_id").alias("v"))), F.when(F.col("_dst").isNotNull(), F.struct(F.col("_dst").alias("u"), F.col("src_id").alias("v"))))
    return met.select("id", F.explode(ways).alias("way")).where("way is not null").select("way.u", "way.v", "id").distinct()


def entity_steps(ids: DataFrame, claim_entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(u, v, edge): from each claim of ``ids`` over one relation between entities to other claims; self-relations included once.

    Starts from the claims asked for: their entities, the relations of those, the entities beyond, their claims.
    """
    here = claim_entities.join(ids.select(F.col("id").alias("claim_id")), "claim_id", "left_semi").select(F.col("claim_id").alias("from_claim"), F.col("entity_id").alias("u")).distinct()
    held = materialize(here.select("u").distinct(), "entities")
    hops = materialize(_hops(relations, held), "hops")
    # Only the entities beyond are looked up; the semi-join goes below a DISTINCT of the table.
    beyond = small(materialize(hops.select("v").distinct(), "beyond"))
    there = claim_entities.join(beyond, F.col("entity_id") == F.col("v"), "left_semi").select(F.col("claim_id").alias("to_claim"), F.col("entity_id").alias("v"))
    steps = hops.join(here, "u").join(there, "v").where(F.col("from_claim") != F.col("to_claim"))
    return steps.select(F.col("from_claim").alias("u"), F.col("to_claim").alias("v"), F.col("id").alias("edge"))


def walk_steps(links: DataFrame) -> DataFrame:
    """Links oriented by policy: (u, v, edge, weight, kind). Superseded claims lead to what replaced them."""
    l = links.withColumn("weight", weight_of(F.col("link_type")) * F.col("confidence")).withColumn("kind", kind_of(F.col("link_type")))
    ahead = l.where(F.col("link_type").isin(*FORWARD, *BOTH_WAYS)).select(F.col("source_claim_id").alias("u"), F.col("target_claim_id").alias("v"), F.col("id").alias("edge"), "weight", "kind")
    back = l.where(F.col("link_type").isin(*BOTH_WAYS, "supersedes")).select(F.col("target_claim_id").alias("u"), F.col("source_claim_id").alias("v"), F.col("id").alias("edge"), "weight", "kind")
    return ahead.unionByName(back)


def steps_from(ids: DataFrame, oriented: DataFrame, claim_entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(u, v, edge, weight, kind, source) of all steps from the claims of the materialised ``ids``: links as oriented, and entity steps."""
    own = oriented.join(small(ids), F.col("u") == F.col("id"), "left_semi").select("u", "v", "edge", "weight", "kind", F.lit("claim_links").alias("source"))
    ent = entity_steps(small(ids), claim_entities, relations)
    return own.unionByName(ent.select("u", "v", "edge", F.lit(ENTITY_WEIGHT).alias("weight"), F.lit("support").alias("kind"), F.lit("entity_graph").alias("source")))


@dataclass
class Walk:
    """What a walk met: ``ways`` has one row for each admitted step (id, seed, via, edge, kind, depth, path_score, path, segments)."""

    ways: DataFrame

    def derived(self) -> DataFrame:
        """The best way to each claim, the earlier at a tie; then by seed, way and edge."""
        last = Window.partitionBy("id").orderBy(F.desc("path_score"), "depth", "seed", "via", "edge")
        return self.ways.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")

    def shadowed(self) -> DataFrame:
        """(id): claims from which a step led to what supersedes them."""
        return self.ways.where("kind = 'supersession'").select(F.col("via").alias("id")).distinct()

    def conflicts(self) -> DataFrame:
        """(seed, id, via): contradicting claims met on the ways of each seed."""
        return self.ways.where("kind = 'conflict'").select("seed", "id", "via").distinct()


def walk(seeds: DataFrame, links: DataFrame, claim_entities: DataFrame, relations: DataFrame, allowed: DataFrame, hops: int = 2, decay: float = HOP_DECAY) -> Walk:
    """Ways from the seeds (id, score) over links and entity steps to allowed claims within ``hops`` steps.

    Each hop expands only its frontier. A conflict is reported but not walked on. Of a hop's ways to a
    claim the best goes on. Scores are the seed's times all weights and the decay of each hop, to six places.
    """
    oriented, ok = walk_steps(links), allowed.select("id")
    start = seeds.select("id", F.col("id").alias("seed"), F.col("score").alias("seed_score"), F.lit(1.0).alias("product"), F.array("id").alias("path"), F.array().cast(SEGMENTS).alias("segments"))
    frontier = materialize(start, "frontier")
    best = Window.partitionBy("id").orderBy(F.desc("path_score"), "seed", "via", "edge")
    found = []
    for hop in range(1, hops + 1):
        steps = steps_from(materialize(frontier.select("id").distinct(), "ids"), oriented, claim_entities, relations)
        segment = F.struct("source", F.col("u").alias("from_claim"), F.col("v").alias("to_claim"), "weight", "edge")
        out = steps.join(small(frontier), F.col("id") == F.col("u")).where(~F.array_contains("path", F.col("v")))
        out = out.select(
            F.col("v").alias("id"), "seed", "seed_score", F.col("u").alias("via"), "edge", "kind", F.lit(hop).alias("depth"),
            (F.col("product") * F.col("weight")).alias("product"), F.concat("path", F.array("v")).alias("path"), F.concat("segments", F.array(segment)).alias("segments"),
        ).join(ok, "id", "left_semi")
        out = materialize(out.withColumn("path_score", F.round(F.col("seed_score") * F.col("product") * decay**hop, 6)), "walk")
        found.append(out)
        if hop < hops:
            onward = out.where("kind <> 'conflict'").withColumn("rn", F.row_number().over(best)).where("rn = 1")
            frontier = materialize(onward.select("id", "seed", "seed_score", "product", "path", "segments"), "frontier")
    return Walk(reduce(DataFrame.unionByName, found))


def merge_walk(found: DataFrame, walked: Walk, claims: DataFrame) -> DataFrame:
    """Search results (id, score, created_at) after a walk from them: shadowed ones leave, derived ones join.

    Adds source (search, claim_link, topology), path_score, depth, kind and the number of conflicts of each seed.
    A result that was also reached keeps its score and takes the way. Derived claims have their path score.
    """
    d = walked.derived().select("id", F.col("path_score").alias("way_score"), "kind", "depth", F.when(F.forall("segments", lambda s: s["source"] == "claim_links"), "claim_link").otherwise("topology").alias("way"))
    conflicts = walked.conflicts().groupBy(F.col("seed").alias("id")).agg(F.count(F.lit(1)).alias("conflicts"))
    at = claims.join(d.select("id"), "id", "left_semi").select("id", F.col("created_at").alias("known_at"))
    rows = found.withColumn("found", F.lit(True)).join(walked.shadowed(), "id", "left_anti").join(d, "id", "full_outer").join(at, "id", "left").join(conflicts, "id", "left")
    # A shadowed result that was reached as well comes back as a derived claim.
    return rows.select(
        "id", F.coalesce("score", "way_score").alias("score"), F.coalesce("created_at", "known_at").alias("created_at"),
        F.when(F.col("found"), "search").otherwise(F.col("way")).alias("source"), F.col("way_score").alias("path_score"), "kind", "depth",
        F.when(F.col("found"), F.coalesce("conflicts", F.lit(0))).otherwise(0).alias("conflicts"),
    )


@dataclass
class Blast:
    """What a rollback reaches: ``proposals`` has one row for each step taken (root, id, kind, score, depth, source, segments)."""

    proposals: DataFrame

    def best(self, *by: str) -> DataFrame:
        """The best proposal of each root and claim (and of each further column), the nearer at a tie."""
        over = Window.partitionBy("root", "id", *by).orderBy(F.desc("score"), "depth", "kind", "via", "edge")
        return self.proposals.withColumn("rn", F.row_number().over(over)).where("rn = 1").drop("rn")


def blast_radius(roots: DataFrame, links: DataFrame, claim_entities: DataFrame, relations: DataFrame, claims: DataFrame, hops: int = 2, decay: float = HOP_DECAY) -> Blast:
    """Claims within reach of each root over links either way and entity steps, expanding only each hop's frontier.

    Scores decay at each hop; a claim is walked on from only where its score has become strictly better.
    """
    l = links.withColumn("weight", weight_of(F.col("link_type")) * F.col("confidence")).withColumn("kind", kind_of(F.col("link_type"))).withColumnRenamed("id", "edge")
    oriented = symmetric(l, "source_claim_id", "target_claim_id", "edge", "weight", "kind")
    known = claims.select("id")
    start = roots.select(F.col("id").alias("root"), "id", F.lit(1.0).alias("score"), F.array().cast(SEGMENTS).alias("segments"))
    frontier = materialize(start, "frontier")
    reached = frontier.select("root", "id", "score")
    found = None
    for hop in range(1, hops + 1):
        steps = steps_from(materialize(frontier.select("id").distinct(), "ids"), oriented, claim_entities, relations)
        segment = F.struct(F.col("step").alias("source"), F.col("u").alias("from_claim"), F.col("v").alias("to_claim"), "weight", "edge")
        out = steps.withColumnRenamed("source", "step").join(small(frontier), F.col("id") == F.col("u")).where(F.col("v") != F.col("root"))
        out = out.select("root", F.col("v").alias("id"), "kind", (F.col("score") * F.col("weight") * decay).alias("score"), F.lit(hop).alias("depth"), F.col("u").alias("via"), "edge", F.col("step").alias("source"), F.concat("segments", F.array(segment)).alias("segments"))
        # Of a hop's steps to a claim the best of each kind can matter.
        best = Window.partitionBy("root", "id", "kind").orderBy(F.desc("score"), "via", "edge")
        out = out.join(known, "id", "left_semi").withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")
        out = materialize(out, "blast")
        found = out if found is None else found.unionByName(out)
        if hop < hops:
            top = out.groupBy("root", "id").agg(F.max(F.struct("score", "segments")).alias("b")).select("root", "id", F.col("b.score").alias("score"), F.col("b.segments").alias("segments"))
            before = reached.groupBy("root", "id").agg(F.max("score").alias("old"))
            frontier = materialize(top.join(before, ["root", "id"], "left").where(F.col("score") > F.coalesce("old", F.lit(0.0))).select("root", "id", "score", "segments"), "frontier")
            reached = reached.unionByName(top.select("root", "id", "score"))
    return Blast(found)


def _contexts_of(reach: DataFrame, held: DataFrame) -> DataFrame:
    """(root, contexts): how many contexts hold a claim of ``reach`` (root, claim_id); only the two names of a pair are moved."""
    pairs = reach.join(held.select("claim_id", "active_context_id").distinct(), "claim_id").select("root", "active_context_id").distinct()
    return pairs.groupBy("root").agg(F.count("active_context_id").alias("contexts"))


def affected_contexts(blast: DataFrame, items: DataFrame, layer: Column) -> DataFrame:
    """(root, contexts, items, claims, layers, best) of the contexts that hold a claim in reach of a root.

    ``layer`` is an expression over an item; null is "unknown". A score that is no finite number counts as 0.
    """
    score = F.coalesce(F.when(F.abs("score") < float("inf"), F.col("score")), F.lit(0.0))
    held = items.withColumn("layer", F.coalesce(layer, F.lit("unknown"))).withColumn("score", score)
    # All but the number of contexts comes from one row for each claim.
    reach = materialize(blast.select("root", F.col("id").alias("claim_id")).distinct(), "reach")
    by_claim = held.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("layer").alias("layers"), F.max("score").alias("best"))
    sums = reach.join(by_claim, "claim_id").groupBy("root").agg(
        F.sum("n").alias("items"), F.count(F.lit(1)).alias("claims"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("layers")))), ",").alias("layers"), F.max("best").alias("best"),
    )
    return sums.join(_contexts_of(reach, held), "root").select("root", "contexts", "items", "claims", "layers", "best")


def claim_components(claims: DataFrame, links: DataFrame, claim_entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, component): claims connected over links, shared entities and relations between claims' entities.

    An entity stands for its smallest claim, so one with n claims costs n - 1 edges, not n pairs, and only claims are vertices.
    Relations count only if claims are attached at both ends. The component is its smallest claim id.
    """
    own = claims.select("id")
    ce = claim_entities.join(own, F.col("claim_id") == F.col("id"), "left_semi").select("claim_id", "entity_id").where("entity_id is not null")
    ce = materialize(ce, "claim-entities")
    held = materialize(ce.groupBy(F.col("entity_id").alias("e")).agg(F.min("claim_id").alias("c"), F.count(F.lit(1)).alias("n")), "held")
    several = held.where("n > 1")
    mates = spread_join(ce, several.select(F.col("e").alias("entity_id"), "c", "n"), ["entity_id"], "n", "claim_id").select(F.col("c").alias("src"), F.col("claim_id").alias("dst"))
    at = {k: held.select(F.col("e").alias(f"{k}_id"), F.col("c").alias(k)) for k in ("src", "dst")}
    both = relations.select("src_id", "dst_id").join(at["src"], "src_id").join(at["dst"], "dst_id").select("src", "dst")
    inner = links.join(own, F.col("source_claim_id") == own["id"], "left_semi").join(own, F.col("target_claim_id") == own["id"], "left_semi")
    edges = inner.select(F.col("source_claim_id").alias("src"), F.col("target_claim_id").alias("dst")).union(mates).union(both).where("src <> dst")
    label = connected_components(edges)
    discard(ce, held)
    return own.join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def scope_holes(components: DataFrame, claims: DataFrame) -> DataFrame:
    """Components with project claims but no principle, or session claims with neither."""
    has = {s: F.max(F.when(F.col("scope") == s, 1).otherwise(0)).alias(s) for s in ("principle", "project", "session")}
    c = components.join(claims.select("id", "scope"), "id").groupBy("component").agg(F.count(F.lit(1)).alias("size"), *has.values())
    hole = F.when((F.col("project") == 1) & (F.col("principle") == 0), "project_without_principle").when(
        (F.col("session") == 1) & (F.col("project") == 0) & (F.col("principle") == 0), "session_without_durable"
    )
    return c.select("component", "size", hole.alias("hole")).where("hole is not null")


def orphan_claims(claims: DataFrame, links: DataFrame, claim_entities: DataFrame) -> DataFrame:
    """Claims without a link to another claim and without an entity."""
    ends = symmetric(links, "source_claim_id", "target_claim_id").where("u <> v").select(F.col("u").alias("id")).union(claim_entities.select("claim_id"))
    return claims.select("id").join(ends.distinct(), "id", "left_anti")


def orphan_entities(entities: DataFrame, relations: DataFrame, claim_entities: DataFrame) -> DataFrame:
    used = relations.select(F.col("src_id").alias("id")).union(relations.select("dst_id")).union(claim_entities.select("entity_id"))
    return entities.select("id").join(used.distinct(), "id", "left_anti")


def _directed(links: DataFrame, link_type: str) -> DataFrame:
    return links.where(F.col("link_type") == link_type).select(F.col("source_claim_id").alias("u"), F.col("target_claim_id").alias("v")).distinct()


#: What stands for no way at all where lengths are compared.
NO_WAY = -(1 << 40)


def depths(edges: DataFrame) -> DataFrame:
    """(id, depth): the most edges on a way from each vertex, for vertices of the edges (u, v) that reach no cycle.

    A vertex whose ways on are known but for one has the depth max(b, a + that one's). Such steps compose, so runs of these
    vertices are followed by doubling, three doublings a round. Rounds grow with the logarithm of the longest run, and with the number of
    vertices on a way that wait for two unknown ones or more, not with the way's length.
    """
    left = materialize(edges.select("u", "v").where("u <> v").distinct(), "depth-edges")
    known = materialize(left.select(F.col("v").alias("id")).distinct().join(left.select(F.col("u").alias("id")), "id", "left_anti").withColumn("depth", F.lit(0).cast("long")), "depths")
    found = [known]
    while True:
        d = reduce(DataFrame.unionByName, found).select(F.col("id").alias("v"), "depth")
        ways = left.join(d, "v", "left").groupBy(F.col("u").alias("id")).agg(
            (F.max("depth") + 1).alias("b"), F.count_if(F.col("depth").isNull()).alias("open"), F.max(F.when(F.col("depth").isNull(), F.col("v"))).alias("to")
        )
        ways = materialize(ways.withColumn("b", F.coalesce("b", F.lit(NO_WAY))), "ways")
        whole = ways.where("open = 0").select("id", F.col("b").alias("depth"))
        if whole.isEmpty():
            discard(left, ways)
            return reduce(DataFrame.unionByName, found)
        run = _followed(materialize(ways.where("open = 1").select("id", "to", F.lit(1).cast("long").alias("a"), "b"), "runs"))
        ends = whole.select(F.col("id").alias("to"), "depth")
        solved = materialize(whole.unionByName(run.join(ends, "to").select("id", F.greatest("b", F.col("a") + F.col("depth")).alias("depth"))), "depths")
        found.append(solved)
        rest = materialize(left.join(solved.select(F.col("id").alias("u")), "u", "left_anti").select("u", "v"), "depth-edges")
        discard(left, ways, run)
        left = rest


def _followed(run: DataFrame) -> DataFrame:
    """Steps (id, to, a, b) composed with those of their ends again and again, until an end has none; what runs into a circle stays inside."""
    n = run.count()
    for _ in range(math.ceil(math.log2(n + 1) / 3) if n else 0):
        longer = run
        for _ in range(3):
            on = longer.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
            longer = longer.join(on, "to", "left").select(
                "id", F.coalesce("to2", "to").alias("to"), (F.col("a") + F.coalesce("a2", F.lit(0))).alias("a"),
                F.greatest("b", F.when(F.col("b2") > NO_WAY, F.col("a") + F.col("b2"))).alias("b"), F.col("to2").isNotNull().alias("moved"),
            )
        longer = materialize(longer, "runs")
        discard(run)
        run = longer.drop("moved")
        run._lodestone_path = longer._lodestone_path
        if longer.where("moved").isEmpty():
            break
    return run


def _ways(starts: DataFrame, onward: DataFrame, longest: int) -> DataFrame:
    """(root, path): the vertices from each start (root) along ``onward`` (id, next), ``longest`` edges at most.

    Jumps of 1, 8, 64, ... edges are made first; then the places of a path that are multiples of the largest jump, then of the one below.
    """
    jumps = [onward.select("id", F.col("next").alias("j1"))]
    tables = []
    while True:
        j1 = jumps[-1]
        two = j1.join(j1.select(F.col("id").alias("j1"), F.col("j1").alias("j2")), "j1", "left")
        four = two.join(two.select(F.col("id").alias("j2"), F.col("j2").alias("j4")), "j2", "left")
        table = materialize(four.select("id", "j1", "j2", "j4"), "jumps")
        tables.append(table)
        if 8 ** len(tables) > longest:
            break
        jumps.append(table.where("j4 is not null").join(table.select(F.col("id").alias("j4"), F.col("j4").alias("j8")), "j4").where("j8 is not null").select("id", F.col("j8").alias("j1")))
    rows = starts.select("root", F.lit(0).cast("long").alias("pos"), F.col("root").alias("at"))
    for k in range(len(tables) - 1, -1, -1):
        for m in (4, 2, 1):
            far = tables[k].select(F.col("id").alias("at"), F.col(f"j{m}").alias("to")).where("to is not null")
            rows = rows.unionByName(rows.join(far, "at").select("root", (F.col("pos") + m * 8**k).alias("pos"), F.col("to").alias("at")))
        rows = materialize(rows, "places")
    return rows.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "at"))), lambda x: x["at"]).alias("path"))


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """The edges (u, v) that lie between vertices which a cycle reaches and which reach a cycle: none if there is no cycle."""
    left = edges.where("u <> v")
    for a, b in (("u", "v"), ("v", "u")):
        off = depths(left.select(F.col(a).alias("u"), F.col(b).alias("v"))).select(F.col("id").alias(b))
        left = materialize(left.join(off, b, "left_anti").select("u", "v"), "core")
    return left


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, part, size): vertices that reach each other, named by their smallest; only parts of two vertices or more.

    Each round every vertex takes the smallest vertex that reaches it; what reaches that one back, inside the
    same colour, is its part. Parts found are taken off, until no cycle is left.
    """
    left, parts = cyclic_edges(edges), None
    while not left.isEmpty():
        ids = left.select(F.col("u").alias("id")).union(left.select("v")).distinct()
        colour = _spread(materialize(ids.withColumn("c", F.col("id")), "colour"), left)
        c_u, c_v = colour.select(F.col("id").alias("u"), F.col("c").alias("cu")), colour.select(F.col("id").alias("v"), F.col("c").alias("cv"))
        inside = materialize(left.join(c_u, "u").join(c_v, "v").where("cu = cv").select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("cu").alias("c")), "inside")
        mark = materialize(colour.select("id", F.when(F.col("id") == F.col("c"), F.col("c")).alias("c")), "colour")
        back = _spread(mark, inside.select("u", "v")).where("c is not null")
        part = materialize(back.withColumnRenamed("c", "part"), "part")
        parts = part if parts is None else parts.unionByName(part)
        gone = part.select("id")
        rest = left.join(gone.withColumnRenamed("id", "u"), "u", "left_anti").join(gone.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v")
        left = cyclic_edges(rest)
    if parts is None:
        return edges.select(F.col("u").alias("id"), F.col("u").alias("part"), F.lit(0).cast("long").alias("size")).where("false")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return parts.join(sizes, "part").select("id", "part", "size")


def _spread(colour: DataFrame, edges: DataFrame) -> DataFrame:
    """The smallest non-null colour (id, c) that reaches each vertex along the edges (u, v)."""
    while True:
        came = edges.join(colour.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg(F.min("c").alias("n"))
        step = colour.join(came, "id", "left").select("id", F.least("c", "n").alias("c"), (~F.least("c", "n").eqNullSafe(F.col("c"))).alias("new"))
        fresh = materialize(step, "colour")
        done = fresh.where("new").isEmpty()
        discard(colour)
        colour = fresh.select("id", "c")
        if done:
            return colour


def cycles(links: DataFrame, link_type: str = "contradicts") -> DataFrame:
    """(cycle, length): all simple directed cycles of two nodes or more, each from its smallest node.

    Paths grow only inside the cyclic part of the graph and until none can go on. A dense part has
    exponentially many cycles; ``strong_components`` gives it as one part instead.
    """
    e = cyclic_edges(_directed(links, link_type))
    paths, found, n = materialize(e.where("u < v").select(F.array("u", "v").alias("path"), F.col("v").alias("at")), "cycle-paths"), [], 2
    start = F.element_at("path", 1)
    while n == 2 or not paths.isEmpty():
        close = paths.join(e, (F.col("at") == F.col("u")) & (F.col("v") == start)).select(F.array_join("path", ">").alias("cycle"), F.lit(n).alias("length"))
        found.append(materialize(close, "cycles"))
        step = paths.join(e, F.col("at") == F.col("u")).where((F.col("v") > start) & ~F.array_contains("path", F.col("v")))
        longer = materialize(step.select(F.concat("path", F.array("v")).alias("path"), F.col("v").alias("at")), "cycle-paths")
        discard(paths)
        paths, n = longer, n + 1
    return reduce(DataFrame.unionByName, found)


def small_cycles(links: DataFrame, link_type: str = "contradicts", most: int = 12) -> DataFrame:
    """(cycle, length): the cycles in strong parts of at most ``most`` claims, and each larger part as one row, its smallest claim and its size.

    A part of n claims may hold exponentially many cycles: this is for readers who want large parts named. ``cycles`` lists all, and the audit does so.
    """
    e = _directed(links, link_type)
    parts = materialize(strong_components(e.where("u <> v")), "parts")
    few = parts.where(F.col("size") <= most).select("id")
    inside = links.join(few.withColumnRenamed("id", "source_claim_id"), "source_claim_id", "left_semi").join(few.withColumnRenamed("id", "target_claim_id"), "target_claim_id", "left_semi")
    large = parts.where(F.col("size") > most).select(F.concat("part", F.lit("..."), F.col("size").cast("string")).alias("cycle"), F.col("size").cast("int").alias("length")).distinct()
    return cycles(inside, link_type).unionByName(large)


def longest_chains(links: DataFrame, link_type: str = "supersedes", least: int = 3) -> DataFrame:
    """(root, length, chain): the longest simple chain from each node that nothing leads to, ``least`` edges at least.

    Where no cycle is in reach, lengths come from ``depths``; of the nodes that go on as far the smallest follows, which gives the smallest of the
    longest chains, and it is followed by doubling. From other roots paths are grown an edge at a time: of the paths of
    one length from a root to a node the smallest goes on, and a path also stands for the nodes it has
    used of its end's cyclic part, as those decide how it can go on.
    """
    e = materialize(_directed(links, link_type).where("u <> v"), "chain-edges")
    roots = materialize(e.select("u").distinct().join(e.select(F.col("v").alias("u")).distinct(), "u", "left_anti").withColumnRenamed("u", "root"), "roots")
    d = materialize(depths(e), "depths")
    far = roots.join(d.where(F.col("depth") >= least), F.col("root") == F.col("id")).select("root", "depth")
    longest = far.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    out = roots.select("root", F.lit(0).alias("length"), F.lit("").alias("chain")).where("false")
    if longest:
        at_u, at_v = d.select(F.col("id").alias("u"), F.col("depth").alias("du")), d.select(F.col("id").alias("v"), F.col("depth").alias("dv"))
        onward = e.join(at_u, "u").join(at_v, "v").where("du = dv + 1").groupBy(F.col("u").alias("id")).agg(F.min("v").alias("next"))
        ways = _ways(far, materialize(onward, "onward"), longest)
        out = ways.select("root", (F.size("path") - 1).alias("length"), F.array_join("path", ">").alias("chain"))
    other = roots.join(d.select(F.col("id").alias("root")), "root", "left_anti")
    if other.isEmpty():
        return out
    parts = strong_components(e).select(F.col("id").alias("v"), "part")
    steps = materialize(e.join(parts, "v", "left").select("u", "v", "part"), "chain-edges")
    return out.unionByName(_grow_chains(other, steps, least))


def _grow_chains(roots: DataFrame, steps: DataFrame, least: int) -> DataFrame:
    """The longest chains from ``roots`` over the steps (u, v, cyclic part of v), an edge a round."""
    state = roots.select("root", F.array("root").alias("path"), F.array(F.lit(None).cast("string")).alias("parts"), F.col("root").alias("at"))
    front, best = materialize(state, "chains"), None
    while True:
        step = front.join(steps, F.col("at") == F.col("u")).where(~F.array_contains("path", F.col("v")))
        used = F.when(F.col("part").isNotNull(), F.array_sort(F.filter(F.transform(F.arrays_zip("path", "parts"), lambda x: F.when(x["parts"] == F.col("part"), x["path"])), lambda x: x.isNotNull())))
        step = step.select("root", F.concat("path", F.array("v")).alias("path"), F.concat("parts", F.array("part")).alias("parts"), F.col("v").alias("at"), F.coalesce(used, F.array().cast("array<string>")).alias("used"))
        longer = step.groupBy("root", "at", "used").agg(F.min(F.struct("path", "parts")).alias("b"))
        longer = materialize(longer.select("root", F.col("b.path").alias("path"), F.col("b.parts").alias("parts"), "at"), "chains")
        if longer.isEmpty():
            break
        size = F.size("path") - 1
        done = longer.where(size >= least).groupBy("root").agg(F.min("path").alias("path"), F.max(size).alias("length"))
        # The longest so far of each root, the smallest at a tie (a longer one always replaces it).
        best = done if best is None else done.unionByName(best.join(done.select("root"), "root", "left_anti"))
        best = materialize(best, "longest")
        discard(front)
        front = longer
    if best is None:
        return roots.select("root", F.lit(0).alias("length"), F.lit("").alias("chain")).where("false")
    return best.select("root", "length", F.array_join("path", ">").alias("chain"))


#: A context with more claims than this is heavy: its pairs are not written out.
HEAVY, BLOCK_CLAIMS = 256, 1024


def _heavy_pairs(least: int):
    """(a, b, heavy): pairs of two blocks of claims that share ``least`` heavy contexts or more; each in the first context they share only."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for context, same, left, right in zip(*(batch.column(k).to_pylist() for k in range(4))):
                names = sorted({c for row in (*left, *right) for c in row["heavy"]})
                place = {c: k for k, c in enumerate(names)}

                def marks(rows: list[dict]) -> np.ndarray:
                    m = np.zeros((len(rows), len(names)), np.float32)
                    m[np.repeat(np.arange(len(rows)), [len(r["heavy"]) for r in rows]), [place[c] for r in rows for c in r["heavy"]]] = 1
                    return m

                x = marks(left)
                y = x if same else marks(right)
                upto = place[context]
                i, j = np.nonzero((x @ y.T >= least) & (x[:, :upto] @ y[:, :upto].T == 0))
                if same:
                    i, j = i[i < j], j[i < j]
                n = (x[i] * y[j]).sum(axis=1).astype(np.int64)
                for p, q, k in zip(i, j, n):
                    a, b = sorted((left[p]["claim_id"], right[q]["claim_id"]))
                    out[0].append(a)
                    out[1].append(b)
                    out[2].append(int(k))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["a", "b", "heavy"])

    return run


def shared_contexts(items: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, contexts): how many contexts two claims share, where that is ``least`` or more.

    Contexts of at most HEAVY claims are expanded into pairs and counted. A heavy one is a mark on its claims: a pair that light contexts
    have brought together takes the heavy ones from both lists of marks, and pairs of claims with ``least`` marks each are counted in
    blocks of BLOCK_CLAIMS, as products of matrices. So a context of n claims gives no pair by itself.
    """
    rows = materialize(items.where("active_context_id is not null and claim_id is not null").select("active_context_id", "claim_id").distinct(), "items")
    sizes = rows.groupBy("active_context_id").agg(F.count(F.lit(1)).alias("size"))
    heavy = materialize(sizes.where(F.col("size") > HEAVY), "heavy")
    none = heavy.isEmpty()
    light = rows if none else rows.join(small(heavy.select("active_context_id")), "active_context_id", "left_anti")
    x, y = light.alias("x"), light.alias("y")
    pairs = x.join(y, (F.col("x.active_context_id") == F.col("y.active_context_id")) & (F.col("x.claim_id") < F.col("y.claim_id")))
    counts = pairs.groupBy(F.col("x.claim_id").alias("a"), F.col("y.claim_id").alias("b")).agg(F.count(F.lit(1)).alias("contexts"))
    if none:
        return counts.where(F.col("contexts") >= least)
    marked = spread_join(rows, heavy.withColumn("n", F.col("size")), ["active_context_id"], "n", "claim_id").groupBy("claim_id").agg(F.array_sort(F.collect_list("active_context_id")).alias("heavy"))
    marked = materialize(marked, "marks")
    own = {c: marked.select(F.col("claim_id").alias(c), F.col("heavy").alias(f"h{c}")) for c in "ab"}
    both = F.coalesce(F.size(F.array_intersect("ha", "hb")), F.lit(0))
    met = counts.join(own["a"], "a", "left").join(own["b"], "b", "left").select("a", "b", (F.col("contexts") + F.when(F.col("ha").isNotNull() & F.col("hb").isNotNull(), both).otherwise(0)).alias("contexts"))
    met = materialize(met.where(F.col("contexts") >= least), "pairs")
    # Pairs that no light context brings together need ``least`` heavy ones.
    many = marked.where(F.size("heavy") >= least).select("claim_id", "heavy", F.explode("heavy").alias("context"))
    n = many.groupBy("context").agg(F.ceil(F.count(F.lit(1)) / BLOCK_CLAIMS).cast("int").alias("parts"), F.count(F.lit(1)).alias("n"))
    dealt = spread_join(many, materialize(n, "parts"), ["context"], "n", "claim_id").withColumn("part", F.pmod(F.xxhash64("claim_id"), "parts").cast("int"))
    packs = materialize(dealt.groupBy("context", "parts", "part").agg(F.collect_list(F.struct("claim_id", "heavy")).alias("v")), "packs")
    left = packs.select("context", F.col("part").alias("mine"), F.col("v").alias("x"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("part"))
    blocks = left.join(packs.select("context", "part", F.col("v").alias("y")), ["context", "part"]).select("context", (F.col("mine") == F.col("part")).alias("same"), "x", "y")
    alone = blocks.mapInArrow(_heavy_pairs(least), "a string, b string, heavy long").join(met.select("a", "b"), ["a", "b"], "left_anti")
    return met.unionByName(alone.withColumnRenamed("heavy", "contexts"))


def coactivation(items: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, contexts, context_ids): claims that share at least so many contexts; the ids are gathered for these pairs only."""
    pairs = materialize(shared_contexts(items, least), "pairs")
    rows = items.select("active_context_id", "claim_id").distinct()
    held = pairs.select("a", "b").join(rows.withColumnRenamed("claim_id", "a"), "a").join(rows.withColumnRenamed("claim_id", "b"), ["active_context_id", "b"], "left_semi")
    ids = held.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_list("active_context_id")), ",").alias("context_ids"))
    return pairs.join(ids, ["a", "b"]).select("a", "b", "contexts", "context_ids")


def unlinked_coactivation(items: DataFrame, links: DataFrame, claim_entities: DataFrame, relations: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, contexts) of co-activated pairs without any edge: no link, no shared entity, no relation between their entities."""
    pairs = shared_contexts(items, least)
    direct = links.select(F.least("source_claim_id", "target_claim_id").alias("a"), F.greatest("source_claim_id", "target_claim_id").alias("b"))
    pairs = materialize(pairs.join(direct, ["a", "b"], "left_anti"), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("claim_id")).distinct()
    ce = materialize(claim_entities.select("claim_id", "entity_id").distinct().join(asked, "claim_id", "left_semi"), "entities")
    held_a, held_b = ce.select(F.col("claim_id").alias("a"), F.col("entity_id").alias("ea")), ce.select(F.col("claim_id").alias("b"), F.col("entity_id").alias("eb"))
    beside = pairs.join(held_a, "a").select("a", "b", "ea")
    shared = beside.join(held_b.withColumnRenamed("eb", "ea"), ["b", "ea"], "left_semi").select("a", "b")
    # Only relations between entities that are asked for, either way round.
    known = small(materialize(ce.select("entity_id").distinct(), "known"))
    inner = relations.select("src_id", "dst_id").join(known, F.col("src_id") == F.col("entity_id"), "left_semi").join(known, F.col("dst_id") == F.col("entity_id"), "left_semi")
    hops = symmetric(inner, "src_id", "dst_id").select(F.col("u").alias("ea"), F.col("v").alias("eb")).distinct()
    related = beside.join(hops, "ea").join(held_b, ["b", "eb"], "left_semi").select("a", "b")
    return pairs.join(shared.union(related).distinct(), ["a", "b"], "left_anti")


def neighbours(ids: DataFrame, links: DataFrame, claim_entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, other, reasons): claims next to each of the materialised ``ids`` by a link, a shared entity or a relation of entities."""
    own = symmetric(links, "source_claim_id", "target_claim_id").join(small(ids), F.col("u") == F.col("id"), "left_semi").select("u", "v", F.lit("claim_link").alias("reason"))
    ce = claim_entities.select("claim_id", "entity_id").distinct()
    here = ce.join(small(ids), F.col("claim_id") == F.col("id"), "left_semi").select(F.col("claim_id").alias("u"), "entity_id")
    mates = here.join(ce.select(F.col("claim_id").alias("v"), "entity_id"), "entity_id").select("u", "v", F.lit("shared_entity").alias("reason"))
    over = entity_steps(small(ids), claim_entities, relations).select("u", "v", F.lit("relation").alias("reason"))
    rows = own.unionByName(mates).unionByName(over).where("u <> v")
    return rows.groupBy(F.col("u").alias("id"), F.col("v").alias("other")).agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def shared_entities(claim_entities: DataFrame) -> DataFrame:
    """(claim_id, entity_id, representative, n_claims) of entities with several claims: pairs as membership, not expanded."""
    groups = claim_entities.groupBy("entity_id").agg(F.min("claim_id").alias("representative"), F.count_distinct("claim_id").alias("n_claims")).where("n_claims > 1")
    return claim_entities.distinct().join(groups, "entity_id").select("claim_id", "entity_id", "representative", "n_claims")


def entity_degrees(entities: DataFrame, claim_entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, degree): distinct claims of an entity plus its relation ends."""
    c = claim_entities.groupBy(F.col("entity_id").alias("id")).agg(F.count_distinct("claim_id").alias("c"))
    r = relations.select(F.col("src_id").alias("id")).union(relations.select("dst_id")).groupBy("id").agg(F.count(F.lit(1)).alias("r"))
    return entities.select("id").join(c, "id", "left").join(r, "id", "left").select("id", (F.coalesce("c", F.lit(0)) + F.coalesce("r", F.lit(0))).alias("degree"))


def counted(findings: DataFrame) -> DataFrame:
    """Every finding (kind, subject) with its kind's count (total) beside it; a row for each kind is broadcast, so no kind gathers in one task."""
    totals = findings.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    return findings.join(F.broadcast(totals), "kind")
