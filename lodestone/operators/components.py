"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import HOT_ROWS, discard, materialize, push


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): the smallest vertex reachable from each vertex that has an edge.

    Each round takes the smallest label among neighbours, then jumps to the label's own
    label, so rounds grow with the logarithm of the longest path. Labels are written to the
    shared folder once a round, those of the round before are deleted; only one row of counts comes to the driver.
    The label of a vertex with over HOT_ROWS edges is pushed to its edges (there are few such vertices), so a star's edges don't gather in one task.
    Self-loops, repeated edges and null ends are harmless (null ends are ignored).
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))  # one pass over the edges' plan
    both = materialize(e.select(F.explode(ways).alias("way")).select("way.u", "way.v").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("u"), F.min("v")).alias("component"), (F.count(F.lit(1)) > HOT_ROWS).alias("hot")), "labels")
    hubs = materialize(labels.where("hot").select(F.col("id").alias("v"), F.lit(True).alias("hub")), "hubs")
    some = not hubs.isEmpty()
    if some:
        marked = push(both, hubs, ["v"], "u")
        to_hub, plain = materialize(marked.where("hub").select("u", "v"), "edges"), materialize(marked.where("hub is null").select("u", "v"), "edges")
    while True:
        label = labels.select(F.col("id").alias("v"), F.col("component").alias("c"), "hot")
        if some:
            pushed = push(to_hub, label.where("hot").drop("hot"), ["v"], "u", "inner").unionByName(plain.join(label.where("not hot").drop("hot"), "v"))
        else:
            pushed = both.join(label.drop("hot"), "v")
        near = pushed.groupBy(F.col("u").alias("id")).agg(F.min("c").alias("near"))
        step = labels.join(near, "id").select("id", "hot", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        own = labels.select(F.col("id").alias("c"), F.col("component").alias("cc"))
        fresh = materialize(step.join(own, "c", "left").select("id", "hot", "old", F.least("c", F.coalesce("cc", "c")).alias("component")), "labels")
        changed = not fresh.where(F.col("old") != F.col("component")).isEmpty()
        discard(labels)
        labels = fresh
        if not changed:
            discard(both, hubs, *((to_hub, plain) if some else ()))
            return labels.select("id", "component")
