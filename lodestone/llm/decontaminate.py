"""Benchmark decontamination by containment MinHash, with DataFrame functions only (operator 10).

Only the short side is sketched. Items are partitioned by the size of their shingle set; each
partition has a sketch of its own length, made of the shingles that have the smallest hash under
each of k functions (a small set is its own sketch). Whether such a minimum lies in a document's
set is a fair draw of the item's containment in the document, however long the document is, so the
share of minima found estimates containment without sketching long texts, which would drown a short
item. Documents stream once against the sketches; pairs with enough hits are verified on all of the
item's shingles, as strings.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import materialize, small

#: (largest set size, functions in the sketch) of each size partition; the last holds all larger sets.
SIZE_PARTITIONS = ((16, 0), (64, 16), (None, 24))
#: A true pair is lost in the search with at most this probability, at the threshold itself.
MISS = 1e-9


def words(text: F.Column) -> F.Column:
    """Lower-cased words of a text: runs of characters other than 0x20 and 0x09-0x0D; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def exploded(df: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """One row for each n-word shingle of ``w``, as columns g0..; fewer words are one shingle."""
    count = F.greatest(F.size("w") - (n - 1), F.when(F.size("w") > 0, 1).otherwise(0))
    at = df.where(F.size("w") > 0).select(*keep, "w", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    return at.select(*keep, *[F.get("w", F.col("i") + k).alias(f"g{k}") for k in range(n)])


def hits_needed(k: int, threshold: float) -> int:
    """The most hits h so that fewer than h of k draws have probability MISS at most at the threshold."""
    below, h = 0.0, 0
    while h < k:
        below += comb(k, h) * threshold**h * (1 - threshold) ** (k - h)
        if below > MISS:
            break
        h += 1
    return max(1, h)


def sketches(items: DataFrame, threshold: float, n: int = 5) -> DataFrame:
    """(item_id, hash, weight, need): minima of each item, how many functions chose each, and hits needed."""
    grams = [f"g{k}" for k in range(n)]
    sets = exploded(items.select("item_id", words(F.col("text")).alias("w")), n, ["item_id"])
    sets = sets.select("item_id", F.xxhash64(*grams).alias("hash")).distinct()
    sized = sets.join(sets.groupBy("item_id").agg(F.count(F.lit(1)).alias("q")), "item_id")
    whole = SIZE_PARTITIONS[0][0]
    parts = [sized.where(f"q <= {whole}").select("item_id", "hash", F.lit(1).cast("long").alias("weight"), F.greatest(F.lit(1), F.floor(F.col("q") * threshold).cast("int")).alias("need"))]
    low = whole
    for high, k in SIZE_PARTITIONS[1:]:
        part = sized.where((F.col("q") > low) & (F.col("q") <= high if high else F.lit(True)))
        minima = part.groupBy("item_id").agg(*[F.min_by("hash", F.xxhash64("hash", F.lit(j))).alias(f"m{j}") for j in range(k)])
        drawn = minima.select("item_id", F.explode(F.array(*[f"m{j}" for j in range(k)])).alias("hash"))
        parts.append(drawn.groupBy("item_id", "hash").agg(F.count(F.lit(1)).alias("weight")).withColumn("need", F.lit(hits_needed(k, threshold))))
        low = high
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contained_items(docs: DataFrame, items: DataFrame, threshold_percent: int = 80, n: int = 5) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): pairs where 100 * n_shared >= threshold_percent * n_item.

    n_item counts the item's distinct n-word shingles, n_shared those that the document has.
    Items and documents without words match nothing; one with fewer than n words is a single
    shingle and matches only its like. Rows that repeat a doc_id or item_id count as one document or
    item; null ids are skipped. Columns other than ids and text are ignored; empty tables give no rows.
    """
    grams = [f"g{k}" for k in range(n)]
    items = items.where("item_id is not null").select("item_id", "text")
    base = docs.where("doc_id is not null").select("doc_id", "text")
    sketch = materialize(sketches(items, threshold_percent / 100, n), "sketches")
    stream = exploded(base.select("doc_id", words(F.col("text")).alias("w")), n, ["doc_id"])
    hits = stream.select("doc_id", F.xxhash64(*grams).alias("hash")).join(small(sketch), "hash")
    found = hits.groupBy("doc_id", "item_id", "hash").agg(F.first("weight").alias("weight"), F.first("need").alias("need"))
    enough = found.groupBy("doc_id", "item_id").agg(F.sum("weight").alias("hits"), F.first("need").alias("need")).where("hits >= need")
    pairs = materialize(enough.select("doc_id", "item_id"), "candidates")
    ids = materialize(pairs.select("doc_id").distinct(), "ids")
    suspects = base.join(small(ids), "doc_id", "left_semi")
    said = F.to_json(F.array(*grams)).alias("shingle")
    full = materialize(exploded(items.select("item_id", words(F.col("text")).alias("w")), n, ["item_id"]).select("item_id", said).distinct(), "items")
    n_item = full.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    have = exploded(suspects.select("doc_id", words(F.col("text")).alias("w")), n, ["doc_id"]).select("doc_id", said)
    shared = have.join(small(full), "shingle").distinct().groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    return (
        shared.join(pairs, ["doc_id", "item_id"], "left_semi")
        .join(n_item, "item_id")
        .where(F.col("n_shared") * 100 >= F.col("n_item") * threshold_percent)
        .select("doc_id", "item_id", "n_item", "n_shared")
    )


ORACLE = """
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')
  FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT DISTINCT kind, id, to_json(w[i : i + 4]) AS shingle
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
q AS (SELECT id AS item_id, count(*) AS n_item FROM s WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n_item, count(*) AS n_shared
FROM s d JOIN s i ON d.kind = 'd' AND i.kind = 'i' AND d.shingle = i.shingle JOIN q ON q.item_id = i.id
GROUP BY ALL HAVING count(*) * 100 >= n_item * 80"""
