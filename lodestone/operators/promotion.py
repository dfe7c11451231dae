"""What follows a promotion: vectors of the claims that came in, similar claims, and links to suggest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.boundary import confidential, redacted_for_embedding
from lodestone.functions.embeddings import bag_embedding
from lodestone.operators.search import nearest_unlinked, similar_apart

SIMILAR, LEAST, SUGGESTIONS = 0.85, 0.7, 5


def with_vectors(claims: DataFrame, embed: Callable[[Column], Column] = bag_embedding) -> DataFrame:
    """Claims (text, boundary_class, ...) with ``embedding`` in place of these two; texts of confidential classes, and of none, are redacted first."""
    text = F.when(confidential(F.col("boundary_class")), redacted_for_embedding(F.col("text"))).otherwise(F.col("text"))
    return claims.withColumn("embedding", embed(text)).drop("text", "boundary_class")


def promoted_vectors(claims: DataFrame, embed: Callable[[Column], Column] = bag_embedding) -> DataFrame:
    """(id, embedding) of claims (id, text, boundary_class), as ``with_vectors`` makes them."""
    return with_vectors(claims.select("id", "text", "boundary_class"), embed)


def after_promotion(accepted: DataFrame, rows: DataFrame, links: DataFrame, similar: float = SIMILAR, least: float = LEAST, most: int = SUGGESTIONS) -> tuple[DataFrame, DataFrame]:
    """Similar claims of every accepted one, and links to suggest for those that are new.

    ``accepted`` is (id, scope, hash, embedding, is_new), ``rows`` the active claims as they are after the batch (id, scope,
    hash, created_at, embedding), ``links`` (source_claim_id, target_claim_id). Returns (id, other, similarity): rows of the
    same scope with another hash and a cosine above ``similar``; and (id, target, score, link_type, place): the best ``most``
    rows of any scope whose cosine, put on 0 to 1, is at least ``least`` and below ``similar``, and which no link joins to the
    claim in either direction; the most similar first, then the newest, then the smallest id. Cosines are rounded to nine
    places, so ties are ties on every machine. Null and zero vectors are similar to none; repeated rows count once. Neither writes or
    shuffles the pairs it does not return: what a pair needs travels with its vectors.
    """
    asked = accepted.where(F.size("embedding") > 0).dropDuplicates(["id"])
    known = rows.where(F.size("embedding") > 0).dropDuplicates(["id"])
    alike = similar_apart(asked.select("id", "scope", "embedding", "hash"), known.select("id", "scope", "embedding", "hash"), similar, "scope", "hash")
    linked = links.select(F.col("source_claim_id").alias("id"), F.col("target_claim_id").alias("other"))
    linked = linked.union(linked.select("other", "id")).groupBy("id").agg(F.collect_set("other").alias("linked"))
    fresh = asked.where("is_new").select("id", F.lit(0).alias("all"), "embedding").join(linked, "id", "left")
    best = nearest_unlinked(fresh, known.select("id", F.lit(0).alias("all"), "embedding", "created_at"), least, similar, most, "all")
    score = F.round((F.col("similarity") + 1) / 2, 4).alias("score")
    return alike, best.select("id", F.col("other").alias("target"), score, F.lit("related").alias("link_type"), "place")
