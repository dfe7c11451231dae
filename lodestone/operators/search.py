"""Hybrid retrieval: text and vector candidates, fusion, reranking, diversification, expansion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scoring as S
from lodestone.functions import text as X
from lodestone.functions import vectors as V
from lodestone.operators.filters import active
from lodestone.operators.ordering import numbered
from lodestone.operators.paging import newest_first
from lodestone.runtime import SALTS, materialize, small

ALPHA, THRESHOLD = 0.65, 0.15
TEXT_LIMIT, VECTOR_LIMIT = 128, 256
MMR_HEAD, MMR_LAMBDA = 48, 0.72


def text_candidates(claims: DataFrame, queue: DataFrame, critic: DataFrame, words: Sequence[str] | None, where: Column, limit: int | None = TEXT_LIMIT) -> DataFrame:
    """Active claims that hold any word, scored by their critic (0.5 without one); without a query, all, scored 0 without one."""
    match = X.any_word(F.col("text"), list(words)) if words is not None else F.lit(True)
    found = active(claims, queue).where(where).where(match).join(critic.select(F.col("claim_id").alias("id"), F.col("score").alias("critic")), "id", "left")
    scored = found.withColumn("score", F.coalesce("critic", F.lit(0.5 if words is not None else 0.0))).drop("critic")
    return scored.orderBy(*newest_first()).limit(max(1, limit)) if limit is not None else scored


def vector_candidates(claims: DataFrame, queue: DataFrame, vectors: DataFrame, query: DataFrame, where: Column, limit: int = VECTOR_LIMIT) -> DataFrame:
    """Active claims by cosine to the one-row ``query`` (column q), moved to 0..1; exact scan, top ``limit``."""
    scan = active(claims, queue).where(where).join(vectors, F.col("id") == F.col("claim_id")).drop("claim_id")
    scored = scan.join(F.broadcast(query.limit(1).select("q"))).withColumn("score", S.norm_cos(V.cosine(F.col("embedding"), F.col("q"))))
    return scored.drop("q", "embedding").orderBy(*newest_first()).limit(max(1, limit))


def fuse(text: DataFrame, vec: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(id, s_text, s_vec, s): full outer merge of candidates; a missing or null score is 0."""
    t, v = text.select("id", F.col("score").alias("t")), vec.select("id", F.col("score").alias("v"))
    both = t.join(v, "id", "full_outer").select("id", F.coalesce("t", F.lit(0.0)).alias("s_text"), F.coalesce("v", F.lit(0.0)).alias("s_vec"))
    return both.withColumn("s", S.hybrid(F.col("s_text"), F.col("s_vec"), alpha))


def utility_stats(claims: DataFrame, queue: DataFrame, where: Column) -> DataFrame:
    """One row (mean, deviation) of utility over the filtered active pool; 0 and 1 where undefined."""
    pool = active(claims, queue).where(where)
    return pool.agg(F.coalesce(F.avg("utility"), F.lit(0.0)).alias("mean"), F.coalesce(F.nullif(F.stddev_samp("utility"), F.lit(0.0)), F.lit(1.0)).alias("deviation"))


def candidate_features(ids: DataFrame, claims: DataFrame, evidence: DataFrame, queue: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row per candidate: its columns, evidence count, lineage flag and feedback counts. Each side is aggregated before it joins."""
    e = evidence.join(ids, evidence["claim_id"] == ids["id"], "left_semi").groupBy(F.col("claim_id").alias("id")).agg(F.count_distinct("id").alias("evidence_count"))
    q = queue.where("status = 'accepted'").groupBy(F.col("accepted_claim_id").alias("id")).agg(F.lit(True).alias("lineage"))
    signals = {s: F.count_if(F.col("signal") == s).alias(s) for s in S.FEEDBACK_WEIGHTS}
    f = feedback.join(ids, feedback["claim_id"] == ids["id"], "left_semi").groupBy(F.col("claim_id").alias("id")).agg(*signals.values())
    rows = claims.join(ids, "id", "left_semi").join(e, "id", "left").join(q, "id", "left").join(f, "id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("evidence_count", *signals)]
    return rows.select(*claims.columns, F.coalesce("lineage", F.lit(False)).alias("lineage"), *zero)


def provenance_given(rows: DataFrame) -> Column:
    """Whether a row's provenance document names both an actor and a note; false without that column."""
    if "provenance" not in rows.columns:
        return F.lit(False)
    said = [F.length(F.coalesce(F.get_json_object("provenance", f"$.{k}"), F.lit(""))) > 0 for k in ("actor", "note")]
    return said[0] & said[1]


def rerank(fused: DataFrame, features: DataFrame, stats: DataFrame, now: Column, intent: str | None = None, feedback: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """Fused score times utility/confidence/recency, intent, provenance and feedback factors; threshold on the product."""
    f = features.join(F.broadcast(stats))
    weight = S.RECENCY_WEIGHT.get(intent or "", 1.0)
    g = (
        S.utility_term(F.col("utility"), F.col("mean"), F.col("deviation"))
        * S.confidence_term(F.col("confidence"))
        * S.recency_term(S.recency(F.col("created_at"), S.half_life(F.col("kind")), now), weight)
    )
    quality = S.provenance_quality(F.col("evidence_count"), provenance_given(f), F.col("lineage"))
    boost = S.feedback_boost({s: F.col(s) for s in S.FEEDBACK_WEIGHTS}) if feedback else F.lit(1.0)
    factors = f.select("id", "created_at", g.alias("g"), S.intent_boost(intent, F.col("kind"), F.col("memory_type")).alias("intent_boost"), quality.alias("quality"), boost.alias("feedback_boost"))
    one = [F.coalesce(c, F.lit(1.0)).alias(c) for c in ("g", "intent_boost", "quality", "feedback_boost")]
    out = fused.join(factors, "id", "left").select("id", "created_at", "s_text", "s_vec", "s", *one)
    return out.withColumn("score", F.col("s") * F.col("g") * F.col("intent_boost") * F.col("quality") * F.col("feedback_boost")).where(F.col("score") >= threshold)


def usage_only(text: DataFrame, now: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Text candidates times their usage factor: the threshold tests the raw score and ``rank`` stays that of the raw one."""
    kept = numbered(text.where(F.col("score") >= threshold), newest_first(), "rank")
    last = F.lit(None).cast("timestamp_ntz") if "last_retrieved_at" not in text.columns else F.col("last_retrieved_at")
    return kept.withColumn("score", F.col("score") * S.usage_term(F.col("retrieval_count"), last, now))


BLOCK_VECTORS = 1024


def _blocks(vectors: DataFrame, block: str, name: str, *more: str) -> tuple[DataFrame, int]:
    """Vectors (id, embedding, and the columns ``more``) packed into rows of about BLOCK_VECTORS, by ``block`` and a hash of the id (``part``); and how many parts."""
    n = max(1, -(-vectors.count() // BLOCK_VECTORS))
    dealt = vectors.select(block, F.pmod(F.xxhash64("id"), F.lit(n)).alias("part"), F.struct("id", "embedding", *more).alias("v"))
    return dealt.groupBy(block, "part").agg(F.collect_list("v").alias(name)), n


def blocks(vectors: DataFrame, name: str, *more: str) -> tuple[int, DataFrame]:
    """How many parts, and vectors (id, embedding, and the columns ``more``) packed into one row (part, ``name``) for each, of about BLOCK_VECTORS."""
    n = max(1, -(-vectors.count() // BLOCK_VECTORS))
    dealt = vectors.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("part"), F.struct("id", "embedding", *more).alias("v"))
    return n, dealt.groupBy("part").agg(F.collect_list("v").alias(name))


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a packed block; shorter vectors are filled with zeros, a zero vector stays."""
    vectors = column.field("embedding")
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    norm = np.sqrt((out * out).sum(axis=1))
    return column.field("id").to_numpy(zero_copy_only=False), out / np.where(norm > 0, norm, 1)[:, None]


def _above(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y")):
                (ids, q), (others, r) = matrix(x.values), matrix(y.values)
                width = max(q.shape[1], r.shape[1])
                q, r = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, r))
                near = q @ r.T
                i, j = np.nonzero((near > threshold) & (ids[:, None] != others[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i], pa.string()), pa.array(others[j], pa.string()), pa.array(near[i, j])], names=["id", "other", "similarity"])

    return run


def _met(queries: DataFrame, vectors: DataFrame, block: str, asked: tuple[str, ...] = (), known: tuple[str, ...] = ()) -> DataFrame:
    """(x, y): each packed block of ``queries`` beside each of ``vectors`` in the same ``block``; both are (id, block, embedding), and the columns ``asked`` or ``known``."""
    (x, _), (y, parts) = _blocks(queries, block, "x", *asked), _blocks(vectors, block, "y", *known)
    salts = min(SALTS, parts)
    # A block of queries goes to every salt of its group once; rows are dealt over the salts.
    x = x.select(block, "x", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    y = y.select(block, "y", (F.col("part") % salts).cast("int").alias("salt"))
    return x.join(y, [block, "salt"]).select("x", "y")


def similar_to(queries: DataFrame, vectors: DataFrame, threshold: float, block: str) -> DataFrame:
    """(id, other, similarity): for each query the rows of ``vectors`` in the same ``block`` above the threshold, exactly.

    Both are (id, block, embedding). They are packed into blocks of vectors, and a block of queries meets a block of
    rows as one product of matrices in a task, so work is queries times rows and nothing is broadcast.
    Vectors of unequal length are compared over their common part with full norms; zero vectors have no similar ones.
    """
    return _met(queries, vectors, block).mapInArrow(_above(threshold), "id string, other string, similarity double")


#: Rows of a batch of pairs that leaves a block.
PAIRS = 1 << 16


def _cosines(x: pa.StructArray, y: pa.StructArray) -> np.ndarray:
    """Cosines to nine places of two packed blocks; NaN where a vector is zero, or a row meets itself."""
    (ids, q), (others, r) = matrix(x), matrix(y)
    width = max(q.shape[1], r.shape[1])
    q, r = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, r))
    near = np.round(q @ r.T, 9)
    near[~q.any(axis=1)] = np.nan
    near[:, ~r.any(axis=1)] = np.nan
    place = {other: k for k, other in enumerate(others)}
    for i, same in enumerate(ids):
        if same in place:
            near[i, place[same]] = np.nan
    return near


def _codes(*columns: pa.Array) -> list[np.ndarray]:
    """Numbers in place of the values of several columns, equal for equal values; -1 for null."""
    coded = pa.chunked_array(columns).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.split(coded, np.cumsum([len(c) for c in columns])[:-1])


def _apart(threshold: float, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = x.values, y.values
                near = _cosines(x, y)
                i, j = np.nonzero(near > threshold)
                mine, its = _codes(x.field(column), y.field(column))
                keep = (mine[i] != its[j]) & (mine[i] >= 0) & (its[j] >= 0)
                i, j = i[keep], j[keep]
                for at in range(0, len(i), PAIRS):
                    p, q = i[at : at + PAIRS], j[at : at + PAIRS]
                    yield pa.RecordBatch.from_arrays([x.field("id").take(pa.array(p)), y.field("id").take(pa.array(q)), pa.array(near[p, q])], names=["id", "other", "similarity"])

    return run


def similar_apart(queries: DataFrame, vectors: DataFrame, threshold: float, block: str, column: str) -> DataFrame:
    """``similar_to`` of rows that differ in ``column`` (a string; null differs from none), cosines to nine places.

    The pairs are whole when they leave their block: they are not joined with anything, so none is shuffled or written.
    """
    return _met(queries, vectors, block, (column,), (column,)).mapInArrow(_apart(threshold, column), "id string, other string, similarity double")


def _nearest(least: float, below: float, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = x.values, y.values
                near = _cosines(x, y)
                score = (near + 1) / 2
                near[~((score >= least) & (score < below))] = -np.inf
                others = y.field("id").to_numpy(zero_copy_only=False)
                place = {other: k for k, other in enumerate(others)}
                for i, linked in enumerate(x.field("linked").to_pylist()):
                    for other in linked or ():
                        if other in place:
                            near[i, place[other]] = -np.inf
                # Columns from the newest to the oldest, then by id; of equal cosines the first stays.
                at = y.field("created_at").cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                name, age = (np.unique(c, return_inverse=True)[1] for c in (others, at))
                order = np.lexsort((name, -age))
                near = near[:, order]
                k = min(most, near.shape[1])
                worst = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
                i, j = np.nonzero((near >= worst[:, None]) & (near > -np.inf))
                by = np.lexsort((j, -near[i, j], i))
                i, j = i[by], j[by]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[rank < most], j[rank < most]
                own = pa.array(order[j])
                yield pa.RecordBatch.from_arrays([x.field("id").take(pa.array(i)), y.field("id").take(own), pa.array(near[i, j]), y.field("created_at").take(own)], names=["id", "other", "similarity", "created_at"])

    return run


def nearest_unlinked(queries: DataFrame, vectors: DataFrame, least: float, below: float, most: int, block: str) -> DataFrame:
    """(id, other, similarity, created_at): of each query's rows whose cosine, put on 0 to 1, is at least ``least`` and below ``below``, the best ``most``.

    ``queries`` is (id, block, embedding, linked), ``vectors`` (id, block, embedding, created_at); ids in ``linked`` (an array) are left out. The
    most similar go first, then the newest, then the smallest id. Each meeting of two blocks gives its best ``most`` of each query and no other pair; among these the best are
    taken here (with ``place``). Cosines are to nine places.
    """
    kind = vectors.schema["created_at"].dataType.simpleString()
    met = _met(queries, vectors, block, ("linked",), ("created_at",)).mapInArrow(_nearest(least, below, most), f"id string, other string, similarity double, created_at {kind}")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), F.desc("created_at"), F.asc("other")))
    return met.withColumn("place", place).where(F.col("place") <= most)


def similar_to_page(page: DataFrame, vectors: DataFrame, threshold: float, block: str) -> DataFrame:
    """``similar_to`` for a materialised page of few rows: one scan of ``vectors`` meets the page, which is broadcast if measured small."""
    asked = page.select("id", block, F.col("embedding").alias("q"))
    met = vectors.select(F.col("id").alias("other"), block, "embedding").join(small(asked), block).where(F.col("id") != F.col("other"))
    return met.select("id", "other", V.cosine(F.col("q"), F.col("embedding")).alias("similarity")).where(F.col("similarity") > threshold)


def page_pairs(vectors: DataFrame, threshold: float, most: int = 128) -> DataFrame:
    """(a, b, similarity): similar pairs inside one page of at most ``most`` rows (id, embedding), a < b. A larger input is refused."""
    rows = materialize(vectors.limit(most + 1), "page")
    if rows.count() > most:
        raise ValueError(f"a page has at most {most} rows")
    one = F.transform("embedding", lambda x: x / F.nullif(V.norm(F.col("embedding")), F.lit(0.0))).alias("u")
    x, y = rows.select(F.col("id").alias("a"), one.alias("ua")), rows.select(F.col("id").alias("b"), one.alias("ub"))
    pairs = x.join(F.broadcast(y), F.col("a") < F.col("b")).select("a", "b", S.clamp(V.dot(F.col("ua"), F.col("ub")), 0.0, 1.0).alias("similarity"))
    return pairs.where(F.col("similarity") > threshold)


def newer_similar(near: DataFrame, created: DataFrame) -> DataFrame:
    """(id, newer, similarity): of the similar rows (id, other, similarity) the newest that is newer than the row itself.

    ``created`` is (id, created_at); equal times are ordered by id. Of several, the newest, then the most similar.
    """
    t0, t1 = created.select("id", F.col("created_at").alias("t0")), created.select(F.col("id").alias("other"), F.col("created_at").alias("t1"))
    rows = near.join(t0, "id").join(t1, "other").where((F.col("t1") > F.col("t0")) | ((F.col("t1") == F.col("t0")) & (F.col("other") > F.col("id"))))
    best = rows.groupBy("id").agg(F.max(F.struct("t1", "similarity", "other")).alias("b"))
    return best.select("id", F.col("b.other").alias("newer"), F.col("b.similarity").alias("similarity"))


def diversify(ranked: DataFrame, limit: int, balance: float = MMR_LAMBDA, head: int = MMR_HEAD, vectors: bool = True) -> DataFrame:
    """(id, position): the best max(limit, head) rows (id, score, text, embedding) by maximal marginal relevance, the others after them in order.

    The choice is sequential by nature, so the bounded head goes to one task and the rest never does.
    """
    size = max(limit, head)
    order = [F.desc("score"), F.asc("id")]
    top = materialize(ranked.orderBy(*order).limit(size).select("id", "score", X.token_set(F.col("text")).alias("tokens"), "embedding"), "head")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        low, span = rows.score.min(), max(rows.score.max() - rows.score.min(), 1e-6)
        relevance = (rows.score - low) / span
        tokens = [set(t) for t in rows.tokens]

        def alike(i: int, j: int) -> float:
            words = len(tokens[i] & tokens[j]) / len(tokens[i] | tokens[j]) if tokens[i] and tokens[j] else 0.0
            a, b = rows.embedding[i], rows.embedding[j]
            near = 0.0
            if vectors and a is not None and b is not None and len(a) == len(b):
                na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
                if na and nb:
                    near = min(1.0, max(0.0, (sum(x * y for x, y in zip(a, b)) / na / nb + 1) / 2))
            return max(words, near)

        left, picked, closest = list(range(len(rows))), [], [0.0] * len(rows)
        while left:
            best = max(left, key=lambda i: (round(balance * relevance[i] - (1 - balance) * closest[i], 12), rows.score[i], -i))
            picked.append(best)
            left.remove(best)
            for i in left:
                closest[i] = max(closest[i], alike(i, best))
        return pd.DataFrame({"id": rows.id[picked].values, "position": range(1, len(picked) + 1)})

    first = top.groupBy(F.lit(1).alias("all")).applyInPandas(lambda rows: choose(rows), "id string, position long")
    tail = numbered(ranked.select("id", "score").join(F.broadcast(top.select("id")), "id", "left_anti"), order, "place")
    return first.unionByName(tail.select("id", (F.col("place") + size).alias("position")))


def observation_scores(observations: DataFrame, words: list[str], now: Column, live: Column) -> DataFrame:
    """Live observations by matched share of the words, decayed with a half-life of one day and capped at 0.8."""
    share = X.matched_share(F.col("content"), words)
    found = observations.where(live & (share > 0))
    return found.select("id", "created_at", (share * F.least(S.recency(F.col("created_at"), F.lit(1.0), now), F.lit(0.8))).alias("score"))


def scaled_observations(durable: DataFrame, observations: DataFrame) -> DataFrame:
    """Observation scores shrunk so that their largest is 0.98 of the largest durable score; never stretched."""
    tops = durable.agg(F.max("score").alias("d")).join(observations.agg(F.max("score").alias("o")))
    factor = F.when((F.col("d") > 0) & (F.col("o") > F.col("d") * 0.98), F.col("d") * 0.98 / F.col("o")).otherwise(F.lit(1.0))
    return observations.join(F.broadcast(tops)).withColumn("score", F.col("score") * factor).drop("d", "o")


# Fixed weights of a match of the whole query or of one of its words with an entity's name or key.
EXACT, PART, WORD = {"name": 8.0, "canonical_key": 10.0}, {"name": 4.0, "canonical_key": 5.0}, {"name": 2.0, "canonical_key": 3.0}


def expand_query(query: str, entities: DataFrame, relations: DataFrame, claim_entities: DataFrame, seeds: int = 3, related: int = 8, tokens: int = 8) -> DataFrame:
    """(term, source, weight): names of entities that match the query, then of entities related to them or sharing a claim with them.

    Entities are (id, name, and if there canonical_key, created_at); of equal weights the newer goes first, then the smaller id.
    """
    q = query.strip().lower()
    words = [w for w in dict.fromkeys(X.query_words(q)) if len(w) >= 2][:tokens]
    weight = F.lit(0.0)
    for column in EXACT:
        if column in entities.columns:
            at = F.lower(F.coalesce(column, F.lit("")))
            weight = weight + F.when(at == q, EXACT[column]).otherwise(0.0) + F.when(at.contains(q), PART[column]).otherwise(0.0)
            for w in words:
                weight = weight + F.when(at.contains(w), WORD[column]).otherwise(0.0)
    order = [F.desc("weight"), *([F.desc("created_at")] if "created_at" in entities.columns else []), F.asc("id")]
    seed = materialize(entities.withColumn("weight", weight).where("weight > 0").orderBy(*order).limit(seeds).select("id", "name", "weight"), "seeds")
    ids = F.broadcast(seed.select(F.col("id").alias("u")))
    names = entities.select(F.col("id").alias("v"), F.col("name"))
    ahead = relations.join(ids, F.col("src_id") == F.col("u"), "left_semi").select(F.col("dst_id").alias("v"))
    back = relations.join(ids, F.col("dst_id") == F.col("u"), "left_semi").select(F.col("src_id").alias("v"))
    own = F.broadcast(seed.select(F.col("id").alias("v")))
    linked = ahead.union(back).distinct().join(own, "v", "left_anti").join(names, "v").orderBy("v").limit(related)
    mates = claim_entities.join(ids, F.col("entity_id") == F.col("u"), "left_semi").select("claim_id").distinct()
    shared = claim_entities.join(mates, "claim_id").select(F.col("entity_id").alias("v")).distinct().join(own, "v", "left_anti").join(names, "v").orderBy("v").limit(related)
    out = seed.select("name", F.lit("seed").alias("source"), "weight")
    out = out.unionByName(linked.select("name", F.lit("relation").alias("source"), F.lit(0.0).alias("weight")))
    out = out.unionByName(shared.select("name", F.lit("claim").alias("source"), F.lit(0.0).alias("weight")))
    return out.select(X.expansion_term(F.col("name")).alias("term"), "source", "weight").where("term is not null")
