"""Quality metrics of rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ordering import average_ranks, numbered
from lodestone.operators.search import blocks, matrix
from lodestone.runtime import materialize, small


def ranked_hits(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    """(query, rn, grade): each ranked row (query, id, rn) with its grade (query, id, grade), 0 if unjudged."""
    return ranked.join(judged, ["query", "id"], "left").select("query", "rn", F.coalesce("grade", F.lit(0)).alias("grade"))


def at_k(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """Per query: precision, recall, F1, reciprocal rank, average precision, DCG, normalised DCG, whether anything was hit, and the first useful place, at ``k``.

    Gain is 2^grade - 1 over log2(place + 1); every query with a judgement appears, with zeros if nothing was found.
    """
    hits = ranked_hits(ranked, judged).where(F.col("rn") <= k)
    good = F.col("grade") > 0
    so_far = F.sum(F.when(good, 1).otherwise(0)).over(Window.partitionBy("query").orderBy("rn"))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rn") + 1.0)
    per = hits.withColumn("found", so_far).groupBy("query").agg(
        F.count_if(good).alias("hits"), F.min(F.when(good, F.col("rn"))).alias("first"), F.sum(gain).alias("dcg"),
        F.sum(F.when(good, F.col("found") / F.col("rn")).otherwise(0.0)).alias("ap"),
    )
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "id"))
    best = judged.where("grade > 0").withColumn("place", place)
    ideal = best.groupBy("query").agg(
        F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("place") <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("ideal")
    )
    rows = ideal.join(per, "query", "left")
    zero = F.lit(0.0)
    values = {
        "precision": F.coalesce(F.col("hits") / k, zero), "recall": F.coalesce(F.col("hits") / F.col("relevant"), zero), "mrr": F.coalesce(1 / F.col("first"), zero),
        "map": F.coalesce(F.col("ap") / F.least("relevant", F.lit(k)), zero), "dcg": F.coalesce("dcg", zero), "ndcg": F.coalesce(F.col("dcg") / F.col("ideal"), zero),
        "f1": F.coalesce(2 * F.col("hits") / (F.lit(k) + F.col("relevant")), zero), "hit": F.when(F.col("hits") > 0, 1.0).otherwise(0.0), "first_useful": F.col("first").cast("double"),
    }
    return rows.select("query", *[F.round(c, 6).alias(n) for n, c in values.items()])


def spearman(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns of rows with an ``id`` in each group; 0 where undefined."""
    rows = df.select("id", group, a, b)
    ranks = average_ranks(average_ranks(rows, group, a, "ra"), group, b, "rb")
    return ranks.groupBy(group).agg(F.round(F.coalesce(F.nanvl(F.corr("ra", "rb"), F.lit(0.0)), F.lit(0.0)), 6).alias("rho"))


GRAPH_SOURCES = ("graph", "claim_link", "topology")


def noise_at_k(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query, variant, precision, recall, noise, graph, graph_share) of results (query, variant, id, rn, source) at ``k``."""
    known = relevant.select("query", "id").distinct()
    total = known.groupBy("query").agg(F.count(F.lit(1)).alias("total"))
    top = results.where(F.col("rn") <= k).join(known.withColumn("good", F.lit(True)), ["query", "id"], "left")
    per = top.groupBy("query", "variant").agg(F.count("good").alias("hits"), F.count_if(F.col("good").isNull()).alias("noise"), F.count_if(F.col("source").isin(*GRAPH_SOURCES)).alias("graph"))
    rows = per.join(total, "query", "left")
    recall = F.coalesce(F.col("hits") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    return rows.select("query", "variant", F.round(F.col("hits") / k, 6).alias("precision"), F.round(recall, 6).alias("recall"), "noise", "graph", F.round(F.col("graph") / k, 3).alias("graph_share"))


def noise_deltas(measured: DataFrame, baseline: str, other: str) -> DataFrame:
    """Per query: what ``other`` changed against ``baseline`` (precision and recall to three places)."""
    a, b = (measured.where(F.col("variant") == v).select("query", *[F.col(c).alias(f"{side}_{c}") for c in ("precision", "recall", "noise", "graph")]) for side, v in (("a", baseline), ("b", other)))
    return a.join(b, "query").select("query", *[F.round(F.col(f"b_{c}") - F.col(f"a_{c}"), 3).alias(c) for c in ("precision", "recall")], *[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(c) for c in ("noise", "graph")])


def sweep_summary(deltas: DataFrame) -> DataFrame:
    """One row over all cases: how many got worse, and the largest drop of precision."""
    return deltas.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("precision") < 0).alias("precision_drops"), F.count_if(F.col("recall") < 0).alias("recall_drops"),
        F.count_if(F.col("noise") > 0).alias("noisier"), F.round(F.greatest(F.lit(0.0), -F.min("precision")), 3).alias("largest_drop"),
    )


#: Cells of a histogram of cosines, from -1 to 1.
CELLS = 1024
SHARES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p100": 1.0}
#: Tasks that share the rows; each gives one histogram for each query.
MOST_PARTS = 16


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the query block, the block, its ids, cosines, which of them count) for each pair of blocks."""
    for batch in batches:
        for part, x, y in zip(batch.column("part").to_pylist(), batch.column("x"), batch.column("y")):
            (ids, q), (others, r) = matrix(x.values), matrix(y.values)
            width = max(q.shape[1], r.shape[1])
            q, r = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, r))
            near = q @ r.T
            yield part, x.values, ids, near, (near > -2) & (ids[:, None] != others[None, :])


def _cells(near: np.ndarray) -> np.ndarray:
    # Rounded, so that a cosine is in the same cell whatever block it was made in.
    return np.clip(np.floor((np.round(near, 9) + 1) * (CELLS / 2)), 0, CELLS - 1).astype(np.int64)


def _tallied(above: float):
    def out(ids, n, total, over, hist):
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, hist.size + 1, CELLS), pa.int32()), pa.array(hist.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(n), pa.array(total), pa.array(over), lists], names=["id", "n", "total", "above", "hist"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for part, _, ids, near, ok in _products(batches):
            if part != at or len(held[0]) != len(ids):
                if held is not None:
                    yield out(*held)
                at, held = part, (ids, np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids), np.int64), np.zeros((len(ids), CELLS), np.int64))
            held[1][:] += ok.sum(axis=1)
            held[2][:] += np.where(ok, near, 0).sum(axis=1)
            held[3][:] += (ok & (near > above)).sum(axis=1)
            i, j = np.nonzero(ok)
            held[4][:] += np.bincount(i * CELLS + _cells(near[i, j]), minlength=len(ids) * CELLS).reshape(len(ids), CELLS)
        if held is not None:
            yield out(*held)

    return run


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cosines of each query that lie in its wanted cells."""
    for _, x, ids, near, ok in _products(batches):
        wanted = np.zeros((len(ids), CELLS), bool)
        for k, cells in enumerate(x.field("cells").to_pylist()):
            wanted[k, cells] = True
        cell = _cells(np.where(ok, near, 0))
        i, j = np.nonzero(ok & wanted[np.arange(len(ids))[:, None], cell])
        yield pa.RecordBatch.from_arrays([pa.array(ids[i], pa.string()), pa.array(cell[i, j].astype(np.int32)), pa.array(near[i, j])], names=["id", "cell", "similarity"])


def similarity_spread(queries: DataFrame, vectors: DataFrame, above: float = 0.7) -> DataFrame:
    """Per query: mean, percentiles by nearest rank and how many are above, of its cosines with all rows of ``vectors`` but itself; both are (id, embedding).

    Pairs are never written. Blocks of vectors are multiplied twice: first each query's cosines are counted by CELLS equal cells, which tells the cells
    that hold the wanted places; then only the cosines in those cells, about a hundredth of all, are put in order.
    """
    n_parts, rows = blocks(vectors, "y")
    rows = materialize(rows, "rows")
    salts = min(MOST_PARTS, n_parts)

    def met(some: DataFrame, *more: str) -> DataFrame:
        _, x = blocks(some, "x", *more)
        x = x.select("part", "x", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        return x.join(rows.select((F.col("part") % salts).cast("int").alias("salt"), "y"), "salt").select("part", "x", "y")

    tally = met(queries).mapInArrow(_tallied(above), "id string, n long, total double, above long, hist array<long>")
    tally = materialize(tally, "tally")
    sums = tally.groupBy("id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("above").alias("above")).where("n > 0")
    cells = tally.select("id", F.posexplode("hist").alias("cell", "c")).where("c > 0").groupBy("id", "cell").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("id").orderBy("cell"))
    places = F.array(*[F.struct(F.lit(k).alias("name"), F.least(F.floor(F.col("n") * s), F.col("n") - 1).alias("at")) for k, s in SHARES.items()])
    wanted = cells.withColumn("upto", upto).join(sums.select("id", "n"), "id").withColumn("w", F.explode(places))
    wanted = wanted.where((F.col("w.at") < F.col("upto")) & (F.col("w.at") >= F.col("upto") - F.col("c")))
    wanted = materialize(wanted.select("id", "cell", "w.name", (F.col("w.at") - F.col("upto") + F.col("c") + 1).alias("rn")), "wanted")
    asked = queries.join(wanted.groupBy("id").agg(F.collect_set("cell").alias("cells")), "id")
    found = met(asked, "cells").mapInArrow(_picked, "id string, cell int, similarity double")
    ranked = found.withColumn("rn", F.row_number().over(Window.partitionBy("id", "cell").orderBy("similarity")))
    picked = ranked.join(wanted, ["id", "cell", "rn"]).groupBy("id").agg(*[F.round(F.max(F.when(F.col("name") == k, F.col("similarity"))), 6).alias(k) for k in SHARES])
    return sums.join(picked, "id").select("id", F.round(F.col("total") / F.col("n"), 6).alias("mean"), "above", *SHARES)


def match_overlap(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query, golden, other, ratio): how many golden and other documents (text, golden) hold any word of each query (query, words).

    Queries are few and bounded by the caller; each document is read once.
    """
    hit = F.exists("words", lambda w: F.contains(F.lower("text"), F.lower(w)))
    rows = docs.join(F.broadcast(queries)).where(hit).groupBy("query").agg(F.count_if("golden").alias("golden"), F.count_if(~F.col("golden")).alias("other"))
    rows = queries.select("query").join(rows, "query", "left").na.fill(0)
    return rows.select("query", "golden", "other", F.round(F.col("other") / F.nullif(F.col("golden") + F.col("other"), F.lit(0)), 2).alias("ratio"))


def grid(spark, **axes: list) -> DataFrame:
    """Every combination of a few parameter values, as rows."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        out = one if out is None else out.crossJoin(one)
    return out


def perturbed(pool: DataFrame, settings: DataFrame, threshold: float, base: str = "baseline") -> DataFrame:
    """(config, shown, kept, ids) of each setting (config, alpha, rerank, top_k): its page of the candidates, and how many of them ``base`` shows.

    ``pool`` is a bounded page of candidates (id, created_at, s_text, s_vec, and the factors of a reranking); settings are few.
    """
    mixed = F.col("alpha") * F.col("s_vec") + (1 - F.col("alpha")) * F.col("s_text")
    factor = F.col("g") * F.col("intent_boost") * F.col("quality") * F.col("feedback_boost")
    scored = pool.join(F.broadcast(settings)).withColumn("score", F.round(mixed * F.when(F.col("rerank"), factor).otherwise(1.0), 9)).where(F.col("score") >= threshold)
    rank = F.row_number().over(Window.partitionBy("config").orderBy(F.desc("score"), F.desc("created_at"), "id"))
    top = materialize(scored.withColumn("rank", rank).where(F.col("rank") <= F.col("top_k")).select("config", "id", "rank"), "perturbed")
    own = top.where(F.col("config") == base).select("id", F.lit(True).alias("own"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), ",").alias("ids")
    return top.join(F.broadcast(own), "id", "left").groupBy("config").agg(F.count(F.lit(1)).alias("shown"), F.count_if("own").alias("kept"), ids)


def synthetic_claims(spark, golden: DataFrame, n: int, templates: list[tuple[str, str, str]], fillers: DataFrame) -> DataFrame:
    """Golden rows (id, text, kind, scope), then made ones up to ``n`` in all: by index, a template (text, kind, scope) and a filler for its {tech}.

    Fillers are rows (id, name) of any number; they get their places by id and are joined to the made rows. Without any, nothing is made.
    """
    have = golden.count()
    placed = materialize(numbered(fillers.select("id", "name"), [F.asc("id")], "place"), "fillers")
    several = max(1, placed.count())
    pick = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(row, ("text", "kind", "scope"))]) for row in templates])
    made = spark.range(max(0, n - have)).select(F.col("id").alias("i"), (F.col("id") % several + 1).alias("place")).join(small(placed.select("place", "name")), "place")
    row, digits = F.get(pick, (F.col("i") % len(templates)).cast("int")), F.col("i").cast("string")
    name = F.concat(F.lit("synth-"), F.lpad(digits, F.greatest(F.lit(5), F.length(digits)), F.lit("0")))
    made = made.select(name.alias("id"), F.replace(row["text"], F.lit("{tech}"), F.col("name")).alias("text"), row["kind"].alias("kind"), row["scope"].alias("scope"))
    kept = golden.select("id", "text", "kind", "scope")
    if n < have:
        kept = numbered(kept, [F.asc("id"), F.asc("text")], "_place").where(F.col("_place") <= n).drop("_place")
    return kept.unionByName(made)
