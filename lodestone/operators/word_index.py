"""An index of three-letter runs for substring search: postings as a table, partitioned by run.

A word matches a text only if the text holds all of its runs, so the postings of the word's rarest runs bound the candidates, and the match itself
is made on the candidates' texts. Only the partitions of these runs are read. Words under three characters are
matched by a scan, as they have no run.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.runtime import fresh_path, materialize, small

RUN = 3
#: Runs of a word whose postings are read, the rarest ones.
READ = 3


@dataclass(frozen=True)
class WordIndex:
    """``postings`` (part, run, id) lies partitioned by part; ``counts`` has the number of texts of each run."""

    postings: DataFrame
    counts: DataFrame
    parts: int


def runs_of(text: Column) -> Column:
    """The distinct runs of a text, made where its row is read; a look-ahead finds those that overlap, none from inside a character."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=([^\x{{DC00}}-\x{{DFFF}}].{{{RUN - 1}}}))"), F.lit(1)))


def part_of(run: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(parts)).cast("int")


def build(rows: DataFrame, parts: int = 64) -> WordIndex:
    """An index of ``rows`` (id, text), in the shared folder. Null and short texts have no postings.

    A part's postings are in order of run, so its files are read in pages of few runs; a common run is dealt over several tasks by id.
    """
    spark = rows.sparkSession
    path, kind = fresh_path(spark, "postings"), rows.schema["id"].dataType.simpleString()
    posted = rows.where("text is not null").select("id", F.explode(runs_of(F.lower("text"))).alias("run")).withColumn("part", part_of(F.col("run"), parts))
    ordered = posted.repartitionByRange("part", "run", "id").sortWithinPartitions("part", "run", "id")
    ordered.write.partitionBy("part").option("compression", "zstd").parquet(path)
    postings = spark.read.schema(f"run string, id {kind}, part int").parquet(path)
    return WordIndex(postings, materialize(postings.groupBy("run").agg(F.count(F.lit(1)).alias("n")), "counts"), parts)


def postings_of(index: WordIndex, word: str) -> tuple[DataFrame, int]:
    """The postings of the word's rarest runs, and how many runs that are; none if some run is nowhere."""
    low = word.lower()
    runs = list(dict.fromkeys(low[k : k + RUN] for k in range(len(low) - RUN + 1)))
    spark = index.postings.sparkSession
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in runs])).alias("run")).withColumn("part", part_of(F.col("run"), index.parts))
    found = asked.join(index.counts.where(F.col("run").isin(runs)), "run", "left").select("run", "part", "n").collect()
    if any(r.n is None for r in found):
        return index.postings.where("false"), 1
    rare = sorted(found, key=lambda r: (r.n, r.run))[:READ]
    return index.postings.where(F.col("part").isin([r.part for r in rare]) & F.col("run").isin([r.run for r in rare])), len(rare)


def matches(rows: DataFrame, index: WordIndex, words: Sequence[str]) -> DataFrame:
    """The ``rows`` (id, text, ...) that hold any of the words, as ``any_word`` finds them, by the index of the same rows."""
    long, short = [w for w in words if len(w) >= RUN], [w for w in words if len(w) < RUN]
    if short or not long:
        return rows.where(X.any_word(F.col("text"), list(words)))
    ids = None
    for word in long:
        posted, n = postings_of(index, word)
        some = posted.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select("id")
        ids = some if ids is None else ids.unionByName(some)
    ids = materialize(ids.distinct(), "candidates")
    return rows.join(small(ids), "id", "left_semi").where(X.any_word(F.col("text"), long))
