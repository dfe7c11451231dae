"""A training corpus from raw documents, in five stages; each is written as Parquet and read back.

Stages keep the columns of ``documents`` (the last returns token digests) and work on all that the
stage before kept: reject poor documents, leave one of each near-duplicate group, drop documents
that hold a benchmark item, replace personal data, encode into pieces and decode again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, minhash, pieces, pseudonyms, quality
from lodestone.llm.frames import columns_of
from lodestone.llm.queries import table, tune
from lodestone.runtime import discard, fresh_path, materialize, scope, ship_package, small


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``ids``; rows with a null doc_id stay."""
    ids = materialize(ids.select("doc_id").distinct(), "ids")
    return docs.join(small(ids), "doc_id", "left_anti").select(*columns_of(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier takes for good.

    Null and empty texts are scored as empty texts; very long ones whole; repeated rows score alike; rows with a null
    doc_id are scored too, but never learned from. Where nothing can be learned (no labelled good documents, or no
    unlabelled ones) all documents stay. An empty table stays empty; extra columns stay as they are.
    """
    tune(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (similarity 0.8 on five-word shingles), that with the smallest doc_id.

    Of repeated rows with one doc_id the one with the smallest text stays, then the smallest by the other columns
    (columns that have no order, like maps, apart). Null, empty and word-less texts are nobody's copy and stay, as do rows with
    a null doc_id. Long texts count whole; an empty table stays empty; extra columns stay as they are.
    """
    tune(spark)
    classes = minhash.near_duplicates(docs, threshold_percent=80)
    left = _without(docs, classes.where(~F.col("kept")))
    again = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "ids")
    n = again.count()
    if not n:
        return left
    repeated = left.join(small(again), "doc_id", "left_semi").select(*columns_of(docs))
    ordered = [c for c, (name, kind) in zip(columns_of(docs), docs.dtypes) if name not in ("doc_id", "text") and not any(k in kind for k in ("map<", "variant", "interval"))]
    one = repeated.groupBy("doc_id").agg(F.min_by(F.struct(*columns_of(docs)), F.struct("text", *ordered)).alias("r"))
    return left.join(small(again), "doc_id", "left_anti").select(*columns_of(docs)).unionByName(one.select("r.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (containment 0.8 of its five-word shingles).

    Null and empty texts hold none; items without words are in none; rows with a null doc_id stay; of repeated
    rows with one doc_id all go if one holds an item. Long texts count whole; empty tables on either side change nothing;
    extra columns stay as they are.
    """
    found = decontaminate.contained_items(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found)


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms of the same format, under the session's key.

    A null text stays null and an empty one empty; equal values get equal pseudonyms in all rows, repeated ones too; long
    texts are read whole. No row goes; n_chars follows the new text; the other columns stay as they are.
    """
    tune(spark)
    return pseudonyms.replace_text(docs, pseudonyms.session_key(spark))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's piece ids and of what decoding them gives.

    One row for each document, repeated ones too, with its doc_id (null stays null). Null and empty texts have no ids. Long
    texts are encoded whole; an empty table gives no rows; other columns are left behind.
    """
    tune(spark)
    return pieces.encode_decode(docs, digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("PII", pseudonymised),
    ("SentencePiece encoding and decoding", encoded),
]

#: Training a classifier and permuting by key are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ship_package(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name.split()[0].lower())
        with scope():
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        docs._lodestone_path = path
        if before is not None:
            discard(before)
        before = docs
    return docs
