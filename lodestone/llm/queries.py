"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bwt, chat, chunks, decontaminate, fm, minhash, pieces, pseudonyms, quality, secretscan, shards, sql, trie, whitening
from lodestone.runtime import ship_package


#: Bytes and rows of an Arrow batch that goes to a Python worker.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 1000


def tune(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes, as long texts must not pile up in one batch, and by rows, as short ones grow in a worker.

    Spark reads these settings when a result is computed, so they stay with the session.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), threshold_percent=85)


def op2_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.histogram_sort(table(spark, sf_dir, "documents"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    out = pseudonyms.pseudonyms(table(spark, sf_dir, "documents"), pseudonyms.session_key(spark))
    return out.select("doc_id", "text", "n_found", F.to_json("kinds").alias("kinds"))


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return pieces.encode_decode(table(spark, sf_dir, "documents"), digests=True)


def op5_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return fm.remove_repeated_words(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return chat.digests(chat.format_chats(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return chunks.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_bwt_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return bwt.remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return secretscan.find_secrets(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_histogram_sort": op2_histogram_sort,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_piece_encoding": op4_piece_encoding,
    "op5_fm_substring_dedup": op5_fm_substring_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality": op8_quality,
    "op9_bwt_substring_dedup": op9_bwt_substring_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_secret_scan": op13_secret_scan,
}

ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": sql.near_duplicates(85),
    "op2_histogram_sort": sql.byte_shards(),
    "op5_fm_substring_dedup": sql.repeated_words(fm.WINDOW),
    "op6_chat_format": sql.chats(chat.OPEN.decode(), chat.CLOSE.decode()),
    "op9_bwt_substring_dedup": sql.repeated_bytes(bwt.WINDOW),
    "op10_decontaminate": decontaminate.ORACLE,
    "op11_prefix_trie": trie.oracle(),
}
