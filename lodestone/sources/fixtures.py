"""Knowledge-record tables as views of the driver's parquet tables.

The same text serves Spark and DuckDB; only the type names in braces differ. ``NOW`` is fixed so
that results do not depend on the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "2024-02-01 00:00:00"

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_ND = "(SELECT count(*) FROM documents)"

VIEWS = {
    "claims": """SELECT concat('clm_', doc_id) AS id, text,
 CASE doc_id % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'task' WHEN 2 THEN 'preference' ELSE 'policy_hint' END AS kind,
 CASE doc_id % 3 WHEN 0 THEN 'project' WHEN 1 THEN 'principle' ELSE 'session' END AS scope,
 CASE WHEN doc_id % 10 < 5 THEN 'internal' WHEN doc_id % 10 < 8 THEN 'public' WHEN doc_id % 10 = 8 THEN 'pii' ELSE 'secret' END AS boundary_class,
 CASE doc_id % 6 WHEN 0 THEN 'knowledge' WHEN 1 THEN 'working_state' WHEN 2 THEN 'procedure' WHEN 3 THEN 'norm' WHEN 4 THEN 'evidence' END AS memory_type,
 CASE doc_id % 7 WHEN 0 THEN 'completed' WHEN 1 THEN 'stale' ELSE 'active' END AS status,
 CAST(n_chars % 101 AS DOUBLE) / 100 AS utility, CAST(doc_id % 11 AS DOUBLE) / 10 AS confidence,
 {TS} '2024-02-01 00:00:00' - INTERVAL '1' HOUR * CAST((doc_id * 37) % 4800 AS INT) AS created_at,
 CAST(doc_id % 25 AS INT) AS retrieval_count, doc_id % 17 = 0 AS tombstone FROM documents""",
    "claim_vectors": "SELECT concat('clm_', vec_id) AS claim_id, CAST(embedding AS {DARR}) AS embedding FROM embeddings",
    "feedback": f"""SELECT concat('fb_', event_id) AS id, concat('clm_', (event_id * 7) % {_ND}) AS claim_id,
 CASE event_type WHEN 'purchase' THEN 'helpful' WHEN 'error' THEN 'harmful' WHEN 'view' THEN 'outdated' WHEN 'click' THEN 'duplicate' ELSE 'completed' END AS signal,
 value AS score, ts, event_id AS seq FROM events""",
    "observations": """SELECT concat('obs_', conv_id, '_', turn) AS id,
 CASE role WHEN 'user' THEN 'chat' WHEN 'assistant' THEN 'tool' ELSE 'system' END AS source_type, text AS content,
 {TS} '2024-02-01 00:00:00' - INTERVAL '1' HOUR * CAST((conv_id * 13 + turn) % 960 AS INT) AS created_at,
 {TS} '2024-02-01 00:00:00' - INTERVAL '1' HOUR * CAST((conv_id * 13 + turn) % 960 AS INT) + INTERVAL '720' HOUR AS expires_at FROM conversations""",
    "entities": """SELECT concat('cust_', c_custkey) AS id, 'Actor' AS type, c_name AS name FROM customer
 UNION ALL SELECT concat('ord_', o_orderkey), 'Event', o_orderpriority FROM orders
 UNION ALL SELECT concat('part_', p_partkey), 'Artifact', p_name FROM part
 UNION ALL SELECT concat('nat_', n_nationkey), 'Concept', n_name FROM nation""",
    "relations": """SELECT concat('r_po_', o_orderkey) AS id, concat('cust_', o_custkey) AS src_id, concat('ord_', o_orderkey) AS dst_id, 'PLACED' AS type FROM orders
 UNION ALL SELECT concat('r_oc_', l_orderkey, '_', l_linenumber), concat('ord_', l_orderkey), concat('part_', l_partkey), 'CONTAINS' FROM lineitem""",
    "entity_rows": """SELECT id, type, name, CASE WHEN k % 3 = 0 THEN concat(lower(type), ':', k) END AS canonical_key,
 concat('{{"n":', k % 7, ',"tags":["a","', k % 3, '"]}}') AS attrs, {TS} '2024-02-01 00:00:00' - INTERVAL '1' HOUR * CAST((k * 37) % 4800 AS INT) AS created_at FROM (
 SELECT concat('cust_', c_custkey) AS id, 'Actor' AS type, c_name AS name, c_custkey AS k FROM customer
 UNION ALL SELECT concat('ord_', o_orderkey), 'Event', o_orderpriority, o_orderkey FROM orders
 UNION ALL SELECT concat('part_', p_partkey), 'Artifact', p_name, p_partkey FROM part
 UNION ALL SELECT concat('nat_', n_nationkey), 'Concept', n_name, n_nationkey FROM nation) x""",
    "relation_rows": """SELECT id, src_id, dst_id, type, concat('{{"w":', k % 5, '}}') AS props, {TS} '2024-02-01 00:00:00' - INTERVAL '1' HOUR * CAST((k * 41) % 4800 AS INT) AS created_at FROM (SELECT id, min(src_id) AS src_id, min(dst_id) AS dst_id, min(type) AS type, min(k) AS k FROM (
 SELECT concat('r_po_', o_orderkey) AS id, concat('cust_', o_custkey) AS src_id, concat('ord_', o_orderkey) AS dst_id, 'PLACED' AS type, o_orderkey AS k FROM orders
 UNION ALL SELECT concat('r_oc_', l_orderkey, '_', l_linenumber), concat('ord_', l_orderkey), concat('part_', l_partkey), 'CONTAINS', l_orderkey + l_linenumber FROM lineitem) y GROUP BY id) x""",
    "active_context_items": f"""SELECT concat('aci_', l_orderkey, '_', l_linenumber) AS id, concat('ac_', l_orderkey) AS active_context_id,
 concat('clm_', l_partkey % {_ND}) AS claim_id, CAST(l_linenumber AS INT) AS rank, l_discount AS score FROM lineitem WHERE (l_partkey % {_ND}) % 5 <> 0""",
    "claim_entities": f"""SELECT DISTINCT claim_id, entity_id FROM (
 SELECT concat('clm_', doc_id) AS claim_id, concat('part_', 1 + (doc_id * 3) % CAST(floor({_ND} / 2) AS BIGINT)) AS entity_id FROM documents WHERE doc_id % 4 <> 3
 UNION ALL SELECT concat('clm_', o_orderkey % {_ND}), concat('ord_', o_orderkey) FROM orders WHERE (o_orderkey % {_ND}) % 4 <> 3 AND o_orderkey % 5 = 0) x""",
    "claim_links": f"""SELECT concat('clk_', src) AS id, concat('clm_', src) AS source_claim_id, concat('clm_', dst) AS target_claim_id, link_type, confidence FROM (
 SELECT doc_id AS src, CASE doc_id % 5 WHEN 3 THEN CASE WHEN doc_id % 15 = 13 THEN doc_id - 10 ELSE doc_id + 5 END WHEN 4 THEN doc_id + 5 ELSE (doc_id * 7 + 11) % {_ND} END AS dst,
 CASE doc_id % 5 WHEN 0 THEN 'supports' WHEN 1 THEN 'extends' WHEN 2 THEN 'related' WHEN 3 THEN 'contradicts' ELSE 'supersedes' END AS link_type,
 CAST(5 + doc_id % 6 AS DOUBLE) / 10 AS confidence FROM documents
 WHERE (doc_id % 5 < 3 AND doc_id % 2 = 0) OR doc_id % 5 = 3 OR (doc_id % 5 = 4 AND doc_id % 35 <> 34)) x WHERE dst <> src AND dst < {_ND}""",
    "critic": "SELECT concat('clm_', doc_id) AS claim_id, CAST(quality AS DOUBLE) * 3 + 1 - CAST(toxic AS DOUBLE) AS score FROM labels",
    "promotion_queue": "SELECT concat('pq_', doc_id) AS id, concat('clm_', doc_id) AS accepted_claim_id, CASE WHEN doc_id % 46 = 0 THEN 'rolled_back' ELSE 'accepted' END AS status FROM documents WHERE doc_id % 23 = 0",
    "evidence": "SELECT concat('evd_', l_orderkey, '_', l_linenumber) AS id, concat('clm_', l_suppkey * 3) AS claim_id, l_returnflag AS source_type FROM lineitem WHERE l_linenumber = 1",
}


class Tables:
    """Lazily built DataFrames of the raw tables and the record views, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in VIEWS:
            text = VIEWS[name]
            used = {r: getattr(self, r) for r in RAW if f"FROM {r}" in text}
            for r in used:
                text = text.replace(f"FROM {r}", f"FROM {{{r}}}")
            text = text.replace("{TS}", "TIMESTAMP_NTZ").replace("{DARR}", "ARRAY<DOUBLE>")
            df = self.spark.sql(text, **used)
        else:
            raise AttributeError(name)
        self.__dict__[name] = df
        return df


def sql_views(*names: str) -> str:
    """``WITH`` clause that defines the named views in DuckDB."""
    parts = [f"{n} AS ({VIEWS[n].replace('{TS}', 'TIMESTAMP').replace('{DARR}', 'DOUBLE[]').replace('{{', '{').replace('}}', '}')})" for n in names]
    return "WITH RECURSIVE " + ",\n".join(parts)
