"""Files: record directories, JSON lines, manifests and policies."""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass, field, fields

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLAIM = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "kind", "scope", "boundary_class", "content_hash", "memory_type")])
ENTITY = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "type", "name", "canonical_key")])
RELATION = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "src_id", "dst_id", "type")])


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object a file, in any folder below ``path``; unreadable files become rows with ``bad`` set."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    df = spark.read.schema(whole).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").json(path)
    return df.select(*schema.fieldNames(), F.col("_corrupt_record").isNotNull().alias("bad"), F.col("_metadata.file_path").alias("file"))


def write_claims(claims: DataFrame, path: str) -> None:
    """Export claims as JSON, a folder for each scope."""
    claims.write.mode("overwrite").partitionBy("scope").json(f"{path}/claims")


def write_files(rows: DataFrame, path: str) -> DataFrame:
    """Write each row (file, document) as a file of its own below ``path``, indented JSON with a line end; gives (file) of what is written.

    For exchange with people and version control; tables of many rows belong in ``write_claims``. A task
    that runs again writes the same files again.
    """

    def run(batches):
        for batch in batches:
            for name, document in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, full = fs.FileSystem.from_uri(f"{path}/{name}")
                where.create_dir(full.rsplit("/", 1)[0], recursive=True)
                with where.open_output_stream(full) as out:
                    out.write((json.dumps(json.loads(document), indent=2, ensure_ascii=False) + "\n").encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["file"])

    return rows.select("file", "document").mapInArrow(run, "file string")


# Fixed names of a manifest's fields.
MANIFEST_VERSION = "1.0"
MANIFEST_FIELDS = {"version", "engine_version", "last_push_at", "last_push_policy_version", "last_pull_at"}


def read_manifest(path: str) -> dict | None:
    """The manifest of an exchange folder; null if there is none or it does not hold."""
    where, full = fs.FileSystem.from_uri(f"{path}/manifest.json")
    if where.get_file_info(full).type != fs.FileType.File:
        return None
    with where.open_input_stream(full) as f:
        try:
            found = json.loads(f.read())
        except ValueError:
            return None
    ok = isinstance(found, dict) and found.get("version") == MANIFEST_VERSION and {"engine_version", "last_push_at"} <= set(found) <= MANIFEST_FIELDS
    return found if ok else None


def _write_manifest(path: str, manifest: dict) -> dict:
    where, full = fs.FileSystem.from_uri(f"{path}/manifest.json")
    where.create_dir(full.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(full) as out:
        out.write((json.dumps(manifest, indent=2) + "\n").encode())
    return manifest


def push_manifest(path: str, at: datetime.datetime, engine_version: str, policy_version: str | None = None) -> dict:
    """Write the manifest of a push; the time of the last pull stays."""
    old = read_manifest(path) or {}
    new = {"version": MANIFEST_VERSION, "engine_version": engine_version, "last_push_at": at.isoformat()}
    if policy_version is not None:
        new["last_push_policy_version"] = policy_version
    return _write_manifest(path, {**new, **{k: v for k, v in old.items() if k == "last_pull_at"}})


def pull_manifest(path: str, at: datetime.datetime) -> dict | None:
    """Note a pull in an existing manifest; without one nothing is written."""
    old = read_manifest(path)
    return None if old is None else _write_manifest(path, {**old, "last_pull_at": at.isoformat()})


def newest(rows: DataFrame, since: Column | None = None, most: int = 10_000) -> DataFrame:
    """The newest ``most`` rows (id, created_at), from ``since`` on if given."""
    found = rows.where(F.col("created_at") >= since) if since is not None else rows
    return found.orderBy(F.desc("created_at"), F.desc("id")).limit(most)


def append_audit(rows: DataFrame, path: str) -> None:
    """Append-only log as JSON lines."""
    rows.write.mode("append").json(path)


def folder_status(spark: SparkSession, path: str) -> DataFrame:
    """(folder, files, bytes) below ``path``, from file listings alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def reconcile(df: DataFrame, schema: T.StructType, defaults: dict | None = None, renamed: dict[str, str] | None = None) -> DataFrame:
    """``df`` with exactly the columns and types of ``schema``: old names become new ones, missing columns are added, nulls take their default."""
    defaults, had = defaults or {}, {new: old for old, new in (renamed or {}).items()}

    def column(f: T.StructField) -> Column:
        name = f.name if f.name in df.columns else had.get(f.name)
        have = F.col(name).try_cast(f.dataType) if name in df.columns else F.lit(None).cast(f.dataType)
        return (F.coalesce(have, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else have).alias(f.name)

    return df.select(*[column(f) for f in schema.fields])


@dataclass
class Retrieval:
    """Parameters of retrieval as a policy document gives them."""

    alpha: float = 0.65
    threshold: float = 0.15
    k_text: int = 48
    k_vec: int = 96
    max_hops: int = 2
    hop_decay: float = 0.75
    seed_k: int = 6
    extra: dict = field(default_factory=dict)


def retrieval_policy(document: dict) -> Retrieval:
    """Validated parameters: unknown keys are refused, missing ones take their defaults, numbers are kept in range."""
    block = document.get("retrieval") or {}
    known = {f.name for f in fields(Retrieval)} - {"extra"}
    unknown = set(block) - known
    if unknown:
        raise ValueError(f"unknown retrieval keys: {sorted(unknown)}")
    p = Retrieval(**block)
    if not 0 <= p.alpha <= 1 or not 0 < p.hop_decay <= 1:
        raise ValueError("alpha must be in [0, 1] and hop_decay in (0, 1]")
    p.max_hops, p.k_text, p.k_vec = min(2, max(0, p.max_hops)), max(1, p.k_text), max(1, p.k_vec)
    return p


def read_policy(path: str) -> dict:
    """A policy document from a JSON or YAML file; YAML needs the yaml package."""
    where, full = fs.FileSystem.from_uri(path)
    with where.open_input_stream(full) as f:
        text = f.read().decode()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def limit_or(value: object, default: int) -> int:
    """A limit as given, at least 1; what is no finite number takes the default."""
    ok = isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) != float("inf")
    return max(1, int(value)) if ok else default


def latest_policy(policies: DataFrame) -> DataFrame:
    """The newest row of a policy table."""
    return policies.agg(F.max(F.struct("created_at", "id", "version")).alias("p")).select("p.*")
