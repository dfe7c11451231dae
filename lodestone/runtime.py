"""Session helpers that every family of operators shares.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``: it is
shared by the driver and all executors, so a table written there outlives any executor. They are
deleted when their scope ends, when they are discarded, or with the process.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Measured bytes of a table that may be broadcast; larger sides shuffle.
BROADCAST_BYTES = 8 << 20
#: Rows and bytes of a batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
#: What a row of a broadcast table costs beside its values.
ROW_BYTES = 16
#: A key with more rows than this is hot: its rows are dealt over SALTS tasks.
HOT_ROWS = 1000
SALTS = 64

_WIDTH = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4}
#: Paths of intermediate tables that still exist, by scope, the innermost last.
_tables: list[list[tuple[SparkSession, str]]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables. Where none is set a local master gets a fresh one; a cluster is refused."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-lodestone-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder; one whose JVM has gone stays."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    if jvm is None:
        return
    with contextlib.suppress(Py4JError, ConnectionError):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration() if jsc else jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder among the intermediate tables, deleted with its scope."""
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    _tables[-1].append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    gone = {t._lodestone_path: t.sparkSession for t in tables if "_lodestone_path" in t.__dict__}
    for path, spark in gone.items():
        _delete(spark, path)
    for scope in _tables:
        scope[:] = [x for x in scope if x[1] not in gone]


@contextlib.contextmanager
def scope(*, keep: bool = False) -> Iterator[None]:
    """Tables written inside are deleted at its end; write what must outlive it after leaving, or before entering."""
    _tables.append([])
    try:
        yield
    finally:
        mine = _tables.pop()
        if keep:
            _tables[-1].extend(mine)
        else:
            for spark, path in mine:
                _delete(spark, path)


@atexit.register
def clean() -> None:
    """Delete all intermediate tables of this process."""
    for tables in _tables:
        for spark, path in tables:
            _delete(spark, path)
        tables.clear()


def bounded(spark: SparkSession) -> SparkSession:
    """``spark`` with the limits under which all queries are planned.

    The planner takes the size of compressed files for that of their rows and would broadcast tables many times BROADCAST_BYTES,
    through the driver. So without a hint nothing is broadcast before its rows were shuffled and their bytes counted.
    Batches for Python workers are bounded, as their default of 10 000 rows of text is not. The shuffle files of an action are deleted
    when it ends, not when the driver's memory is next collected, so a query of many steps holds the files of one.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(BROADCAST_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def measured(df: DataFrame) -> int:
    """Bytes of a table's values and rows, counted by one aggregate over it."""
    fixed, grown = ROW_BYTES, []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            grown.append(F.octet_length(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            grown.append(F.size(f.name) * 8)
        elif isinstance(f.dataType, T.StructType):
            fixed += 8 * len(f.dataType.fields)
        else:
            fixed += _WIDTH.get(type(f.dataType), 8)
    size = sum((F.coalesce(g, F.lit(0)).cast("long") for g in grown), F.lit(fixed).cast("long"))
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a materialised table for broadcast if its measured bytes stay under ``limit``; else leave it to a shuffle join."""
    return F.broadcast(df) if measured(df) <= limit else df


def push(rows: DataFrame, table: DataFrame, on: list[str], by: str, how: str = "left") -> DataFrame:
    """Join ``rows`` with a materialised ``table`` of one row per key, few keys with many rows each.

    The table is broadcast if small; else it is repeated SALTS times and met by a salt taken from column
    ``by``, so the rows of a key are dealt over as many tasks.
    """
    if measured(table) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), on, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], rows_of: str, by: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with a ``table`` of one row per key, whose column ``rows_of`` says how many rows the key has.

    Keys of more than HOT_ROWS rows are few and are pushed to their rows, so none gathers in one task; the
    others shuffle. ``how`` is inner or left_semi.
    """
    hot, rest = table.where(F.col(rows_of) > HOT_ROWS).drop(rows_of), table.where(F.col(rows_of) <= HOT_ROWS).drop(rows_of)
    wanted = [c for c in table.columns if c not in on and c != rows_of] if how == "inner" else []
    if hot.isEmpty():
        return rows.join(rest, on, how).select(*rows.columns, *wanted)
    met = push(rows, materialize(hot.withColumn("_hot", F.lit(True)), "hot"), on, by)
    first = met.where("_hot").select(*rows.columns, *wanted)
    return first.unionByName(met.where("_hot is null").select(*rows.columns).join(rest, on, how).select(*rows.columns, *wanted))


def ship_package(spark: SparkSession) -> None:
    """Let local Python workers import this package from where the driver found it.

    On a cluster the package is installed or sent with ``--py-files``; this only helps where
    workers share the driver's file system.
    """
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, home])
