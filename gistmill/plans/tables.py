"""Stored tables: cut lineage with Parquet in the folder that the session's ``spark.checkpoint.dir`` names.

What a result does not read is deleted as soon as it is used up.  What a lazy result reads stays until
the ``scope`` in which it was made is closed, else until the driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_ROOTS: dict[tuple[str, str], str] = {}
_SCOPE: ContextVar[list[str] | None] = ContextVar("gistmill_scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is named, a temporary one is made if the session runs in one process; on a cluster that would give each machine
    a folder of its own, so there ValueError is raised.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="gistmill-")
    return _LOCAL["dir"]


def root(spark: SparkSession) -> str:
    """The application's own folder in the shared one; the driver's JVM removes it when it ends."""
    key = (spark.sparkContext.applicationId, shared_dir(spark))
    if key not in _ROOTS:
        path = f"{key[1]}/gistmill-{uuid.uuid4().hex}"
        at, where = _place(spark, path)
        where.mkdirs(at)
        where.deleteOnExit(at)
        _ROOTS[key] = path
    return _ROOTS[key]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the application's folder, deleted with the scope if not before."""
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    held = _SCOPE.get()
    if held is not None:
        held.append(path)
    return path


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once as Parquet in the shared folder; return it reread, and its path.

    Later stages, and retries after a lost executor, read the table instead of repeating the
    work that made it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove stored tables that nothing reads any more."""
    for path in paths:
        at, where = _place(spark, path)
        where.delete(at, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a stored table."""
    at, where = _place(spark, path)
    return where.getContentSummary(at).getLength()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Every stored table that is made inside is gone at the end: for results that are written out, or collected, inside."""
    held: list[str] = []
    token = _SCOPE.set(held)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        delete(spark, *held)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table for work that is heavier than its bytes: dealt out to all cores where its files give fewer partitions.

    Large tables have more partitions than there are cores, and are read as they are.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows and bytes of one Arrow batch that is handed to Python.  Long texts make large batches, so both are bounded.
BATCH_ROWS = 1024
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, so that long texts fit in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
