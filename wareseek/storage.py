"""Shared scratch space, staging writes and size-checked reads to the driver."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

_CHECKPOINT_CONF = "spark.checkpoint.dir"
_OWNED: ContextVar[list[str] | None] = ContextVar("scratch folders of the run that is going on", default=None)
MAX_BROADCAST_BYTES = 64 << 20


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may run without it.
    """
    root = spark.conf.get(_CHECKPOINT_CONF, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_CONF} to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="wareseek-")
    spark.conf.set(_CHECKPOINT_CONF, root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    owned = _OWNED.get()
    if owned is not None:
        owned.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes what was staged inside the block when it ends, also when it fails.

    For runs that leave their results in a table of their own: DataFrames over staged copies
    cannot be read afterwards.
    """
    token = _OWNED.set([])
    try:
        yield
    finally:
        for path in _OWNED.get() or ():
            delete_folder(spark, path)
        _OWNED.reset(token)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can write one; a missing one is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def list_folders(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """Names of the folders below ``path`` and when each was last changed, in seconds since 1970."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = files.listStatus(folder)
    return [(f.getPath().getName(), f.getModificationTime() / 1000) for f in found if f.isDirectory()]


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a plain scan over all cores when its files yield fewer splits than there are cores.

    Meant ahead of costly per-row work: a few files with huge row groups would otherwise keep it
    on a few tasks. A scan with enough splits is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Later passes reuse the files, so an expensive stage (downloads, models) runs once and its
    result outlives the executors that produced it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_if_at_most(df: DataFrame, max_rows: int) -> list[Row] | None:
    """The rows of ``df`` when there are no more than ``max_rows``, else None.

    Never brings more than ``max_rows + 1`` rows to the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def is_small(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether ``df`` may be broadcast: measured in rows and in bytes of content.

    Reads no more than ``max_rows + 1`` rows.
    """
    width = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    found = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), width.alias("bytes")).first()
    return found["rows"] <= max_rows and (found["bytes"] or 0) <= max_bytes
