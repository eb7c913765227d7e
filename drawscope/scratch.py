"""Tables written to the folder that driver and executors share.

Lineage is cut by writing Parquet there and reading it again: any executor can be
lost afterwards, and nothing upstream is computed twice. What a returned plan still reads
stays there until its result is written: a caller that writes it opens a ``scope`` and
leaves it afterwards, which deletes all that was written within.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Used only where one machine runs all and the session names no spark.checkpoint.dir (tests, a laptop).
LOCAL_FALLBACK = "file:///tmp/checkpoints/drawscope"

#: Paths written in each open scope of this thread (or task of an event loop); others have their own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a local one is set only if none is and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir is unset: {master} needs a folder that driver and executors share")
        folder = LOCAL_FALLBACK
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/drawscope-{label}-{uuid.uuid4().hex}"


def scoped_path(spark: SparkSession, label: str) -> str:
    """A new path that the open scope, if any, deletes."""
    path = new_path(spark, label)
    if _scopes.get():
        _scopes.get()[-1].append(path)
    return path


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back; ``.scratch_path`` names the place."""
    spark = df.sparkSession
    path = scoped_path(spark, label)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


def release(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once no later plan reads it."""
    for df in frames:
        path = getattr(df, "scratch_path", None)
        if path:
            _delete(df.sparkSession, path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, on leaving, whatever ``materialise`` wrote within, in this thread (and no inner scope has deleted)."""
    written: list[str] = []
    token = _scopes.set((*_scopes.get(), written))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in written:
            _delete(spark, path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
