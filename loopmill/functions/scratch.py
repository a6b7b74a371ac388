"""Written tables that end a plan's lineage, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders written inside each open ``scope`` of this thread or task; others have their own.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode, and an error on a cluster,
    whose executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().get()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name in the shared folder."""
    path = f"{shared_folder(spark)}/loopmill/{uuid.uuid4().hex}"
    for scope_ in _SCOPES.get():
        scope_.append(path)
    return path


def settle(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once and read it back: lineage ends, so that a lost executor costs its own tasks.

    The next join of what is read is a sorted one: see ``unbroadcast``.
    """
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return unbroadcast(df.sparkSession.read.schema(df.schema).parquet(path))


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df``, which its next join does not broadcast. Spark judges a table by its compressed files and takes no account
    of an ``explode``, so that what grows with the input would pass through the driver."""
    return df.hint("merge")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark reads; nothing happens if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end all scratch tables written inside it by its own thread, so results must be written or
    collected before. Scopes of other threads that run meanwhile keep theirs.

    Tables written outside a scope stay until the shared folder is cleared.
    """
    written: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), written))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in written:
            remove(spark, path)
