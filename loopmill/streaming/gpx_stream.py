"""Profiles of GPX files as they arrive: each file is judged by itself, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loopmill.functions.scratch import scope
from loopmill.operators.tracks import profile_summary
from loopmill.sources.gpx import BINARY_FILE, as_text, read_gpx

COMMITS = "_commits"


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """track_id (the path) and content of files that come into ``folder``; content is null where it is not UTF-8."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select(F.col("path").alias("track_id"), as_text().alias("content"))


def table_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """track_id and content of rows that come as Parquet files into ``folder``, as from an upload log."""
    return spark.readStream.schema("track_id STRING, content STRING").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _commits(spark: SparkSession, profiles: str, number: int | None = None):
    """(file system, path) of the commit marks beside ``profiles``, or of one batch's."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{profiles}/{COMMITS}" + ("" if number is None else f"/{number}"))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def write_batch(batch: DataFrame, number: int, profiles: str, rejects: str) -> None:
    """Summaries and rejects of one batch, with a mark once both are there; scratch tables go with the batch.

    A batch that runs again overwrites its own folders. Its mark goes first, so that no reader meets a half of it.
    """
    spark = batch.sparkSession
    files, mark = _commits(spark, profiles, number)
    files.delete(mark, False)
    with scope(spark):
        points, bad = read_gpx(batch)
        profile_summary(points, ["track_id"]).write.mode("overwrite").parquet(f"{profiles}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
    files.create(mark, True).close()


def read_committed(spark: SparkSession, profiles: str, rejects: str) -> tuple[DataFrame, DataFrame] | None:
    """(summaries, rejects) of the batches that are whole, with their ``batch``; None if there is none yet.

    A batch counts by its mark, which is written after both of its tables.
    """
    files, path = _commits(spark, profiles)
    numbers = [m.getPath().getName() for m in files.listStatus(path)] if files.exists(path) else []
    if not numbers:
        return None
    both = [spark.read.option("basePath", base).parquet(*(f"{base}/batch={n}" for n in numbers)) for base in (profiles, rejects)]
    return both[0], both[1]


def start(files: DataFrame, profiles: str, rejects: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write summaries of the stream ``files`` below ``profiles`` and rejected files below ``rejects``, by ``write_batch``;
    ``read_committed`` reads both."""
    writer = files.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, profiles, rejects)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
