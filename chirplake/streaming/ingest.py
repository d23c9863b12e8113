"""Streams: new recordings once each by md5, into tables or stored collections, and calendar counts of late events."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chirplake.functions.timefns import time_cell


def recordings(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """Files as they arrive in a folder, with header fields; a copy that comes within ``late`` of the first is dropped."""
    from chirplake.functions.dsp import header_info

    schema = "path string, modificationTime timestamp, length long, content binary"
    files = small_files(spark).readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{wav,WAV}").load(path)
    rows = files.select("path", "modificationTime", F.col("length").alias("filesize"), F.md5("content").alias("md5"), header_info("content").alias("h"))
    return rows.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["md5"]).select("path", "modificationTime", "filesize", "md5", "h.*")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files as they arrive in a folder, with header fields and md5."""
    from chirplake.functions.dsp import header_info

    schema = "path string, modificationTime timestamp, length long, content binary"
    arriving = small_files(spark).readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{wav,WAV}").load(path)
    return arriving.select("path", F.col("length").alias("filesize"), F.md5("content").alias("md5"), header_info("content").alias("h")).select("path", "filesize", "md5", "h.*")


#: How a batch of many small files is read: tasks that look them up (10,000 otherwise), and bytes that opening one counts as
#: (4 MB otherwise, so 32 files a task).
SMALL_FILES = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "64", "spark.sql.files.openCostInBytes": str(64 << 10)}


def small_files(spark: SparkSession) -> SparkSession:
    """A session with the settings of this one, and those for small files. A stream takes up its session's settings once it runs,
    so they can't be those of a moment. Views and functions that were registered by name in the session aren't in it."""
    own = spark.newSession()
    for k, v in {**spark.conf.getAll, **SMALL_FILES}.items():
        if own.conf.isModifiable(k):
            own.conf.set(k, v)
    return own


def insert(stream: DataFrame, collection: Any, name: str, checkpoint: str, rejects: str, metadata: Callable[[DataFrame], Column] | None = None, parse_seq: list[dict] | None = None) -> StreamingQuery:
    """Insert what arrives (:func:`files`) into a stored collection, once for what is there now.

    Each batch is one insert, and its number is in the snapshot that it makes: one that is replayed after a crash adds
    nothing, and its files aren't read. Copies are known by the store's md5s, however long ago the first came, so the stream holds no state. What an
    insert leaves out goes to a table at ``rejects``, a folder for each batch. ``metadata`` gives the JSON of a file's
    record; without it that has its path and a timeexp of 1.
    """
    if collection.store is None:
        raise ValueError("a stream goes into a stored collection")
    text = metadata or (lambda _: F.to_json(F.struct("path", F.lit(1.0).alias("timeexp"))))

    def write(batch: DataFrame, number: int) -> None:
        from chirplake.operators.ingest import stored
        from chirplake.sources.readers import streamed

        if collection.has_batch((name, number)):
            return
        batch = stored(batch)
        collection.insert_media(streamed(batch, name, text(batch)), batch.dropDuplicates(["path"]), parse_seq, (name, number))
        if collection.inserted == (name, number):
            collection.rejects.write.mode("overwrite").parquet(f"{rejects}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cell_counts(events: DataFrame, at: str, window: str = "1 day", late: str = "1 hour", unit: float = 3600, modulo: int = 24) -> DataFrame:
    """Counts by event-time window and calendar cell, as a stream or a table; events that come too late are left out."""
    events = events.withColumn(at, F.col(at).cast("timestamp"))
    seconds = F.unix_micros(F.col(at)) / F.lit(1e6)
    cells = events.withWatermark(at, late).withColumn("timeCell", time_cell(seconds, 0.0, unit, modulo))
    return cells.groupBy(F.window(at, window), "timeCell").agg(F.count(F.lit(1)).alias("count")).select(F.col("window.start").alias("start"), "timeCell", "count")


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream to a Parquet table, once for what is there now."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
