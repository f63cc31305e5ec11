"""Incremental ingest with Structured Streaming: scan, dedup, running counts, work queue."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corpusloom.functions.text import clean
from corpusloom.sources.records import MARK, PGN, headers


def record_stream(spark: SparkSession, folder: str, files: str = PGN) -> DataFrame:
    """Records of files as they arrive in a folder, .pgn files or those of another pattern: file, raw, headers; text before a file's first record is dropped.

    Stateless: nothing is numbered, and a record's key is its content.
    """
    raw = spark.readStream.option("lineSep", "\n" + MARK).option("pathGlobFilter", files).text(folder)
    text = F.when(F.startswith("value", F.lit(MARK)), F.col("value")).otherwise(F.concat(F.lit(MARK), F.col("value")))
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.rtrim(clean(text)).alias("raw"))
    return rows.where(F.col("raw").rlike(r'^\[Event "')).withColumn("headers", headers(F.col("raw")))


def distinct_within(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """First copies of each key, with state kept for the watermark's delay only."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def running_counts(stream: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Counts by key, for update or complete mode; a missing key counts as unknown."""
    named = [F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias(k) if isinstance(k, str) else k for k in keys]
    return stream.groupBy(*named).agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time: str, size: str, delay: str, keys: Sequence[str]) -> DataFrame:
    """Counts by tumbling window; rows later than the delay are left out, as the watermark says."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))


def closed_windows(stream: DataFrame, time: str, size: str, delay: str, keys: Sequence[str]) -> DataFrame:
    """Counts by tumbling window for append mode: start, the keys, n; each window comes once, when the watermark passes its end.

    State holds open windows only: a window that is given out leaves it. Rows of windows already closed are left out.
    """
    counts = windowed_counts(stream, time, size, delay, keys)
    return counts.select(F.col("window.start").alias("start"), *keys, "n")


def table_writer(stream: DataFrame, sink: str, checkpoint: str) -> DataStreamWriter:
    """Append a stream to a Parquet folder, each row once over all restarts; a start takes what is there and ends."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", sink)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)


def run(writer: DataStreamWriter) -> list[dict]:
    """Start a stream that ends by itself, wait for it, and return what its batches report."""
    query = writer.start()
    query.awaitTermination()
    return [json.loads(p.json) for p in query.recentProgress]


def state_rows(reports: Sequence[dict]) -> list[int]:
    """Rows in the state after each batch."""
    return [sum(s["numRowsTotal"] for s in r["stateOperators"]) for r in reports]


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep state on local disk and write only changes to their checkpoint folder.

    So a batch costs what it brings, whatever the state has grown to.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def new_keys(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key once, when it is first met. The keys met are the stream's state: what was written is never read.

    For streams started within ``keyed_state``, with a sink that appends.
    """
    return stream.select(*keys).dropDuplicates(list(keys))
