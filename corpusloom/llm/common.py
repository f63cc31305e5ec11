"""Helpers shared by the training-data operators: shared-folder tables, streamed groups, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word hashes, computed once; emptied when it holds more than ``most``."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_codes(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """A 64-bit code of every run of ``width`` words, from the words' hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    code = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        code = code * _MIX + h[k : k + n]
        code ^= code >> np.uint64(29)
    return code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Only where the session names none (tests, a laptop) a local one is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/corpusloom-{uuid.uuid4().hex}"


def stash(df: DataFrame, space: str, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{space}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    return [next(n + "_" * k for k in range(len(taken) + 1) if n + "_" * k not in taken) for n in names]


def small_side(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A table to join with, broadcast if it is counted to have ``rows`` rows at most; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def drop_stash(spark: SparkSession, space: str, name: str) -> None:
    """Delete a stashed table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{space}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of plans that have ended, so that Spark's cleaner deletes their shuffle files now, not when the driver's memory fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Spark's setting for the bytes of a batch that goes to a Python worker.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """From now on the session sends its Python workers about ``size`` bytes at once, not 64 MB, as JVM and worker hold a batch each.

    A size that the session sets itself stands.
    """
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, str(size))


def release_memory() -> None:
    """Give what a task has freed back to the system, where the C library can, as workers live on for further tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bounded_slices(batch: pa.RecordBatch, column: int, rows: int = 2048, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bound in rows and in bytes of a text column; a longer text stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        past = ends[at - 1] if at else 0
        upto = min(at + rows, max(at + 1, int(np.searchsorted(ends, past + size, side="right"))), batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of rows with equal keys from batches that come sorted by those integer keys.

    Holds one group at a time, so the caller bounds memory by bounding its groups.
    """
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], batch.num_rows)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            k = tuple(c[a].item() for c in cols)
            if k != key:
                if held:
                    yield key, pa.Table.from_batches(held)
                held, key = [], k
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the classes of the linked positions a[i], b[i]; a class is named by its smallest position."""
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if np.array_equal(la, lb):
            return label
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while not np.array_equal(deeper := label[label], label):
            label = deeper


def components(edges: DataFrame, space: str, name: str = "cc") -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the smallest node.

    Alternates large-star and small-star rounds; each round is two grouped minima with
    joins, written to the shared folder. Nothing of the graph is brought to the driver
    but a count and a checksum for the end test. Nodes without edges get no row.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stash(pairs, space, f"{name}0")
    last, step = None, 0
    while True:
        mark = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == last or not mark["n"]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                pairs.select(F.col("v"), F.col("v")).distinct()
            )
        last, step = mark, step + 1
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(met.select("u", F.col("m").alias("v"))).distinct()
        pairs = stash(small, space, f"{name}{step}")
        drop_stash(spark, space, f"{name}{step - 1}")
