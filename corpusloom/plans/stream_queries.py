"""Queries that run a table's files through a stream and read what the stream wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.shared import shared_folder
from corpusloom.sources import records as R
from corpusloom.sources import sinks
from corpusloom.streaming import ingest as I

from .bindings import steps, table
from .catalog import query


@query("stream_counts", "select event_type, count(*) n from events group by event_type")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Running counts, in complete mode, of all rows that are there."""
    space, name = shared_folder(spark, "stream"), f"counts_{uuid.uuid4().hex}"
    counts = I.running_counts(_folder_stream(spark, d, "events"), ["event_type"])

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{space}/{name}")

    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{space}/c").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{space}/{name}")


def _folder_stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A stream over a table, be it one file or a folder of files."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    folder = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    rows = folder.parquet(f"{d}/{name}.parq*")
    zoned = {c: F.col(c).cast("timestamp") for c, t in rows.dtypes if t == "timestamp_ntz"}  # event time needs a zone
    return rows.withColumns(zoned) if zoned else rows


@query("stream_windows", "select date_trunc('hour', ts) start, event_type, count(*) n from events group by all")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling counts of all rows that are there, in complete mode, which closes no window; append mode is ``stream_closed_windows``."""
    space = shared_folder(spark, "stream")
    counts = I.windowed_counts(_folder_stream(spark, d, "events"), "ts", "1 hour", "2 hours", ["event_type"])

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{space}/out")

    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{space}/c").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{space}/out").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_distinct", "select distinct user_id, event_type from events")
def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    """First copies of each key with bounded state."""
    space = shared_folder(spark, "stream")
    first = I.distinct_within(_folder_stream(spark, d, "events"), ["user_id", "event_type"], "ts", "40 days").select("user_id", "event_type")
    first.writeStream.option("checkpointLocation", f"{space}/c").format("parquet").option("path", f"{space}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{space}/out")


@query("stream_queue", "select distinct l_partkey from lineitem")
def stream_queue(spark: SparkSession, d: str) -> DataFrame:
    """A work queue that receives each key once: in six arrivals, each a start from the checkpoint of the one before."""
    space, parts = shared_folder(spark, "stream"), 6
    keys = table(spark, d, "lineitem").select("l_partkey", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(parts)).alias("arrival"))
    arrive_and_run(spark, keys, space, parts, lambda s: I.new_keys(s, ["l_partkey"]))
    return spark.read.parquet(f"{space}/out")


def arrive_and_run(spark: SparkSession, rows: DataFrame, space: str, arrivals: int, plan: Callable[[DataFrame], DataFrame]) -> list[list[dict]]:
    """Bring the rows of a table in one arrival after the other, and start the stream anew on each: what each start reports.

    The rows are written by arrival once; a start finds its state and its place in the checkpoint folder.
    """
    rows.write.partitionBy("arrival").parquet(f"{space}/staged")
    staged, kind = spark.read.parquet(f"{space}/staged"), rows.drop("arrival").schema
    reports = []
    with I.keyed_state(spark):
        for k in range(arrivals):
            staged.where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(f"{space}/in")
            stream = spark.readStream.schema(kind).parquet(f"{space}/in")
            reports.append(I.run(I.table_writer(plan(stream), f"{space}/out", f"{space}/c")))
    return reports


ARRIVALS = 8


def late_events(spark: SparkSession, d: str) -> DataFrame:
    """events as they arrive: by five days, but some rows of a last day one arrival later, in time for the watermark, and some of a first day two later, too late."""
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    late = F.when((F.col("event_id") % 5 == 0) & (day % 5 == 4), 1).when((F.col("event_id") % 7 == 0) & (day % 5 == 0), 2).otherwise(0)
    return e.select("ts", "event_type", F.least(F.lit(ARRIVALS - 1), F.greatest(F.lit(0), F.floor(day / 5).cast("int")) + late).alias("arrival"))


@query(
    "stream_closed_windows",
    """with e as (select *, date_diff('day', date '2024-01-01', ts::date) as day from events),
a as (select ts, event_type, least(7, greatest(0, day // 5) + case when event_id % 5 = 0 and day % 5 = 4 then 1 when event_id % 7 = 0 and day % 5 = 0 then 2 else 0 end) arrival from e),
m as (select arrival, max(ts) as latest from a group by arrival),
w as (select a.*, (select max(latest) - interval 2 day from m where m.arrival < a.arrival) mark from a),
n as (select date_trunc('hour', ts) as start, event_type, count(*) n from w where mark is null or date_trunc('hour', ts) + interval 1 hour > mark group by all)
select * from n where start + interval 1 hour <= (select max(ts) - interval 2 day from events)""",
)
def stream_closed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling counts in append mode over eight arrivals and as many restarts: late rows beyond two days are left out, windows still open are not given."""
    space = shared_folder(spark, "stream")
    arrive_and_run(spark, late_events(spark, d), space, ARRIVALS, lambda s: I.closed_windows(s, "ts", "1 hour", "2 days", ["event_type"]))
    return spark.read.parquet(f"{space}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_records", "select 'o' || o_orderkey event, o_orderpriority site, '1. e4 ' || o_custkey || ' *' moves from orders")
def stream_records(spark: SparkSession, d: str) -> DataFrame:
    """Record files read as a stream in two arrivals, the second after a restart."""
    space, k = shared_folder(spark, "stream"), F.col("o_orderkey")
    tags = F.create_map(F.lit("Event"), F.concat(F.lit("o"), k), F.lit("Site"), F.col("o_orderpriority"))
    raw = table(spark, d, "orders").select((k % 2).alias("arrival"), R.to_text(tags, F.concat(F.lit("1. e4 "), "o_custkey", F.lit(" *"))).alias("raw"))
    for arrival in range(2):
        sinks.write_records(raw.where(F.col("arrival") == arrival), "raw", f"{space}/in/{arrival}")
        stream = I.record_stream(spark, f"{space}/in/*", "*.txt").select("raw", "headers")
        I.run(I.table_writer(stream, f"{space}/out", f"{space}/c"))
    rows = spark.read.parquet(f"{space}/out")
    return rows.select(F.col("headers")["Event"].alias("event"), F.col("headers")["Site"].alias("site"), F.regexp_replace(R.movetext(F.col("raw")), r"\s+$", "").alias("moves"))


@query("pivot_by_source", "select event_type, count(*) filter (user_id % 3 = 0) otb, count(*) filter (user_id % 3 = 1) online from events group by event_type")
def pivot_by_source(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("user_id") % 3
    e = table(spark, d, "events").select("event_type", F.when(k == 0, "otb").when(k == 1, "online").otherwise("unknown").alias("s"), F.lit(1).alias("one"))
    return sinks.pivoted(e, "event_type", "s", "one", ["otb", "online"])


@query("snapshot_document", "select 'all' \"view\", '{' || string_agg('\"' || label || '\":{\"n\":' || n || '}', ',' order by label) || '}' document from (select event_type label, count(*) n from events group by 1)")
def snapshot_document(spark: SparkSession, d: str) -> DataFrame:
    n = steps(spark, d).groupBy("label").agg(F.count("*").alias("n")).withColumn("view", F.lit("all"))
    return sinks.nested(n, "view", "label", ["n"])


@query("markdown_table", "select '| ' || event_type || ' | ' || count(*) || ' |' line from events group by event_type")
def markdown_table(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return sinks.markdown(n, [F.col("event_type"), F.col("n").cast("string")])
