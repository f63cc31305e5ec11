"""Orderings, top-k, and deterministic samples by hash order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, unused


def numbered(df: DataFrame, order: Sequence[Column | str], entity: Sequence[str] = (), name: str = "place") -> DataFrame:
    """Number rows from 1 in a total order, over the whole table or within entities, by ranges of that order.

    Rows go to range partitions, where they are sorted and numbered; a count of each partition (a row a partition on the
    driver) says where its numbers begin. So neither the table nor a large entity meets in one task. The ranges are
    written once, as sampled bounds may differ from run to run. Rows that tie are numbered in any order.
    """
    spark = df.sparkSession
    at, part, before, first = unused(df, "at", "part", "before", "first")
    keys = [*entity, *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    ranged = stored(ranged, "ranges").withColumn(part, F.shiftright(at, 33))
    sizes = sorted((r[part], r["n"]) for r in ranged.groupBy(part).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = spark.createDataFrame(starts, f"`{part}` long, `{before}` long")
    place = F.col(before) + F.col(at).bitwiseAND((1 << 33) - 1) + 1
    placed = ranged.join(F.broadcast(offsets), part).withColumn(name, place).drop(at, before)  # a row a partition
    if not entity:
        return placed.drop(part)
    named = dict(zip(entity, unused(placed, *(f"{e}_of" for e in entity)), strict=True))
    # Met by partition and entity, so that a large entity is not gathered for its first number.
    part_of, own = unused(placed, "part_of", "own")
    held = placed.groupBy(F.col(part).alias(part_of), *(F.col(e).alias(k) for e, k in named.items())).agg(F.min(name).alias(own))
    firsts = held.groupBy(*(F.col(k).alias(f"{k}_") for k in named.values())).agg(F.min(own).alias(first))
    starts = held.join(firsts, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in named.values()]).select(part_of, *named.values(), first)
    same = [F.col(part) == F.col(part_of), *(F.col(e).eqNullSafe(F.col(k)) for e, k in named.items())]
    return placed.join(starts, same).withColumn(name, F.col(name) - F.col(first) + 1).drop(first, part, part_of, *named.values())


def peaks(df: DataFrame, entity: Sequence[str], value: str, n: int) -> DataFrame:
    """Entities by their largest value; ties share a place. Places come from counts of the n largest different values."""
    best = df.groupBy(*entity).agg(F.max(value).alias("peak")).where("peak is not null")
    counts = best.groupBy("peak").agg(F.count("*").alias("n")).orderBy(F.desc("peak")).limit(n)
    places = counts.withColumn("place", (F.coalesce(F.sum("n").over(Window.orderBy(F.desc("peak")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).cast("int"))  # n rows at most
    return best.join(F.broadcast(places.where(F.col("place") <= n).drop("n")), "peak").select(*entity, "peak", "place")


def hash_order(keys: Sequence[Column], seed: str = "") -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in keys)))


def hash_sample(df: DataFrame, groups: Sequence[str], key: Column, k: int) -> DataFrame:
    """The k rows of each group with the smallest keys; per-partition cuts come before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy("hash"))
    return df.withColumn("hash", key).withColumn("place", place).where(F.col("place") <= k)


def stratified_sample(df: DataFrame, groups: Sequence[str], source: str, key: Column, k: int) -> DataFrame:
    """Up to k rows of each group, dealt round-robin over its sources, with the rows available.

    A row's round is its rank by hash in its source; rows go by round, then source. No
    source can give more than k rows, so ranks above k are cut before groups meet.
    """
    counts = df.groupBy(*groups).agg(F.count("*").alias("available"))
    rounds = Window.partitionBy(*groups, source).orderBy("hash")
    dealt = df.withColumn("hash", key).withColumn("round", F.row_number().over(rounds)).where(F.col("round") <= k)
    place = F.row_number().over(Window.partitionBy(*groups).orderBy("round", source))
    return dealt.withColumn("place", place).where(F.col("place") <= k).join(F.broadcast(counts) if not groups else counts, list(groups))


def quota_sample(df: DataFrame, label: str, quotas: Mapping[str, int], key: Column) -> DataFrame:
    """Rows of each class in hash order up to the class's own quota."""
    quota = F.coalesce(*(F.when(F.col(label) == k, F.lit(n)) for k, n in quotas.items()), F.lit(0))
    place = F.row_number().over(Window.partitionBy(label).orderBy("hash"))
    most = max(quotas.values())
    return df.withColumn("hash", key).withColumn("place", place).where((F.col("place") <= most) & (F.col("place") <= quota))


def top_label(df: DataFrame, source: str, label: str, count: str) -> DataFrame:
    """The label with the largest count of each source, the smallest name on ties."""
    best = df.groupBy(source).agg(F.min(F.struct((-F.col(count)).alias("c"), F.col(label).alias("label"))).alias("b"))
    return best.select(source, F.col("b.label").alias("top_label"), (-F.col("b.c")).alias(count))
