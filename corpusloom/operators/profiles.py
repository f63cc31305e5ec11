"""Shares, crosstabs and distances between category profiles."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shares(df: DataFrame, group: str, item: str) -> DataFrame:
    """Count of each item in each group and its percentage of the group."""
    n = df.groupBy(group, item).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(group))
    return n.select(group, item, "n", total.alias("total"), (100 * F.col("n") / total).alias("pct"))


def full_grid(shared: DataFrame, group: str, item: str) -> DataFrame:
    """Shares over all groups and items, 0 where a group lacks an item; both are small dimensions."""
    groups = shared.select(group).distinct()
    items = shared.select(item).distinct()
    grid = groups.crossJoin(items)
    return grid.join(shared.select(group, item, "pct"), [group, item], "left").fillna(0.0, ["pct"])


def rms_distance(shared: DataFrame, group: str, item: str) -> DataFrame:
    """Root mean square distance of each group's profile from the mean profile."""
    grid = full_grid(shared, group, item)
    mean = grid.groupBy(item).agg(F.avg("pct").alias("mean"))
    apart = grid.join(mean, item).withColumn("d", F.col("pct") - F.col("mean"))
    return apart.groupBy(group).agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"))


def differences(shared: DataFrame, group: str, item: str, top: int) -> DataFrame:
    """The ``top`` items of each group by the absolute difference of their share from the mean share, as value, mean, diff and place."""
    grid = full_grid(shared, group, item)
    apart = grid.join(grid.groupBy(item).agg(F.avg("pct").alias("mean")), item).select(group, item, F.col("pct").alias("value"), "mean", (F.col("pct") - F.col("mean")).alias("diff"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round(F.abs("diff"), 9)), item))
    return apart.withColumn("place", place).where(F.col("place") <= top)


def quantile(df: DataFrame, value: str, place: Callable[[int], int], bins: int = 4096) -> tuple[int, Any]:
    """The number of values and the value at a sorted place (from 1), by counts in ever finer bins.

    Each pass counts the values of one range in ``bins`` equal bins, a row a bin on the driver, and goes on in the bin
    that holds the place until that holds one value. So no task sorts or holds all values. Null and NaN are left out.
    """
    most = F.lit(sys.float_info.max)
    v = F.least(most, F.greatest(-most, F.col(value).cast("double")))  # infinite values count as the largest
    exact = df.select(F.col(value).alias("v"), v.alias("d")).where(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    n, low, high = exact.agg(F.count("*"), F.min("d"), F.max("d")).first()
    if not n:
        return 0, None
    want, rows = place(n), exact
    while True:
        if not low < high:  # equal as doubles; larger integers may still differ
            same = rows.groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect()
            for r in same:
                if want <= r["n"]:
                    return n, r["v"]
                want -= r["n"]
        half = 1.0 if high - low < math.inf else 0.5  # a difference may overflow
        share = (F.col("d") * half - low * half) / (high * half - low * half)
        bin_ = F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int")
        counts = rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
        for r in sorted(counts.collect()):
            if want <= r["n"]:
                break
            want -= r["n"]
        low, high = r["low"], r["high"]
        rows = exact.where(F.col("d").between(low, high))


def p99(df: DataFrame, value: str) -> DataFrame:
    """One row: the number of values, and the value at the sorted place floor(0.99 n), the first at least."""
    n, found = quantile(df, value, lambda n: max(1, 99 * n // 100))
    return df.sparkSession.createDataFrame([(n, found)], T.StructType([T.StructField("n", T.LongType()), T.StructField("p99", df.schema[value].dataType)]))


def crosstab(df: DataFrame, keys: Sequence[str], row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts with one column for each value, the row's total, in one aggregation."""
    return df.groupBy(*keys, row).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values), F.count("*").alias("row_total"))
