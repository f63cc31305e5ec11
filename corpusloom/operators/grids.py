"""Aggregates over grids of views and thresholds, shares, denominators and wide counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = "all"


def views_of(group: Column, known: Sequence[str] = ("otb", "online")) -> Column:
    """The views a row counts in: all, and its own group if that is a known one."""
    return F.when(group.isin(*known), F.array(F.lit(ALL), group)).otherwise(F.array(F.lit(ALL)))


def on_grid(df: DataFrame, group: str, length: str, thresholds: Sequence[int]) -> DataFrame:
    """A row for each view and each threshold that the run length reaches; a bounded, narrow expansion."""
    reached = F.filter(F.array(*(F.lit(t) for t in thresholds)), lambda t: t <= F.col(length))
    return df.withColumn("view", F.explode(views_of(F.col(group)))).withColumn("threshold", F.explode(reached))


def matched(grid: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Matched rows and matched entities of each view and threshold."""
    return grid.groupBy("view", "threshold").agg(F.count("*").alias("matched_rows"), F.count_distinct(*entity).alias("matched_entities"))


def incidence(grid: DataFrame, label: str, totals: DataFrame) -> DataFrame:
    """Quantity of each label, its percentage of the view's entities and its share of all matches."""
    n = grid.groupBy("view", "threshold", label).agg(F.count("*").alias("quantity"))
    share = F.col("quantity") / F.sum("quantity").over(Window.partitionBy("view", "threshold"))
    joined = n.withColumn("matched_share", F.round(share, 6)).join(F.broadcast(totals), "view")
    return joined.select("view", "threshold", label, "quantity", F.round(100 * safe_share(F.col("quantity"), F.col("total")), 6).alias("percentage"), "matched_share")


def safe_share(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where there is nothing to divide by."""
    return F.when(F.coalesce(whole, F.lit(0)) > 0, part / whole).otherwise(F.lit(0.0))


def counted(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows by key; a missing key is counted as unknown."""
    return df.groupBy(*(F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias(k) for k in keys)).agg(F.count("*").alias(name))


def counted_with_total(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by key with a grand total in the same pass; the total's keys are null and is_total is 1."""
    named = df.select(*(F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias(k) for k in keys))
    grouped = named.rollup(*keys).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return grouped.where(F.col("g").isin(0, 2 ** len(keys) - 1)).select(*keys, "n", F.when(F.col("g") == 0, 0).otherwise(1).alias("is_total"))


def top(groups: DataFrame, keys: Sequence[str], count: str, n: int) -> DataFrame:
    """The n largest groups, ties by key, each with the number of groups before the cut."""
    total = groups.agg(F.count("*").alias("total_groups"))
    return groups.orderBy(F.desc(count), *keys).limit(n).crossJoin(F.broadcast(total))


def wide(df: DataFrame, keys: Sequence[str], predicates: Mapping[str, Column]) -> DataFrame:
    """One counter a predicate, all in one pass over the rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(p).alias(k) for k, p in predicates.items()))


def grouping_totals(df: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """Row counts of several groupings at once."""
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(F.count("*").alias("n"), F.grouping_id().alias("grouping"))
    return grouped.select(*keys, "grouping", "n")


def histogram_total(histogram: DataFrame, value: str, n: str) -> DataFrame:
    return histogram.groupBy(value).agg(F.sum(n).alias(n))
