"""First-wins deduplication and set operations on record collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import normalize_moves


def first_wins(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The first row of each key in a stated order; only keys and order go through the window's sort."""
    place = F.row_number().over(Window.partitionBy("__key").orderBy(*order))
    return df.withColumn("__key", key).withColumn("__place", place).where("__place = 1").drop("__key", "__place")


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def content_key(text: str) -> Column:
    """Identity of a record's text after trimming white space on the right."""
    return F.md5(F.regexp_replace(F.col(text), r"\s+$", ""))


def normalised_key(text: str) -> Column:
    """Identity of a movetext by its moves alone: comments, variations, numbers, glyphs and results left out, case kept."""
    return F.md5(normalize_moves(F.col(text)))


def union_distinct(a: DataFrame, b: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """Distinct records of both; a's copy wins."""
    both = a.withColumn("__side", F.lit(0)).unionByName(b.withColumn("__side", F.lit(1)))
    return first_wins(both, content_key(text), ["__side", *order]).drop("__side")


def intersect_distinct(a: DataFrame, b: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    keys = b.select(content_key(text).alias("__k")).distinct()
    return first_wins(a, content_key(text), order).withColumn("__k", content_key(text)).join(keys, "__k", "left_semi").drop("__k")


def difference_distinct(a: DataFrame, b: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    keys = b.select(content_key(text).alias("__k")).distinct()
    return first_wins(a, content_key(text), order).withColumn("__k", content_key(text)).join(keys, "__k", "left_anti").drop("__k")


def dedup_stats(df: DataFrame, key: Column) -> DataFrame:
    """One row: records seen, written and removed."""
    seen = df.agg(F.count("*").alias("seen"), F.count_distinct(key).alias("written"))
    return seen.withColumn("removed", F.col("seen") - F.col("written"))
