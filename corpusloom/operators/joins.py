"""Joins of facts with evaluations, catalogs, totals and books."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_default(df: DataFrame, other: DataFrame, on: str | Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Left join whose missing columns take defaults."""
    joined = df.join(other, on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def zero_filled(catalog: DataFrame, facts: DataFrame, on: str, counts: Sequence[str]) -> DataFrame:
    """Every catalog row with its counts, 0 where there are no facts."""
    return with_default(catalog, facts, on, dict.fromkeys(counts, 0))


def reconcile(expected: DataFrame, actual: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Rows where two tables of totals differ or one lacks the key."""
    both = expected.withColumnRenamed(value, "expected").join(actual.withColumnRenamed(value, "actual"), list(on), "full_outer")
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").otherwise("different")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual"))).withColumn("state", state)


def first_candidate(df: DataFrame, key: str, candidates: Sequence[Column], lookup: DataFrame, name: str, value: str) -> DataFrame:
    """The value of the first candidate name that the lookup holds, else null."""
    tried = df.select(key, F.posexplode(F.array(*candidates)).alias("priority", name))
    found = tried.join(lookup, name).groupBy(key).agg(F.min(F.struct("priority", value)).alias("f"))
    return df.join(found.select(key, F.col(f"f.{value}").alias(value)), key, "left")


def deepest_match(steps: DataFrame, entity: Sequence[str], depth: str, key: str, book: DataFrame, order: str, max_depth: int) -> DataFrame:
    """Each entity's book entry at its deepest step; the book's first row of a key counts."""
    first = book.groupBy(key).agg(F.min(F.struct(order, "entry")).alias("e")).select(key, F.col("e.entry").alias("entry"))
    hit = steps.where(F.col(depth) <= max_depth).join(first, key)
    return hit.groupBy(*entity).agg(F.max(F.struct(depth, "entry")).alias("m")).select(*entity, f"m.{depth}", "m.entry")


def overlay(source: DataFrame, notes: DataFrame, key: Sequence[str], order: str, note: str, keep_all: bool = True) -> DataFrame:
    """Records with the ordered, distinct notes that share their key."""
    rows = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, note))), lambda r: r[note]))
    stacked = notes.groupBy(*key).agg(rows.alias("notes"))
    return source.join(stacked, list(key), "left" if keep_all else "inner")


def pair_counts(df: DataFrame, entity: Sequence[str], label: str) -> DataFrame:
    """Entities in which two different labels occur, by unordered pair.

    Pairs come from each entity's small set of labels, not from a join of the table with itself.
    """
    sets = df.groupBy(*entity).agg(F.array_sort(F.collect_set(label)).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n"))


def label_overlap(df: DataFrame, entity: Sequence[str], label: str) -> DataFrame:
    """Of each label: entities, instances, entities with no other label, and with others."""
    sets = df.groupBy(*entity).agg(F.collect_list(label).alias("all"), F.collect_set(label).alias("s"))
    rows = sets.select(F.explode("s").alias(label), "all", F.size("s").alias("k"))
    own = F.size(F.filter("all", lambda x: x == F.col(label)))
    return rows.groupBy(label).agg(
        F.count("*").alias("entities"), F.sum(own).alias("instances"), F.count_if(F.col("k") == 1).alias("exclusive"), F.count_if(F.col("k") > 1).alias("overlapping")
    )
