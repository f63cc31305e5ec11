"""Patterns over the steps of an entity: fixed lines, repetitions, looks ahead and behind."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .automata import Part, automaton


def fixed_line(df: DataFrame, entity: Sequence[str], step: str, conditions: Sequence[Column]) -> DataFrame:
    """The steps where consecutive steps meet consecutive conditions."""
    order = Window.partitionBy(*entity).orderBy(step)
    flags = {f"__c{k}": c for k, c in enumerate(conditions)}
    flagged = df.withColumns(flags)
    ahead = flagged.withColumns({f"__a{k}": F.lead(f"__c{k}", k).over(order) for k in range(1, len(conditions))})
    met = F.col("__c0")
    for k in range(1, len(conditions)):
        met = met & F.coalesce(F.col(f"__a{k}"), F.lit(False))
    return ahead.where(met).select(df.columns)


def line_hits(df: DataFrame, entity: Sequence[str], step: str, symbol: Column, line: Sequence[Part], width: int = 4096) -> DataFrame:
    """Hits of a line of repeated parts over each entity's steps: leftmost, as long as they go, none overlapping.

    ``step`` numbers an entity's steps from 1 without gaps (``ordering.numbered`` does so without gathering an entity).
    Entities are cut into ``width`` steps. What a segment does to the automaton, for each state the next state and the
    hits on the way, is a small array; such arrays compose, 64 to one in each round, so a long entity is matched by many
    tasks and no group is larger than a segment. A null symbol is passed over.
    """
    table = automaton(line)
    states, size = len(table.following), len(table.symbols) + 1
    following, hits = (F.array(*(F.lit(x) for row in t for x in row)) for t in (table.following, table.hits))
    number = F.instr(F.lit(table.symbols), F.col("s"))  # 0: a symbol that no part names
    start = F.array(*(F.struct(F.lit(k).alias("state"), F.lit(0).cast("long").alias("hits")) for k in range(states)))

    def go(at: Column, n: Column) -> Column:
        def one(x: Column) -> Column:
            edge = x["state"] * size + n + 1
            return F.struct(F.element_at(following, edge).alias("state"), (x["hits"] + F.element_at(hits, edge)).alias("hits"))

        return F.transform(at, one)

    def then(a: Column, b: Column) -> Column:
        return F.transform(a, lambda x: F.struct(F.get(b, x["state"])["state"].alias("state"), (x["hits"] + F.get(b, x["state"])["hits"]).alias("hits")))

    rows = df.select(*entity, F.col(step).alias("k"), F.floor((F.col(step) - 1) / width).cast("long").alias("segment"), symbol.alias("s"))
    last = rows.agg(F.max("segment")).first()[0] or 0
    numbers = F.transform(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("s").isNotNull(), number).alias("n")))), lambda x: x["n"])
    maps = rows.groupBy(*entity, "segment").agg(F.aggregate(F.filter(numbers, lambda n: n.isNotNull()), start, go).alias("map"))
    while last:
        last //= 64
        parts = F.transform(F.array_sort(F.collect_list(F.struct("segment", "map"))), lambda x: x["map"])
        maps = maps.groupBy(*entity, F.floor(F.col("segment") / 64).cast("long").alias("upper")).agg(F.aggregate(parts, start, then).alias("map")).withColumnRenamed("upper", "segment")
    end = F.get("map", F.lit(0))
    left = F.get(F.array(*(F.lit(n) for n in table.left)), end["state"])
    return maps.select(*entity, (end["hits"] + left).alias("hits"))


def find(df: DataFrame, entity: Sequence[str], step: str, before: Mapping[str, Column], after: Mapping[str, Column]) -> DataFrame:
    """Whether a condition held at an earlier step, and at how many later steps one holds."""
    order = Window.partitionBy(*entity).orderBy(step)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(1, Window.unboundedFollowing)
    seen = {k: F.max(F.when(c, 1).otherwise(0)).over(earlier) for k, c in before.items()}
    return df.withColumns(seen | {k: F.count(F.when(c, 1)).over(later) for k, c in after.items()})


def parent(df: DataFrame, entity: Sequence[str], step: str, value: str, depth: int, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(value, depth).over(Window.partitionBy(*entity).orderBy(step)))


def flags(df: DataFrame, entity: Sequence[str], step: str, move: str) -> DataFrame:
    """Flags of each step: move number, next mover, mate and check from the move's suffix, first and last of its entity."""
    last = F.max(step).over(Window.partitionBy(*entity))
    k, m = F.col(step), F.col(move)
    return df.withColumns({
        "movenumber": F.floor((k + 1) / 2), "mover_next": F.when(k % 2 == 1, "black").otherwise("white"), "mate": F.contains(m, F.lit("#")),
        "check": F.right(m, F.lit(1)).isin("+", "#"), "initial": k == 1, "terminal": k == last,
    })
