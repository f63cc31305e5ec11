"""Runs of labels over ordered steps, first occurrences, and transitions between labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "start", "end"


def numbered(df: DataFrame, entity: Sequence[str], order: Sequence[str], name: str = "step") -> DataFrame:
    """Number the rows of each entity from 1 in a given order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*entity).orderBy(*order)).cast("long"))


def runs(df: DataFrame, entity: Sequence[str], step: str, label: str) -> DataFrame:
    """Runs of consecutive steps with one label: run_start, run_end, run_length.

    A label that occurs twice at a step counts once. Steps minus their rank within the
    label are equal exactly along a run, so a single shuffle on the entity does it.
    """
    rank = F.row_number().over(Window.partitionBy(*entity, label).orderBy(step))
    islands = df.select(*entity, label, step).distinct().withColumn("__island", F.col(step) - rank)
    return (
        islands.groupBy(*entity, label, "__island")
        .agg(F.min(step).alias("run_start"), F.max(step).alias("run_end"), F.count("*").alias("run_length"))
        .drop("__island")
    )


def first_run(found: DataFrame, entity: Sequence[str], label: str) -> DataFrame:
    """The first run of each entity and label; position_count is its length, as facts store it."""
    first = found.groupBy(*entity, label).agg(F.min(F.struct("run_start", "run_end", "run_length")).alias("r"))
    return first.select(*entity, label, "r.run_start", "r.run_end", "r.run_length", F.col("r.run_length").alias("position_count"))


def longest_run(found: DataFrame, entity: Sequence[str], label: str) -> DataFrame:
    return found.groupBy(*entity, label).agg(F.max("run_length").alias("max_run_length"))


def run_histogram(found: DataFrame, label: str) -> DataFrame:
    return found.groupBy(label, "run_length").agg(F.count("*").alias("n"))


def entity_max_histogram(found: DataFrame, entity: Sequence[str], label: str) -> DataFrame:
    """How many entities have each longest run of a label."""
    return longest_run(found, entity, label).groupBy(label, "max_run_length").agg(F.count("*").alias("n"))


def first_marker(df: DataFrame, entity: Sequence[str], step: str, label: str) -> DataFrame:
    """The first step of each label, and how often the label occurs."""
    return df.groupBy(*entity, label).agg(F.min(step).alias("first_step"), F.count("*").alias("markers"))


def first_n(df: DataFrame, entity: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    return numbered(df, entity, order, "place").where(F.col("place") <= n)


def resolve_overlaps(df: DataFrame, entity: Sequence[str], step: str, label: str, rank: Column) -> DataFrame:
    """One label a step: the one with the smallest rank, then the smallest name."""
    best = df.groupBy(*entity, step).agg(F.min(F.struct(rank.alias("rank"), F.col(label).alias(label))).alias("b"))
    return best.select(*entity, step, f"b.{label}")


def collapse_repeats(df: DataFrame, entity: Sequence[str], step: str, label: str) -> DataFrame:
    """Drop steps whose label equals that of the step before."""
    before = F.lag(label).over(Window.partitionBy(*entity).orderBy(step))
    return df.withColumn("__before", before).where(~F.col(label).eqNullSafe(F.col("__before"))).drop("__before")


def next_step(df: DataFrame, entity: Sequence[str], step: str, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lead(value).over(Window.partitionBy(*entity).orderBy(step)))


def transitions(df: DataFrame, entity: Sequence[str], step: str, label: str) -> DataFrame:
    """Counts of label pairs at neighbouring steps, with a start and an end node for every entity.

    Windows give the neighbour, so long sequences are never gathered into one row.
    """
    order = Window.partitionBy(*entity).orderBy(step)
    known = df.withColumns({"__prev": F.lag(label).over(order), "__next": F.lead(label).over(order)})
    moves = F.filter(
        F.array(
            F.when(F.col("__prev").isNull(), F.struct(F.lit(START).alias("src"), F.col(label).alias("dst"))),
            F.struct(F.col(label).alias("src"), F.coalesce("__next", F.lit(END)).alias("dst")),
        ),
        lambda x: x.isNotNull(),
    )
    return known.select(F.inline(moves)).groupBy("src", "dst").agg(F.count("*").alias("n"))


def transition_flow(counted: DataFrame) -> DataFrame:
    """Inflow and outflow of each node and its share of all transitions."""
    total = counted.agg(F.sum("n").alias("total"))
    ends = counted.select(F.inline(F.array(F.struct(F.col("dst").alias("node"), F.col("n").alias("inflow"), F.lit(0).cast("long").alias("outflow")), F.struct(F.col("src").alias("node"), F.lit(0).cast("long").alias("inflow"), F.col("n").alias("outflow")))))
    nodes = ends.groupBy("node").agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
    return nodes.crossJoin(F.broadcast(total)).select("node", "inflow", "outflow", F.round(F.col("inflow") / F.col("total"), 6).alias("share"))


def stages(df: DataFrame, entity: Sequence[str], step: str, label: str) -> DataFrame:
    """Labels first met at the same step, as one stage: an array of labels by first step."""
    first = df.groupBy(*entity, label).agg(F.min(step).alias(step))
    return first.groupBy(*entity, step).agg(F.array_sort(F.collect_set(label)).alias("labels"))


def stage_transitions(staged: DataFrame, entity: Sequence[str], step: str) -> DataFrame:
    """Counts of label pairs across neighbouring stages, without pairs of a label and itself."""
    following = F.lead("labels").over(Window.partitionBy(*entity).orderBy(step))
    crossed = staged.withColumn("__next", following).where("__next is not null")
    crossed = crossed.select(F.explode("labels").alias("src"), "__next").select("src", F.explode("__next").alias("dst"))
    return crossed.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def stage_metrics(staged: DataFrame, entity: Sequence[str], counted: DataFrame) -> DataFrame:
    """One row: label incidences, entities with two stages or more, distinct and total transitions."""
    per = staged.groupBy(*entity).agg(F.count("*").alias("stages"), F.sum(F.size("labels")).alias("labels"))
    left = per.agg(F.sum("labels").alias("incidences"), F.count_if(F.col("stages") >= 2).alias("multi_stage_entities"))
    right = counted.agg(F.count("*").alias("distinct_transitions"), F.sum("n").alias("total_transitions"))
    return left.crossJoin(F.broadcast(right))
