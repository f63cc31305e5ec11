"""Filters on record fields, markers and outcomes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import fold, tokens


def matches_tokens(field: Column, query: str) -> Column:
    """Every folded token of the query is part of the folded field; an empty query matches nothing."""
    wanted = tokens(F.lit(query))
    return (F.size(wanted) > 0) & F.forall(wanted, lambda t: F.contains(fold(field), t))


def grep(df: DataFrame, queries: Mapping[str | tuple[str, ...], str]) -> DataFrame:
    """Rows that match all queries; a query on several fields is met by any of them."""
    for fields, text in queries.items():
        names = (fields,) if isinstance(fields, str) else fields
        met = matches_tokens(F.col(names[0]), text)
        for name in names[1:]:
            met = met | matches_tokens(F.col(name), text)
        df = df.where(met)
    return df


def year_between(date: Column, least: int, most: int) -> Column:
    """Whether the number that the first four characters form lies in a range; no number fails."""
    year = F.substring(date, 1, 4).try_cast("int")
    return F.coalesce(year.between(least, most), F.lit(False))


def split_rejects(df: DataFrame, bad: Column) -> DataFrame:
    """Mark rows ok or rejected; facts are made from the ok ones only."""
    return df.withColumn("status", F.when(F.coalesce(bad, F.lit(True)), "reject").otherwise("ok"))


def marker_equals(comment: Column, marker: str) -> Column:
    return F.trim(comment) == marker


def marker_within(comment: Column, marker: str) -> Column:
    return F.contains(comment, F.lit(marker))


def mark_oversized(df: DataFrame, status: str, size: str, cap: int, new: str) -> DataFrame:
    """Pending rows above a size get another status."""
    return df.withColumn(status, F.when((F.col(status) == "pending") & (F.col(size) > cap), new).otherwise(F.col(status)))


def route_by_size(df: DataFrame, size: str, cap: int, small: Column, large: Column) -> DataFrame:
    """Score small and large rows by different columns, in one pass; rows without a size are left out."""
    fits = F.col(size) <= cap
    return df.where(F.col(size).isNotNull()).withColumns({"scorer": F.when(fits, "small").otherwise("large"), "scored": F.when(fits, small).otherwise(large)})


def matched_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """A row for each rule that a row meets; all rules in one pass over the rows."""
    hit = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    return df.withColumn("rule", F.explode(hit))


def keep_known(df: DataFrame, label: str, known: DataFrame, known_label: str) -> DataFrame:
    return df.join(known.select(F.col(known_label).alias(label)).distinct(), label, "left_semi")
