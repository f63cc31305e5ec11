"""Writers: record text, JSON facts, ordered CSV, pivots, nested and chunked output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.setops import first_wins


def write_records(df: DataFrame, raw: str, path: str, part: str | None = None, order: str | None = None) -> None:
    """Record text, right-trimmed, one blank line between records; with a part, a file for each value, its records in order."""
    rows = df.select(F.rtrim(raw).alias("value"), *(c for c in (part, order) if c))
    if part:
        rows = rows.repartition(part).sortWithinPartitions(part, *((order,) if order else ()))
    writer = rows.drop(*((order,) if order else ())).write.option("lineSep", "\n\n")
    (writer.partitionBy(part) if part else writer).text(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Outcomes of runs as CSV in the columns that ``tables.read_summary`` reads, missing ones empty."""
    from corpusloom.sources.tables import SUMMARY

    names = [c.split()[0] for c in SUMMARY.split(", ")]
    df.select(*(F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names)).write.option("header", True).csv(path)


def write_facts(df: DataFrame, keys: Sequence[str], order: Sequence[str], partition: str, path: str) -> None:
    """A fact table with one row a key, the first in a stated order, in folders by a small dimension."""
    first_wins(df, F.struct(*keys), order).write.partitionBy(partition).parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Append to a CSV table whose header must be the same."""
    spark = df.sparkSession
    try:
        there = spark.read.option("header", True).csv(path).columns
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        there = df.columns
    if there != df.columns:
        raise ValueError(f"the table has the columns {there}, not {df.columns}")
    df.write.mode("append").option("header", True).csv(path)


def write_ordered_csv(df: DataFrame, order: Sequence[str], path: str) -> None:
    """An aggregate as CSV in key order (a range sort over the whole result)."""
    df.orderBy(*order).write.option("header", True).csv(path)


def pivoted(df: DataFrame, key: str, source: str, value: str, sources: Sequence[str]) -> DataFrame:
    """One column for each of the named sources, 0 where there is nothing."""
    return df.groupBy(key).pivot(source, list(sources)).agg(F.sum(value)).fillna(0)


def nested(df: DataFrame, outer: str, inner: str, values: Sequence[str]) -> DataFrame:
    """One JSON document for each outer key: inner key to a struct of values."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(inner).cast("string").alias("key"), F.struct(*values).alias("value"))))
    return df.groupBy(outer).agg(F.to_json(F.map_from_entries(entries)).alias("document"))


def write_chunks(df: DataFrame, by: Sequence[str], path: str) -> None:
    df.write.partitionBy(*by).json(path)


def markdown(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Rows of a Markdown table."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |")).alias("line"))
