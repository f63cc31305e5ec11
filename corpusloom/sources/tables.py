"""Readers of facts, summaries, catalogs and other tables in files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY = "source string, rule string, output_pgn string, pair_output_pgn string, status string, match_count int, returncode int, duration_seconds double, timed_out string, missing_output string, stdout_bytes long, stderr_bytes long, error string"
FACTS = "schema_version int, kind string, source_pgn string, source_group string, game_key string, result string, stem string, max_run_length int, position_count int, ply_index int, run_length int, material_side string, eco_base string"
CATALOG = "stem string, label string, group string, description string, color string"
COUNTS = "ending string, first_game_count int, all_marker_count int"


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Pair outcomes from CSV with their schema."""
    return spark.read.schema(SUMMARY).option("header", True).csv(path)


def strict_summary(df: DataFrame) -> DataFrame:
    """All rows; the first query fails if any status is not ok."""
    ok = F.when(F.col("status") == "ok", F.col("status")).otherwise(F.raise_error(F.concat(F.lit("status is "), F.coalesce("status", F.lit("null")))))
    return df.withColumn("status", ok)


def lenient_summary(df: DataFrame) -> DataFrame:
    return df.where("status = 'ok'")


def read_facts(spark: SparkSession, path: str, version: int = 1, kind: str | None = None, stems: DataFrame | None = None) -> DataFrame:
    """Facts from JSON lines of one schema version, of one kind if it is given; a stem that ``stems`` lacks is an error."""
    rows = spark.read.schema(FACTS).json(path).where(F.col("schema_version") == version)
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if stems is None:
        return rows
    known = stems.select("stem").distinct().withColumn("__known", F.lit(True))
    checked = F.when(F.col("__known"), F.col("stem")).otherwise(F.raise_error(F.concat(F.lit("unknown stem "), F.coalesce("stem", F.lit("null")))))
    return rows.join(known, "stem", "left").withColumn("stem", checked).drop("__known").select(rows.columns)


def summary_issues(df: DataFrame, stems: DataFrame) -> DataFrame:
    """(issue, source, rule): rows with another status than ok, unknown stems, repeated pairs of source and rule, and stems without a row."""
    known = stems.select(F.col("stem").alias("rule")).distinct()
    bad = df.where("status is distinct from 'ok'").select(F.lit("status").alias("issue"), "source", "rule")
    unknown = df.join(known, "rule", "left_anti").select(F.lit("unknown stem").alias("issue"), "source", "rule")
    twice = df.groupBy("source", "rule").count().where("count > 1").select(F.lit("repeated").alias("issue"), "source", "rule")
    missing = known.join(df, "rule", "left_anti").select(F.lit("missing").alias("issue"), F.lit(None).cast("string").alias("source"), "rule")
    return bad.union(unknown).union(twice).union(missing)


def read_wdl(spark: SparkSession, path: str) -> DataFrame:
    """Wins, draws and losses by ending and material, summed on repeated keys."""
    raw = spark.read.schema("ending string, material_label string, wins long, draws long, losses long").option("header", True).csv(path)
    return raw.groupBy("ending", "material_label").agg(*(F.sum(c).alias(c) for c in ("wins", "draws", "losses")))


def read_examples(spark: SparkSession, path: str, stems: DataFrame) -> DataFrame:
    """Sampled examples from JSON lines, those of known stems."""
    rows = spark.read.schema("stem string, place int, game_key string, fen string").json(path)
    return rows.join(stems.select("stem").distinct(), "stem", "left_semi").select("stem", "place", "game_key", "fen")


def normalise_facts(df: DataFrame, spellings: Mapping[str, list[str]]) -> DataFrame:
    """One spelling for each field of older and newer facts: the first present one with a value."""
    out = []
    for name, names in spellings.items():
        known = [F.col(n) for n in names if n in df.columns]
        out.append((F.coalesce(*known) if known else F.lit(None)).alias(name))
    return df.select(*out)


def read_totals(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested source totals as rows: view, key, games; a document a file, or a line."""
    raw = spark.read.schema("view string, totals map<string,long>").option("multiLine", not lines).json(path)
    return raw.select("view", F.explode("totals").alias("key", "games"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG).option("header", True).csv(path)


def read_openings(spark: SparkSession, path: str) -> DataFrame:
    """Opening book from CSV with quoted fields, numbered in file order by its own column."""
    schema = "row_number int, eco string, eco_base string, eco_group string, name string, moves string, source_url string"
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Marker counts, summed on repeated keys."""
    raw = spark.read.schema(COUNTS).option("header", True).csv(path)
    return raw.groupBy("ending").agg(F.sum("first_game_count").alias("first_game_count"), F.sum("all_marker_count").alias("all_marker_count"))


def read_fens(spark: SparkSession, path: str) -> DataFrame:
    """One FEN a line; what follows # is a comment."""
    text = F.trim(F.split_part("value", F.lit("#"), F.lit(1)))
    return spark.read.text(path).select(text.alias("fen")).where("fen <> ''")


def html_rows(pages: DataFrame, key: str, html: str, row: str, fields: Mapping[str, str]) -> DataFrame:
    """Rows of HTML tables or lists: every match of the row pattern, its place, and fields by pattern."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(row), F.lit(0))).alias("place", "__row"))
    return rows.select(key, "place", *(F.regexp_extract("__row", p, 1).alias(n) for n, p in fields.items()))
