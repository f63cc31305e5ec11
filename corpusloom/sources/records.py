"""Scan of game records in text files: records, headers, movetext, numbering."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How a record starts and how its tags look.
MARK = "[Event "
PGN = "*.[pP][gG][nN]"
TAG = r'(?m)^\s*\[(\w+)\s+"([^"]*)"'
ORDER = ("Event", "Site", "Date", "Round", "White", "Black", "Result")


def read_records(spark: SparkSession, path: str, files: str = PGN) -> DataFrame:
    """Records of all .pgn files below a folder, or of files of another pattern: file, game_index (from 1), start_line, raw.

    A record starts at a line with ``[Event ``; text before a file's first record is
    dropped. Records are numbered within parts of a split of a file, and the parts' counts, a
    row for 65,536 records, tell where a part's numbers start: no split is gathered in one task.
    """
    return _numbered(spark, path, MARK, files)


def read_strict_records(spark: SparkSession, path: str, files: str = PGN) -> DataFrame:
    """As ``read_records``, where a record starts only at a line with ``[Event`` and a quoted value."""
    return _numbered(spark, path, MARK + '"', files)


def _numbered(spark: SparkSession, path: str, mark: str, files: str) -> DataFrame:
    raw = (
        spark.read.option("lineSep", "\n" + mark).option("recursiveFileLookup", True).option("pathGlobFilter", files).text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    )
    rows = raw.withColumns({"part": F.shiftright("place", 16), "lines": F.regexp_count("value", F.lit("\n")) + 1})
    text = F.regexp_replace("value", "^\\uFEFF", "")
    starts = F.startswith(text, F.lit(mark))
    # A part is 65,536 rows of a split at most: a row of sums for each.
    sums = rows.groupBy("file", "block", "part").agg(F.count("*").alias("n"), F.sum("lines").alias("lines"), F.min(F.struct("place", starts.alias("starts"))).alias("first"))
    earlier = Window.partitionBy("file").orderBy("block", "part")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    outset = (F.col("block") == 0) & (F.row_number().over(earlier) == 1)  # what stands before a file's first mark is in its first row
    sums = sums.withColumn("outset", outset).withColumn("skipped", (F.col("outset") & ~F.col("first.starts")).cast("int"))
    sums = sums.select(
        "file", "block", "part", "outset", "skipped", F.col("first.place").alias("first"),
        F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum(F.col("n") - F.col("skipped")).over(before), F.lit(0)).alias("records_before"),
    )
    found = rows.join(F.broadcast(sums), ["file", "block", "part"])
    inside = Window.partitionBy("file", "block", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("line", F.coalesce(F.sum("lines").over(inside), F.lit(0)))  # dropped where nobody asks for lines
    head = F.col("outset") & (F.col("place") == F.col("first"))
    number = F.col("place") - F.col("first") + 1 - F.col("skipped") + F.col("records_before")
    raw_text = F.when(head, text).otherwise(F.concat(F.lit(mark), text))
    found = found.where(~head | (F.col("skipped") == 0))
    return found.select("file", number.cast("int").alias("game_index"), (F.col("line") + F.col("lines_before") + 1).cast("long").alias("start_line"), F.rtrim(raw_text).alias("raw"))


def headers(raw: Column) -> Column:
    """Tags and values of a record's head, which ends at the first line that is no tag; the first value of a tag counts."""
    raw = F.regexp_extract(raw, r'^((?:\s*\[\w+\s+"[^"\n]*"\][^\n]*(?:\n|\z))*)', 1)
    tags, values = F.regexp_extract_all(raw, F.lit(TAG), F.lit(1)), F.regexp_extract_all(raw, F.lit(TAG), F.lit(2))
    pairs = F.zip_with(tags, values, lambda t, v: F.struct(t.alias("key"), v.alias("value")))
    first = F.filter(pairs, lambda p, i: F.array_position(tags, p["key"]) == i + 1)
    return F.map_from_entries(first)


def movetext(raw: Column) -> Column:
    """What follows the header lines."""
    return F.trim(F.regexp_replace(raw, r'(?s)^(\s*\[\w+\s+"[^"]*"\]\s*)+', ""))


def parsed(records: DataFrame) -> DataFrame:
    return records.withColumns({"headers": headers(F.col("raw")), "movetext": movetext(F.col("raw"))})


def set_tags(known: Column, tags: Mapping[str, Column]) -> Column:
    """Replace or add tags of a header map."""
    new = F.create_map(*(x for t, v in tags.items() for x in (F.lit(t), v)))
    return F.map_concat(F.map_filter(known, lambda t, v: ~t.isin(*tags)), new)


def order_tags(known: Column) -> Column:
    """Tags as an array: the seven of the roster first, the others by name after Result."""
    entries = F.transform(
        F.map_entries(known),
        lambda e: F.struct(
            F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(o) for o in ORDER)), e["key"]), F.lit(0)), F.lit(len(ORDER) + 1)).alias("place"),
            e["key"].alias("tag"), e["value"].alias("value"),
        ),
    )
    return F.array_sort(entries)


def to_text(known: Column, moves: Column) -> Column:
    """A record as text: tags, a blank line, movetext."""
    lines = F.transform(order_tags(known), lambda e: F.concat(F.lit("["), e["tag"], F.lit(' "'), e["value"], F.lit('"]')))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), moves)


def markers(records: DataFrame, known: list[str], more: Mapping[str, Column] | None = None) -> DataFrame:
    """Label facts from comments: file, game_index, ply of the move before, label, and more columns of the record.

    A record's words are counted through where it is: no word is shuffled.
    """
    from corpusloom.functions.text import GLYPH, NUMBER, RESULTS, known_labels, strip_nested

    parts = F.regexp_extract_all(strip_nested(movetext(F.col("raw")), "(", ")"), F.lit(r"\{[^}]*\}|[^\s{}]+"), F.lit(0))
    zero = F.struct(F.lit(0).cast("long").alias("ply"), F.array().cast("array<struct<ply:bigint,token:string>>").alias("out"))

    def step(a: Column, token: Column) -> Column:
        move = ~token.rlike(GLYPH) & ~token.rlike(NUMBER) & ~token.isin(*RESULTS)
        said = F.struct(a["ply"].alias("ply"), F.concat(a["out"], F.array(F.struct(a["ply"].alias("ply"), token.alias("token")))).alias("out"))
        return F.when(F.startswith(token, F.lit("{")), said).otherwise(F.struct((a["ply"] + move.cast("int")).alias("ply"), a["out"].alias("out")))

    kept = {"file": F.col("file"), "game_index": F.col("game_index"), **(more or {})}
    found = records.select(*(c.alias(n) for n, c in kept.items()), F.inline(F.aggregate(parts, zero, step, lambda a: a["out"])))
    return found.select(*kept, "ply", F.explode(known_labels(F.regexp_replace("token", "[{}]", ""), known)).alias("label"))


def read_blank_line_records(spark: SparkSession, path: str, files: str = PGN) -> DataFrame:
    """Records split at blank lines before a tag, whole files at a time: for small files of loose form."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files).text(path, wholetext=True)
    parts = F.posexplode(F.split("value", r"\r?\n\s*\r?\n(?=\[)"))
    rows = whole.select(F.col("_metadata.file_path").alias("file"), parts.alias("place", "raw")).where(F.col("raw").rlike(r"^\s*\["))
    return rows.select("file", (F.col("place") + 1).alias("game_index"), F.rtrim("raw").alias("raw"))


ANNOTATED = (
    "game_index long, headers map<string,string>, parse_errors array<string>, move_uci_sequence array<string>, "
    "positions array<struct<ply_index:int,fullmove_number:int,move_san:string,move_uci:string,fen:string,side_to_move:string,piece_count:int>>"
)


def read_annotated(spark: SparkSession, path: str) -> DataFrame:
    """Annotated records from JSON lines; those with parse errors are marked and give no facts."""
    rows = spark.read.schema(ANNOTATED).json(path)
    return rows.withColumn("status", F.when(F.size(F.coalesce("parse_errors", F.array())) > 0, "reject").otherwise("ok"))
