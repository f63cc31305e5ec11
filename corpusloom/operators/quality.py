"""Data-quality rules on records as rows of issues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip_markup

#: The tags that every record needs, and the formats of dates and results.
REQUIRED = ("Event", "Site", "Date", "Round", "White", "Black", "Result")
DATE = r"^[0-9?]{4}\.[0-9?]{2}\.[0-9?]{2}$"
RESULTS = ("1-0", "0-1", "1/2-1/2", "*")


def missing_tags(headers: Column, required: Sequence[str] = REQUIRED) -> Column:
    return F.array_except(F.array(*(F.lit(r) for r in required)), F.map_keys(headers))


def bad_date(date: Column) -> Column:
    return ~F.coalesce(date, F.lit("")).rlike(DATE)


def bad_result(result: Column) -> Column:
    return ~F.coalesce(result, F.lit("")).isin(*RESULTS)


def final_token(text: Column) -> Column:
    """The last token of a movetext without its markup."""
    return F.regexp_extract(F.rtrim(F.regexp_replace(strip_markup(text, ""), r"\s+", " ")), r"(\S+)$", 1)


def unbalanced(text: Column, opening: str, closing: str) -> Column:
    """How many more opening than closing brackets, line comments and escaped lines left out."""
    bare = F.regexp_replace(text, r";[^\n]*|(?<![^\n])%[^\n]*", "")
    return F.regexp_count(bare, F.lit(f"\\{opening}")) - F.regexp_count(bare, F.lit(f"\\{closing}"))


def issues(df: DataFrame, keys: Sequence[str], rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """A row (keys, code, message) for each rule that a row breaks, in one pass."""
    found = F.array(*(F.when(bad, F.struct(F.lit(code).alias("code"), message.alias("message"))) for code, (bad, message) in rules.items()))
    return df.select(*keys, F.inline(F.filter(found, lambda x: x.isNotNull())))
