"""What the name of a source file tells: its group, its year, its key and its title."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """The file name without folders and its last ending."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def group(stem_: Column, prefixes: Mapping[str, str]) -> Column:
    """The group whose prefix the stem begins with, null for none: such rows are errors of their own."""
    return F.coalesce(*(F.when(F.startswith(stem_, F.lit(p)), F.lit(g)) for g, p in prefixes.items()))


def rest(stem_: Column, prefixes: Mapping[str, str]) -> Column:
    return F.coalesce(*(F.when(F.startswith(stem_, F.lit(p)), F.substring(stem_, F.lit(len(p) + 1), F.length(stem_))) for p in prefixes.values()), stem_)


def key(stem_: Column, prefixes: Mapping[str, str]) -> Column:
    """group:rest, or the stem of an unknown group."""
    return F.concat_ws(":", group(stem_, prefixes), rest(stem_, prefixes))


def title(stem_: Column, prefixes: Mapping[str, str], names: Mapping[str, str]) -> Column:
    """The group's name and the rest in words, a partial release named so."""
    words = F.replace(F.replace(rest(stem_, prefixes), F.lit("_partial_release"), F.lit(" partial")), F.lit("_"), F.lit(" "))
    return F.concat_ws(" ", F.coalesce(*(F.when(group(stem_, prefixes) == g, F.lit(n)) for g, n in names.items())), words)


def year(stem_: Column) -> Column:
    """The first word that begins with four digits, or is a number; stems without one come after all years, undated ones last."""
    words = F.split(F.replace(stem_, F.lit("-"), F.lit("_")), "_")
    dated = F.transform(F.filter(words, lambda w: w.rlike(r"^[0-9]{4}") | w.rlike(r"^[0-9]+$")), lambda w: F.when(F.length(w) >= 4, F.left(w, F.lit(4))).otherwise(w).cast("int"))
    return F.when(F.endswith(stem_, F.lit("_noDate")) | (stem_ == "noDate"), 999_999).otherwise(F.coalesce(F.get(dated, F.lit(0)), F.lit(999_998)))
