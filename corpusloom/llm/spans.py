"""Spans of regular-expression matches as native columns, in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,rank:int,kind:string,end:int,text:string,score:double>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def matches(text: Column, pattern: str, rank: int, kind: str, block: int = 256) -> Column:
    """All leftmost non-overlapping matches of a pattern with their places.

    Places are the running lengths of the pieces between matches and of the matches, summed
    by blocks of matches first, so the work grows in proportion to them; texts without a
    match cost one search.
    """

    def size(x: Column) -> Column:
        return F.length(x["before"]) + F.length(x["found"])

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["before"])
        end = start + F.length(x["found"])
        span = F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            end.alias("end"),
            x["found"].alias("text"),
            F.lit(1.0).alias("score"),
        )
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    before = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(before, F.lit(1), F.size(found)), found, lambda b, m: F.struct(b.alias("before"), m.alias("found")))

    def spans_of(block_: Column, at: Column) -> Column:
        return F.aggregate(block_, F.struct(at.alias("at"), no_spans().alias("out")), step, lambda a: a["out"])

    def blocks_of(pairs_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs_) - 1) / block).cast("int")), lambda k: F.slice(pairs_, k * block + 1, F.lit(block)))

    def starts_of(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + size(x)))
        return F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    # let() names a value that is used twice, so that it is worked out once
    long = let(pairs, lambda p: let(blocks_of(p), lambda b: F.flatten(F.zip_with(b, F.slice(starts_of(b), F.lit(1), F.size(b)), spans_of))))
    return F.when(text.rlike(pattern), long).otherwise(no_spans())


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def clear_of(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of those taken."""
    return F.filter(spans, lambda s: ~F.exists(taken, lambda t: (s["start"] < t["end"]) & (t["start"] < s["end"])))


def ordered(*spans: Column) -> Column:
    """Spans by start, then kind as ranked."""
    return F.array_sort(F.concat(*spans))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def masked(text: Column, spans: Column, mask: Callable[[Column], Column]) -> Column:
    """The text with each span replaced by its mask; spans that start inside an earlier one join it."""

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        return F.when(
            s["start"] >= a["at"],
            F.struct(s["end"].alias("at"), F.concat(a["out"], gap, mask(s)).alias("out")),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
