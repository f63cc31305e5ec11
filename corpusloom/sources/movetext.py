"""Movetext as tokens with places, plies and variations, and its annotation by ply: each text is scanned where it is."""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import comment_delta, inserted
from corpusloom.operators.shared import unused

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

#: White space, a comment, a line comment, brackets, a glyph, a number or result, a word; or any other character.
TOKEN = r"\s+|\{[^}]*\}?|;[^\n]*|[()]|\$[0-9]+|[0-9]+(?:-[0-9]+|/[0-9]+-[0-9]+/[0-9]+)?\.*|[^\s{}();$]+|[\s\S]"


_FIRST = {" ": "space", "\t": "space", "\n": "space", "\r": "space", "\f": "space", "\v": "space", "{": "comment", ";": "line", "(": "open", ")": "close"}
_FIRST |= dict.fromkeys("0123456789", "number") | dict.fromkeys("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "move")


def scan(text: str) -> Iterator[tuple[str, str, int, list[int], int]]:
    """Token, kind, begin, numbers of the variations around it (its own last) and ply of each token, as ``tokens`` has them."""
    begin = ply = opened = 0
    around: list[int] = []
    plies: list[int] = []  # before each variation around
    for token in re.findall(TOKEN, text, re.ASCII):
        kind = _FIRST.get(token[0], "other")
        if kind == "move":
            ply += 1
        elif kind == "open":
            opened += 1
            around = [*around, opened]
            plies.append(ply)
            ply -= 1
        elif kind == "close":
            if around:
                ply = plies.pop()
                yield token, kind, begin, around, ply
                around = around[:-1]
                begin += 1
                continue
            kind = "other"
        elif kind == "other" and token[0] == "$" and len(token) > 1:
            kind = "glyph"
        yield token, kind, begin, around, ply
        begin += len(token)


def _texts(column: pa.Array) -> Iterator[str]:
    for raw in column.cast(pa.binary()):
        yield (raw.as_py() or b"").decode("utf-8", "replace")


def tokens(df: DataFrame, key: Sequence[str], text: str, kinds: Sequence[str] = ()) -> DataFrame:
    """The key, place (from 0), token, kind, begin (its offset in code points), depth, variation, parent, ply and path.

    Kinds are space, comment, line, open, close, glyph, number, move and other; with ``kinds`` only those are returned.
    Variations are numbered from 1 in a record in the order of their opening brackets, 0 is the main line; brackets
    count as inside, and a closing bracket without its opening one is other. ``ply`` numbers moves; the first move of a
    variation has the ply of the move that it replaces, and other tokens have the ply of the move before. ``path`` has
    the numbers of the variations around a token, the outermost first, and its own. An open variation ends with the
    text. Every row is a text of its own. Null and empty texts have no tokens.

    A text is read once from left to right in the task that holds it: no token is shuffled or sorted, and what is held
    is a text and 50,000 tokens.
    """
    wanted, most = set(kinds), 50_000

    def read(batches):
        for batch in batches:
            keys, texts = batch.select(range(batch.num_columns - 1)), _texts(batch.column(batch.num_columns - 1))
            rows, token, kinds_, path, ends = array("q"), [], [], array("q"), array("i", [0])
            numbers = {n: array("q") for n in ("place", "begin", "depth", "variation", "ply")}
            parent: list[int | None] = []

            def flush():
                given = keys.take(pa.array(rows, pa.int64()))
                n = {k: pa.array(v, pa.int64()) for k, v in numbers.items()}
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(path, pa.int64()))
                columns = [*given.columns, n["place"].cast(pa.int32()), pa.array(token, pa.string()), pa.array(kinds_, pa.string()), n["begin"], n["depth"], n["variation"], pa.array(parent, pa.int64()), n["ply"], lists]
                out = pa.RecordBatch.from_arrays(columns, [*given.schema.names, "place", "token", "kind", "begin", "depth", "variation", "parent", "ply", "path"])
                for x in (rows, token, kinds_, path, parent, *numbers.values()):
                    del x[:]
                del ends[1:]
                return out

            for row, text in enumerate(texts):
                for place, (t, kind, begin, around, ply) in enumerate(scan(text)):
                    if wanted and kind not in wanted:
                        continue
                    rows.append(row)
                    token.append(t)
                    kinds_.append(kind)
                    path.extend(around)
                    ends.append(len(path))
                    for n, v in (("place", place), ("begin", begin), ("depth", len(around)), ("variation", around[-1] if around else 0), ("ply", ply)):
                        numbers[n].append(v)
                    parent.append((around[-2] if len(around) > 1 else 0) if kind == "open" else None)
                    if len(rows) + len(path) >= most:
                        yield flush()
            if rows:
                yield flush()

    given = df.select(*key, F.col(text).cast("string").alias(unused(df, "text_")[0]))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(read, f"{shape}, place int, token string, kind string, begin long, depth long, variation long, parent long, ply long, path array<long>")


def paths(found: DataFrame, key: Sequence[str]) -> DataFrame:
    """The key, variation, parent and path of every variation: the numbers of those around it, the outermost first, and its own."""
    return found.where("kind = 'open'").select(*key, "variation", "parent", "path")


def main_line(df: DataFrame, text: str, name: str) -> DataFrame:
    """The rows with an array of structs: at place k, counted from 0, the end of the main line's move of ply k (null for ply 0) and the comment after it.

    Comments after one move are joined; empty and unclosed ones are left out, and null stands for none. Null and empty
    texts have an empty array.
    """

    def read(batches):
        for batch in batches:
            at, ends, moves, notes = 0, array("i", [0]), [], []

            def upto(row):
                line = pa.StructArray.from_arrays([pa.array(moves, pa.int64()), pa.array(notes, pa.string())], ["end", "comment"])
                rows = batch.slice(at, row - at)
                return pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), line)], [*rows.schema.names[:-1], name])

            for row, text in enumerate(_texts(batch.column(batch.num_columns - 1))):
                if text:
                    own, said = [None], [[]]
                    for t, kind, begin, around, _ in scan(text):
                        if around:
                            continue
                        if kind == "move":
                            own.append(begin + len(t))
                            said.append([])
                        elif kind == "comment" and t[-1] == "}" and (inner := t[1:-1].strip(" \t\n\r\f\v")):
                            said[-1].append(inner)
                    moves += own
                    notes += [" ".join(c) if c else None for c in said]
                ends.append(len(moves))
                if len(moves) >= 50_000:
                    yield upto(row + 1)
                    at, ends, moves, notes = row + 1, array("i", [0]), [], []
            if at < batch.num_rows:
                yield upto(batch.num_rows)

    given = df.select("*", F.col(text).cast("string").alias(unused(df, "text_")[0]))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return given.mapInArrow(read, f"{shape}, `{name}` array<struct<end:bigint,comment:string>>")


def comments(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """The key, ply and comment of the main line: those after one move joined, empty and unclosed ones left out."""
    line = main_line(df.select(*key, text), text, "line_")
    return line.select(*key, F.posexplode("line_").alias("ply", "x")).where("x.comment is not null").select(*key, F.col("ply").cast("long").alias("ply"), F.col("x.comment").alias("comment"))


def annotate(records: DataFrame, annotated: DataFrame, key: Sequence[str], row: str, text: str, order: str, unmatched: bool = True) -> DataFrame:
    """Records with the comments that annotated versions of them add, each after the move of its ply.

    ``annotated`` has the key's columns, ``order``, which ranks its rows, and the text of a version; all versions of a
    key apply to all records of that key, which ``row`` tells apart. Of each comment only what the record's own comment
    at that ply lacks is added, once, in the versions' order, with closing braces made parentheses; plies beyond the
    record's moves go to its end; of notes at one place those of later plies come first. With ``unmatched`` false only records with a version stay. A null key matches none.
    """
    line, versions = unused(records, "line_", "versions_")
    noted = F.filter(F.transform("line_", lambda x, k: F.struct(k.cast("long").alias("ply"), x["comment"].alias("comment"))), lambda x: x["comment"].isNotNull())
    theirs = main_line(annotated.select(*key, order, text), text, "line_").select(*key, F.struct(F.col(order).alias("order"), noted.alias("notes")).alias("version"))
    theirs = theirs.groupBy(*key).agg(F.array_sort(F.collect_list("version")).alias(versions))
    joined = records.join(theirs, list(key), "left" if unmatched else "inner").select(*records.columns, versions)
    own = main_line(joined, text, line)  # its rows come as they are, the line's array is no expression to work out again

    def old(ply: Column) -> Column:
        return F.get(F.col(line), ply.cast("int"))

    deltas = F.flatten(F.transform(versions, lambda v: F.transform(v["notes"], lambda n: F.struct(n["ply"].alias("ply"), comment_delta(n["comment"], old(n["ply"])["comment"]).alias("note")))))
    deltas_, plies_, notes_ = unused(own, "deltas_", "plies_", "notes_")
    own = own.withColumn(deltas_, F.filter(deltas, lambda d: d["note"] != "")).withColumn(plies_, F.array_distinct(F.transform(deltas_, lambda d: d["ply"])))

    def note(ply: Column) -> Column:
        said = F.array_distinct(F.transform(F.filter(F.col(deltas_), lambda d: d["ply"] == ply), lambda d: d["note"]))
        offset = F.when(ply == 0, 0).otherwise(F.coalesce(old(ply)["end"], F.length(text), F.lit(0))).cast("int")
        return F.struct(offset.alias("offset"), (-ply).alias("later"), F.concat(F.lit(" {"), F.array_join(said, " "), F.lit("}")).alias("note"))

    own = own.withColumn(notes_, F.transform(plies_, note))
    put: Column = F.when(F.coalesce(F.size(notes_), F.lit(0)) <= 0, F.col(text)).otherwise(inserted(F.coalesce(F.col(text), F.lit("")), F.col(notes_)))
    return own.withColumn(text, put).select(records.columns)
