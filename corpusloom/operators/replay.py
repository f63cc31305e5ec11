"""Replay of move lists of any length: boards by a fold that holds one board, pieces by maps of squares that compose."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

START = "rnbqkbnrpppppppp................................PPPPPPPPRNBQKBNR"
PIECES = "PNBRQKpnbrqk"
MOVE = re.compile("[a-h][1-8][a-h][1-8][qrbnQRBN]?")


def square_key(piece: str, place: int) -> int:
    """The number that a piece on a place (1 to 64) adds to a board's key: 60 bits of an MD5."""
    return int(hashlib.md5(f"{piece}{place}".encode()).hexdigest()[:15], 16)


def zobrist(board: Column) -> Column:
    """The key of a board of 64 characters: the numbers of its pieces and places, combined by exclusive or."""
    numbers = F.array(*(F.lit(square_key(p, k)) for p in PIECES for k in range(1, 65)))

    def add(key: Column, k: Column) -> Column:
        kind = F.instr(F.lit(PIECES), F.substring(board, k, F.lit(1)))
        return F.when(kind > 0, key.bitwiseXOR(F.element_at(numbers, (kind - 1) * 64 + k))).otherwise(key)

    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0).cast("long"), add)


def boards(df: DataFrame, entity: Sequence[str], step: str, move: str, start: str = START) -> DataFrame:
    """What each move does: the entity, the step, board (after it), piece, taken, kind, clock and key.

    Moves are coordinates with a fifth letter for promotions, which means nothing for other pieces than pawns. A king that moves two files from the e-file takes its rook
    along, a pawn that moves aside to an empty square takes the pawn it passes (``kind`` says so, or ``promotion``).
    ``taken`` is the piece taken, empty if none; ``clock`` counts moves since the last taken piece or pawn move; ``key``
    is ``zobrist`` of the board, brought forward by the squares that change. A null or other text changes nothing and
    has a null piece. Moves need not be legal.

    What castling and en passant do depends on the pieces met, so moves do not compose without their board. Rows are
    sorted by entity and step and folded as they stream by: one board is held, no list of boards.
    """
    numbers = {(p, k): square_key(p, k + 1) for p in PIECES for k in range(64)}
    first = 0
    for k, p in enumerate(start):
        first ^= numbers.get((p, k), 0)
    names, width = ["board", "piece", "taken", "kind", "clock", "key"], len(entity)

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, cells, clock, key = None, [], 0, 0

        def put(k: int, p: str) -> None:
            nonlocal key
            key ^= numbers.get((cells[k], k), 0) ^ numbers.get((p, k), 0)
            cells[k] = p

        for batch in batches:
            out: list[tuple] = []
            columns = [c.to_pylist() for c in batch.columns]
            for *own, _, m in zip(*columns, strict=True):
                if own != of:
                    of, cells, clock, key = own, list(start), 0, first
                if m is None or not MOVE.fullmatch(m):
                    out.append(("".join(cells), None, "", "", clock, key))
                    continue
                a, b = "abcdefgh".index(m[0]), "abcdefgh".index(m[2])
                source, target = (8 - int(m[1])) * 8 + a, (8 - int(m[3])) * 8 + b
                piece, taken, kind = cells[source], cells[target] if source != target else ".", ""
                put(source, ".")
                if len(m) == 5 and piece in "Pp":
                    kind = "promotion"
                    put(target, m[4].upper() if piece == "P" else m[4].lower())
                else:
                    put(target, piece)
                if piece in "Pp" and a != b and taken == ".":
                    kind, passed = "en passant", source // 8 * 8 + b
                    taken = cells[passed]
                    put(passed, ".")
                elif piece in "Kk" and a == 4 and abs(a - b) == 2 and m[1] == m[3]:
                    kind, rook = "castling", "R" if piece == "K" else "r"
                    put(target + 1 if b > a else target - 2, ".")
                    put(target - 1 if b > a else target + 1, rook)
                clock = 0 if piece in "Pp" or taken != "." else clock + 1
                out.append(("".join(cells), piece, taken.replace(".", ""), kind, clock, key))
            new = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[: width + 1], *new], [*(f"k{i}" for i in range(width + 1)), *names])

    kinds = [pa.string()] * 4 + [pa.int64()] * 2
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate([*entity, step])]
    rows = df.select(*keys, F.col(move).alias("m"))
    sorted_ = rows.repartition(*rows.columns[:width]).sortWithinPartitions(*rows.columns[: width + 1])
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: width + 1])
    told = sorted_.mapInArrow(fold, f"{shape}, board string, piece string, taken string, kind string, clock long, key long")
    return told.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate([*entity, step])), *names)


def origins(df: DataFrame, entity: Sequence[str], step: str, source: Column, target: Column, width: int = 64) -> DataFrame:
    """On which square each moved piece began: the entity, the step and origin (1 to 64; 0 for a square left before).

    Steps are numbered from 1 without gaps. The moves of ``width`` steps are a map that says for every square whose
    piece it holds; maps compose, 64 to one in each round, and what comes before each segment is handed down again. So
    an entity of any length is spread over many tasks. Castling and en passant are not followed.
    """
    same = F.array(*(F.lit(k) for k in range(1, 65)))
    keys, segment = [f"k{i}" for i in range(len(entity))], F.floor((F.col(step) - 1) / width).cast("long")

    def move(a: Column, m: Column) -> Column:
        return F.transform(a, lambda p, k: F.when(k + 1 == m["t"], F.element_at(a, m["s"])).when(k + 1 == m["s"], F.lit(0)).otherwise(p))

    def then(a: Column, b: Column) -> Column:
        return F.transform(b, lambda k: F.when(k == 0, 0).otherwise(F.element_at(a, F.greatest(k, F.lit(1)))))

    def listed(name: str, *fields: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col(fields[-1]).isNotNull(), F.struct(*fields)))).alias(name)

    rows = df.select(*(F.col(c).alias(k) for c, k in zip(entity, keys, strict=True)), F.col(step).alias("k"), segment.alias("segment"), source.cast("int").alias("s"), target.cast("int").alias("t"))
    segments = rows.groupBy(*keys, "segment").agg(listed("moves", "k", "s", "t"))
    segments = stored(segments.withColumn("map", F.aggregate("moves", same, move)), "segments")
    levels, last = [segments.select(*keys, "segment", "map")], segments.agg(F.max("segment")).first()[0] or 0
    upper = F.floor(F.col("segment") / 64).cast("long")
    while last:
        last //= 64
        parts = levels[-1].groupBy(*keys, upper.alias("upper")).agg(listed("parts", "segment", "map"))
        levels.append(parts.select(*keys, F.col("upper").alias("segment"), F.aggregate(F.transform("parts", lambda p: p["map"]), same, then).alias("map")))
    before = levels[-1].select(*keys, "segment", same.alias("before"))
    for lower in reversed(levels[:-1]):
        both = lower.select(*keys, upper.alias("upper"), "segment", "map", F.lit(None).cast("array<int>").alias("before"))
        both = both.union(before.select(*keys, F.col("segment").alias("upper"), F.lit(None).cast("long"), F.lit(None).cast("array<int>"), "before"))
        parts = both.groupBy(*keys, "upper").agg(listed("parts", "segment", "map"), F.first("before", ignorenulls=True).alias("before"))
        start = F.struct(F.col("before").alias("at"), F.array().cast("array<struct<segment:bigint,before:array<int>>>").alias("out"))
        handed = F.aggregate(
            "parts", start,
            lambda a, p: F.struct(then(a["at"], p["map"]).alias("at"), F.concat(a["out"], F.array(F.struct(p["segment"].alias("segment"), a["at"].alias("before")))).alias("out")),
            lambda a: a["out"],
        )
        before = parts.select(*keys, F.inline(handed))
    empty = F.lit(None).cast("array<struct<k:bigint,s:int,t:int>>")
    both = segments.select(*keys, "segment", F.col("moves").cast("array<struct<k:bigint,s:int,t:int>>").alias("moves"), F.lit(None).cast("array<int>").alias("before"))
    both = both.union(before.select(*keys, "segment", empty, "before")).groupBy(*keys, "segment").agg(F.first("moves", ignorenulls=True).alias("moves"), F.first("before", ignorenulls=True).alias("before"))
    start = F.struct(F.col("before").alias("on"), F.array().cast("array<struct<k:bigint,origin:int>>").alias("out"))
    told = F.aggregate(
        "moves", start,
        lambda a, m: F.struct(move(a["on"], m).alias("on"), F.concat(a["out"], F.array(F.struct(m["k"].alias("k"), F.element_at(a["on"], m["s"]).alias("origin")))).alias("out")),
        lambda a: a["out"],
    )
    return both.select(*keys, F.inline(told)).select(*(F.col(k).alias(c) for c, k in zip(entity, keys, strict=True)), F.col("k").alias(step), "origin")
