"""Replay of long move lists, keys of positions and origins of pieces, against plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import replay as P

MOVES = "g string, k long, m string"


def plain(moves, start=P.START):
    cells, out = list(start), []
    for m in moves:
        a, b, c, d = "abcdefgh".index(m[0]), 8 - int(m[1]), "abcdefgh".index(m[2]), 8 - int(m[3])
        s, t = b * 8 + a, d * 8 + c
        piece, met = cells[s], cells[t] if s != t else "."
        cells[s] = "."
        cells[t] = piece if len(m) < 5 or piece not in "Pp" else (m[4].upper() if piece == "P" else m[4].lower())
        if piece in "Pp" and a != c and met == ".":
            cells[b * 8 + c] = "."
        if piece in "Kk" and a == 4 and b == d and c in (2, 6):
            cells[d * 8 + (7 if c == 6 else 0)], cells[d * 8 + (5 if c == 6 else 3)] = ".", "R" if piece == "K" else "r"
        out.append("".join(cells))
    return out


def drawn(rng, n):
    square = lambda: rng.choice("abcdefgh") + rng.choice("12345678")
    return [square() + square() for _ in range(n)]


def rows_of(spark, lists):
    rows = [(g, k + 1, m) for g, moves in lists.items() for k, m in enumerate(moves)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, MOVES).repartition(3)


def test_kinds_of_moves(spark):
    lists = {
        "long castling": ["d2d4", "d7d5", "c1f4", "b8c6", "b1c3", "c8g4", "d1d2", "d8d7", "e1c1", "e8c8"],
        "passing": ["h2h4", "c7c5", "h4h5", "g7g5", "h5g6", "c5c4", "b2b4", "c4b3"],
        "promotion": ["a2b8n", "h7g1q", "b1c3q"],
        "none": ["e2e4", None, "castles", "e7e5"],
    }
    told = {(r.g, r.k): r for r in P.boards(rows_of(spark, lists), ["g"], "k", "m").collect()}
    assert told["long castling", 10].board.startswith("..kr.bnr") and told["long castling", 10].board.endswith("..KR.BNR")
    for g, moves in lists.items():
        if g != "none":
            assert [told[g, k + 1].board for k in range(len(moves))] == plain(moves)
    assert [told["long castling", k].kind for k in (9, 10)] == ["castling"] * 2
    assert [(told["passing", k].kind, told["passing", k].taken) for k in (5, 8)] == [("en passant", "p"), ("en passant", "P")]
    assert [(told["promotion", k].kind, told["promotion", k].taken, told["promotion", k].clock) for k in (1, 2)] == [("promotion", "n", 0), ("promotion", "N", 0)]
    assert told["promotion", 1].board[1] == "N" and told["promotion", 2].board[62] == "q"
    assert [told["none", k].piece for k in (1, 2, 3, 4)] == ["P", None, None, "p"]
    assert told["none", 3].board == told["none", 1].board
    assert [told["long castling", k].clock for k in range(1, 11)] == [0, 0, 1, 2, 3, 4, 5, 6, 7, 8]


def test_long_lists_and_keys(spark):
    rng = random.Random(5)
    lists = {"long": drawn(rng, 100_000), "short": drawn(rng, 7), None: drawn(rng, 3)}
    told = P.boards(rows_of(spark, lists), ["g"], "k", "m").withColumn("whole", P.zobrist(F.col("board")))
    assert told.where("key <> whole").count() == 0
    rows = {(r.g, r.k): r.board for r in told.select("g", "k", "board").collect()}
    assert len(rows) == 100_010
    for g, moves in lists.items():
        assert [rows[g, k + 1] for k in range(len(moves))] == plain(moves)
    assert told.select("board").distinct().count() == told.select("key").distinct().count()


@pytest.mark.parametrize("width", [1, 64])
def test_origins_through_composed_maps(spark, width):
    rng = random.Random(width)
    lists = {"long": drawn(rng, 5000 if width > 1 else 200), "short": drawn(rng, 5), None: drawn(rng, 66)}
    place = lambda at: (8 - F.substring("m", at + 1, 1).cast("int")) * 8 + F.instr(F.lit("abcdefgh"), F.substring("m", at, 1))
    told = {(r.g, r.k): r.origin for r in P.origins(rows_of(spark, lists), ["g"], "k", place(1), place(3), width).collect()}
    for g, moves in lists.items():
        held = list(range(1, 65))
        for k, m in enumerate(moves):
            s, t = ((8 - int(m[i + 1])) * 8 + "abcdefgh".index(m[i]) for i in (0, 2))
            moved, held[s] = held[s], 0
            held[t] = moved
            assert told[g, k + 1] == moved
    assert len(told) == sum(map(len, lists.values()))


def test_no_moves(spark):
    none = spark.createDataFrame([], MOVES)
    assert P.boards(none, ["g"], "k", "m").collect() == []
    assert P.origins(none, ["g"], "k", F.lit(1), F.lit(2)).collect() == []
