"""Board queries: one shuffle, no work on a board for each of its squares, and the same as plain Python."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import bitboards as BB
from corpusloom.functions import boards as B
from corpusloom.plans.text_queries import boards_of

SF = "/root/testdata/sf0.001"
STRAIGHT, SLANTED = [(0, 1), (0, -1), (1, 0), (-1, 0)], [(1, 1), (1, -1), (-1, 1), (-1, -1)]
WAYS = {"R": STRAIGHT, "B": SLANTED, "Q": STRAIGHT + SLANTED}


def _boards(spark, n=40):
    rng = random.Random(5)
    boards = ["".join(rng.choice(".......KQRBNPkqrbnpPpPp") for _ in range(64)) for _ in range(n)] + ["." * 64, "K" + "." * 62 + "k"]
    return boards, spark.createDataFrame(list(enumerate(boards)), "k int, board string")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_boards_are_built_in_one_shuffle(spark):
    assert _plan(boards_of(spark, SF)).count("Exchange hashpartitioning") == 1
    cells = spark.createDataFrame([(1, 1, "k"), (1, 1, "K"), (1, 64, "p"), (1, 16, "r"), (2, None, "q"), (2, 5, None)], "k int, sq int, p string")
    assert {r.k: r.board for r in B.of_pieces(cells, "k", F.col("sq"), F.col("p")).collect()} == {1: "k" + "." * 14 + "r" + "." * 47 + "p", 2: "." * 64}


def test_passed_pawns_and_directions_by_bits(spark):
    boards, df = _boards(spark)
    b = F.col("board")
    cells = df.select("k", F.posexplode(F.split("board", "")).alias("at", "p")).where("p in ('P', 'p', 'K')")
    ways = {"up": 7, "right": 7, "northeast": 7, "horizontal": 7, "diagonal": 7, "orthogonal": 2}
    told = BB.of_pieces(cells, "k", F.col("at") + 1, F.col("p")).join(df, "k").select(
        BB.passed_pawns("P").alias("x0"), B.passed_pawns(b, "P").alias("y0"), BB.passed_pawns("p").alias("x1"), B.passed_pawns(b, "p").alias("y1"),
        *(F.bit_count(B.reached_bits(F.col("white_k"), w, n)).alias(f"x{w}") for w, n in ways.items()), *(F.size(B.reached(B.squares_of(b, "K"), w, n)).alias(f"y{w}") for w, n in ways.items()),
    )
    rows = told.collect()
    assert len(rows) >= 40 and all(r[f"x{n}"] == r[f"y{n}"] for r in rows for n in (0, 1, *ways))


def _lines(board):
    for at, piece in enumerate(board):
        for dr, df in WAYS.get(piece.upper(), []):
            over = []
            for n in range(1, 8):
                r, f = at // 8 + dr * n, at % 8 + df * n
                if not (0 <= r < 8 and 0 <= f < 8) or len(over) > 1:
                    break
                if board[r * 8 + f] != ".":
                    if len(over) == 1:
                        yield piece, at + 1, over[0][0], over[0][1], board[r * 8 + f], r * 8 + f + 1, dr == 0 or df == 0
                    over.append((board[r * 8 + f], r * 8 + f + 1))


def test_lines_over_one_piece(spark):
    boards, df = _boards(spark)
    lines = [(k, *x) for k, b in enumerate(boards) for x in _lines(b)]
    pins = B.pins(df, "k")
    assert "mover" in _plan(pins)  # a piece meets one row of moves, not one row for each square
    assert sorted(map(tuple, pins.collect())) == sorted((k, p, a, t, m, to) for k, p, a, t, m, target, to, _ in lines if target == ("k" if p.isupper() else "K"))
    alike = {(k, p, a, t, g, to) for k, p, a, t, _, g, to, straight in lines if t.isupper() == p.isupper() and t.upper() in ("RQ" if straight else "BQ")}
    assert {tuple(r) for r in B.xrays(df, "k").collect()} == alike
    rays = {(k, p, a, t, g, to) for k, p, a, t, _, g, to, straight in lines if straight and p in "RQ" and t in "kq" and g in "qrbn"}
    assert {tuple(r) for r in B.rays(df, "k", "RQ", "kq", "qrbn", "orthogonal").collect()} == rays


def test_patterns_and_turns(spark):
    boards, df = _boards(spark)
    b = F.col("board")
    rows = df.select("board", B.flip_files(b).alias("files"), B.rotate90(b).alias("turn"), B.flip_diagonal(b).alias("across"), B.met_in_eight_ways(b, {"a1": "K", "b2": "Pp"}).alias("met"), B.shifted(b, "K", "Pp", 1, 1).alias("near")).collect()
    for r in rows:
        grid = [r.board[i : i + 8] for i in range(0, 64, 8)]
        assert r.files == "".join(x[::-1] for x in grid) and r.across == "".join(map("".join, zip(*grid, strict=True)))
        assert r.turn == "".join(map("".join, zip(*grid[::-1], strict=True)))
        assert r.met == any(grid[y][x] == "K" and grid[v][u] in "Pp" for y, x, v, u in ((7, 0, 6, 1), (7, 7, 6, 6), (0, 0, 1, 1), (0, 7, 1, 6)))
        assert r.near == any(grid[y][x] == "K" and grid[y - 1][x + 1] in "Pp" for y in range(1, 8) for x in range(7))
