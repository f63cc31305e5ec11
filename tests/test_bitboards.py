"""Boards as bits against boards as text."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import bitboards as BB
from corpusloom.functions import boards as B


def test_bits_tell_what_text_tells(spark):
    rng = random.Random(8)
    boards = ["".join(rng.choice("......KQRBNPkqrbnpPPpp") for _ in range(64)) for _ in range(60)] + ["P" * 64, "." * 63 + "k", B.START]
    df = spark.createDataFrame(list(enumerate(boards)), "k int, board string")
    cells = df.select("k", F.posexplode(F.split("board", "")).alias("at", "p")).where("p not in ('.', '')")
    bits = BB.of_pieces(cells, "k", F.col("at") + 1, F.col("p")).join(df, "k")
    b = F.col("board")
    pairs = {
        "doubled": (BB.doubled_pawns(), B.doubled_pawns(b)), "isolated": (BB.isolated_pawns("p"), B.isolated_pawns(b, "p")), "connected": (BB.connected_pawns(), B.connected_pawns(b)),
        "power": (BB.power(False), B.power(b, False)), "signature": (BB.signature(), B.signature(b)), "h1": (BB.piece_on(64), B.piece_on(b, "h1")), "minors": (BB.count_of("NBnb"), B.count_of(b, "NBnb")),
        "white": (BB.count_of("A-Z"), B.count_of(b, "A-Z")), "light": (BB.light_bishops(), F.size(F.filter(B.squares_of(b, "Bb"), B.is_light))), "full": (BB.occupied(b), BB.any_of("KQRBNPkqrbnp")),
    }
    told = bits.select(*(x.alias(f"{n}_bits") for n, (x, _) in pairs.items()), *(y.alias(f"{n}_text") for n, (_, y) in pairs.items())).collect()
    assert len(told) == len(boards)
    for r in told:
        assert all(r[f"{n}_bits"] == r[f"{n}_text"] for n in pairs)


def test_attacks_of_all_pieces(spark):
    rng = random.Random(9)
    boards = ["".join(rng.choice("....KQRBNPkqrbnp") for _ in range(64)) for _ in range(12)]
    got = {(r.k, r.piece, r["from"], r.target, r.to) for r in B.attacks(spark.createDataFrame(list(enumerate(boards)), "k int, board string"), "k").collect()}
    want = set()
    straight, slanted = [(0, 1), (0, -1), (1, 0), (-1, 0)], [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    ways = {"R": straight, "B": slanted, "Q": straight + slanted, "K": straight + slanted, "N": [(a, b) for a in (-2, -1, 1, 2) for b in (-2, -1, 1, 2) if abs(a) != abs(b)]}
    for k, board in enumerate(boards):
        for at, piece in enumerate(board):
            steps = [(-1, -1), (-1, 1)] if piece == "P" else [(1, -1), (1, 1)] if piece == "p" else ways.get(piece.upper(), [])
            for dr, df in steps:
                for n in range(1, 8 if piece in "RBQrbq" else 2):
                    r, f = at // 8 + dr * n, at % 8 + df * n
                    if not (0 <= r < 8 and 0 <= f < 8):
                        break
                    if board[r * 8 + f] != ".":
                        want.add((k, piece, at + 1, board[r * 8 + f], r * 8 + f + 1))
                        break
    assert got == want
