"""Boards as twelve whole numbers, a bit a square (bit 0 is a8, bit 63 h1): counts and pawn structure by masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = "KQRBNPkqrbnp"


def signed(mask: int) -> int:
    """64 bits as a whole number with a sign."""
    return mask - (1 << 64) if mask >> 63 else mask


FILES = [signed(sum(1 << (8 * r + f) for r in range(8))) for f in range(8)]
LIGHT = signed(sum(1 << k for k in range(64) if (k % 8 + k // 8) % 2 == 0))


def column(piece: str) -> str:
    """The column of a kind of piece: names do not depend on case."""
    return f"{'white' if piece.isupper() else 'black'}_{piece.lower()}"


def of_pieces(cells: DataFrame, key: str, square: Column, piece: Column) -> DataFrame:
    """The key and a number for each kind of piece, from rows of pieces on squares (1 to 64)."""
    bit = F.expr("shiftleft(1L, square - 1)")
    rows = cells.select(key, square.alias("square"), piece.alias("piece"))
    return rows.groupBy(key).agg(*(F.coalesce(F.bit_or(F.when(F.col("piece") == p, bit)), F.lit(0)).cast("long").alias(column(p)) for p in PIECES))


def any_of(pieces: str) -> Column:
    """The squares of the pieces named; A-Z and a-z name a side."""
    named = {"A-Z": "KQRBNP", "a-z": "kqrbnp"}.get(pieces, pieces)
    out = F.col(column(named[0]))
    for p in named[1:]:
        out = out.bitwiseOR(F.col(column(p)))
    return out


def count_of(pieces: str) -> Column:
    return F.bit_count(any_of(pieces))


def within(squares: Column, mask: int) -> Column:
    return F.bit_count(squares.bitwiseAND(F.lit(mask)))


def piece_on(place: int) -> Column:
    """The piece on a square (1 to 64), a dot for none."""
    return F.coalesce(*(F.when(F.getbit(F.col(column(p)), F.lit(place - 1)) == 1, p) for p in PIECES), F.lit("."))


def power(white: bool) -> Column:
    worth = {"P": 1, "N": 3, "B": 3, "R": 5, "Q": 9}
    return sum((w * count_of(p if white else p.lower()) for p, w in worth.items()), F.lit(0))


def doubled_pawns(pawn: str = "P") -> Column:
    """Pawns with another of their side on their file."""
    pawns = F.col(column(pawn))
    return sum((F.when(within(pawns, f) > 1, within(pawns, f)).otherwise(0) for f in FILES), F.lit(0))


def isolated_pawns(pawn: str = "P") -> Column:
    """Pawns without one of their side on a neighbouring file."""
    pawns, out = F.col(column(pawn)), F.lit(0)
    for k, f in enumerate(FILES):
        beside = (FILES[k - 1] if k else 0) | (FILES[k + 1] if k < 7 else 0)
        out = out + F.when(within(pawns, beside) == 0, within(pawns, f)).otherwise(0)
    return out


def connected_pawns(pawn: str = "P") -> Column:
    """Pawns with one of their side on a neighbouring file."""
    return F.bit_count(F.col(column(pawn))) - isolated_pawns(pawn)


def passed_pawns(pawn: str = "P") -> Column:
    """Pawns with no opposing pawn ahead on their own or a neighbouring file."""
    own, behind = F.col(column(pawn)), F.col(column(pawn.swapcase()))
    move = F.shiftleft if pawn.isupper() else F.shiftrightunsigned
    behind = move(behind, 8).bitwiseOR(move(behind, 16))  # squares that an opposing pawn keeps: all behind it
    for n in (16, 32):
        behind = behind.bitwiseOR(move(behind, n))
    left = F.shiftrightunsigned(behind.bitwiseAND(F.lit(~FILES[0])), 1)
    right = F.shiftleft(behind.bitwiseAND(F.lit(~FILES[7])), 1)
    return F.bit_count(own.bitwiseAND(F.bitwise_not(behind.bitwiseOR(left).bitwiseOR(right))))


def light_bishops() -> Column:
    return within(any_of("Bb"), LIGHT)


def signature() -> Column:
    """Both sides' pieces but the kings, strongest first, such as QRvRP2; bare for none."""

    def side(pieces: str) -> Column:
        parts = []
        for p in pieces:
            n = count_of(p)
            parts.append(F.when(n > 1, F.concat(F.lit(p.upper()), n.cast("string"))).when(n == 1, F.lit(p.upper())).otherwise(""))
        text = F.concat(*parts)
        return F.when(text == "", "bare").otherwise(text)

    return F.concat_ws("v", side("QRBNP"), side("qrbnp"))


def occupied(board: Column) -> Column:
    """The occupied squares of a board of 64 characters, as bits."""
    return standing(board, PIECES)


def standing(board: Column, pieces: str) -> Column:
    """The squares of the pieces named on a board of 64 characters, as bits."""
    return F.conv(F.translate(F.reverse(board), PIECES + ".", "".join("1" if p in pieces else "0" for p in PIECES + ".")), 2, -10).cast("long")
