"""Material rules as rows: what must stand on a board for an ending, judged once for each material that occurs."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import bitboards as BB
from corpusloom.functions import boards as B
from corpusloom.functions.outcomes import side_rule


class Rule(NamedTuple):
    """A stem and its counts: groups of pieces, upper case for one side and lower for the other, with = or >=.

    ``all`` counts every piece, kings too; ``light`` bishops of both sides on light squares, ``linked`` own pawns beside
    a file with another. A rule holds for a board if it holds for either side. ``parents`` are labels that come along.
    """

    stem: str
    counts: str
    parents: tuple[str, ...] = ()


#: The endings in the order in which the first that holds names a board.
ENDINGS = [
    Rule("1-4BN", "N=1 B=1 all=4"),
    Rule("1-5NNp", "N=2 p=1 all=5"),
    Rule("2-1P", "P=1 all=3", ("2-0Pp",)),
    Rule("2-0Pp", "Pp>=1 QqRrBbNn=0"),
    Rule("3-1Np", "N=1 p>=1 QqRrBbn=0"),
    Rule("3-2NN", "N=1 n=1 QqRrBb=0"),
    Rule("4-1Bp", "B=1 p>=1 QqRrbNn=0"),
    Rule("4-2scBB", "B=1 b=1 light!=1 QqRrNn=0"),
    Rule("4-3ocBB", "B=1 b=1 light=1 QqRrNn=0"),
    Rule("5-0BN", "B=1 n=1 bNQqRr=0"),
    Rule("6-1-0RP", "R=1 p>=1 QqrBbNnP=0"),
    Rule("6-2-1RPr", "R=1 P=1 r=1 all=5"),
    Rule("6-2-2RPPr", "R=1 P=2 r=1 all=6", ("6-2-0Rr",)),
    Rule("6-2-0Rr", "R=1 r=1 QqBbNn=0 all>=6"),
    Rule("6-3RRrr", "R=2 r=2 QqBbNn=0 all>=6"),
    Rule("7-1RN", "R=1 n=1 QqrNBb=0"),
    Rule("7-2RB", "R=1 b=1 QqrBNn=0"),
    Rule("8-1RNr", "R=1 N=1 r=1 n=0 QqBb=0"),
    Rule("8-2RBr", "R=1 B=1 r=1 QqbNn=0"),
    Rule("8-3RAra", "R=1 BN=1 r=1 bn=1 Qq=0"),
    Rule("9-1Qp", "Q=1 p>=1 qRrBbNnP=0"),
    Rule("9-3QPq", "Q=1 P=1 q=1 RrBbNnp=0", ("9-2Qq",)),
    Rule("9-2Qq", "Q=1 q=1 BbNnRr=0"),
    Rule("10-1Qa", "Q=1 bn=1 qRrNB=0"),
    Rule("10-2Qr", "Q=1 r=1 qRBbNn=0"),
    Rule("10-3Qaa", "Q=1 bn=2 qBNRr=0"),
    Rule("10-4Qra", "Q=1 r=1 bn=1 qRBN=0"),
    Rule("10-5Qrr", "Q=1 r=2 qRBbNn=0"),
    Rule("10-6Qaaa", "Q=1 bn=3 qBNRr=0"),
    Rule("10-7-1Qbrr", "Q=1 B=1 r=2 qRbNn=0"),
    Rule("10-7QAq", "Q=1 BN=1 q=1 Rrbn=0"),
]

#: Parts of endings that are counted beside them; those that repeat an ending word for word are aliases.
AUXILIARY = [
    Rule("6-2-2RPPrConnected", "R=1 P=2 r=1 linked=2 all=6", ("6-2-2RPPr", "6-2-0Rr")),
    Rule("8-1RNrNoPawns", "R=1 N=1 r=1 n=0 QqBbPp=0", ("8-1RNr",)),
    Rule("8-1RNrPp", "R=1 N=1 r=1 n=0 QqBb=0"),
    Rule("8-2RBrNoPawns", "R=1 B=1 r=1 QqbNnPp=0", ("8-2RBr",)),
    Rule("8-2RBrPp", "R=1 B=1 r=1 QqbNn=0"),
    Rule("10-2QrNoPawns", "Q=1 r=1 qRBbNnPp=0", ("10-2Qr",)),
    Rule("10-2QrPp", "Q=1 r=1 qRBbNn=0"),
    Rule("10-7-1QbrrNoPawns", "Q=1 B=1 r=2 qRbNnPp=0", ("10-7-1Qbrr",)),
    Rule("10-7-1QbrrPp", "Q=1 B=1 r=2 qRbNn=0"),
]

#: Which side an ending favours, and its name; endings not named favour neither.
FAVOURED = {
    "1-4BN": ("bishop+knight side", "B>=1 N>=1 qrbnp=0"),
    "1-5NNp": ("two-knights side", "N>=2 p>=1"),
    "2-1P": ("pawn side", "P>=1 qrbnp=0"),
    "3-1Np": ("knight side", "N>=1 p>=1"),
    "4-1Bp": ("bishop side", "B>=1 p>=1"),
    "5-0BN": ("bishop side", "B>=1 n>=1"),
    "6-1-0RP": ("rook side", "R>=1 p>=1"),
    "6-2-1RPr": ("rook+pawn side", "R>=1 P>=1 r>=1"),
    "6-2-2RPPr": ("rook+two-pawns side", "R>=1 P>=2 r>=1"),
    "7-1RN": ("rook side", "R>=1 n>=1"),
    "7-2RB": ("rook side", "R>=1 b>=1"),
    "8-1RNr": ("rook+knight side", "R>=1 N>=1 r>=1"),
    "8-2RBr": ("rook+bishop side", "R>=1 B>=1 r>=1"),
    "9-1Qp": ("queen side", "Q>=1 p>=1"),
    "9-3QPq": ("queen+pawn side", "Q>=1 P>=1 q>=1"),
    "10-1Qa": ("queen side", "Q>=1 bn>=1"),
    "10-2Qr": ("queen side", "Q>=1 r>=1"),
    "10-3Qaa": ("queen side", "Q>=1 bn>=2"),
    "10-4Qra": ("queen side", "Q>=1 r>=1 bn>=1"),
    "10-5Qrr": ("queen side", "Q>=1 r>=2"),
    "10-6Qaaa": ("queen side", "Q>=1 bn>=3"),
    "10-7-1Qbrr": ("queen+bishop side", "Q>=1 B>=1 r>=2"),
    "10-7QAq": ("queen+minor side", "Q>=1 BN>=1 q>=1"),
}

PIECES = "KQRBNPkqrbnp"


def material(board: Column) -> Column:
    """What rules can ask of a board: pieces of each kind, light bishops, linked pawns of both sides, the latter two only where a rule needs them."""
    count = {p: B.count_of(board, p) for p in PIECES}
    light = F.when((count["B"] == 1) & (count["b"] == 1), F.size(F.filter(B.squares_of(board, "Bb"), B.is_light))).otherwise(0)
    rooks = (count["R"] == 1) & (count["r"] == 1)
    linked = [F.when(rooks & (count[p] == 2), B.connected_pawns(board, p)).otherwise(0) for p in "Pp"]
    fields = [count[p].cast("int").alias(n) for p, n in zip(PIECES, _NAMES, strict=True)]
    return F.struct(*fields, light.cast("int").alias("light"), linked[0].cast("int").alias("linked"), linked[1].cast("int").alias("linked_other"))


def material_of_bits() -> Column:
    """As ``material``, of a board as bits by piece."""
    one = {p: BB.count_of(p) == 1 for p in "BbRr"}
    light = F.when(one["B"] & one["b"], BB.light_bishops()).otherwise(0)
    linked = [F.when(one["R"] & one["r"] & (BB.count_of(p) == 2), BB.connected_pawns(p)).otherwise(0) for p in "Pp"]
    fields = [BB.count_of(p).cast("int").alias(n) for p, n in zip(PIECES, _NAMES, strict=True)]
    return F.struct(*fields, light.cast("int").alias("light"), linked[0].cast("int").alias("linked"), linked[1].cast("int").alias("linked_other"))


_NAMES = [f"{side}_{p}" for side in ("own", "other") for p in "kqrbnp"]
_FIELD = dict(zip(PIECES, _NAMES, strict=True))


def holds(counts: str, of: Column, swapped: bool) -> Column:
    """Whether a material meets counts, with white, or black if ``swapped``, as the side in upper case."""
    met = F.lit(True)
    for group, sign, number in re.findall(r"(\w+?)(!=|>=|=)(\d+)", counts):
        if group == "all":
            value = sum((of[n] for n in _NAMES), F.lit(0))
        elif group == "light":
            value = of["light"]
        elif group == "linked":
            value = of["linked_other" if swapped else "linked"]
        else:
            value = sum((of[_FIELD[p.swapcase() if swapped else p]] for p in group), F.lit(0))
        met = met & (value >= int(number) if sign == ">=" else value != int(number) if sign == "!=" else value == int(number))
    return met


def judged(boards: DataFrame, board: str = "board", aliases: bool = False, of: Column | None = None) -> DataFrame:
    """The boards with labels (all that hold, with their parents, an array in order), stem, side and favoured.

    ``stem`` is the first ending that holds, null if none; ``side`` is white, black, symmetric or unknown by the side
    that the ending favours, named in ``favoured``. Rules are judged on the different materials that occur, far fewer
    than boards, and joined back. With ``aliases`` rules that repeat an ending are labels of their own. ``of`` is the
    material where the boards are not text.
    """
    rows = boards.withColumn("material", material(F.col(board)) if of is None else of)
    told = _told(rows.select("material").distinct(), aliases)
    return rows.join(told, "material").drop("material")


def label_counts(boards: DataFrame, board: str = "board", aliases: bool = False, of: Column | None = None) -> DataFrame:
    """(label, n): how many boards have each label of ``judged``. Boards are counted by material, so none is joined back."""
    counts = boards.groupBy((material(F.col(board)) if of is None else of).alias("material")).agg(F.count("*").alias("n"))
    labels = _told(counts, aliases).select(F.explode("labels").alias("label"), "n")
    return labels.groupBy("label").agg(F.sum("n").alias("n"))


def _told(seen: DataFrame, aliases: bool) -> DataFrame:
    """Different materials with what ``judged`` tells of them."""
    rules = AUXILIARY + ENDINGS
    if not aliases:
        known = {r.counts for r in ENDINGS}
        rules = [r for r in AUXILIARY if r.counts not in known] + ENDINGS
    m = F.col("material")
    either = {r.stem: holds(r.counts, m, False) | holds(r.counts, m, True) for r in rules}
    labels = F.array_distinct(F.flatten(F.array_compact(F.array(*(F.when(either[r.stem], F.array(*map(F.lit, (r.stem, *r.parents)))) for r in rules)))))
    stem = F.coalesce(*(F.when(either[r.stem], F.lit(r.stem)) for r in ENDINGS))
    told = seen.withColumns({"labels": labels, "stem": stem})
    side, favoured = [], []
    for r in ENDINGS:
        label, counts = FAVOURED.get(r.stem, ("symmetric/either side", None))
        own = F.lit("symmetric") if counts is None else side_rule(holds(counts, m, False), holds(counts, m, True))
        side.append(F.when(F.col("stem") == r.stem, own))
        favoured.append(F.when(F.col("stem") == r.stem, F.lit(label)))
    return told.withColumns({"side": F.coalesce(*side), "favoured": F.coalesce(*favoured)})
