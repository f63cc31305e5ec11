"""Boards of 64 characters (a8 to h1) as columns: counts, sets of squares, structure, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitboards import PIECES, occupied, signed, standing

#: What pieces are worth.
POWER = {"P": 1, "N": 3, "B": 3, "R": 5, "Q": 9}
START = "rnbqkbnrpppppppp................................PPPPPPPPRNBQKBNR"


def expand_fen(fen: Column) -> Column:
    """The board field of a FEN as 64 characters."""
    board = F.replace(F.split_part(fen, F.lit(" "), F.lit(1)), F.lit("/"), F.lit(""))
    for n in range(8, 0, -1):
        board = F.replace(board, F.lit(str(n)), F.lit("." * n))
    return board


def of_pieces(cells: DataFrame, key: str, square: Column, piece: Column) -> DataFrame:
    """(key, board) from rows of pieces on squares (1 to 64); of several pieces on a square the last by name stays.

    Rows move once, by the key. A board is four whole numbers, a hexadecimal digit a square, until it is spelled out.
    """
    order = "".join(sorted(PIECES))
    rows = cells.select(key, square.alias("square"), F.nullif(F.instr(F.lit(order), piece), F.lit(0)).alias("n"))
    best = rows.repartition(key).groupBy(key, "square").agg(F.max("n").alias("n"))
    digits = [F.bit_or(F.when(F.col("square").between(a + 1, a + 16), F.call_function("shiftleft", F.col("n").cast("long"), (a + 16 - F.col("square")) * 4))) for a in range(0, 64, 16)]
    four = best.groupBy(key).agg(*(F.coalesce(q, F.lit(0)).cast("long").alias(f"q{k}") for k, q in enumerate(digits)))
    spelled = F.concat(*(F.lpad(F.hex(f"q{k}"), 16, "0") for k in range(4)))
    return four.select(key, F.translate(spelled, "0123456789ABC", "." + order).alias("board"))


def epd(fen: Column) -> Column:
    """The first four fields of a FEN."""
    return F.array_join(F.slice(F.split(fen, " "), 1, 4), " ")


def count_of(board: Column, pieces: str) -> Column:
    """How many of the pieces named are on the board; A-Z and a-z name a side."""
    named = {"A-Z": "KQRBNP", "a-z": "kqrbnp"}.get(pieces, pieces)
    rest = F.translate(board, named, "") if len(named) > 1 else F.replace(board, F.lit(named), F.lit(""))
    return F.length(board) - F.length(rest)


def square(name: str) -> int:
    """The place of a square, 1 to 64."""
    return (8 - int(name[1])) * 8 + "abcdefgh".index(name[0]) + 1


def piece_on(board: Column, name: str) -> Column:
    return F.substring(board, square(name), 1)


def squares_of(board: Column, pieces: str) -> Column:
    """Places of the pieces named."""
    return F.filter(F.sequence(F.lit(1), F.lit(64)), lambda k: F.contains(F.lit(pieces), F.substring(board, k, F.lit(1))))


def file_of(k: Column) -> Column:
    return (k - 1) % 8


def rank_of(k: Column) -> Column:
    return 8 - F.floor((k - 1) / 8).cast("int")


def is_light(k: Column) -> Column:
    return (file_of(k) + rank_of(k)) % 2 == 0


def power(board: Column, white: bool) -> Column:
    out = F.lit(0)
    for piece, worth in POWER.items():
        out = out + worth * count_of(board, piece if white else piece.lower())
    return out


def signature(board: Column) -> Column:
    """Both sides' pieces but the kings, strongest first, such as QRvRP2; bare for none."""

    def side(pieces: str) -> Column:
        parts = []
        for p in pieces:
            n = count_of(board, p)
            parts.append(F.when(n > 1, F.concat(F.lit(p.upper()), n.cast("string"))).when(n == 1, F.lit(p.upper())).otherwise(""))
        text = F.concat(*parts)
        return F.when(text == "", "bare").otherwise(text)

    return F.concat_ws("v", side("QRBNP"), side("qrbnp"))


def pawn_files(board: Column, pawn: str) -> Column:
    return F.transform(squares_of(board, pawn), file_of)


def doubled_pawns(board: Column, pawn: str = "P") -> Column:
    """Pawns with another of their side on their file."""
    files = pawn_files(board, pawn)
    return F.size(F.filter(files, lambda f: F.size(F.filter(files, lambda g: g == f)) > 1))


def isolated_pawns(board: Column, pawn: str = "P") -> Column:
    """Pawns without one of their side on a neighbouring file."""
    files = pawn_files(board, pawn)
    return F.size(F.filter(files, lambda f: ~F.exists(files, lambda g: F.abs(g - f) == 1)))


def connected_pawns(board: Column, pawn: str = "P") -> Column:
    """Pawns with one of their side on a neighbouring file."""
    files = pawn_files(board, pawn)
    return F.size(F.filter(files, lambda f: F.exists(files, lambda g: F.abs(g - f) == 1)))


def passed_pawns(board: Column, pawn: str = "P") -> Column:
    """Pawns with no opposing pawn ahead on their own or a neighbouring file."""
    own, other = squares_of(board, pawn), squares_of(board, "p" if pawn == "P" else "P")
    ahead = (lambda k, o: o < k) if pawn == "P" else (lambda k, o: o > k)

    def blocked(k: Column) -> Column:
        return F.exists(other, lambda o: (F.abs(file_of(o) - file_of(k)) <= 1) & (F.floor((o - 1) / 8) != F.floor((k - 1) / 8)) & ahead(k, o))

    return F.size(F.filter(own, lambda k: ~blocked(k)))


def flip_colour(board: Column) -> Column:
    """The board from the other side: ranks turned, colours swapped."""
    return F.translate(flip_ranks(board), "KQRBNPkqrbnp", "kqrbnpKQRBNP")


def flip_files(board: Column) -> Column:
    return flip_ranks(F.reverse(board))


def placed(board: Column, places: list[int]) -> Column:
    """The board whose squares are those of the places in turn."""
    return F.array_join(F.transform(F.array(*(F.lit(k) for k in places)), lambda k: F.substring(board, k, F.lit(1))), "")


def rotate90(board: Column) -> Column:
    """A quarter turn to the right."""
    return placed(board, [(7 - k % 8) * 8 + k // 8 + 1 for k in range(64)])


def put(board: Column, place: Column, piece: Column) -> Column:
    return F.overlay(board, piece, place, F.lit(1))


def after_move(board: Column, uci: Column) -> Column:
    """The board after a move in coordinates: castling moves the rook, en passant takes, a fifth letter promotes."""

    def place(at: int) -> Column:
        return (8 - F.substring(uci, at + 1, 1).cast("int")) * 8 + F.instr(F.lit("abcdefgh"), F.substring(uci, at, 1))

    source, target = place(1), place(3)
    piece = F.substring(board, source, F.lit(1))
    taken = F.substring(board, target, F.lit(1))
    promoted = F.substring(uci, 5, 1)
    landed = F.when(promoted == "", piece).when(piece == "P", F.upper(promoted)).otherwise(F.lower(promoted))
    moved = put(put(board, source, F.lit(".")), target, landed)
    passing = piece.isin("P", "p") & (file_of(source) != file_of(target)) & (taken == ".")
    behind = (F.floor((source - 1) / 8).cast("int")) * 8 + file_of(target) + 1
    step = target - source
    castled = piece.isin("K", "k") & F.abs(step).isin(2) & (F.floor((source - 1) / 8) == F.floor((target - 1) / 8))
    rook = F.when(piece == "K", "R").otherwise("r")
    short = put(put(moved, target + 1, F.lit(".")), target - 1, rook)
    long = put(put(moved, target - 2, F.lit(".")), target + 1, rook)
    return F.when(castled & (step > 0), short).when(castled, long).when(passing, put(moved, behind, F.lit("."))).otherwise(moved)


def replay(moves: Column, start: Column | None = None) -> Column:
    """The boards after each move, as an array."""
    first = F.lit(START) if start is None else start
    zero = F.struct(first.alias("board"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, m: Column) -> Column:
        board = after_move(a["board"], m)
        return F.struct(board.alias("board"), F.concat(a["out"], F.array(board)).alias("out"))

    return F.aggregate(moves, zero, step, lambda a: a["out"])


def geometry(spark: SparkSession) -> DataFrame:
    """(from, to, kind, between) of all lines and leaps: 64 x 64 pairs at most, a fixed small table."""
    pair = spark.range(64).select((F.col("id") + 1).cast("int").alias("from")).crossJoin(spark.range(64).select((F.col("id") + 1).cast("int").alias("to")))
    df, dr = file_of(F.col("to")) - file_of(F.col("from")), rank_of(F.col("to")) - rank_of(F.col("from"))
    a, b = F.abs(df), F.abs(dr)
    kind = (
        F.when((a == 0) & (b == 0), None)
        .when((a == 0) | (b == 0), "orthogonal")
        .when(a == b, "diagonal")
        .when(a + b == 3, "knight")
    )
    distance = F.greatest(a, b)
    stride = F.signum(df).cast("int") - 8 * F.signum(dr).cast("int")
    between = F.when(kind == "knight", F.array().cast("array<int>")).otherwise(
        F.transform(F.filter(F.sequence(F.lit(1), F.lit(7)), lambda k: k < distance), lambda k: F.col("from") + k * stride)
    )
    return pair.select("from", "to", kind.alias("kind"), distance.alias("distance"), dr.alias("up"), between.alias("between")).where("kind is not null")


def movers(spark: SparkSession) -> DataFrame:
    """(mover, from, moves): for each kind of piece and square the squares it reaches, with those between as bits and whether on a file or rank; a fixed small table.

    A mover is a capital letter, or p for black pawns.
    """
    g = geometry(spark)
    near, line = F.col("distance") == 1, F.col("kind")
    reaches = {
        "R": line == "orthogonal", "B": line == "diagonal", "Q": line.isin("orthogonal", "diagonal"), "N": line == "knight", "K": near & (line != "knight"),
        "P": near & (line == "diagonal") & (F.col("up") == 1), "p": near & (line == "diagonal") & (F.col("up") == -1),
    }
    mover = F.array_compact(F.array(*(F.when(c, F.lit(m)) for m, c in reaches.items())))
    mask = F.aggregate("between", F.lit(0).cast("long"), lambda a, k: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k - 1)))
    rows = g.select("from", "to", mask.alias("between"), (line == "orthogonal").alias("straight"), F.explode(mover).alias("mover"))
    return rows.groupBy("mover", "from").agg(F.collect_list(F.struct("to", "between", "straight")).alias("moves"))


def _over_one(boards: DataFrame, key: str, board: str, sliders: str, bits: dict[str, Column], mover: Column, met) -> DataFrame:
    """(key, board, piece, from, at, m): moves of line pieces over exactly one piece, at ``at``, that meet a condition on bits of the board."""
    spark, full = boards.sparkSession, F.col("full")
    known = boards.select(key, board, *(c.alias(n) for n, c in {"full": occupied(F.col(board)), "sliders": standing(F.col(board), sliders), **bits}.items()))
    places = F.filter(F.sequence(F.lit(1), F.lit(64)), lambda k: F.getbit(F.col("sliders"), k - 1) == 1)
    rows = known.select(key, board, "full", *bits, F.explode(places).alias("from"))
    rows = rows.withColumn("piece", F.substring(F.col(board), F.col("from"), F.lit(1))).withColumn("mover", mover)
    lines = rows.join(F.broadcast(movers(spark)), ["mover", "from"])
    hits = F.filter("moves", lambda m: (F.bit_count(full.bitwiseAND(m["between"])) == 1) & met(m, full.bitwiseAND(m["between"])))
    found = lines.select(key, board, "piece", "from", "full", F.explode(hits).alias("m"))
    at = F.bit_count(full.bitwiseAND(F.col("m.between")) - 1) + 1  # no corner lies between two squares
    return found.select(key, board, "piece", "from", at.alias("at"), "m")


def attacks(boards: DataFrame, key: str, board: str = "board") -> DataFrame:
    """(key, piece, from, target, to) of all attacks of pieces on occupied squares.

    Each piece meets one row of the fixed table of moves, by its kind and square; what it reaches is told from the
    board's occupied squares as bits, before rows are made.
    """
    full = occupied(F.col(board))
    places = F.filter(F.sequence(F.lit(1), F.lit(64)), lambda k: F.getbit(F.col("full"), k - 1) == 1)
    pieces = boards.select(key, board, full.alias("full")).select(key, board, "full", F.explode(places).alias("from"))
    pieces = pieces.withColumn("piece", F.substring(F.col(board), F.col("from"), F.lit(1)))
    mover = F.when(F.col("piece") == "p", "p").otherwise(F.upper("piece"))
    lines = pieces.withColumn("mover", mover).join(F.broadcast(movers(boards.sparkSession)), ["mover", "from"])
    free = F.filter("moves", lambda m: (F.getbit(F.col("full"), m["to"] - 1) == 1) & (F.col("full").bitwiseAND(m["between"]) == 0))
    hits = lines.select(key, board, "piece", "from", F.explode(free).alias("m"))
    return hits.select(key, "piece", "from", F.substring(F.col(board), F.col("m.to"), F.lit(1)).alias("target"), F.col("m.to").alias("to"))


def pins(boards: DataFrame, key: str, board: str = "board") -> DataFrame:
    """(key, piece, from, pinned, at, king): line pieces with exactly one piece between them and the other king."""
    b, p = F.col(board), F.col("piece")
    kings = {"white_king": standing(b, "K"), "black_king": standing(b, "k")}
    king = F.when(p == F.upper(p), F.col("black_king")).otherwise(F.col("white_king"))
    crowned = boards.where(F.contains(b, F.lit("K")) | F.contains(b, F.lit("k")))
    hit = _over_one(crowned, key, board, "RBQrbq", kings, F.upper("piece"), lambda m, _: F.getbit(king, m["to"] - 1) == 1)
    return hit.select(key, "piece", "from", F.substring(b, F.col("at"), F.lit(1)).alias("pinned"), "at", F.col("m.to").alias("king"))


def xrays(boards: DataFrame, key: str, board: str = "board") -> DataFrame:
    """(key, piece, from, through, target, to): line pieces whose line passes one own line piece that moves alike."""
    b, p = F.col(board), F.col("piece")
    alike = {f"{side}_{way}": standing(b, named if side == "white" else named.lower()) for side in ("white", "black") for way, named in (("straight", "RQ"), ("slanted", "BQ"))}
    straight, slanted = (F.when(p == F.upper(p), F.col(f"white_{way}")).otherwise(F.col(f"black_{way}")) for way in ("straight", "slanted"))

    def met(m: Column, between: Column) -> Column:
        return (F.getbit("full", m["to"] - 1) == 1) & (between.bitwiseAND(F.when(m["straight"], straight).otherwise(slanted)) != 0)

    hit = _over_one(boards, key, board, "RBQrbq", alike, F.upper("piece"), met)
    through, target = F.substring(b, F.col("at"), F.lit(1)), F.substring(b, F.col("m.to"), F.lit(1))
    return hit.select(key, "piece", "from", through.alias("through"), target.alias("target"), F.col("m.to").alias("to"))


def move_kinds(board: Column, uci: Column) -> dict[str, Column]:
    """What a move does on the board before it: capture, promotion, castling, en passant."""

    def place(at: int) -> Column:
        return (8 - F.substring(uci, at + 1, 1).cast("int")) * 8 + F.instr(F.lit("abcdefgh"), F.substring(uci, at, 1))

    source, target = place(1), place(3)
    piece, taken = F.substring(board, source, F.lit(1)), F.substring(board, target, F.lit(1))
    passing = piece.isin("P", "p") & (file_of(source) != file_of(target)) & (taken == ".")
    return {
        "piece": piece,
        "capture": (taken != ".") | passing,
        "promotion": F.length(uci) == 5,
        "castling": piece.isin("K", "k") & (F.abs(file_of(target) - file_of(source)) == 2),
        "en_passant": passing,
    }


def tracks(moves: Column) -> Column:
    """Which piece each move moves: the place it stood on in the start position, 0 for none.

    The state is the number of the piece on each of the 64 squares.
    """

    def place(m: Column, at: int) -> Column:
        return (8 - F.substring(m, at + 1, 1).cast("int")) * 8 + F.instr(F.lit("abcdefgh"), F.substring(m, at, 1))

    squares = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.when(F.substring(F.lit(START), k, F.lit(1)) != ".", k).otherwise(0))
    zero = F.struct(squares.alias("on"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, m: Column) -> Column:
        source, target = place(m, 1), place(m, 3)
        moved = F.element_at(a["on"], source)
        on = F.transform(a["on"], lambda p, k: F.when(k + 1 == target, moved).when(k + 1 == source, 0).otherwise(p))
        return F.struct(on.alias("on"), F.concat(a["out"], F.array(moved)).alias("out"))

    return F.aggregate(moves, zero, step, lambda a: a["out"])


def squares(named: str) -> list[int]:
    """Places of a square or of a block of squares between two corners, such as a2-h3."""
    first, _, last = named.partition("-")
    last = last or first
    files, ranks = sorted((first[0], last[0])), sorted((first[1], last[1]))
    return [square(chr(f) + str(r)) for f in range(ord(files[0]), ord(files[1]) + 1) for r in range(int(ranks[0]), int(ranks[1]) + 1)]


def held(board: Column, pieces: str, places: list[int]) -> Column:
    """How many of the pieces named stand on places: the runs of places are cut out and counted in."""
    runs: list[list[int]] = []
    for k in sorted(set(places)):
        if runs and k == runs[-1][-1] + 1:
            runs[-1].append(k)
        else:
            runs.append([k])
    return count_of(F.concat(*(F.substring(board, r[0], len(r)) for r in runs)), pieces)


#: Steps of files and ranks for each direction.
WAYS = {"up": [(0, 1)], "down": [(0, -1)], "left": [(-1, 0)], "right": [(1, 0)], "northeast": [(1, 1)], "northwest": [(-1, 1)], "southeast": [(1, -1)], "southwest": [(-1, -1)]}
WAYS |= {"horizontal": WAYS["left"] + WAYS["right"], "vertical": WAYS["up"] + WAYS["down"], "diagonal": [w for k in ("northeast", "northwest", "southeast", "southwest") for w in WAYS[k]]}
WAYS |= {"orthogonal": WAYS["horizontal"] + WAYS["vertical"]}


def reached(places: Column, way: str, reach: int = 7) -> Column:
    """The squares up to ``reach`` steps away from any of the places in a direction."""
    steps = F.array(*(F.struct(F.lit(f * n).alias("f"), F.lit(r * n).alias("r")) for f, r in WAYS[way] for n in range(1, reach + 1)))

    def moved(k: Column) -> Column:
        inside = F.filter(steps, lambda s: (file_of(k) + s["f"]).between(0, 7) & (rank_of(k) + s["r"]).between(1, 8))
        return F.transform(inside, lambda s: (k + s["f"] - 8 * s["r"]).cast("int"))

    return F.array_distinct(F.flatten(F.transform(places, moved)))


def reached_bits(bits: Column, way: str, reach: int = 7) -> Column:
    """As ``reached``, with places and squares as bits: each place brings its fixed mask."""
    masks = []
    for k in range(64):
        ends = [(k % 8 + f * n, k // 8 - r * n) for f, r in WAYS[way] for n in range(1, reach + 1)]
        masks.append(signed(sum(1 << (8 * r + f) for f, r in set(ends) if 0 <= f <= 7 and 0 <= r <= 7)))
    table = F.array(*(F.lit(m).cast("long") for m in masks))
    at = F.filter(F.sequence(F.lit(1), F.lit(64)), lambda k: F.getbit(bits, k - 1) == 1)
    return F.aggregate(at, F.lit(0).cast("long"), lambda a, k: a.bitwiseOR(F.element_at(table, k)))


def squares_between(a: Column, b: Column) -> Column:
    """How many squares lie between two places on a line, none where they are on no line."""
    f, r = F.abs(file_of(a) - file_of(b)), F.abs(rank_of(a) - rank_of(b))
    return F.when((f == 0) | (r == 0) | (f == r), F.greatest(f, r) - 1).otherwise(0)


def rays(boards: DataFrame, key: str, sliders: str, through: str, targets: str, kind: str, board: str = "board") -> DataFrame:
    """(key, piece, from, through, target, to): lines from a slider over exactly one piece, of those named, to a target."""
    b = F.col(board)
    sets = {"passed": standing(b, through), "targets": standing(b, targets)}
    hit = _over_one(boards, key, board, sliders, sets, F.lit("R" if kind == "orthogonal" else "B"), lambda m, between: (F.getbit("targets", m["to"] - 1) == 1) & (between.bitwiseAND(F.col("passed")) != 0))
    over, target = F.substring(b, F.col("at"), F.lit(1)), F.substring(b, F.col("m.to"), F.lit(1))
    return hit.select(key, "piece", "from", over.alias("through"), target.alias("target"), F.col("m.to").alias("to"))


def flip_ranks(board: Column) -> Column:
    """The board upside down, colours as they are."""
    return F.concat(*(F.substring(board, r * 8 + 1, 8) for r in range(7, -1, -1)))


def flip_diagonal(board: Column) -> Column:
    """Files and ranks changed for each other, a8 and h1 kept."""
    return placed(board, [k % 8 * 8 + k // 8 + 1 for k in range(64)])


def met_in_eight_ways(board: Column, pattern: dict[str, str]) -> Column:
    """Whether squares hold one of the pieces named for each, in one of the board's four turns or their mirror images.

    The pattern's few squares are turned, not the board.
    """
    ways = set()
    for across in (False, True):
        for left in (False, True):
            for down in (False, True):
                turned = []
                for name, held_ in pattern.items():
                    r, f = divmod(square(name) - 1, 8)
                    r, f = (f, r) if across else (r, f)
                    turned.append(((7 - r if down else r) * 8 + (7 - f if left else f) + 1, held_))
                ways.add(tuple(sorted(turned)))
    met = None
    for way in sorted(ways):
        hit = None
        for k, held_ in way:
            on = F.contains(F.lit(held_), F.substring(board, k, 1))
            hit = on if hit is None else hit & on
        met = hit if met is None else met | hit
    return met


def shifted(board: Column, pieces: str, others: str, files: int, ranks: int) -> Column:
    """Whether anywhere one of the pieces has, so many files and ranks further, one of the others."""
    inside = signed(sum(1 << k for k in range(64) if 0 <= k % 8 + files <= 7 and 0 <= k // 8 - ranks <= 7))
    move = files - 8 * ranks
    found = standing(board, pieces).bitwiseAND(F.lit(inside))
    there = F.shiftleft(found, move) if move >= 0 else F.shiftrightunsigned(found, -move)
    return there.bitwiseAND(standing(board, others)) != 0


def pieces(boards: DataFrame, key: str, board: str = "board") -> DataFrame:
    """(key, square, type, colour, file, rank, name) of every piece."""
    at = F.filter(F.sequence(F.lit(1), F.lit(64)), lambda k: F.substring(F.col(board), k, F.lit(1)) != ".")
    rows = boards.select(key, board, F.explode(at).alias("square")).withColumn("p", F.substring(F.col(board), F.col("square"), F.lit(1)))
    file, rank = file_of(F.col("square")) + 1, rank_of(F.col("square"))
    colour = F.when(F.col("p") == F.upper("p"), "white").otherwise("black")
    return rows.select(key, "square", F.lower("p").alias("type"), colour.alias("colour"), file.alias("file"), rank.alias("rank"), F.concat(F.chr(96 + file), rank.cast("string")).alias("name"))


def full_signature(board: Column) -> Column:
    """Every piece named, kings first, white before black."""
    return F.concat(*(F.repeat(F.lit(p), count_of(board, p)) for p in "KQRBNPkqrbnp"))
