"""Queries over positions: sets of squares, directions, rays, transforms, flags of steps, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import bitboards as BB
from corpusloom.functions import boards as B
from corpusloom.operators import patterns as P
from corpusloom.operators import runs as R

from .bindings import RECORDS, STEPS, records, steps, table
from .catalog import query
from .text_queries import _ATT, _BOARD, _PIECES, bits_of, boards_of

_CELL = "count(*) filter ({})"


@query("squares_held", f"""with {_PIECES} select k, {_CELL.format("p = 'P' and r between 5 and 6")} pawns_low, {_CELL.format("p = 'p' and r = 1")} = 0 no_black_on_seventh,
  {_CELL.format("p in ('N', 'n') and (f = 0 or f = 7)")} rim_knights, {_CELL.format("p in ('K', 'k') and sq in (1, 8, 57, 64)")} corner_kings from pieces group by k""")
def squares_held(spark: SparkSession, d: str) -> DataFrame:
    """How many of some pieces stand on sets of squares."""
    b = F.col("board")
    return boards_of(spark, d).select(
        "k",
        B.held(b, "P", B.squares("a2-h3")).alias("pawns_low"),
        (B.held(b, "p", B.squares("a7-h7")) == 0).alias("no_black_on_seventh"),
        B.held(b, "Nn", B.squares("a1-a8") + B.squares("h1-h8")).alias("rim_knights"),
        B.held(b, "Kk", B.squares("a1") + B.squares("a8") + B.squares("h1") + B.squares("h8")).alias("corner_kings"),
    )


@query("hanging", f"""with {_PIECES}, {_ATT}, t as (select k, "to", bool_or((piece = upper(piece)) <> (target = upper(target))) hit, bool_or((piece = upper(piece)) = (target = upper(target))) held, any_value(target) target from att group by k, "to")
select k, {_CELL.format("hit and not held and target = upper(target)")} white, {_CELL.format("hit and not held and target = lower(target)")} black from t group by k""")
def hanging(spark: SparkSession, d: str) -> DataFrame:
    """Pieces that the other side attacks and their own does not: differences and unions of sets of squares."""
    a = B.attacks(boards_of(spark, d), "k")
    own = (F.col("piece") == F.upper("piece")) == (F.col("target") == F.upper("target"))
    side = F.col("target") == F.upper("target")
    sets = a.groupBy("k").agg(*(F.collect_set(F.when((side if white else ~side) & (own if held else ~own), F.col("to"))).alias(f"{n}{white}") for n, held in (("held", True), ("hit", False)) for white in (True, False)))
    loose = {white: F.array_except(f"hit{white}", f"held{white}") for white in (True, False)}
    return sets.select("k", F.size(loose[True]).alias("white"), F.size(loose[False]).alias("black"))


_WAY = {
    "up": "s.f = a.f and s.r < a.r", "right": "s.r = a.r and s.f > a.f", "northeast": "s.r < a.r and s.f - a.f = a.r - s.r",
    "horizontal": "s.r = a.r and s.f <> a.f", "diagonal": "abs(s.f - a.f) = abs(s.r - a.r) and s.f <> a.f", "orthogonal": "(s.f = a.f) <> (s.r = a.r)",
    "near": "(s.f = a.f) <> (s.r = a.r) and abs(s.f - a.f) + abs(s.r - a.r) between 1 and 2",
}


@query("directions", f"with {_PIECES}, s as (select sq, (sq - 1) % 8 f, (sq - 1) // 8 r from (select unnest(range(1, 65))::int sq)) select a.k, " + ", ".join(f"count(distinct s.sq) filter ({c}) \"{n}\"" for n, c in _WAY.items()) + " from pieces a cross join s where a.p = 'K' group by a.k")
def directions(spark: SparkSession, d: str) -> DataFrame:
    """How many squares lie in each direction from the white kings."""
    kings = BB.any_of("K")
    ways = {n: (n, 7) for n in _WAY if n != "near"} | {"near": ("orthogonal", 2)}
    return bits_of(spark, d).where(kings != 0).select("k", *(F.bit_count(B.reached_bits(kings, way, reach)).alias(n) for n, (way, reach) in ways.items()))


_LINE = """a.k = b.k and a.sq <> b.sq and {orth} join pieces m on m.k = a.k and m.sq not in (a.sq, b.sq) and (m.f - a.f) * (b.r - a.r) = (m.r - a.r) * (b.f - a.f)
  and m.f between least(a.f, b.f) and greatest(a.f, b.f) and m.r between least(a.r, b.r) and greatest(a.r, b.r)"""


@query("chained_rays", f"""with {_PIECES}, line as (select a.k, a.sq a, b.sq b, b.p target, m.p through, count(*) over (partition by a.k, a.sq, b.sq) n from pieces a join pieces b on {_LINE.format(orth="(a.f = b.f or a.r = b.r)")} where a.p in ('R', 'Q'))
select k, a "from", target, b "to" from line where n = 1 and through in ('k', 'q') and target in ('q', 'r', 'b', 'n')""")
def chained_rays(spark: SparkSession, d: str) -> DataFrame:
    """Rooks and queens that look through a king or queen at a piece behind it."""
    return B.rays(boards_of(spark, d), "k", "RQ", "kq", "qrbn", "orthogonal").select("k", "from", "target", "to")


@query("between_kings", f"""with {_PIECES}, p as (select k, max(sq) filter (p = 'K') x, max(sq) filter (p = 'k') y from pieces group by k having count(*) filter (p = 'K') = 1 and count(*) filter (p = 'k') = 1),
  g as (select k, abs((x - 1) % 8 - (y - 1) % 8) f, abs((x - 1) // 8 - (y - 1) // 8) r from p) select k, case when f = 0 or r = 0 or f = r then greatest(f, r) - 1 else 0 end squares from g""")
def between_kings(spark: SparkSession, d: str) -> DataFrame:
    """How many squares lie between the kings on a line."""
    one = boards_of(spark, d).where((B.count_of(F.col("board"), "K") == 1) & (B.count_of(F.col("board"), "k") == 1))
    x, y = F.instr("board", "K"), F.instr("board", "k")
    return one.select("k", B.squares_between(x, y).alias("squares"))


@query("forks", f"""with {_PIECES}, {_ATT}, n as (select k, "from", count(*) c from att where piece = 'N' and target = lower(target) group by all)
select k, bool_or(coalesce(c, 0) >= 2) some_fork, bool_and(coalesce(c, 0) >= 1) all_attack from (select k, sq "from" from pieces where p = 'N') left join n using (k, "from") group by k""")
def forks(spark: SparkSession, d: str) -> DataFrame:
    """Whether some white knight attacks two black pieces, and whether all attack one."""
    boards = boards_of(spark, d).where(F.contains("board", F.lit("N")))
    hits = B.attacks(boards, "k").where("piece = 'N' and target = lower(target)").groupBy("k", "from").agg(F.count("*").alias("c"))
    knights = boards.select("k", F.explode(B.squares_of(F.col("board"), "N")).alias("from")).join(hits, ["k", "from"], "left")
    c = F.coalesce("c", F.lit(0))
    return knights.groupBy("k").agg(F.bool_or(c >= 2).alias("some_fork"), F.bool_and(c >= 1).alias("all_attack"))


def _turn_sql() -> list[str]:
    spots = [(57, 50), (64, 55), (1, 10), (8, 15)]
    return [f"(substr(board, {a}, 1) = 'K' and substr(board, {b}, 1) <> '.')" for a, b in spots]


@query("more_transforms", f"""with {_BOARD} select k, array_to_string(list_transform(range(8), lambda r: substr(board, (7 - r) * 8 + 1, 8)), '') upside, array_to_string(list_transform(range(64), lambda i: substr(board, i % 8 * 8 + i // 8 + 1, 1)), '') mirrored,
  {' or '.join(_turn_sql())} corner, len(list_filter(range(1, 65), lambda i: substr(board, i, 1) = 'K' and i % 8 <> 0 and i > 8 and substr(board, i - 7, 1) <> '.')) > 0 shifted from boards""")
def more_transforms(spark: SparkSession, d: str) -> DataFrame:
    """A pattern (a king on a1, any piece on b2) met in one of its eight turns, or shifted anywhere."""
    b = F.col("board")
    corner = B.met_in_eight_ways(b, {"a1": "K", "b2": BB.PIECES})
    return boards_of(spark, d).select("k", B.flip_ranks(b).alias("upside"), B.flip_diagonal(b).alias("mirrored"), corner.alias("corner"), B.shifted(b, "K", BB.PIECES, 1, 1).alias("shifted"))


@query("step_flags", f"""with {STEPS}, s as (select user_id, step, label || case when step % 7 = 0 then '#' when step % 5 = 0 then '+' else '' end san, max(step) over (partition by user_id) last from steps)
select user_id, step, (step + 1) // 2 movenumber, case when step % 2 = 1 then 'black' else 'white' end mover_next, contains(san, '#') mate, right(san, 1) in ('+', '#') "check", step = 1 initial, step = last terminal from s""")
def step_flags(spark: SparkSession, d: str) -> DataFrame:
    """Move number, side to move, mate and check from the move's suffix, first and last step."""
    k = F.col("step")
    san = F.concat("label", F.when(k % 7 == 0, "#").when(k % 5 == 0, "+").otherwise(""))
    return P.flags(steps(spark, d).select("user_id", "step", san.alias("san")), ["user_id"], "step", "san").drop("san")


@query("one_side_streaks", f"""with {STEPS}, m as (select user_id, step % 2 side, label, row_number() over (partition by user_id, step % 2 order by step) n from steps),
  g as (select user_id, side, label, count(*) c from (select *, n - row_number() over (partition by user_id, side, label order by n) g from m) group by user_id, side, label, g)
select user_id, side, label, max(c) streak from g group by all having max(c) >= 2""")
def one_side_streaks(spark: SparkSession, d: str) -> DataFrame:
    """The longest run of one label among the moves of one side alone."""
    s = steps(spark, d).withColumn("side", F.col("step") % 2)
    own = s.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "side").orderBy("step")))
    found = R.runs(own.select("user_id", "side", "label", "n"), ["user_id", "side"], "n", "label")
    return found.groupBy("user_id", "side", "label").agg(F.max("run_length").alias("streak")).where("streak >= 2")


@query("value_windows", f"""with {STEPS}, h as (select user_id, step, step - row_number() over (partition by user_id order by step) g from steps where value >= 10)
select user_id, count(*) windows, max(c) longest from (select user_id, g, count(*) c from h group by all) where c >= 2 group by user_id having count(*) between 1 and 5""")
def value_windows(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of two steps or more above a value, of entities with one to five of them."""
    held = steps(spark, d).where("value >= 10").withColumn("label", F.lit("held"))
    found = R.runs(held.select("user_id", "step", "label"), ["user_id"], "step", "label").where("run_length >= 2")
    per = found.groupBy("user_id").agg(F.count("*").alias("windows"), F.max("run_length").alias("longest"))
    return per.where(F.col("windows").between(1, 5))


@query("record_ranges", f"with {RECORDS} select site, count(*) n, min(record_id) first from records where record_id between 200 and 9000 group by site having count(*) between 5 and 100000")
def record_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Groups with a number of matches in a range, of records with a number in a range."""
    r = records(spark, d).where(F.col("record_id").between(200, 9000))
    return r.groupBy("site").agg(F.count("*").alias("n"), F.min("record_id").alias("first")).where(F.col("n").between(5, 100_000))


@query("tag_regex", f"with {RECORDS} select record_id, regexp_extract(player, '([1-9][0-9]*)$', 1) number, upper(tag) || ' ' || lower(segment) text, greatest(least(price, 400000), 1000) bounded, round(sqrt(abs(price - 200000)), 6) root from records where regexp_matches(player, '#0*[0-9]*7$') and result = '1-0'")
def tag_regex(spark: SparkSession, d: str) -> DataFrame:
    """Records whose tag matches a pattern, with bounds, roots and joined texts of their fields."""
    r = records(spark, d).where(F.col("player").rlike("#0*[0-9]*7$") & (F.col("result") == "1-0"))
    text = F.concat(F.upper("tag"), F.lit(" "), F.lower("segment"))
    return r.select("record_id", F.regexp_extract("player", "([1-9][0-9]*)$", 1).alias("number"), text.alias("text"), F.greatest(F.least("price", F.lit(400000.0)), F.lit(1000.0)).alias("bounded"), F.round(F.sqrt(F.abs(F.col("price") - 200000)), 6).alias("root"))


@query("pieces_placed", f"with {_PIECES} select k, sq square, lower(p) type, case when p = upper(p) then 'white' else 'black' end colour, f + 1 file, 8 - r rank, chr(97 + f::int) || (8 - r) name from pieces")
def pieces_placed(spark: SparkSession, d: str) -> DataFrame:
    """A row for each piece: its type and colour, its square's file, rank and name."""
    return B.pieces(boards_of(spark, d), "k")


@query("position_keys", f"with {_BOARD} select k, md5(board || ' w') position_key, sha256('fast' || chr(31) || board || ' w') eval_key, regexp_matches(board, '^[^Qq]*$') queenless from boards")
def position_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of positions and of their evaluations under a profile, and a pattern over the board."""
    fen = F.concat("board", F.lit(" w"))
    return boards_of(spark, d).select("k", F.md5(fen).alias("position_key"), F.sha2(F.concat_ws("\u001f", F.lit("fast"), fen), 256).alias("eval_key"), F.col("board").rlike("^[^Qq]*$").alias("queenless"))


@query("full_signature", f"with {_BOARD} select k, array_to_string(list_transform(string_split('KQRBNPkqrbnp', ''), lambda p: repeat(p, length(board) - length(replace(board, p, '')))), '') signature from boards")
def full_signature(spark: SparkSession, d: str) -> DataFrame:
    """Material with kings, every piece named, white first."""
    return boards_of(spark, d).select("k", B.full_signature(F.col("board")).alias("signature"))


@query("only_line", "select p_partkey, abs(2 / (1 + exp(-0.00368208 * greatest(-1000, least(1000, (p_size - 25) * 40)))) - 2 / (1 + exp(-0.00368208 * greatest(-1000, least(1000, (p_partkey % 50 - 25) * 40))))) >= 0.3 or p_partkey % 50 = 0 as sharp from part")
def only_line(spark: SparkSession, d: str) -> DataFrame:
    """Positions whose two best lines are far apart, or that have one line only."""
    from corpusloom.functions import outcomes as O

    k = F.col("p_partkey") % 50
    second = F.when(k != 0, (k - 25) * 40)
    return table(spark, d, "part").select("p_partkey", O.is_sharp((F.col("p_size") - 25) * 40, second, 0.3).alias("sharp"))
