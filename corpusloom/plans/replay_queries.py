"""Queries over replayed move lists: flags of moves, keys of positions, repetitions, material."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import replay as P
from corpusloom.operators import runs as R

from .bindings import table
from .catalog import SQL, query
from .text_queries import _BOARD, boards_of


def moves(spark: SparkSession, d: str) -> DataFrame:
    """events as moves in coordinates, numbered by user; they need not be legal."""
    e = F.col("event_id")

    def part(a: int, b: int, c: int, f: int) -> list:
        return [F.chr(97 + (e * a + b) % 8), ((e * c + f) % 8 + 1).cast("string")]

    m = table(spark, d, "events").select("user_id", "ts", "event_id", F.concat(*part(7, 0, 5, 0), *part(3, 1, 11, 3)).alias("m"))
    return R.numbered(m, ["user_id"], ["ts", "event_id"]).select("user_id", "step", "m")


def replayed(spark: SparkSession, d: str) -> DataFrame:
    return P.boards(moves(spark, d), ["user_id"], "step", "m")


_MOVES = """mv as (select user_id, step, (8 - b) * 8 + a + 1 s, (8 - d) * 8 + c + 1 t, a, b, c, d from (select user_id, row_number() over (partition by user_id order by ts, event_id) step,
  (event_id * 7) % 8 a, (event_id * 5) % 8 + 1 b, (event_id * 3 + 1) % 8 c, (event_id * 11 + 3) % 8 + 1 d from events))"""
_PUT = "substr({b}, 1, {k} - 1) || {p} || substr({b}, {k} + 1)"
_REPLAY = f"""recursive {_MOVES},
r as (select distinct user_id, cast(0 as bigint) step, 'rnbqkbnrpppppppp................................PPPPPPPPRNBQKBNR' board, '' piece, '' taken, '' kind, cast(0 as bigint) clock from events
union all select user_id, step, case kind when 'en passant' then {_PUT.format(b="moved", k="beside", p="'.'")}
    when 'castling' then case when c > a then substr(moved, 1, t - 2) || rook || substr(moved, t, 1) || '.' || substr(moved, t + 2)
      else substr(moved, 1, t - 3) || '.' || substr(moved, t - 1, 2) || rook || substr(moved, t + 2) end else moved end board,
  piece, gone taken, kind, case when piece in ('P', 'p') or gone <> '' then 0 else clock + 1 end clock
from (select *, case when kind = 'en passant' then replace(substr(moved, beside, 1), '.', '') else replace(met, '.', '') end gone from
 (select *, {_PUT.format(b="lifted", k="t", p="piece")} moved, (s - 1) // 8 * 8 + c + 1 beside, case piece when 'K' then 'R' else 'r' end rook,
  case when piece in ('P', 'p') and a <> c and met = '.' then 'en passant' when piece in ('K', 'k') and a = 4 and abs(a - c) = 2 and b = d then 'castling' else '' end kind from
  (select mv.*, r.clock, substr(board, s, 1) piece, case when s = t then '.' else substr(board, t, 1) end met, {_PUT.format(b="board", k="s", p="'.'")} lifted
   from r join mv on mv.user_id = r.user_id and mv.step = r.step + 1))))"""


#: The queries themselves are ``text_queries.replay_moves`` and ``rule_queries.piece_tracks``.
SQL["replay_moves"] = f"with {_REPLAY} select user_id, step - 1 ply, board from r where step > 0"
SQL["piece_tracks"] = f"""with recursive {_MOVES}, p as (select distinct user_id, cast(0 as bigint) step, list_transform(range(1, 65), lambda k: case when k between 17 and 48 then 0 else k end) held, cast(0 as bigint) piece from events
union all select mv.user_id, mv.step, list_transform(range(1, 65), lambda k: case when k = t then held[s] when k = s then 0 else held[k] end), held[s] from p join mv on mv.user_id = p.user_id and mv.step = p.step + 1)
select user_id, cast(piece as int) piece, count(*) moves from p where piece > 0 group by user_id, piece"""


@query("move_flags", f"with {_REPLAY} select user_id, step, piece, taken, kind, clock from r where step > 0")
def move_flags(spark: SparkSession, d: str) -> DataFrame:
    """The piece that moves, what it takes, castling and en passant, and the half-move clock."""
    return replayed(spark, d).select("user_id", "step", "piece", "taken", "kind", "clock")


_NUMBER = "cast('0x' || substr(md5({p} || {k}), 1, 15) as bigint)"


@query(
    "zobrist_keys",
    f"""with {_BOARD}, p as (select k, unnest(range(1, 65)) sq, board from boards)
select k, bit_xor(case when substr(board, sq, 1) = '.' then 0 else {_NUMBER.format(p="substr(board, sq, 1)", k="sq")} end) "key" from p group by k""",
)
def zobrist_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of boards: the numbers of pieces on squares, combined by exclusive or."""
    return boards_of(spark, d).select("k", P.zobrist(F.col("board")).alias("key"))


@query(
    "position_repeats",
    f"""with {_REPLAY} select user_id, min(step) first_step, max(step) last_step, count(*) times from r where step > 0 group by user_id, board having count(*) > 1""",
)
def position_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Positions that come back in a move list, found by the keys that replay brings forward."""
    seen = replayed(spark, d).groupBy("user_id", "key").agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count("*").alias("times"))
    return seen.where("times > 1").drop("key")


_WORTH = " + ".join(f"{w} * (length(board) - length(replace(board, '{p}', '')))" for p, w in (("P", 1), ("N", 3), ("B", 3), ("R", 5), ("Q", 9)))
_BALANCE = f"b as (select user_id, step, taken, ({_WORTH}) - ({_WORTH.translate(str.maketrans('PNBRQ', 'pnbrq'))}) balance from r)"


@query(
    "material_deficits",
    f"""with {_REPLAY}, {_BALANCE}, s as (select user_id, step, side, case side when 'white' then balance else -balance end lead from b, (select unnest(['white', 'black']) side) where step > 0),
h as (select *, step - row_number() over (partition by user_id, side order by step) g from s where lead <= -3)
select user_id, side, min(step) first_step, count(*) steps, min(lead) deepest from h group by user_id, side, g having count(*) >= 2""",
)
def material_deficits(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of two steps or more in which a side is behind by three pawns or more."""
    b = F.col("board")
    worth = {"P": 1, "N": 3, "B": 3, "R": 5, "Q": 9}
    own = sum(F.lit(w) * (F.length(b) - F.length(F.replace(b, F.lit(p), F.lit("")))) for p, w in worth.items())
    other = sum(F.lit(w) * (F.length(b) - F.length(F.replace(b, F.lit(p.lower()), F.lit("")))) for p, w in worth.items())
    rows = replayed(spark, d).withColumn("balance", own - other)
    sides = rows.select("user_id", "step", F.inline(F.array(F.struct(F.lit("white").alias("side"), F.col("balance").alias("lead")), F.struct(F.lit("black").alias("side"), (-F.col("balance")).alias("lead")))))
    behind = sides.where("lead <= -3")
    island = F.col("step") - F.row_number().over(Window.partitionBy("user_id", "side").orderBy("step"))
    found = behind.withColumn("g", island).groupBy("user_id", "side", "g").agg(F.min("step").alias("first_step"), F.count("*").alias("steps"), F.min("lead").alias("deepest"))
    return found.where("steps >= 2").drop("g")


@query(
    "exchange_windows",
    f"""with {_REPLAY}, c as (select user_id, step, case when taken = '' then 0 else 1 end hit, case upper(taken) when 'P' then 1 when 'N' then 3 when 'B' then 3 when 'R' then 5 when 'Q' then 9 else 0 end *
  case when taken = upper(taken) then -1 else 1 end gain from r where step > 0),
w as (select user_id, step, sum(hit) over v takes, sum(gain) over v swing, sum(abs(gain)) over v volume from c window v as (partition by user_id order by step range between 3 preceding and current row))
select user_id, step, takes, swing, volume from w where takes >= 2 and abs(swing) * 2 <= volume""",
)
def exchange_windows(spark: SparkSession, d: str) -> DataFrame:
    """Four steps with two pieces taken or more, of which at most half by worth is one side's gain: exchanges."""
    taken = F.col("taken")
    worth = F.when(F.upper(taken) == "P", 1).when(F.upper(taken).isin("N", "B"), 3).when(F.upper(taken) == "R", 5).when(F.upper(taken) == "Q", 9).otherwise(0)
    gain = worth * F.when(taken == F.upper(taken), -1).otherwise(1)
    near = Window.partitionBy("user_id").orderBy("step").rangeBetween(-3, 0)
    rows = replayed(spark, d).withColumns({"hit": F.when(taken == "", 0).otherwise(1), "gain": gain})
    w = rows.select("user_id", "step", F.sum("hit").over(near).alias("takes"), F.sum("gain").over(near).alias("swing"), F.sum(F.abs("gain")).over(near).alias("volume"))
    return w.where((F.col("takes") >= 2) & (F.abs("swing") * 2 <= F.col("volume")))
