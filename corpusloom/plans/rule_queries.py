"""Queries over rules, exports and moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import boards as B
from corpusloom.functions import outcomes as O
from corpusloom.operators import exports as X
from corpusloom.operators import material as U
from corpusloom.operators import ordering as S

from .bindings import EVALS, POSITIONS, RECORDS, evaluations, positions, records, table
from .catalog import query
from .text_queries import _BOARD, _PIECES, _n, _side_sql, bits_of, boards_of

def _material_sql(own: str, other: str) -> str:
    counts = ", ".join(f"{_n(p)} {p.lower()}{k}" for k, pieces in ((1, own), (2, other)) for p in pieces)
    return f"select k, board, {counts}, {_n('A-Za-z')} t from boards"


#: Boards from either side: pieces of the own (1) and the other side (2), all pieces, and what each ending asks of them.
_ENDINGS = f"""{_BOARD}, m as (select 'white' side, *, 'P' pawn from ({_material_sql("QRBNP", "qrbnp")}) union all select 'black', *, 'p' from ({_material_sql("qrbnp", "QRBNP")})),
light as (select k, len(list_filter(range(1, 65), lambda i: lower(substr(board, i, 1)) = 'b' and ((i - 1) % 8 + (i - 1) // 8) % 2 = 0)) light from boards),
linked as (select k, side, len(list_filter(files, lambda x: list_contains(files, x - 1) or list_contains(files, x + 1))) linked
  from (select k, side, list_transform(list_filter(range(1, 65), lambda i: substr(board, i, 1) = pawn), lambda i: (i - 1) % 8) files from m)),
e as (select k, side, q1, r1, b1, n1, p1, q2, r2, b2, n2, p2, unnest([
  case when n1 = 1 and b1 = 1 and t = 4 then '01 1-4BN' end, case when n1 = 2 and p2 = 1 and t = 5 then '02 1-5NNp' end, case when p1 = 1 and t = 3 then '03 2-1P' end,
  case when p1 + p2 >= 1 and q1 + q2 + r1 + r2 + b1 + b2 + n1 + n2 = 0 then '04 2-0Pp' end, case when n1 = 1 and p2 >= 1 and q1 + q2 + r1 + r2 + b1 + b2 + n2 = 0 then '05 3-1Np' end,
  case when n1 = 1 and n2 = 1 and q1 + q2 + r1 + r2 + b1 + b2 = 0 then '06 3-2NN' end, case when b1 = 1 and p2 >= 1 and q1 + q2 + r1 + r2 + b2 + n1 + n2 = 0 then '07 4-1Bp' end,
  case when b1 = 1 and b2 = 1 and light in (0, 2) and q1 + q2 + r1 + r2 + n1 + n2 = 0 then '08 4-2scBB' end, case when b1 = 1 and b2 = 1 and light = 1 and q1 + q2 + r1 + r2 + n1 + n2 = 0 then '09 4-3ocBB' end,
  case when b1 = 1 and n2 = 1 and b2 + n1 + q1 + q2 + r1 + r2 = 0 then '10 5-0BN' end, case when r1 = 1 and p2 >= 1 and q1 + q2 + r2 + b1 + b2 + n1 + n2 + p1 = 0 then '11 6-1-0RP' end,
  case when r1 = 1 and p1 = 1 and r2 = 1 and t = 5 then '12 6-2-1RPr' end, case when r1 = 1 and p1 = 2 and r2 = 1 and t = 6 then '13 6-2-2RPPr' end,
  case when r1 = 1 and r2 = 1 and q1 + q2 + b1 + b2 + n1 + n2 = 0 and t >= 6 then '14 6-2-0Rr' end, case when r1 = 2 and r2 = 2 and q1 + q2 + b1 + b2 + n1 + n2 = 0 and t >= 6 then '15 6-3RRrr' end,
  case when r1 = 1 and n2 = 1 and q1 + q2 + r2 + n1 + b1 + b2 = 0 then '16 7-1RN' end, case when r1 = 1 and b2 = 1 and q1 + q2 + r2 + b1 + n1 + n2 = 0 then '17 7-2RB' end,
  case when r1 = 1 and n1 = 1 and r2 = 1 and n2 = 0 and q1 + q2 + b1 + b2 = 0 then '18 8-1RNr' end, case when r1 = 1 and b1 = 1 and r2 = 1 and q1 + q2 + b2 + n1 + n2 = 0 then '19 8-2RBr' end,
  case when r1 = 1 and b1 + n1 = 1 and r2 = 1 and b2 + n2 = 1 and q1 + q2 = 0 then '20 8-3RAra' end, case when q1 = 1 and p2 >= 1 and q2 + r1 + r2 + b1 + b2 + n1 + n2 + p1 = 0 then '21 9-1Qp' end,
  case when q1 = 1 and p1 = 1 and q2 = 1 and r1 + r2 + b1 + b2 + n1 + n2 + p2 = 0 then '22 9-3QPq' end, case when q1 = 1 and q2 = 1 and b1 + b2 + n1 + n2 + r1 + r2 = 0 then '23 9-2Qq' end,
  case when q1 = 1 and b2 + n2 = 1 and q2 + r1 + r2 + n1 + b1 = 0 then '24 10-1Qa' end, case when q1 = 1 and r2 = 1 and q2 + r1 + b1 + b2 + n1 + n2 = 0 then '25 10-2Qr' end,
  case when q1 = 1 and b2 + n2 = 2 and q2 + b1 + n1 + r1 + r2 = 0 then '26 10-3Qaa' end, case when q1 = 1 and r2 = 1 and b2 + n2 = 1 and q2 + r1 + b1 + n1 = 0 then '27 10-4Qra' end,
  case when q1 = 1 and r2 = 2 and q2 + r1 + b1 + b2 + n1 + n2 = 0 then '28 10-5Qrr' end, case when q1 = 1 and b2 + n2 = 3 and q2 + b1 + n1 + r1 + r2 = 0 then '29 10-6Qaaa' end,
  case when q1 = 1 and b1 = 1 and r2 = 2 and q2 + r1 + b2 + n1 + n2 = 0 then '30 10-7-1Qbrr' end, case when q1 = 1 and b1 + n1 = 1 and q2 = 1 and r1 + r2 + b2 + n2 = 0 then '31 10-7QAq' end,
  case when r1 = 1 and p1 = 2 and r2 = 1 and t = 6 and linked = 2 then '41 6-2-2RPPrConnected' end, case when r1 = 1 and n1 = 1 and r2 = 1 and n2 = 0 and q1 + q2 + b1 + b2 + p1 + p2 = 0 then '42 8-1RNrNoPawns' end,
  case when r1 = 1 and b1 = 1 and r2 = 1 and q1 + q2 + b2 + n1 + n2 + p1 + p2 = 0 then '43 8-2RBrNoPawns' end, case when q1 = 1 and r2 = 1 and q2 + r1 + b1 + b2 + n1 + n2 + p1 + p2 = 0 then '44 10-2QrNoPawns' end,
  case when q1 = 1 and b1 = 1 and r2 = 2 and q2 + r1 + b2 + n1 + n2 + p1 + p2 = 0 then '45 10-7-1QbrrNoPawns' end]) as stem
  from m join light using (k) join linked using (k, side))"""
_FAVOURED = """case stem when '01 1-4BN' then b1 >= 1 and n1 >= 1 and q2 + r2 + b2 + n2 + p2 = 0 when '02 1-5NNp' then n1 >= 2 and p2 >= 1 when '03 2-1P' then p1 >= 1 and q2 + r2 + b2 + n2 + p2 = 0
  when '05 3-1Np' then n1 >= 1 and p2 >= 1 when '07 4-1Bp' then b1 >= 1 and p2 >= 1 when '10 5-0BN' then b1 >= 1 and n2 >= 1 when '11 6-1-0RP' then r1 >= 1 and p2 >= 1
  when '12 6-2-1RPr' then r1 >= 1 and p1 >= 1 and r2 >= 1 when '13 6-2-2RPPr' then r1 >= 1 and p1 >= 2 and r2 >= 1 when '16 7-1RN' then r1 >= 1 and n2 >= 1 when '17 7-2RB' then r1 >= 1 and b2 >= 1
  when '18 8-1RNr' then r1 >= 1 and n1 >= 1 and r2 >= 1 when '19 8-2RBr' then r1 >= 1 and b1 >= 1 and r2 >= 1 when '21 9-1Qp' then q1 >= 1 and p2 >= 1 when '22 9-3QPq' then q1 >= 1 and p1 >= 1 and q2 >= 1
  when '24 10-1Qa' then q1 >= 1 and b2 + n2 >= 1 when '25 10-2Qr' then q1 >= 1 and r2 >= 1 when '26 10-3Qaa' then q1 >= 1 and b2 + n2 >= 2 when '27 10-4Qra' then q1 >= 1 and r2 >= 1 and b2 + n2 >= 1
  when '28 10-5Qrr' then q1 >= 1 and r2 >= 2 when '29 10-6Qaaa' then q1 >= 1 and b2 + n2 >= 3 when '30 10-7-1Qbrr' then q1 >= 1 and b1 >= 1 and r2 >= 2 when '31 10-7QAq' then q1 >= 1 and b1 + n1 >= 1 and q2 >= 1 end"""


@query(
    "rule_first_match",
    f"""with {_ENDINGS}, f as (select k, min(stem) first_ from e where stem < '40' group by k),
s as (select k, stem, bool_or(favours and side = 'white') w, bool_or(favours and side = 'black') b, bool_or(favours is null) even
  from (select k, side, f.first_ as stem, {_FAVOURED} favours from f join (select distinct on (k, side) * exclude (stem) from e) using (k)) group by k, stem)
select k, substr(stem, 4) as stem, case when stem is null then null when even or (w and b) then 'symmetric' when w then 'white' when b then 'black' else 'unknown' end side from (select distinct k from boards) left join s using (k)""",
)
def rule_first_match(spark: SparkSession, d: str) -> DataFrame:
    """The first of 31 endings that a board's material meets, and the side that it favours."""
    return U.judged(bits_of(spark, d), of=U.material_of_bits()).select("k", "stem", "side")


_PARENTS = """case stem when '2-1P' then ['2-0Pp'] when '6-2-2RPPr' then ['6-2-0Rr'] when '6-2-2RPPrConnected' then ['6-2-2RPPr', '6-2-0Rr'] when '8-1RNrNoPawns' then ['8-1RNr'] when '8-2RBrNoPawns' then ['8-2RBr']
  when '9-3QPq' then ['9-2Qq'] when '10-2QrNoPawns' then ['10-2Qr'] when '10-7-1QbrrNoPawns' then ['10-7-1Qbrr'] else [] end"""


@query("rule_labels", f"with {_ENDINGS}, l as (select distinct k, unnest(list_append({_PARENTS}, stem)) as label from (select k, substr(stem, 4) as stem from e where stem is not null)) select label, count(*) n from l group by label")
def rule_labels(spark: SparkSession, d: str) -> DataFrame:
    """How many boards have each label: all endings and parts of endings that hold, with their parents."""
    return U.label_counts(bits_of(spark, d), of=U.material_of_bits())


@query("export_rows", f"with {POSITIONS}, {EVALS} select record_id, ply, winner, case when winner is null then 'missing' else 'ok' end status from positions left join evals using (eval_key) where pieces <= 30 union all select record_id, ply, null, 'reject' from positions where pieces > 30")
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    p = positions(spark, d).select("record_id", "ply", "eval_key", "pieces")
    e = evaluations(spark, d).select("eval_key", "winner")
    return X.export_rows(p.where("pieces <= 30"), e, "eval_key", p.where("pieces > 30")).select("record_id", "ply", "winner", "status")


@query("opening_label", f"with {RECORDS}, b as (select p_size k, arg_min(p_type, p_partkey) entry from part group by 1) select record_id, case when tag <> '5-LOW' then tag when player_id % 10 = 0 then null else entry end opening from records left join b on k = record_id % 50")
def opening_label(spark: SparkSession, d: str) -> DataFrame:
    book = table(spark, d, "part").groupBy(F.col("p_size").alias("k")).agg(F.min_by("p_type", "p_partkey").alias("entry"))
    r = records(spark, d).withColumn("k", F.col("record_id") % 50).join(book, "k", "left")
    own = F.when(F.col("tag") != "5-LOW", F.col("tag"))
    return r.select("record_id", X.opening_label(own, F.col("player_id") % 10 == 0, F.col("entry")).alias("opening"))


@query(
    "training_rows",
    f"""with {_BOARD} select k, {_side_sql('QRBNP')} || 'v' || {_side_sql('qrbnp')} material, case when abs(b) <= 2 then 'draw' when b > 0 then 'white' else 'black' end expected, abs(b) >= 6 "sharp"
from (select *, {_n('P')} + 3 * {_n('N')} + 3 * {_n('B')} + 5 * {_n('R')} + 9 * {_n('Q')} - ({_n('p')} + 3 * {_n('n')} + 3 * {_n('b')} + 5 * {_n('r')} + 9 * {_n('q')}) b from boards)""",
)
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("board")
    rows = boards_of(spark, d).withColumn("b", B.power(b, True) - B.power(b, False))
    return rows.select("k", B.signature(b).alias("material"), O.winner_from_score(F.col("b"), 2).alias("expected"), (F.abs("b") >= 6).alias("sharp"))


@query(
    "training_quota",
    f"""with {_BOARD}, r as (select k, case when abs(b) <= 2 then 'draw' when b > 0 then 'white' else 'black' end expected from
  (select *, {_n('P')} + 3 * {_n('N')} + 3 * {_n('B')} + 5 * {_n('R')} + 9 * {_n('Q')} - ({_n('p')} + 3 * {_n('n')} + 3 * {_n('b')} + 5 * {_n('r')} + 9 * {_n('q')}) b from boards))
select k, expected from (select *, row_number() over (partition by expected order by md5('train|' || k)) place from r) where place <= case expected when 'draw' then 50 else 400 end""",
)
def training_quota(spark: SparkSession, d: str) -> DataFrame:
    """Training rows up to a quota for each expected result, in hash order."""
    rows = training_rows(spark, d).select("k", "expected")
    return S.quota_sample(rows, "expected", {"white": 400, "black": 400, "draw": 50}, S.hash_order([F.col("k")], "train")).select("k", "expected")


@query("board_xrays", f"""with {_PIECES}, line as (select a.k, a.p piece, a.sq a, b.sq b, b.p target, m.p thr, count(*) over (partition by a.k, a.sq, b.sq) n, a.f = b.f or a.r = b.r orth from pieces a join pieces b on a.k = b.k and a.sq <> b.sq
  and (upper(a.p) in ('R', 'Q') and (a.f = b.f or a.r = b.r) or upper(a.p) in ('B', 'Q') and abs(a.f - b.f) = abs(a.r - b.r))
  join pieces m on m.k = a.k and m.sq not in (a.sq, b.sq) and (m.f - a.f) * (b.r - a.r) = (m.r - a.r) * (b.f - a.f) and m.f between least(a.f, b.f) and greatest(a.f, b.f) and m.r between least(a.r, b.r) and greatest(a.r, b.r))
select k, piece, a "from", thr through, target, b "to" from line where n = 1 and (thr = upper(thr)) = (piece = upper(piece)) and case when orth then upper(thr) in ('R', 'Q') else upper(thr) in ('B', 'Q') end""")
def board_xrays(spark: SparkSession, d: str) -> DataFrame:
    return B.xrays(boards_of(spark, d), "k")


@query("piece_tracks")
def piece_tracks(spark: SparkSession, d: str) -> DataFrame:
    """How often each piece, named by the square it began on, is moved in each user's list."""
    from corpusloom.operators.replay import START, origins

    from .replay_queries import moves

    def place(at: int) -> Column:
        return (8 - F.substring("m", at + 1, 1).cast("int")) * 8 + F.instr(F.lit("abcdefgh"), F.substring("m", at, 1))

    found = origins(moves(spark, d), ["user_id"], "step", place(1), place(3)).withColumnRenamed("origin", "piece")
    found = found.where((F.col("piece") > 0) & (F.substring(F.lit(START), F.col("piece"), F.lit(1)) != "."))
    return found.groupBy("user_id", "piece").agg(F.count("*").alias("moves"))
