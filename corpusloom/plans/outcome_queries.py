"""Queries over outcomes, evaluations and category profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import outcomes as O
from corpusloom.operators import grids as G
from corpusloom.operators import joins as J
from corpusloom.operators import profiles as P

from .bindings import EVALS, FACTS, GRID, JUDGED, POSITIONS, RECORDS, evaluations, facts, judged, positions, records, table
from .catalog import query

RESULTS = ("win", "draw", "loss", "decisive", "unknown")


@query("outcome_games", f"with {JUDGED} select distinct record_id from judged where outcome = 'win' and label = 'F' and pieces <= 20")
def outcome_games(spark: SparkSession, d: str) -> DataFrame:
    won = judged(spark, d).where("outcome = 'win' and label = 'F' and pieces <= 20").select("record_id")
    return records(spark, d).join(won, "record_id", "left_semi").select("record_id")


@query("result_outcomes", f"with {JUDGED} select label, outcome, count(*) n from judged group by all")
def result_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).groupBy("label", "outcome").agg(F.count("*").alias("n"))


_COUNTERS = ", ".join(f"count(*) filter (outcome = '{r}') result_{r}, count(*) filter (evaluated = '{r}') eval_{r}" for r in RESULTS)
_CELLS = ", ".join(f"count(*) filter (evaluated = '{e}' and outcome = '{r}') eval_{e}_result_{r}" for e in RESULTS[:4] for r in RESULTS)


@query("wdl_rows", f"with {JUDGED} select label, count(*) n, {_COUNTERS} from judged group by label")
def wdl_rows(spark: SparkSession, d: str) -> DataFrame:
    p = {k: v for k, v in O.predicates(F.col("outcome"), F.col("evaluated")).items() if k.count("_") == 1}
    return G.wide(judged(spark, d), ["label"], p)


@query("wdl_crosstab", f"with {JUDGED} select label, evaluated, {', '.join(f'count(*) filter (outcome = {chr(39)}{r}{chr(39)}) as {chr(34)}{r}{chr(34)}' for r in RESULTS)}, count(*) row_total from judged group by all")
def wdl_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return P.crosstab(judged(spark, d), ["label"], "evaluated", "outcome", RESULTS)


@query("wide_counters", f"with {JUDGED} select label, side, count(*) n, {_COUNTERS}, {_CELLS} from judged group by label, side")
def wide_counters(spark: SparkSession, d: str) -> DataFrame:
    return G.wide(judged(spark, d), ["label", "side"], O.predicates(F.col("outcome"), F.col("evaluated")))


@query(
    "wide_counters_grid",
    f"with {JUDGED}, grid as (select *, unnest(case when record_id % 3 = 0 then ['all', 'otb'] when record_id % 3 = 1 then ['all', 'online'] else ['all'] end) \"view\" from judged, (select unnest([1, 10, 40]) threshold) where pieces >= threshold) select \"view\", threshold, label, count(*) n, {_COUNTERS}, {_CELLS} from grid group by all",
)
def wide_counters_grid(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("record_id") % 3
    j = judged(spark, d).withColumn("g", F.when(k == 0, "otb").when(k == 1, "online").otherwise("unknown"))
    # counters first, at the finest grain; the small result is spread over the grid and summed
    keys = ["g", "label", "band"]
    band = F.when(F.col("pieces") >= 40, 40).when(F.col("pieces") >= 10, 10).when(F.col("pieces") >= 1, 1).otherwise(0)
    fine = G.wide(j.withColumn("band", band), keys, O.predicates(F.col("outcome"), F.col("evaluated")))
    grid = G.on_grid(fine, "g", "band", [1, 10, 40])
    return grid.groupBy("view", "threshold", "label").agg(*(F.sum(c).alias(c) for c in fine.columns if c not in keys))


@query("merge_labels", f"with {POSITIONS}, c as (select label, side, count(*) n from positions where pieces > 45 or label = 'F' and side = 'white' group by all) select label, case when count(*) = 1 then min(side) else 'multiple material sides' end side, cast(sum(n) as bigint) n from c where not (label = 'F' and side <> 'white') group by label")
def merge_labels(spark: SparkSession, d: str) -> DataFrame:
    c = positions(spark, d).where("pieces > 45 or label = 'F' and side = 'white'").groupBy("label", "side").agg(F.count("*").alias("n"))
    c = c.where("not (label = 'F' and side <> 'white')")
    side = F.when(F.count("*") == 1, F.min("side")).otherwise("multiple material sides")
    return c.groupBy("label").agg(side.alias("side"), F.sum("n").alias("n"))


@query("section_totals", f"with {JUDGED} select coalesce(label, 'total') label, count(*) n, count(*) filter (outcome = 'win') wins from judged group by rollup (label)")
def section_totals(spark: SparkSession, d: str) -> DataFrame:
    j = judged(spark, d).rollup("label").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "win").alias("wins"))
    return j.select(F.coalesce("label", F.lit("total")).alias("label"), "n", "wins")


@query(
    "rating_bands",
    """with r as (select c_mktsegment, cast(floor(case when c_acctbal > 0 and s_acctbal > 0 then (cast(c_acctbal as int) + cast(s_acctbal as int)) / 2 when c_acctbal > 0 then cast(c_acctbal as int) when s_acctbal > 0 then cast(s_acctbal as int) end) as bigint) m
  from (select c_mktsegment, case when floor(c_acctbal) > 0 then floor(c_acctbal) end c_acctbal, case when floor(s_acctbal) > 0 then floor(s_acctbal) end s_acctbal from customer left join supplier on s_suppkey = c_custkey))
select c_mktsegment, case when m is null then 'Unknown' when m < 1600 then '<1600' when m < 1800 then '1600-1799' when m < 2000 then '1800-1999' when m < 2200 then '2000-2199' when m < 2400 then '2200-2399' when m < 2600 then '2400-2599' else '2600+' end band, count(*) n from r group by all""",
)
def rating_bands(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("c_custkey"), "left")
    band = O.rating_band(F.array(F.floor("c_acctbal"), F.floor("s_acctbal")))
    return both.select("c_mktsegment", band.alias("band")).groupBy("c_mktsegment", "band").agg(F.count("*").alias("n"))


@query(
    "outcome_payload",
    f"""with {JUDGED}, g as (select label, side, count(*) n, count(*) filter (outcome = 'win') w, count(*) filter (outcome = 'draw') d, count(*) filter (outcome = 'loss') l, count(*) filter (outcome = 'decisive') x from judged group by all)
select label, side, case when side = 'symmetric' then 'symmetric' else 'sided' end basis, case when side = 'symmetric' then x else w end favourable, d draws, greatest(0, n - case when side = 'symmetric' then x + d else w + d + l end) unknowns from g""",
)
def outcome_payload(spark: SparkSession, d: str) -> DataFrame:
    g = G.wide(judged(spark, d), ["label", "side"], {k: F.col("outcome") == k for k in ("win", "draw", "loss", "decisive")})
    even = F.col("side") == O.SYMMETRIC
    known = F.when(even, F.col("decisive") + F.col("draw")).otherwise(F.col("win") + F.col("draw") + F.col("loss"))
    return g.select(
        "label", "side", F.when(even, "symmetric").otherwise("sided").alias("basis"), F.when(even, F.col("decisive")).otherwise(F.col("win")).alias("favourable"),
        F.col("draw").alias("draws"), F.greatest(F.lit(0), F.col("n") - known).alias("unknowns"),
    )


@query("crosstab_aligned", f"with {JUDGED}, c as (select label, evaluated, outcome, count(*) n from judged where evaluated <> 'unknown' group by all) select label, evaluated, cast(sum(n) as bigint) row_total, round(coalesce(sum(n) filter (evaluated = outcome), 0) / sum(n), 6) aligned from c group by label, evaluated")
def crosstab_aligned(spark: SparkSession, d: str) -> DataFrame:
    j = judged(spark, d).where("evaluated <> 'unknown'").groupBy("label", "evaluated")
    g = j.agg(F.count("*").alias("row_total"), F.count_if(F.col("evaluated") == F.col("outcome")).alias("same"))
    return g.select("label", "evaluated", "row_total", F.round(G.safe_share(F.col("same"), F.col("row_total")), 6).alias("aligned"))


@query("winner_from_sign", f"with {POSITIONS}, {EVALS} select record_id, ply, case when score = 0 then 'draw' when score > 0 then case when ply % 2 = 1 then 'white' else 'black' end else case when ply % 2 = 1 then 'black' else 'white' end end winner from positions join evals using (eval_key)")
def winner_from_sign(spark: SparkSession, d: str) -> DataFrame:
    mover = F.when(F.col("ply") % 2 == 1, O.WHITE).otherwise(O.BLACK)
    joined = positions(spark, d).join(evaluations(spark, d).select("eval_key", "score"), "eval_key")
    return joined.select("record_id", "ply", O.winner_from_sign(F.col("score"), mover).alias("winner"))


@query("winner_from_score", f"with {EVALS} select eval_key, case when abs(score) <= 3 then 'draw' when score > 0 then 'white' else 'black' end inclusive, case when abs(score) < 3 then 'draw' when score > 0 then 'white' else 'black' end exclusive from evals")
def winner_from_score(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    return evaluations(spark, d).select("eval_key", O.winner_from_score(s, 3).alias("inclusive"), O.winner_from_score(s, 3, False).alias("exclusive"))


_CHANCE = "(2 / (1 + exp(-0.00368208 * greatest(-1000, least(1000, {} * 10)))) - 1)"


@query("logistic_score", f"select event_id, round({_CHANCE.format('value')}, 6) chance, {_CHANCE.format('value')} - {_CHANCE.format('(value - event_id % 40)')} >= 0.3 sharp from events")
def logistic_score(spark: SparkSession, d: str) -> DataFrame:
    best = O.winning_chance(F.col("value") * 10)
    second = O.winning_chance((F.col("value") - F.col("event_id") % 40) * 10)
    return table(spark, d, "events").select("event_id", F.round(best, 6).alias("chance"), (best - second >= 0.3).alias("sharp"))


@query("unique_best", "with b as (select l_orderkey, max(l_quantity) m from lineitem group by 1) select l_orderkey, count(*) filter (l_quantity >= m - 5) = 1 \"sharp\" from lineitem join b using (l_orderkey) group by l_orderkey")
def unique_best(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    best = F.array_max("q")
    return rows.select("l_orderkey", (F.size(F.filter("q", lambda x: x >= best - 5)) == 1).alias("sharp"))


@query("side_rule", "with c as (select l_orderkey, count(*) filter (l_returnflag = 'A') w, count(*) filter (l_returnflag = 'R') b from lineitem group by 1) select l_orderkey, case when (w >= 2 and b <= 1) and (b >= 2 and w <= 1) then 'symmetric' when w >= 2 and b <= 1 then 'white' when b >= 2 and w <= 1 then 'black' else 'unknown' end side from c")
def side_rule(spark: SparkSession, d: str) -> DataFrame:
    c = G.wide(table(spark, d, "lineitem"), ["l_orderkey"], {"w": F.col("l_returnflag") == "A", "b": F.col("l_returnflag") == "R"})
    w, b = F.col("w"), F.col("b")
    return c.select("l_orderkey", O.side_rule((w >= 2) & (b <= 1), (b >= 2) & (w <= 1)).alias("side"))


@query("counting_views", f"with {POSITIONS} select label, count(distinct record_id) first_count, count(*) all_count from positions group by label")
def counting_views(spark: SparkSession, d: str) -> DataFrame:
    return positions(spark, d).groupBy("label").agg(F.count_distinct("record_id").alias("first_count"), F.count("*").alias("all_count"))


@query("reference_delta", "select n_name, n, n_nationkey * 10 published, n - n_nationkey * 10 delta from (select c_nationkey, count(*) n from customer group by 1) join nation on n_nationkey = c_nationkey")
def reference_delta(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    published = F.col("n_nationkey") * 10
    return table(spark, d, "nation").join(n, "n_nationkey").select("n_name", "n", published.alias("published"), (F.col("n") - published).alias("delta"))


@query("reconcile_totals", f"with {RECORDS}, f as (select site, count(*) n from records group by site), v as (select site, count(*) m from records where price < 499000 group by site) select site, n expected, m actual, 'different' state from f join v using (site) where n <> m")
def reconcile_totals(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return J.reconcile(r.groupBy("site").agg(F.count("*").alias("n")), r.where("price < 499000").groupBy("site").agg(F.count("*").alias("n")), ["site"], "n")


_OPEN = "o as (select p_brand eco, p_type stem, p_partkey from part), s as (select *, sum(n) over (partition by eco) total from (select eco, stem, count(*) n from o group by eco, stem))"


def _shares(spark: SparkSession, d: str) -> DataFrame:
    return P.shares(table(spark, d, "part").select(F.col("p_brand").alias("eco"), F.col("p_type").alias("stem")), "eco", "stem")


@query("opening_share", f"with {_OPEN} select eco, stem, n, cast(total as bigint) total, round(100 * n / total, 6) pct from s")
def opening_share(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d).withColumn("pct", F.round("pct", 6))


@query("opening_profile", f"with {_OPEN} select eco, stem, round(100 * n / total, 6) pct from s where total >= 85")
def opening_profile(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d).where("total >= 85").select("eco", "stem", F.round("pct", 6).alias("pct"))


_RMS = _OPEN + """, g as (select e.eco, t.stem, coalesce(100 * n / total, 0) pct from (select distinct eco from s) e cross join (select distinct stem from s) t left join s on s.eco = e.eco and s.stem = t.stem),
  m as (select stem, avg(pct) mean from g group by stem), r as (select eco, sqrt(avg((pct - mean) * (pct - mean))) rms from g join m using (stem) group by eco)"""


@query("opening_rms", f"with {_RMS} select eco, round(rms, 6) rms from r order by rms desc limit 14")
def opening_rms(spark: SparkSession, d: str) -> DataFrame:
    return P.rms_distance(_shares(spark, d), "eco", "stem").orderBy(F.desc("rms"), "eco").limit(14).withColumn("rms", F.round("rms", 6))


@query("p99_scale", f"with {_OPEN} select count(*) n, (list_sort(list(n)))[greatest(1, count(*) * 99 // 100)] p99 from s")
def p99_scale(spark: SparkSession, d: str) -> DataFrame:
    return P.p99(_shares(spark, d), "n")


@query(
    "opening_ending",
    f"with {JUDGED}, grid as (select *, unnest(case when record_id % 3 = 0 then ['all', 'otb'] when record_id % 3 = 1 then ['all', 'online'] else ['all'] end) \"view\" from judged, (select unnest([1, 10, 40]) threshold) where pieces >= threshold) select \"view\", threshold, site, label, outcome, count(*) n, count(distinct record_id) games from grid group by all",
)
def opening_ending(spark: SparkSession, d: str) -> DataFrame:
    """Endings of each opening by view, threshold and result: positions and games.

    A game is one row a cell, with its positions at each threshold side by side; the grid is spread over sums only.
    Partitions by game hold two million positions or so however many there are, which bounds what a task holds.
    """
    least = [1, 10, 40]
    p = positions(spark, d)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), table(spark, d, "lineitem").count() // 2_000_000 + 1)
    repeated = evaluations(spark, d).groupBy("eval_key").agg(F.count("*").alias("m")).where("m > 1")
    if repeated.isEmpty():  # an evaluation a key: the left join keeps each position once
        p = p.withColumn("m", F.lit(1))
    else:
        p = p.join(repeated, "eval_key", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    p = p.where(F.col("pieces") >= least[0]).select("record_id", "label", "side", "pieces", "m").repartition(parts, "record_id")
    r = records(spark, d).select("record_id", "result", "site").repartition(parts, "record_id")
    outcome = O.result_outcome(F.col("result"), F.col("side"))
    games = p.join(r, "record_id").groupBy("record_id", "site", "label", outcome.alias("outcome")).agg(*(F.sum(F.when(F.col("pieces") >= t, F.col("m")).otherwise(0)).alias(f"n{t}") for t in least))
    k = F.col("record_id") % 3
    group = F.when(k == 0, "otb").when(k == 1, "online").otherwise("unknown")
    cells = games.groupBy(group.alias("g"), "site", "label", "outcome").agg(*(x for t in least for x in (F.sum(f"n{t}").alias(f"n{t}"), F.count_if(F.col(f"n{t}") > 0).alias(f"games{t}"))))
    spread = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"n{t}").alias("n"), F.col(f"games{t}").alias("games")) for t in least)))
    grid = cells.select(F.explode(G.views_of(F.col("g"))).alias("view"), "site", "label", "outcome", spread.alias("x")).where("x.n > 0")
    return grid.groupBy("view", "x.threshold", "site", "label", "outcome").agg(F.sum("x.n").alias("n"), F.sum("x.games").alias("games"))


@query(
    "ending_counters",
    f"""with {JUDGED}, s as (select *, case when winner is not null then 'ok' when eval_key % 2 = 0 then 'skipped_non_tablebase' else 'tablebase_error' end status, case when pieces <= 5 then 'tablebase' else 'stockfish' end source from judged)
select label, side, count(*) total_positions, count(*) filter (status = 'ok') evaluated_positions, count(*) filter (pieces <= 5) tablebase_eligible_positions,
  count(*) filter (status = 'ok' and source = 'tablebase') tablebase_positions, count(*) filter (status = 'ok' and source = 'stockfish') stockfish_positions,
  count(*) filter (status = 'skipped_non_tablebase') skipped_non_tablebase_positions, count(*) filter (status = 'tablebase_error') tablebase_error_positions,
  count(*) filter (winner = 'white') white_wins, count(*) filter (winner = 'draw') draws, count(*) filter (winner = 'black') black_wins,
  count(*) filter (evaluated = 'win') side_wins, count(*) filter (evaluated = 'draw') side_draws, count(*) filter (evaluated = 'loss') side_losses,
  count(*) filter (evaluated = 'decisive') symmetric_decisive, count(*) filter (evaluated = 'unknown') unknown_positions,
  count(*) filter (result = '1-0') actual_white_wins, count(*) filter (result = '1/2-1/2') actual_draws, count(*) filter (result = '0-1') actual_black_wins,
  count(*) filter (outcome = 'win') actual_side_wins, count(*) filter (outcome = 'draw') actual_side_draws, count(*) filter (outcome = 'loss') actual_side_losses,
  count(*) filter (outcome = 'decisive') actual_symmetric_decisive, count(*) filter (outcome = 'unknown') actual_unknown_results,
  count(*) filter (evaluated = 'win' and outcome = 'win') tb_win_result_win, count(*) filter (evaluated = 'win' and outcome = 'draw') tb_win_result_draw,
  count(*) filter (evaluated = 'win' and outcome = 'loss') tb_win_result_loss, count(*) filter (evaluated = 'win' and outcome = 'unknown') tb_win_result_unknown,
  count(*) filter (evaluated = 'draw' and outcome = 'win') tb_draw_result_win, count(*) filter (evaluated = 'draw' and outcome = 'draw') tb_draw_result_draw,
  count(*) filter (evaluated = 'draw' and outcome = 'loss') tb_draw_result_loss, count(*) filter (evaluated = 'draw' and outcome = 'decisive') tb_draw_result_decisive,
  count(*) filter (evaluated = 'draw' and outcome = 'unknown') tb_draw_result_unknown, count(*) filter (evaluated = 'loss' and outcome = 'win') tb_loss_result_win,
  count(*) filter (evaluated = 'loss' and outcome = 'draw') tb_loss_result_draw, count(*) filter (evaluated = 'loss' and outcome = 'loss') tb_loss_result_loss,
  count(*) filter (evaluated = 'loss' and outcome = 'unknown') tb_loss_result_unknown, count(*) filter (evaluated = 'decisive' and outcome = 'decisive') tb_decisive_result_decisive,
  count(*) filter (evaluated = 'decisive' and outcome = 'draw') tb_decisive_result_draw, count(*) filter (evaluated = 'decisive' and outcome = 'unknown') tb_decisive_result_unknown
from s group by label, side""",
)
def ending_counters(spark: SparkSession, d: str) -> DataFrame:
    """All 39 counters of each ending and its material side, in one aggregation."""
    winner, key = F.col("winner"), F.col("eval_key")
    status = F.when(winner.isNotNull(), "ok").when(key % 2 == 0, "skipped_non_tablebase").otherwise("tablebase_error")
    source = F.when(F.col("pieces") <= 5, "tablebase").otherwise("stockfish")
    counters = O.ending_counters(status, source, winner, F.col("result"), F.col("pieces"), F.col("evaluated"), F.col("outcome"))
    return judged(spark, d).groupBy("label", "side").agg(*(F.count_if(c).alias(n) for n, c in counters.items()))


@query(
    "opening_differences",
    f"with {_RMS}, w as (select g.*, mean, row_number() over (partition by eco order by round(abs(pct - mean), 9) desc, stem) place from g join m using (stem)) select eco, stem, round(pct, 6) \"value\", round(mean, 6) mean, round(pct - mean, 6) diff, place from w where place <= 14",
)
def opening_differences(spark: SparkSession, d: str) -> DataFrame:
    """The fourteen endings of each opening that are furthest from the mean of openings."""
    found = P.differences(_shares(spark, d), "eco", "stem", 14)
    return found.select("eco", "stem", *(F.round(c, 6).alias(c) for c in ("value", "mean", "diff")), "place")


@query("opening_views", f"with {GRID}, b as (select user_id, user_id % 5 eco from (select distinct user_id from events)) select \"view\", threshold, eco, count(*) matched_rows, count(distinct user_id) matched_entities from grid join b using (user_id) group by all")
def opening_views(spark: SparkSession, d: str) -> DataFrame:
    grid = G.on_grid(facts(spark, d), "source_group", "run_length", [1, 2, 3]).withColumn("eco", F.col("user_id") % 5)
    return grid.groupBy("view", "threshold", "eco").agg(F.count("*").alias("matched_rows"), F.count_distinct("user_id").alias("matched_entities"))


@query("fact_table", f"with {FACTS} select user_id, label, run_start, run_length, source_group, md5(user_id::varchar || chr(31) || label) fact_key from facts")
def fact_table(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.functions.text import entity_key

    key = entity_key([F.col("user_id").cast("string"), F.col("label")])
    return facts(spark, d).select("user_id", "label", "run_start", "run_length", "source_group", key.alias("fact_key"))
