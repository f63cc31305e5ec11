"""Bindings of the sequence-record model to the tables, in Spark and as SQL common tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import runs as R

ENTITY = ["user_id"]
THRESHOLDS = [1, 2, 3]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_group(entity: Column) -> Column:
    return F.when(entity % 3 == 0, "otb").when(entity % 3 == 1, "online").otherwise("unknown")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as steps: entity user_id, label event_type."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("label"), "value", "ts", "event_id", "props")
    return R.numbered(e, ENTITY, ["ts", "event_id"])


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with six-hour buckets as steps, so that several labels share one."""
    e = table(spark, sf_dir, "events")
    bucket = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) * 4 + F.floor(F.hour("ts") / 6)  # no time zone enters
    return e.select("user_id", bucket.cast("long").alias("step"), F.col("event_type").alias("label"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First runs with their source group: the fact table of labels."""
    found = R.runs(steps(spark, sf_dir), ENTITY, "step", "label")
    return R.first_run(found, ENTITY, "label").withColumn("source_group", source_group(F.col("user_id")))


def view_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of each view."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    group = source_group(F.col("user_id"))
    views = F.when(group.isin("otb", "online"), F.array(F.lit("all"), group)).otherwise(F.array(F.lit("all")))
    return users.select(F.explode(views).alias("view")).groupBy("view").agg(F.count("*").alias("total"))


GROUP_SQL = "case when user_id % 3 = 0 then 'otb' when user_id % 3 = 1 then 'online' else 'unknown' end"
STEPS = "steps as (select user_id, event_type label, value, ts, event_id, props, row_number() over (partition by user_id order by ts, event_id) step from events)"
RUNS = STEPS + """, runs as (select user_id, label, min(step) run_start, max(step) run_end, count(*) run_length from
  (select user_id, label, step, step - row_number() over (partition by user_id, label order by step) g from steps) group by user_id, label, g)"""
FACTS = RUNS + f""", facts as (select user_id, label, min(run_start) run_start, arg_min(run_end, run_start) run_end,
  arg_min(run_length, run_start) run_length, {GROUP_SQL} source_group from runs group by user_id, label)"""
VIEWS = "(select *, unnest(case when source_group in ('otb', 'online') then ['all', source_group] else ['all'] end) as \"view\" from {})"
GRID = FACTS + f""", grid as (select * from {VIEWS.format("facts")} v, (select unnest([1, 2, 3]) threshold) t where run_length >= threshold)"""
TOTALS = f""", totals as (select "view", count(*) total from {VIEWS.format(f"(select distinct user_id, {GROUP_SQL} source_group from events)")} v group by "view")"""
STAGED = "staged as (select user_id, cast(floor(epoch(date_trunc('second', ts)) / 21600) as bigint) step, event_type label from events)"
STAGES = STAGED + """, firsts as (select user_id, label, min(step) step from staged group by user_id, label),
  stages as (select user_id, step, list_sort(list(label)) labels from firsts group by user_id, step)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their customers as records with headers; small dimensions are left to the optimizer's size rule."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    result = F.when(F.col("o_orderstatus") == "F", "1-0").when(F.col("o_orderstatus") == "O", "0-1").otherwise("1/2-1/2")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("record_id"),
        F.date_format("o_orderdate", "yyyy.MM.dd").alias("date"),
        result.alias("result"),
        F.col("o_orderpriority").alias("tag"),
        F.col("c_name").alias("player"),
        F.col("n_name").alias("site"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_totalprice").alias("price"),
        F.col("c_custkey").alias("player_id"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as positions: side from the return flag, label from the line status, pieces from the quantity."""
    side = F.when(F.col("l_returnflag") == "A", "white").when(F.col("l_returnflag") == "N", "symmetric").otherwise("black")
    p = table(spark, sf_dir, "lineitem")
    return p.select(
        F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("ply"), F.col("l_linestatus").alias("label"),
        side.alias("side"), F.col("l_quantity").cast("int").alias("pieces"), F.col("l_partkey").alias("eval_key"),
    )


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as evaluations: the sign of p_size - 25 is the sign of the score; large parts are missing."""
    size = F.col("p_size") - 25
    winner = F.when(size == 0, "draw").when(size > 0, "white").otherwise("black")
    p = table(spark, sf_dir, "part").where("p_size < 48")
    return p.select(F.col("p_partkey").alias("eval_key"), size.alias("score"), winner.alias("winner"))


RECORDS = """records as (select o_orderkey record_id, strftime(o_orderdate, '%Y.%m.%d') date,
  case o_orderstatus when 'F' then '1-0' when 'O' then '0-1' else '1/2-1/2' end result, o_orderpriority tag, c_name player, n_name site,
  c_mktsegment segment, o_totalprice price, c_custkey player_id
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""
POSITIONS = """positions as (select l_orderkey record_id, l_linenumber ply, l_linestatus label,
  case l_returnflag when 'A' then 'white' when 'N' then 'symmetric' else 'black' end side, cast(l_quantity as int) pieces, l_partkey eval_key from lineitem)"""
EVALS = """evals as (select p_partkey eval_key, p_size - 25 score,
  case when p_size = 25 then 'draw' when p_size > 25 then 'white' else 'black' end winner from part where p_size < 48)"""
OUTCOME = """case when result = '1/2-1/2' then 'draw' when result is null or result not in ('1-0', '0-1') then 'unknown'
  when side = 'white' then case when result = '1-0' then 'win' else 'loss' end
  when side = 'black' then case when result = '0-1' then 'win' else 'loss' end when side = 'symmetric' then 'decisive' else 'unknown' end"""
EVALUATED = """case when winner = 'draw' then 'draw' when winner is null then 'unknown'
  when side in ('white', 'black') then case when winner = side then 'win' else 'loss' end when side = 'symmetric' then 'decisive' else 'unknown' end"""
JUDGED = f"""{RECORDS}, {POSITIONS}, {EVALS}, judged as (select p.*, r.result, r.site, r.date, e.winner, e.score, {OUTCOME} outcome, {EVALUATED} evaluated
  from positions p join records r using (record_id) left join evals e using (eval_key))"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with their record's result and their evaluation, as outcomes of the favoured side."""
    from corpusloom.functions import outcomes as O

    r = records(spark, sf_dir).select("record_id", "result", "site", "date")
    joined = positions(spark, sf_dir).join(r, "record_id").join(evaluations(spark, sf_dir), "eval_key", "left")
    return joined.withColumns({"outcome": O.result_outcome(F.col("result"), F.col("side")), "evaluated": O.winner_outcome(F.col("winner"), F.col("side"))})
