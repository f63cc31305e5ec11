"""Queries over sequences: runs, grids, transitions, stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import grids as G
from corpusloom.operators import runs as R

from .bindings import ENTITY, FACTS, GRID, RUNS, STAGED, STAGES, STEPS, THRESHOLDS, TOTALS, facts, staged, steps, table, view_totals
from .catalog import query


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return R.runs(steps(spark, d), ENTITY, "step", "label")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return G.on_grid(facts(spark, d), "source_group", "run_length", THRESHOLDS)


@query("marker_runs", f"with {RUNS} select user_id, label, run_start, run_end, run_length from runs")
def marker_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d)


@query("first_run", f"with {FACTS} select user_id, label, run_start, run_end, run_length, run_length position_count from facts")
def first_run(spark: SparkSession, d: str) -> DataFrame:
    return R.first_run(_runs(spark, d), ENTITY, "label")


@query("longest_run", f"with {RUNS} select user_id, label, max(run_length) max_run_length from runs group by user_id, label")
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    return R.longest_run(_runs(spark, d), ENTITY, "label")


@query("run_histogram", f"with {RUNS} select label, run_length, count(*) n from runs group by label, run_length")
def run_histogram(spark: SparkSession, d: str) -> DataFrame:
    return R.run_histogram(_runs(spark, d), "label")


@query(
    "game_max_histogram",
    f"with {RUNS} select label, max_run_length, count(*) n from (select user_id, label, max(run_length) max_run_length from runs group by user_id, label) group by label, max_run_length",
)
def game_max_histogram(spark: SparkSession, d: str) -> DataFrame:
    return R.entity_max_histogram(_runs(spark, d), ENTITY, "label")


@query("threshold_views", f'with {GRID} select "view", threshold, count(*) matched_rows, count(distinct user_id) matched_entities from grid group by all')
def threshold_views(spark: SparkSession, d: str) -> DataFrame:
    return G.matched(_grid(spark, d), ENTITY)


@query(
    "incidence_share",
    f"""with {GRID}{TOTALS}, n as (select "view", threshold, label, count(*) quantity from grid group by all)
select "view", threshold, label, quantity, round(100 * (quantity / total), 6) percentage,
  round(quantity / sum(quantity) over (partition by "view", threshold), 6) matched_share from n join totals using ("view")""",
)
def incidence_share(spark: SparkSession, d: str) -> DataFrame:
    return G.incidence(_grid(spark, d), "label", view_totals(spark, d))


@query("source_incidence", f"with {GRID} select source_group, threshold, label, count(*) incidences, count(distinct user_id) entities from grid where \"view\" = 'all' group by all")
def source_incidence(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where("view = 'all'").groupBy("source_group", "threshold", "label").agg(F.count("*").alias("incidences"), F.count_distinct("user_id").alias("entities"))


@query("first_marker", f"with {STEPS} select user_id, label, min(step) first_step, count(*) markers from steps group by user_id, label")
def first_marker(spark: SparkSession, d: str) -> DataFrame:
    return R.first_marker(steps(spark, d), ENTITY, "step", "label")


@query("first_n_per_game", f"with {STEPS} select user_id, event_id, label, step from steps where step <= 3")
def first_n_per_game(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_type", "label")
    return R.first_n(e, ENTITY, ["ts", "event_id"], 3).select("user_id", "event_id", "label", F.col("place").alias("step"))


_RANK_SQL = "case label when 'purchase' then 1 when 'signup' then 2 else 3 end"
_RESOLVED = STAGED + f", resolved as (select user_id, step, arg_min(label, ({_RANK_SQL}) || label) label from staged group by user_id, step)"


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("label") == "purchase", 1).when(F.col("label") == "signup", 2).otherwise(3)
    return R.resolve_overlaps(staged(spark, d), ENTITY, "step", "label", rank)


@query("overlap_resolve", f"with {_RESOLVED} select user_id, step, label from resolved")
def overlap_resolve(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d)


_COLLAPSED = _RESOLVED + ", collapsed as (select * from (select *, lag(label) over (partition by user_id order by step) p from resolved) where label is distinct from p)"


@query("collapse_repeats", f"with {_COLLAPSED} select user_id, step, label from collapsed")
def collapse_repeats(spark: SparkSession, d: str) -> DataFrame:
    return R.collapse_repeats(_resolved(spark, d), ENTITY, "step", "label")


_MOVES = _COLLAPSED + """, moves as (select coalesce(lag(label) over w, 'start') src, label dst from collapsed window w as (partition by user_id order by step)
  union all select label, 'end' from (select label, lead(label) over (partition by user_id order by step) f from collapsed) where f is null),
  counted as (select src, dst, count(*) n from moves group by src, dst)"""


def _transitions(spark: SparkSession, d: str) -> DataFrame:
    return R.transitions(collapse_repeats(spark, d), ENTITY, "step", "label")


@query("sequence_transitions", f"with {_MOVES} select src, dst, n from counted")
def sequence_transitions(spark: SparkSession, d: str) -> DataFrame:
    return _transitions(spark, d)


@query(
    "transition_flow",
    f"""with {_MOVES}, ends as (select dst node, n inflow, 0 outflow from counted union all select src, 0, n from counted)
select node, cast(sum(inflow) as bigint) inflow, cast(sum(outflow) as bigint) outflow,
  round(sum(inflow) / (select sum(n) from counted), 6) share from ends group by node""",
)
def transition_flow(spark: SparkSession, d: str) -> DataFrame:
    return R.transition_flow(_transitions(spark, d))


_STAGE_MOVES = STAGES + """, crossed as (select unnest(labels) src, f from (select labels, lead(labels) over (partition by user_id order by step) f from stages) where f is not null),
  counted as (select src, dst, count(*) n from (select src, unnest(f) dst from crossed) where src <> dst group by src, dst)"""


def _stages(spark: SparkSession, d: str) -> DataFrame:
    return R.stages(staged(spark, d), ENTITY, "step", "label")


@query("stage_transitions", f"with {_STAGE_MOVES} select src, dst, n from counted")
def stage_transitions(spark: SparkSession, d: str) -> DataFrame:
    return R.stage_transitions(_stages(spark, d), ENTITY, "step").orderBy(F.desc("n"), "src", "dst")


@query(
    "stage_metrics",
    f"""with {_STAGE_MOVES}, per as (select user_id, count(*) s, sum(len(labels)) l from stages group by user_id)
select cast((select sum(l) from per) as bigint) incidences, (select count(*) from per where s >= 2) multi_stage_entities,
  (select count(*) from counted) distinct_transitions, cast((select sum(n) from counted) as bigint) total_transitions""",
)
def stage_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = _stages(spark, d)
    return R.stage_metrics(s, ENTITY, R.stage_transitions(s, ENTITY, "step"))


@query("next_step", f"with {STEPS} select user_id, step, label, lead(label) over (partition by user_id order by step) next_label from steps")
def next_step(spark: SparkSession, d: str) -> DataFrame:
    return R.next_step(steps(spark, d), ENTITY, "step", "label", "next_label").select("user_id", "step", "label", "next_label")


@query(
    "score_drop",
    f"""with {STEPS}, n as (select user_id, step, value, lead(value) over (partition by user_id order by step) next_value from steps)
select user_id, step, round(case when step % 2 = 1 then value - next_value else next_value - value end, 6) score_drop
from n where case when step % 2 = 1 then value - next_value else next_value - value end >= 50""",
)
def score_drop(spark: SparkSession, d: str) -> DataFrame:
    s = R.next_step(steps(spark, d), ENTITY, "step", "value", "next_value")
    change = F.col("value") - F.col("next_value")
    return s.select("user_id", "step", F.when(F.col("step") % 2 == 1, change).otherwise(-change).alias("d")).where("d >= 50").select("user_id", "step", F.round("d", 6).alias("score_drop"))


@query(
    "find_before_after",
    f"""with {STEPS} select user_id, step, max(case when label = 'error' then 1 else 0 end) over (partition by user_id order by step rows between unbounded preceding and 1 preceding) error_before,
  count(case when label = 'purchase' then 1 end) over (partition by user_id order by step rows between 1 following and unbounded following) purchases_after,
  lag(label, 2) over (partition by user_id order by step) grandparent from steps""",
)
def find_before_after(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators import patterns as P

    s = steps(spark, d)
    found = P.find(s, ENTITY, "step", {"error_before": F.col("label") == "error"}, {"purchases_after": F.col("label") == "purchase"})
    return P.parent(found, ENTITY, "step", "label", 2, "grandparent").select("user_id", "step", "error_before", "purchases_after", "grandparent")


@query(
    "step_pattern",
    f"""with {STEPS}, s as (select user_id, step, label, lead(label, 1) over w l1, lead(label, 2) over w l2 from steps window w as (partition by user_id order by step))
select user_id, step from s where label = 'view' and l1 = 'click' and l2 <> 'error'""",
)
def step_pattern(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators import patterns as P

    label = F.col("label")
    return P.fixed_line(steps(spark, d), ENTITY, "step", [label == "view", label == "click", label != "error"]).select("user_id", "step")


@query(
    "repeat_pattern",
    f"""with {STEPS}, s as (select user_id, string_agg(substr(label, 1, 1), '' order by step) symbols from steps group by user_id)
select user_id, len(regexp_extract_all(symbols, 'v+[^e]{{{{1,3}}}}p')) hits from s""".replace("{{", "{").replace("}}", "}"),
)
def repeat_pattern(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators import patterns as P

    return P.line_hits(steps(spark, d), ENTITY, "step", F.substring("label", 1, 1), [P.Part("v", 1, None), P.Part("e", 1, 3, but=True), P.Part("p")])


@query(
    "pattern_whole_table",
    "with s as (select string_agg(l_returnflag, '' order by l_orderkey, l_linenumber, l_returnflag) symbols from lineitem) select 'all' entity, len(regexp_extract_all(symbols, 'A+[^N]?N{2,3}R*[^A]{1,2}')) hits from s",
)
def pattern_whole_table(spark: SparkSession, d: str) -> DataFrame:
    """A line with gaps over all items as one entity: numbered by ranges, matched in segments."""
    from corpusloom.operators import ordering as O
    from corpusloom.operators import patterns as P

    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    line = [P.Part("A", 1, None), P.Part("N", 0, 1, but=True), P.Part("N", 2, 3), P.Part("R", 0, None), P.Part("A", 1, 2, but=True)]
    placed = O.numbered(rows, ["l_orderkey", "l_linenumber", "l_returnflag"], name="step").withColumn("entity", F.lit("all"))
    return P.line_hits(placed, ["entity"], "step", F.col("l_returnflag"), line)


@query(
    "peak_rank",
    "select user_id, max(value) peak, rank() over (order by max(value) desc) place from events group by user_id qualify place <= 20",
)
def peak_rank(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators import ordering as O

    return O.peaks(table(spark, d, "events"), ENTITY, "value", 20)
