"""Texts are scanned, numbered and counted where they are: plans without tokens in shuffles, sorts or windows."""

from pyspark.sql import functions as F

from corpusloom.operators import ordering as O
from corpusloom.plans import detail_queries, file_queries, movetext_queries, outcome_queries, sequence_queries
from corpusloom.sources import movetext as M
from corpusloom.sources import records as S

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_neither_shuffled_nor_sorted(spark):
    for df in (movetext_queries.variation_tree(spark, SF), detail_queries.original_comments(spark, SF)):
        assert "Window" not in _plan(df) and _plan(df).count("Exchange hashpartitioning") == 1
    # rows that share a key are texts of their own
    df = spark.createDataFrame([(1, "a (b"), (1, "c) d")], "k int, text string")
    assert sorted((r.token, r.ply, list(r.path)) for r in M.tokens(df, ["k"], "text", ["move"]).collect()) == [("a", 1, []), ("b", 1, [1]), ("c", 1, []), ("d", 2, [])]


def test_annotation_shuffles_by_the_key_alone(spark):
    plan = _plan(movetext_queries.annotated_records(spark, SF))
    assert "Window" not in plan and plan.count("Exchange hashpartitioning(o_orderkey") == 0


def test_markers_meet_their_record_without_a_join(spark, tmp_path):
    (tmp_path / "a.pgn").write_text('[Event "x"]\n\n1. e4 {red} (1. d4 {red}) e5 {blue red} *\n\n[Event "y"]\n\n{red} *\n')
    r = S.read_records(spark, str(tmp_path))
    found = S.markers(r, ["red", "blue"], {"event": S.headers(F.col("raw"))["Event"]})
    assert "Window" not in _plan(r.select("game_index")).split("BroadcastExchange")[0]  # only sums are in windows
    assert "SortMergeJoin" not in _plan(found)
    assert sorted((x.event, x.ply, x.label) for x in found.collect()) == [("x", 1, "red"), ("x", 2, "blue"), ("x", 2, "red"), ("y", 0, "red")]
    assert "SortMergeJoin" not in _plan(file_queries.record_markers(spark, SF))


def test_a_long_entity_is_numbered_in_parts(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, "long").when(F.col("id") < 4500, None).otherwise("b").alias("e"), (F.col("id") * 7919 % 5000).alias("v"))
    placed = O.numbered(rows, ["v"], ["e"], "step")
    assert "part" in [line for line in _plan(placed).splitlines() if "Join" in line][0]  # met by partition, not by entity alone
    got = placed.groupBy("e").agg(F.min("step").alias("a"), F.max("step").alias("z"), F.count_distinct("step").alias("n")).collect()
    assert {(r.e, r.a, r.z, r.n) for r in got} == {("long", 1, 4000, 4000), (None, 1, 500, 500), ("b", 1, 500, 500)}
    assert "entity" not in "".join(line for line in _plan(sequence_queries.pattern_whole_table(spark, SF)).splitlines() if "Join" in line)


def test_games_are_counted_without_a_row_for_each_place_of_the_grid(spark):
    plan = _plan(outcome_queries.opening_ending(spark, SF))
    assert all("record_id" not in line for line in plan.splitlines() if "hashpartitioning" in line and "view" in line)
