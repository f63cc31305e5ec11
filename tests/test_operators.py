"""Operators on small literal tables with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import boards as B
from corpusloom.functions import outcomes as O
from corpusloom.functions import text as T
from corpusloom.operators import filters, joins, quality, runs
from corpusloom.sources import records, sinks, tables
from corpusloom.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_runs_gapped_and_repeated(spark):
    rows = spark.createDataFrame([("g", 1, "a"), ("g", 2, "a"), ("g", 2, "a"), ("g", 4, "a"), ("g", 4, "b"), ("h", 1, "a")], "game string, step int, label string")
    found = {tuple(r) for r in runs.runs(rows, ["game"], "step", "label").collect()}
    assert found == {("g", "a", 1, 2, 2), ("g", "a", 4, 4, 1), ("g", "b", 4, 4, 1), ("h", "a", 1, 1, 1)}
    first = {(r.game, r.label): r.position_count for r in runs.first_run(runs.runs(rows, ["game"], "step", "label"), ["game"], "label").collect()}
    assert first == {("g", "a"): 2, ("g", "b"): 1, ("h", "a"): 1}


def test_transitions_with_start_and_end(spark):
    visits = {"ann": "home cart pay", "bo": "home home help home cart", "cy": "help", "dee": "cart pay cart pay thanks"}
    rows = [(who, 10 * k, page) for who, pages in visits.items() for k, page in enumerate(pages.split())]
    counted = runs.transitions(spark.createDataFrame(rows, "g string, k int, s string"), ["g"], "k", "s")
    found = {(r.src, r.dst): r.n for r in counted.collect()}
    assert found == {
        ("start", "home"): 2, ("start", "help"): 1, ("start", "cart"): 1, ("home", "home"): 1, ("home", "help"): 1, ("help", "home"): 1,
        ("home", "cart"): 2, ("cart", "pay"): 3, ("pay", "cart"): 1, ("pay", "thanks"): 1, ("pay", "end"): 1, ("cart", "end"): 1, ("help", "end"): 1, ("thanks", "end"): 1,
    }


def test_overlap_then_collapse(spark):
    worth = {"gold": 1, "silver": 2, "tin": 3}
    told = [("x", 4, "tin gold"), ("x", 5, "gold silver tin"), ("x", 7, "tin"), ("x", 8, "tin"), ("x", 9, "gold"), ("y", 1, "silver tin"), ("y", 2, "silver")]
    rows = spark.createDataFrame([(g, k, s) for g, k, all_ in told for s in all_.split()], "g string, k int, s string")
    rank = F.create_map(*(F.lit(v) for kv in worth.items() for v in kv))[F.col("s")]
    kept = runs.collapse_repeats(runs.resolve_overlaps(rows, ["g"], "k", "s", rank), ["g"], "k", "s")
    assert sorted(tuple(r) for r in kept.select("g", "k", "s").collect()) == [("x", 4, "gold"), ("x", 7, "tin"), ("x", 9, "gold"), ("y", 1, "silver")]


def test_pairs_without_self_join(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b"), (2, "a"), (2, "c")], "g int, s string")
    assert {tuple(r) for r in joins.pair_counts(rows, ["g"], "s").collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}


@pytest.mark.parametrize(
    ("result", "side", "want"),
    [("1-0", "white", "win"), ("0-1", "white", "loss"), ("0-1", "black", "win"), ("1/2-1/2", "black", "draw"), ("*", "white", "unknown"), ("1-0", "symmetric", "decisive")],
)
def test_result_outcome(spark, result, side, want):
    assert one(spark, O.result_outcome(F.lit(result), F.lit(side))) == want


def test_text_functions(spark):
    assert one(spark, T.fold(F.lit("Élœß Ångström Łódź"))) == "eloess angstrom lodz"
    assert one(spark, T.normalize_moves(F.lit("1. e4 {a} (1. d4 (x) y) e5 $3 ; rest\n 2. Nf3 1-0"))) == "e4 e5 Nf3"
    assert one(spark, T.strip_nested(F.lit("a(b(c)d)e)f("), "(", ")")) == "aef"
    assert one(spark, T.with_result(F.lit("1. e4 "))) == "1. e4 *"
    assert one(spark, T.clean(F.lit("﻿a\r\nb\x01"))) == "a\nb"
    assert one(spark, T.known_labels(F.lit(" x b a "), ["a", "b", "x y"])) == ["a", "b"]
    assert one(spark, T.key_base(F.lit("b12/3"))) == "B12" and one(spark, T.key_base(F.lit("F12"))) == "unknown"
    assert one(spark, T.comment_delta(F.lit("old new}"), F.lit("old"))) == "new)"


def test_empty_query_matches_nothing(spark):
    df = spark.createDataFrame([("x",)], "f string")
    assert filters.grep(df, {"f": " , "}).count() == 0 and filters.grep(df, {"f": "X"}).count() == 1


FENS = [
    ("bishop and knight", "7k/8/5K2/8/1N6/8/8/5B2 w - - 0 1", "7k/8/5K2/8/1Q6/8/8/5B2 w - - 0 1", lambda b: (B.count_of(b, "B") == 1) & (B.count_of(b, "N") == 1)),
    ("connected pawns", "8/1r4k1/8/5P2/6P1/8/R5K1/8 w - - 0 1", "8/1r4k1/8/5P2/7P/8/R5K1/8 w - - 0 1", lambda b: B.connected_pawns(b) == 2),
    ("opposite bishops", "6k1/8/4b3/8/5P2/8/1B4K1/8 w - - 0 1", "6k1/8/3b4/8/5P2/8/1B4K1/8 w - - 0 1",
     lambda b: F.size(F.array_distinct(F.transform(B.squares_of(b, "Bb"), B.is_light))) == 2),
]


@pytest.mark.parametrize(("name", "positive", "negative", "rule"), FENS, ids=[f[0] for f in FENS])
def test_position_rules(spark, name, positive, negative, rule):
    assert one(spark, rule(B.expand_fen(F.lit(positive)))) is True
    assert one(spark, rule(B.expand_fen(F.lit(negative)))) is False


def test_board_geometry(spark):
    boards = spark.createDataFrame([(1, "4k3/8/8/8/4R3/8/4n3/4K3 b"), (2, "4k3/4b3/8/8/8/8/8/4RK2 w")], "id int, fen string").withColumn("board", B.expand_fen(F.col("fen")))
    found = {(r.id, r.piece, r.target) for r in B.attacks(boards, "id").collect()}
    assert {(1, "R", "k"), (1, "R", "n"), (1, "K", "n"), (2, "R", "b")} <= found
    assert (2, "R", "k") not in found
    assert {(r.id, r.piece, r.pinned) for r in B.pins(boards, "id").collect()} == {(2, "R", "b")}


def test_replay_special_moves(spark):
    def last(moves):
        return one(spark, F.element_at(B.replay(F.array(*map(F.lit, moves))), -1))

    assert last(["e2e4", "e7e5", "g1f3", "b8c6", "f1b5", "a7a6", "e1g1"])[-8:] == "RNBQ.RK."
    passed = last(["e2e4", "a7a6", "e4e5", "d7d5", "e5d6"])
    assert passed[B.square("d6") - 1] == "P" and passed[B.square("d5") - 1] == "."
    assert last(["a2a8q"])[0] == "Q"


def test_replay_and_tracks_fold_all_moves(spark, tmp_path):
    from datetime import datetime, timedelta

    from corpusloom.plans.rule_queries import piece_tracks
    from corpusloom.plans.text_queries import replay_moves

    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=k), k % 3) for k in range(150)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    boards, moves = {}, {}
    for user in range(3):
        board, on = B.START, [k + 1 if p != "." else 0 for k, p in enumerate(B.START)]
        for ply, e in enumerate(range(user, 150, 3)):
            a, b, c, d = e * 7 % 8, e * 5 % 8 + 1, (e * 3 + 1) % 8, (e * 11 + 3) % 8 + 1
            source, target = (8 - b) * 8 + a, (8 - d) * 8 + c
            cells = list(board)
            piece, taken = cells[source], cells[target]
            cells[source] = "."
            cells[target] = piece
            if piece in "Pp" and a != c and taken == ".":
                cells[source // 8 * 8 + c] = "."
            if piece in "Kk" and a == 4 and b == d and abs(a - c) == 2:
                cells[target + 1 if c > a else target - 2] = "."
                cells[target - 1 if c > a else target + 1] = "R" if piece == "K" else "r"
            board = boards[user, ply] = "".join(cells)
            moved = on[source]
            on[source] = 0
            on[target] = moved
            if moved:
                moves[user, moved] = moves.get((user, moved), 0) + 1
    got = {(r.user_id, r.ply): r.board for r in replay_moves(spark, str(tmp_path)).collect()}
    assert len(got) == 150 and got == boards
    assert {(r.user_id, r.piece): r.moves for r in piece_tracks(spark, str(tmp_path)).collect()} == moves


def test_record_scan(spark, tmp_path):
    text = '﻿preamble\n\n[Event "a"]\n[Site "s"]\n[Event "b"]\n\n1. e4 {x} e5 1-0\n\n[Event "c"]\r\n[Site "t"]\n\n1. d4 (1. c4) {y x} *\n'
    (tmp_path / "one.pgn").write_text(text)
    (tmp_path / "TWO.PGN").write_text('[Event "d"]\n\n1. e4 *\n')
    (tmp_path / "no.txt").write_text('[Event "e"]\n')
    rows = records.parsed(records.read_records(spark, str(tmp_path))).collect()
    by = sorted((r.file.rsplit("/", 1)[1], r.game_index, r.headers["Event"]) for r in rows)
    assert by == [("TWO.PGN", 1, "d"), ("one.pgn", 1, "a"), ("one.pgn", 2, "b"), ("one.pgn", 3, "c")]
    starts = {r.headers["Event"]: r.start_line for r in rows}
    assert starts["a"] == 3 and starts["c"] == 9
    labels = records.markers(records.read_records(spark, str(tmp_path)), ["x", "y"]).collect()
    assert sorted((r.game_index, r.ply, r.label) for r in labels) == [(2, 1, "x"), (3, 1, "x"), (3, 1, "y")]


def test_retag_and_text(spark):
    h = records.set_tags(records.headers(F.lit('[Event "a"]\n[ECO "B00"]\n[White "w"]')), {"ECO": F.lit("C20")})
    assert one(spark, records.to_text(h, F.lit("1. e4 *"))) == '[Event "a"]\n[White "w"]\n[ECO "C20"]\n\n1. e4 *'


def test_lint(spark):
    assert one(spark, quality.unbalanced(F.lit("{a ; }\n}"), "{", "}")) == 0
    assert one(spark, quality.bad_date(F.lit("19??.01.??"))) is False and one(spark, quality.bad_date(F.lit("1990"))) is True


def test_markup_cases_by_hand(spark):
    from corpusloom.plans.text_queries import CASES

    for text, moves, final, cleaned, *counts in CASES:
        t = F.lit(text.replace("~", "\n"))
        assert one(spark, T.normalize_moves(t)) == moves and one(spark, quality.final_token(t)) == final
        got = one(spark, T.rewritten(t))
        assert [got.out, got.comments, got.variations, got.lines, got.results] == [cleaned, *counts], text
    assert one(spark, T.trimmed_token(F.lit("-(a-b_)."))) == "a-b" and one(spark, T.trimmed_token(F.lit("-(a-b_)."), "_-")) == "-(a-b_"
    notes = F.array(*(F.struct(F.lit(o).alias("offset"), F.lit(n).alias("note")) for o, n in ((0, "<"), (3, "{x}"), (3, "{y}"), (6, ">"))))
    assert one(spark, T.inserted(F.lit("abcdef"), notes)) == "<abc{x}{y}def>"


@pytest.mark.parametrize(("n", "want"), [(1, 1), (2, 1), (100, 99), (101, 99), (150, 148), (1000, 990)])
def test_p99_place(spark, n, want):
    from corpusloom.operators import profiles

    assert profiles.p99(spark.range(1, n + 1), "id").first()["p99"] == want


def test_rating_bands(spark):
    bands = [(None, None, "Unknown"), (1599, None, "<1600"), (1600, 0, "1600-1799"), (2398, 2401, "2200-2399"), (2600, 2600, "2600+"), (2599, 2600, "2400-2599")]
    for a, b, want in bands:
        assert one(spark, O.rating_band(F.array(F.lit(a).cast("int"), F.lit(b).cast("int")))) == want


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "o.csv").write_text('row_number,eco,eco_base,eco_group,name,moves,source_url\n1,A00,A00,A,"One, ""two""",e4,u\n')
    assert tables.read_openings(spark, str(tmp_path / "o.csv")).first()["name"] == 'One, "two"'
    (tmp_path / "f.txt").write_text("# all\n8/8 w - - 0 1 # x\n\n")
    assert [r.fen for r in tables.read_fens(spark, str(tmp_path / "f.txt")).collect()] == ["8/8 w - - 0 1"]
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    sinks.write_facts(df, ["k"], ["v"], "k", str(tmp_path / "facts"))
    assert [(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "facts")).collect()] == [("a", 1)]
    sinks.append_csv(df, str(tmp_path / "c"))
    with pytest.raises(ValueError):
        sinks.append_csv(df.withColumnRenamed("v", "w"), str(tmp_path / "c"))


def test_strict_and_lenient_summary(spark):
    df = spark.createDataFrame([("a", "ok"), ("b", "error")], "pgn string, status string")
    assert tables.lenient_summary(df).count() == 1
    with pytest.raises(Exception, match="status is error"):
        tables.strict_summary(df).collect()


def test_record_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pgn").write_text('x\n[Event "a"]\n\n1. e4 *\n\n[Event "b"]\n\n*\n')
    stream = ingest.record_stream(spark, str(tmp_path / "in"))
    q = stream.select(stream.headers["Event"].alias("e")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
    q.option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.e for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_rules_rows_and_parents(spark):
    from corpusloom.operators import rules as U

    known = [U.Rule("bn", {"B": (1, 1), "N": (1, 1)}, parents=("minors",)), U.Rule("minors", {"B": (0, 2), "N": (0, 2)}, {"B": (0, 2), "N": (0, 2)})]
    fens = [(1, "4k3/8/8/8/8/8/8/2B1K1N1 w"), (2, "2b1k1n1/8/8/8/8/8/8/4K3 w"), (3, "4k3/8/8/8/8/8/8/2B1K3 w"), (4, "4k3/8/8/8/8/8/8/2R1K3 w")]
    boards = spark.createDataFrame(fens, "id int, fen string").withColumn("board", B.expand_fen(F.col("fen")))
    first = {r.id: (r.m.stem, r.m.side) if r.m else None for r in boards.withColumn("m", U.first_match(known, F.col("board"))).collect()}
    assert first == {1: ("bn", "white"), 2: ("bn", "black"), 3: ("minors", "symmetric"), 4: None}
    labels = sorted((r.id, r.label) for r in U.all_labels(boards, known, "board").collect())
    assert labels == [(1, "bn"), (1, "minors"), (2, "bn"), (2, "minors"), (3, "minors")]


def test_moves_keep_piece_identity(spark):
    moves = ["e2e4", "d7d5", "e4d5", "d8d5", "e1e2"]
    tracks = one(spark, B.tracks(F.array(*map(F.lit, moves))))
    assert tracks == [B.square("e2"), B.square("d7"), B.square("e2"), B.square("d8"), B.square("e1")]
    kinds = B.move_kinds(F.lit(B.START), F.lit("b1c3"))
    assert [one(spark, kinds[k]) for k in ("piece", "capture", "promotion", "castling", "en_passant")] == ["N", False, False, False, False]


def test_xray_through_own_rook(spark):
    boards = spark.createDataFrame([(1, "4k3/8/8/8/4R3/8/4Q3/4K3 w"), (2, "4k3/8/8/8/4N3/8/4Q3/4K3 w")], "id int, fen string").withColumn("board", B.expand_fen(F.col("fen")))
    assert {(r.id, r.piece, r.through, r.target) for r in B.xrays(boards, "id").collect()} >= {(1, "Q", "R", "k")}
    assert not [r for r in B.xrays(boards, "id").collect() if r.id == 2]


def test_loose_records_and_annotated(spark, tmp_path):
    (tmp_path / "a.pgn").write_text('[Event "a"]\n\n1. e4 *\n\n[Event "b"]\r\n\r\n*\r\n\r\n[Event "c"]\n\n*\n')
    assert [r.game_index for r in records.read_blank_line_records(spark, str(tmp_path)).orderBy("game_index").collect()] == [1, 2, 3]
    (tmp_path / "x.json").write_text('{"game_index": 1, "headers": {"Event": "a"}, "parse_errors": []}\n{"game_index": 2, "parse_errors": ["bad"]}\n')
    assert [(r.game_index, r.status) for r in records.read_annotated(spark, str(tmp_path / "x.json")).collect()] == [(1, "ok"), (2, "reject")]


def test_openings_and_exports(spark):
    from corpusloom.operators import exports as X

    df = spark.createDataFrame([("C20", False, "B00"), (None, True, "B00"), (None, False, "B00")], "t string, c boolean, f string")
    assert [r.o for r in df.select(X.opening_label(F.col("t"), F.col("c"), F.col("f")).alias("o")).collect()] == ["C20", None, "B00"]
    assert [r.o for r in df.select(X.opening_label(F.col("t"), F.col("c"), F.col("f"), force=True).alias("o")).collect()] == ["B00", None, "B00"]
    scored = X.score_pending(spark.range(3), lambda b: b.assign(score=b["id"] * 2.0), "id long, score double")
    assert sorted((r.id, r.score) for r in scored.collect()) == [(0, 0.0), (1, 2.0), (2, 4.0)]
