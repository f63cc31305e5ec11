"""Composable automata, numbering by ranges and exact quantiles, against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ordering, patterns, profiles
from corpusloom.operators.automata import Part, automaton


def count(table, text):
    state = hits = 0
    for c in text:
        k = table.symbols.find(c) + 1
        hits += table.hits[state][k]
        state = table.following[state][k]
    return hits + table.left[state]


def drawn(rng):
    line, expression = [], ""
    for _ in range(rng.randrange(1, 5)):
        symbols, but, least = "".join(rng.sample("abc", rng.randrange(1, 3))), rng.random() < 0.3, rng.randrange(3)
        most = rng.choice([None, max(1, least + rng.randrange(3))])
        line.append(Part(symbols, least, most, but))
        expression += f"[{'^' * but}{symbols}]{{{least},{'' if most is None else most}}}"
    return line, expression


def test_automata_hit_what_regular_expressions_hit():
    rng = random.Random(2)
    for _ in range(150):
        line, expression = drawn(rng)
        if any(p.least for p in line):
            table = automaton(line)
            for _ in range(20):
                text = "".join(rng.choices("abcd", k=rng.randrange(40)))
                assert count(table, text) == len(re.findall(expression, text)), (expression, text)


def test_lines_that_are_none():
    for line in ([], [Part("a", 0, 3)], [Part("a", 3, 2)]):
        with pytest.raises(ValueError, match="a line needs"):
            automaton(line)


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_segments_of_an_entity_compose(spark, width):
    rng = random.Random(width)
    texts = {k: "".join(rng.choices("aabbc", k=n)) for k, n in enumerate((1, 2, 63, 64, 65, 130, 700 if width < 9 else 9000))}
    rows = [(k, i + 1, c) for k, t in texts.items() for i, c in enumerate(t)] + [(0, 2, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "e int, k long, c string")
    line, expression = [Part("a", 1, None), Part("c", 0, 2, but=True), Part("b", 2, 2)], "a+[^c]{0,2}b{2}"
    got = {r.e: r.hits for r in patterns.line_hits(df, ["e"], "k", F.col("c"), line, width).collect()}
    assert got == {k: len(re.findall(expression, t)) for k, t in texts.items()}
    assert patterns.line_hits(df.where("e > 99"), ["e"], "k", F.col("c"), line, width).collect() == []


def test_a_large_entity_is_numbered_and_matched_in_parts(spark):
    n = 300_000
    rows = spark.range(n).select(F.lit("hot").alias("e"), (F.col("id") * 7919 % n).alias("t"))
    rows = rows.union(spark.createDataFrame([("small", 5), ("small", 3), (None, 9)], "e string, t long"))
    placed = ordering.numbered(rows, ["t"], ["e"], "k")
    assert placed.where("e = 'hot' and k <> t + 1").count() == 0 and placed.count() == n + 3
    assert sorted((r.e or "", r.t, r.k) for r in placed.where("e is null or e = 'small'").collect()) == [("", 9, 1), ("small", 3, 1), ("small", 5, 2)]
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    symbol = F.when(F.col("t") % 5 < 3, "a").otherwise("b")
    hits = patterns.line_hits(placed.where("e = 'hot'"), ["e"], "k", symbol, [Part("a", 2, None), Part("b", 1, 2)])
    assert hits.first().hits == n // 5


def test_whole_table_order_without_one_task(spark):
    df = spark.range(500).select((F.col("id") % 50).alias("at"), "id")
    placed = ordering.numbered(df, [F.desc("at"), "id"])
    assert [r.id for r in placed.orderBy("place").collect()] == [r.id for r in sorted(df.collect(), key=lambda r: (-r.at, r.id))]
    assert sorted(placed.columns) == ["at", "id", "place"]


def test_peaks_share_places(spark):
    rows = [(k, v) for k, v in enumerate((9, 9, 8, 7, 7, 7, 1))] + [(1, 2), (8, None)]
    got = ordering.peaks(spark.createDataFrame(rows, "e int, v int"), ["e"], "v", 4)
    assert sorted((r.e, r.peak, r.place) for r in got.collect()) == [(0, 9, 1), (1, 9, 1), (2, 8, 3), (3, 7, 4), (4, 7, 4), (5, 7, 4)]


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_quantiles_of_any_numbers(spark, bins):
    rng = random.Random(bins)
    draws = {
        "few": [1.0], "ties": [5.0] * 40 + [6.0], "wide": [1e300, -1e300, 1.7e308, -1.7e308, 0.0], "small": [5e-324, 0.0, 1e-320],
        "many": [rng.gauss(0, 1) ** 5 for _ in range(300)], "infinite": [math.inf, 1.0, 2.0, -math.inf],
    }
    for name, values in draws.items():
        df = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "v double")
        for place in {1, len(values) // 2 + 1, len(values)}:
            assert profiles.quantile(df, "v", lambda n, p=place: p, bins) == (len(values), sorted(values)[place - 1]), name
    whole = [2**60 + k for k in (0, 1, 1, 2, 3)]
    assert profiles.quantile(spark.createDataFrame([(v,) for v in whole], "v long"), "v", lambda n: 4, bins) == (5, 2**60 + 2)
    assert profiles.quantile(spark.createDataFrame([], "v long"), "v", lambda n: 1, bins) == (0, None)
