"""Material rules on known endings, and quotas on two axes against every allotment."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import boards as B
from corpusloom.operators import material, quotas


def test_endings_of_known_boards(spark):
    fens = {
        "4k3/8/8/8/8/8/8/2B1K1N1": ("1-4BN", "white", ["1-4BN"]),
        "2b1k1n1/8/8/8/8/8/8/4K3": ("1-4BN", "black", ["1-4BN"]),
        "4k3/8/8/8/8/8/4P3/4K3": ("2-1P", "white", ["2-1P", "2-0Pp"]),
        "4k3/4p3/8/8/8/8/4P3/4K3": ("2-0Pp", "symmetric", ["2-0Pp"]),
        "4k3/8/8/8/8/2b5/8/2B1K3": ("4-2scBB", "symmetric", ["4-2scBB"]),
        "4k3/8/8/8/8/3b4/8/2B1K3": ("4-3ocBB", "symmetric", ["4-3ocBB"]),
        "4k2r/8/8/8/8/8/PP6/R3K3": ("6-2-2RPPr", "white", ["6-2-2RPPrConnected", "6-2-2RPPr", "6-2-0Rr"]),
        "4k2r/8/8/8/8/8/P2P4/R3K3": ("6-2-2RPPr", "white", ["6-2-2RPPr", "6-2-0Rr"]),
        "4k2r/8/8/8/8/8/8/RN2K3": ("8-1RNr", "white", ["8-1RNrNoPawns", "8-1RNr"]),
        "3qk3/8/8/8/8/8/8/RR2K3": ("10-5Qrr", "black", ["10-5Qrr"]),
        "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR": (None, None, []),
        "4k3/8/8/8/8/8/8/4K3": (None, None, []),
    }
    rows = [(k, f, s, w, l) for k, (f, (s, w, l)) in enumerate(fens.items())]
    boards = spark.createDataFrame([(k, f) for k, f, *_ in rows], "id int, fen string").withColumn("board", B.expand_fen(F.col("fen")))
    told = {r.id: r for r in material.judged(boards).collect()}
    for k, fen, stem, side, labels in rows:
        assert (told[k].stem, told[k].side, sorted(told[k].labels)) == (stem, side, sorted(labels)), fen
    assert told[0].favoured == "bishop+knight side" and told[3].favoured == "symmetric/either side"
    with_aliases = {r.id: r.labels for r in material.judged(boards, aliases=True).collect()}
    assert "8-1RNrPp" in with_aliases[8] and len(material.ENDINGS) == 31 and len(material.AUXILIARY) == 9


def test_transport_takes_all_that_quotas_allow():
    rng = random.Random(6)
    for _ in range(60):
        counts = {(a, b): rng.randrange(4) for a in "xy" for b in "123"}
        first, second = {a: rng.randrange(5) for a in "xyz"}, {b: rng.randrange(4) for b in "123"}
        taken = quotas.transported(counts, first, second)
        assert all(0 <= n <= counts[k] for k, n in taken.items())
        assert all(sum(n for k, n in taken.items() if k[0] == a) <= q for a, q in first.items())
        assert all(sum(n for k, n in taken.items() if k[1] == b) <= q for b, q in second.items())
        ways = itertools.product(*(range(n + 1) for n in counts.values()))
        fits = lambda way: all(sum(n for k, n in zip(counts, way, strict=True) if k[i] == v) <= q for i, quota in ((0, first), (1, second)) for v, q in quota.items())
        assert sum(taken.values()) == max(sum(way) for way in ways if fits(way))


@pytest.mark.parametrize("quota", [0, 7, 10**6])
def test_sample_under_two_quotas(spark, quota):
    df = spark.range(400).select("id", F.when(F.col("id") % 3 > 0, "common").otherwise("rare").alias("label"), (F.col("id") % 5).cast("string").alias("source"))
    got = quotas.two_quota_sample(df, "label", "source", {"common": 50, "rare": 40, "none": 9}, {str(k): quota for k in range(4)}, F.md5(F.col("id").cast("string"))).collect()
    assert len(got) == min(90, 4 * quota) and len({r.id for r in got}) == len(got)
    for cell in {(r.label, r.source) for r in got}:
        mine = sorted(r.hash for r in got if (r.label, r.source) == cell)
        there = sorted(r.h for r in df.where((df.label == cell[0]) & (df.source == cell[1])).select(F.md5(F.col("id").cast("string")).alias("h")).collect())
        assert mine == there[: len(mine)]
