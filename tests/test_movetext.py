"""Tokens, variations and annotation of movetext against a plain reader."""

import random
import re

import pytest

from corpusloom.sources import movetext as M


def plain(text):
    """(place, kind, begin, path, ply) of each token that is no space, one character after the other."""
    out, i, n, stack, opened = [], 0, 0, [[0, 0]], 0
    while i < len(text):
        c, j, at = text[i], i + 1, [v for v, _ in stack[1:]]
        if c.isspace():
            kind = "space"
            while j < len(text) and text[j].isspace():
                j += 1
        elif c == "{":
            kind, j = "comment", text.find("}", i) + 1 or len(text)
        elif c == ";":
            kind, j = "line", text.find("\n", i) if "\n" in text[i:] else len(text)
        elif c == "(":
            kind, opened = "open", opened + 1
            stack.append([opened, stack[-1][1] - 1])
            at = [v for v, _ in stack[1:]]
        elif c == ")" and len(stack) > 1:
            kind = "close"
        elif not c.isdigit() and c not in "(){}$":
            kind = "move" if c.isascii() and c.isalpha() else "other"
            stack[-1][1] += kind == "move"
            while j < len(text) and text[j] not in " \n{}();$":
                j += 1
        else:
            kind = "number" if c.isdigit() else "other"
            if kind == "number":
                j = i + len(re.match(r"\d+\.*", text[i:])[0])
        if kind == "close":
            stack.pop()
        out.append((n, kind, i, at, stack[-1][1]))
        n, i = n + 1, j
    return out


def drawn(rng):
    parts = ["e4", "Nf3", "(", "(", ")", ")", "1.", "12...", "{c (x) }", "{}", ";l {( \n", ")(", "\n", "é"]
    return "".join(rng.choice(parts) + rng.choice([" ", " ", ""]) for _ in range(rng.randrange(30)))


def test_tokens_and_paths(spark):
    rng = random.Random(3)
    texts = {k: drawn(rng) for k in range(80)} | {100: None, 101: "", 102: "(" * 12 + "a" + ")" * 12 + " b", 103: ")) a (b", 104: "a {open", 105: "e4 " * 3000}
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in texts.items()], "k int, text string, place int, number int")
    found = M.tokens(df, ["k"], "text")
    ways = {(r.k, r.variation): list(r.path) for r in M.paths(found, ["k"]).collect()}
    got = {}
    for r in found.orderBy("k", "place").collect():
        got.setdefault(r.k, []).append((r.place, r.kind, r.begin, ways.get((r.k, r.variation), []), r.ply))
    for k, text in texts.items():
        assert got.get(k, []) == plain(text or ""), text


def test_no_texts(spark):
    none = spark.createDataFrame([], "k int, text string")
    found = M.tokens(none, ["k"], "text")
    assert found.collect() == [] and M.paths(found, ["k"]).collect() == []


@pytest.mark.parametrize("unmatched", [True, False])
def test_annotation(spark, unmatched):
    own = [(1, "g", "1. e4 {x} e5 $1 (1. d4 {é}) 2. Nf3 {y} *"), (2, "g", "e4"), (3, "h", "a b"), (4, None, "a"), (5, "g", None), (6, "g", "")]
    other = [("b", "g", "{s} 1. e4 {x more} e5 {n} 2. Nf3 {pre y} {q}"), ("a", "g", "1. e4 {x} e5 {n} {m} Nf3 {y} d5 {}  c4 {end\t}"), ("c", None, "a {no}"), ("d", "i", "a {no}")]
    records = spark.createDataFrame(own, "id int, game string, text string")
    versions = spark.createDataFrame(other, "v string, game string, text string")
    got = {r.id: r.text for r in M.annotate(records, versions, ["game"], "id", "text", "v", unmatched).collect()}
    want = {
        1: " {s}1. e4 {more} {x} e5 {n m n} $1 (1. d4 {é}) 2. Nf3 {pre y q} {y} * {end}",
        2: " {s}e4 {end} {y pre y q} {n m n} {x x more}",
        5: " {end} {y pre y q} {n m n} {x x more} {s}",
        6: " {end} {y pre y q} {n m n} {x x more} {s}",
    }
    assert got == (want | {3: "a b", 4: "a"} if unmatched else want)


def test_annotation_by_nobody(spark):
    records = spark.createDataFrame([(1, "g", "e4")], "id int, game string, text string")
    none = spark.createDataFrame([], "v string, game string, text string")
    assert [r.text for r in M.annotate(records, none, ["game"], "id", "text", "v").collect()] == ["e4"]
    assert M.annotate(records, none, ["game"], "id", "text", "v", unmatched=False).collect() == []


def test_flat_markup_goes_as_the_fold_takes_it(spark):
    from pyspark.sql import functions as F

    from corpusloom.functions import text as T

    rng = random.Random(12)
    parts = ["{", "}", "(", ")", ";", "\n", "%", "a", "b c", "\n%", "{x}", "(y)", ";z\n", "{(}", "(;)", "{%\n}", ")"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(1500)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", *(x.alias(n) for n, x in (("flat", T.strip_markup(F.col("t"))), ("fold", T.markup(F.col("t"))["out"]), ("bare", T.strip_markup(F.col("t"), "")), ("bare_fold", T.markup(F.col("t"), "")["out"])))).collect()
    for r in rows:
        assert (r.flat, r.bare) == (r.fold, r.bare_fold), r.t
