"""Phrase mining against brute force and SQL, and its filters against plain counting."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from corpusloom.llm import phrases, queries

SCHEMA = "doc_id long, text string, lang string, chunk long, word string"


def brute(rows, top, least):
    """collocations() in plain Python."""
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang, text = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(words) - k + 1))
    found = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    out = []
    for (lang, p), a in found.items():
        if any(lang == m and len(q) > len(p) and 100 * c >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (m, q), c in found.items()):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, l, r, n[lang], score))
    rows = []
    for lang in n:
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        rows += [(lang, i + 1, *x[1:]) for i, x in enumerate(best)]
    return sorted(rows)


def texts(seed, n):
    rng = random.Random(seed)
    words = [*"abcdefghij", "É", "\x1fz", "Ab", "aB", "x\x00y"]
    rows = [(None, "en"), ("", "fr"), ("one two", None), (" \t\n,, ", "de"), ("a b. a b" * 40, "en"), ("Tab\tone tab\x0bone " * 20, None)]
    rows += [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n"]) for _ in range(rng.randrange(120))), rng.choice(["en", "en", "en", None, "und", "de"])) for _ in range(n)]
    return rows + [rows[9]] * 40  # repeated rows count as often as they are there


def frame(spark, rows):
    return spark.createDataFrame([(1, t, l, 7, "w") for t, l in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("top", "entries", "filter_bits"), [(2000, 1 << 22, 27), (5, 50, 16)])
def test_same_as_brute_force(spark, monkeypatch, top, entries, filter_bits):
    rows = texts(top, 150)
    plain = phrases.frequent_phrases
    monkeypatch.setattr(phrases, "frequent_phrases", lambda d, least, longest, text, lang: plain(d, least, longest, text, lang, chunk=3000, entries=entries, filter_bits=filter_bits))
    got = sorted(tuple(r) for r in phrases.collocations(frame(spark, rows), top, 30).collect())
    assert got == brute(rows, top, 30)
    assert len(got) > 10


def test_same_as_sql(spark):
    rows = texts(3, 100)
    got = sorted(tuple(r) for r in phrases.collocations(frame(spark, rows)).collect())
    con = duckdb.connect()
    con.execute("create table documents (text varchar, lang varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert got == sorted(con.execute(queries.SQL["op11_phrases"]).fetchall())


def test_no_phrases(spark):
    for rows in ([], [(None, None), ("", "en"), ("a b c", "en")]):
        assert phrases.collocations(frame(spark, rows)).collect() == []


@pytest.mark.parametrize(("n", "bits"), [(2, 1), (2, 20), (2, 32), (3, 1), (3, 11), (3, 22), (3, 32), (4, 3), (4, 16), (4, 17), (4, 32)])
def test_filters_lose_nothing(n, bits):
    rng = np.random.default_rng(n * bits)
    p = phrases.Packing(n, bits)
    words = [rng.integers(1, max(2, min(1 << bits, 50)), 5000) for _ in range(n)]
    words[0][:3] = (1 << bits) - 1
    high, low = p.pack(words)
    assert (p.unpack(high, low) == np.stack(words, axis=1)).all()
    layout = phrases.Layout(p, 5, 700)
    table = p.summed(high, low, np.ones(5000, dtype=np.int64))
    table[2][0], table[2][-1] = 255, 1 << 40
    back = [np.concatenate(x) for x in zip(*map(layout.decode, layout.encode(*table)), strict=True)]
    assert all((a == b).all() for a, b in zip(table, back, strict=True))
    twice = p.summed(*(np.concatenate(x) for x in zip(back, table, strict=True)))
    assert (twice[0] == table[0]).all() and (twice[2] == 2 * table[2]).all()


def test_scores_beyond_64_bits(spark):
    a, l, r = 7 * 10**18, 8 * 10**18, 9 * 10**18
    row = spark.sql(f"select cast(2000000 as decimal(7,0)) * cast({a}L as decimal(19,0)) div (cast({l}L as decimal(19,0)) + cast({r}L as decimal(19,0))) s").first()
    assert row.s == 2000000 * a // (l + r)
