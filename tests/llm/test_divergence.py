"""The source audit against brute force and SQL, its transducer against sorted lists."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from corpusloom.llm import divergence, queries

SCHEMA = "doc_id long, text string, lang string, source string, rank int, term string, terms int"


def brute(rows, least, top):
    docs = []
    for text, lang, source in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text or "")
        docs.append((lang or "", source or "", [w for w in text.split(" ") if w]))
    within = Counter((lang, w) for lang, _, words in docs for w in set(words))
    kept = defaultdict(set)
    for (lang, w), n in within.items():
        if n >= least:
            kept[lang].add(w)
    groups = sorted({(lang, source) for lang, source, _ in docs})
    counts = defaultdict(Counter)
    for lang, source, words in docs:
        for key in ((lang, source), lang):
            counts[key].update(w for w in words if w in kept[lang])
    share = lambda key, lang, w: 1 + 10**9 * (counts[key][w] + 2) // (counts[key].total() + 2 * len(kept[lang]))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang, source in groups:
        key = (lang, source)
        pairs = [(b, sum(f(share(key, lang, w), share((lang, b), lang, w)) for w in kept[lang])) for a, b in groups if a == lang and b != source]
        terms = [(w, f(share(key, lang, w), share(lang, lang, w))) for w in kept[lang] if counts[key][w] and share(key, lang, w) > share(lang, lang, w)]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(items)]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "ab", "abc", "b", "bc", "É", "éa", "zß", "日本", "日", *(f"{c}{d}" for c in "pqrs" for d in "wxyz")]
    rows = [(None, "en", "s1"), ("", "fr", "s1"), ("1 2 ,", None, None), ("a_b", "fr", None), ("x" * 9000 + " a", "en", "s2"), ("lone", "de", "s1")]
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "fr", None, "aé"]), rng.choice(["s1", "s1", "s2", "s3", None, "\x01"])
        few = words if source != "s3" else words[:9]
        text = "".join((w if rng.random() < 0.7 else w.upper()) + rng.choice([" ", "\x00", "\n", ", ", "1", "\x7f"]) for w in rng.choices(few, k=rng.randrange(40)))
        rows.append((text, lang, source))
    return rows + [rows[9]] * 12


def frame(spark, rows):
    return spark.createDataFrame([(1, t, l, s, 3, "t", 4) for t, l, s in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("terms", "held", "tile", "block"), [(50_000, 64 << 20, 64, 4096), (4, 1, 2, 8)])
def test_same_as_brute_force(spark, monkeypatch, terms, held, tile, block):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = texts(terms, 120)[:: 1 if terms > 4 else 2]
    got = sorted(tuple(r) for r in divergence.audit(frame(spark, rows), terms=terms, held=held if held > 1 else 30_000).collect())
    assert got == brute(rows, 10, 10)
    assert len(got) > 50


def test_same_as_sql(spark):
    rows = texts(5, 150)
    got = sorted(tuple(r) for r in divergence.audit(frame(spark, rows)).collect())
    con = duckdb.connect()
    con.execute("create table documents (text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    assert got == sorted(con.execute(queries.SQL["op13_divergence"]).fetchall())


def test_nothing_kept(spark):
    assert divergence.audit(frame(spark, [])).collect() == []
    got = sorted(tuple(r) for r in divergence.audit(frame(spark, [(None, "en", "a"), ("b", "en", None), (None, "fr", "c")])).collect())
    assert got == [("en", "", "pair", "a", 0, 1), ("en", "a", "pair", "", 0, 1)]


def test_transducer_numbers_terms_in_order():
    rng = random.Random(4)
    terms = sorted({"".join(rng.choices("abé日", k=rng.randrange(1, 9))).encode() for _ in range(3000)})
    m = divergence.Transducer.build(terms)
    asked = [*terms, b"ab" * 30, b"c", b"\xff", *(t + b"a" for t in terms[:99]), *(t[:-1] or b"c" for t in terms[:99])]
    data = np.frombuffer(b" " + b" ".join(asked) + b" ", dtype=np.uint8)
    starts = np.cumsum([1, *(len(t) + 1 for t in asked[:-1])])
    place = {t: k for k, t in enumerate(terms)}
    assert m.ordinals(data, starts).tolist() == [place.get(t, -1) for t in asked]


def test_transducer_is_minimal():
    m = divergence.Transducer.build([b"alpha", b"beta", b"delta"])
    assert len(m.base) - 1 == len({"root", "l|pha", "pha", "ha", "a", "", "eta", "ta", "elta", "lta"})


def test_chance_of_large_counts():
    for c, n, v in ((0, 0, 1), (5, 7, 3), (3 * 10**14, 10**15, 10**8), (10**15, 10**15, 1)):
        assert divergence.chance(np.array([c]), n, v)[0] == 1 + 10**9 * (c + 2) // (n + 2 * v)
