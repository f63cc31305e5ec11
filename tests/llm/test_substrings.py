"""Removal of repeated windows against brute force: copies, hot runs, nulls, ties, small buffers and buckets."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from corpusloom.llm import queries, substrings

SCHEMA = "doc_id long, text string, owner string, start long, id string, spans string"


def brute(texts, width):
    words = [(t or "").encode().split() for t in texts]
    windows = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - width + 1) if windows[tuple(w[i : i + width])] > 1 for k in range(i, i + width)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    make = lambda n: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n))
    passage, line = make(60), make(20)
    out = [None, "", " \n\t", "one", make(9), "a " * 200, "é b " * 50, make(3000)]
    out += [make(80)] * 30 + [make(rng.randrange(120)) for _ in range(60)]
    for _ in range(40):  # a passage, a line and near copies in changing company
        out += [f"{make(rng.randrange(30))} {passage} {make(9)}", f"{make(25)}\n{line}\x0b{make(25)}"]
        out.append(" ".join(["x" if rng.random() < 0.02 else w for w in passage.split()]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "o", 1, "i", "s") for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("width", "bucket", "size"), [(35, 16 << 20, 32 << 20), (12, 2000, 5000), (3, 1 << 16, 1 << 14)])
def test_same_as_brute_force(spark, width, bucket, size):
    rows = list(enumerate(texts(width)))
    want = {i: x for (i, _), x in zip(rows, brute([t for _, t in rows], width), strict=True)}
    kept = substrings.remove_repeats(frame(spark, rows), width, bucket=bucket, size=size).collect()
    assert len(kept) == len(rows)
    for r in kept:
        assert (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) == want[r.doc_id]
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_windows_one_by_one_give_the_same(spark, monkeypatch):
    rows = list(enumerate(texts(8)))
    want = sorted((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], 12), strict=True))
    every = lambda texts, width, total, limit: np.unique(np.concatenate([substrings.minimisers((t or "").encode().split(), width, substrings.WordHashes()) for _, t in rows]))
    monkeypatch.setattr(substrings, "frequent_minimisers", every)
    got = substrings.remove_repeats(frame(spark, rows), 12).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == want


def test_same_as_sql(spark):
    rows = [(None, "a " * 40), *enumerate(texts(35)), (3, "a " * 41)]
    kept = substrings.remove_repeats(frame(spark, rows))
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in kept.collect()]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    order = lambda r: tuple(map(str, r))
    assert sorted(got, key=order) == sorted(con.execute(queries.SQL["op12_substrings"]).fetchall(), key=order)


def test_empty_table(spark):
    assert substrings.remove_repeats(frame(spark, [])).collect() == []


def test_equal_codes_of_different_windows(monkeypatch):
    plain = [b"a b c d e", b"b c d x", b"q r s", b"c d e"]
    want = substrings.repeated_windows(plain, 3)
    monkeypatch.setattr(substrings, "window_codes", lambda codes, width: np.zeros(len(codes) - width + 1, dtype=np.uint64))
    got = substrings.repeated_windows(plain, 3)
    assert [x.tolist() for x in got] == [x.tolist() for x in want] == [[0, 0, 1, 3], [1, 2, 0, 0]]


def test_minimisers_are_smallest_runs():
    words = [f"w{k % 7}".encode() for k in range(60)]
    hashes = substrings.WordHashes()
    codes = substrings.shingle_codes(words, substrings.RUN, hashes)
    assert substrings.minimisers(words, 35, hashes).tolist() == [codes[i : i + 30].min() for i in range(26)]
