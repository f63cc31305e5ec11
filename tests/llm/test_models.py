"""Language and toxicity models: gradients, held-out accuracy, odd inputs."""

import random

import numpy as np

from corpusloom.llm import langid, toxicity, wordforms

SYLLABLES = {"aa": ["ba", "lo", "mi", "ru"], "bb": ["sch", "ung", "ver", "ein"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_languages_and_code_switching(spark):
    rng = random.Random(1)
    rows = [(k, sentence(rng, lang := ("aa", "bb")[k % 2], 40), lang, 1) for k in range(160)]
    mixed = sentence(rng, "aa", 30) + " " + sentence(rng, "bb", 10)
    rows += [(500, mixed, None, 1), (501, None, "aa", 1), (502, "12 34 !", "bb", 1), (503, "", None, 1), (None, sentence(rng, "bb", 9), None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(got) == len(rows)
    held = [(r[2], got[r[0]].lang_pred) for r in rows[:160] if got[r[0]].held_out]
    assert held and all(a == b for a, b in held)
    assert got[500].lang_pred == "aa" and 0.6 < got[500].score < 0.9
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (501, 502, 503))
    assert got[None].lang_pred == "bb" and not got[None].held_out
    assert langid.identify(df.limit(0)).count() == 0
    alone = langid.identify(df.where("lang = 'aa' and doc_id < 500")).collect()
    assert {r.lang_pred for r in alone} == {"aa"}


def test_forward_backward_matches_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    crf = langid.Crf(["x", "y"])
    crf.p["move"][:] = rng.standard_normal((2, 2))
    crf.p["start"][:] = rng.standard_normal(2)
    e = rng.standard_normal((4, 1, 2)).astype(np.float32)
    weight = {}
    for path in itertools.product(range(2), repeat=4):
        s = crf.p["start"][path[0]] + sum(e[t, 0, y] for t, y in enumerate(path)) + sum(crf.p["move"][a, b] for a, b in zip(path, path[1:], strict=False))
        weight[path] = np.exp(s)
    total = sum(weight.values())
    want = np.array([[sum(w for p, w in weight.items() if p[t] == y) / total for y in range(2)] for t in range(4)])
    g, moves = crf.posteriors(e, np.array([4]))
    assert np.allclose(g[:, 0], want, atol=1e-5)
    pairs = [[sum(w * sum(p[t : t + 2] == (a, b) for t in range(3)) for p, w in weight.items()) / total for b in range(2)] for a in range(2)]
    assert np.allclose(moves, pairs, atol=1e-4)
    sums, _ = crf._marginals(e, np.array([4]))
    assert np.allclose(sums[0], want.sum(axis=0), atol=1e-4)


def test_predictions_match_enumerated_paths():
    """Labels and scores of short texts against sums over all label paths, each path scored word by word."""
    import itertools

    rng = random.Random(6)
    words = [[sentence(rng, lang, 1) for _ in range(rng.randrange(1, 7))] for lang in ("aa", "bb") * 20]
    crf = langid.Crf(["aa", "bb", "cc"])
    crf.fit([[sentence(rng, lang, 1) for _ in range(30)] for lang in ("aa", "bb")] * 8 + [["zzz"] * 20], [0, 1] * 8 + [2], rounds=15)
    got = crf.shares(words)
    for text, share in zip(words, got, strict=True):
        e = crf.emissions(wordforms.Forms(text, crf.buckets))
        want, total = np.zeros(3), 0.0
        for path in itertools.product(range(3), repeat=len(text)):
            w = np.exp(crf.p["start"][path[0]] + sum(e[t, y] for t, y in enumerate(path)) + sum(crf.p["move"][a, b] for a, b in zip(path, path[1:], strict=False)))
            want += w * np.bincount(path, minlength=3)
            total += w
        assert np.allclose(share, want / total / len(text), atol=1e-3)


def test_gru_gradients_match_differences():
    rng = np.random.default_rng(2)
    net = toxicity.BiGru(["a", "cc"])
    words = ["a", "b", "cc", "ddé"]
    ids, sizes = rng.integers(0, 4, (5, 3)), np.array([5, 3, 1])
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.forward(ids, sizes, net.inputs(words))
        return float(np.sum(np.log1p(np.exp(z)) - y * z))

    keep = {}
    forms, x = wordforms.Forms(words, toxicity.BUCKETS), net.inputs(words)
    z = net.forward(ids, sizes, x, keep)
    d = (1 / (1 + np.exp(-z)) - y).astype(np.float32)
    grads, d_x = net.gradients(ids, x, keep, d)
    grads |= net.input_gradients(net.own(words), forms, d_x)
    for name in ("out", "att", "att_out", "in_f", "in_b", "in_bias_f", "move_f", "move_b", "word", "char", "edge"):
        flat, g = net.p[name].reshape(-1), grads[name].reshape(-1)
        for k in np.argsort(-np.abs(g))[:3]:
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-2 - g[k]) < 2e-2 * max(1, abs(g[k])), name


def test_score_is_that_of_the_highest_window():
    rng = random.Random(4)
    net = toxicity.BiGru(["lo", "ba"], seed=1)
    net.blank = 0.1
    texts = [sentence(rng, "aa", n).split() for n in (1, 5, 63, 64, 65, 130, 700)] + [[]]
    got = net.scores(texts)
    for words, s in zip(texts, got, strict=True):
        n, best = len(words), -np.inf
        starts = [0] if n <= toxicity.WINDOW else [*range(0, n - toxicity.WINDOW, toxicity.STRIDE), n - toxicity.WINDOW]
        for a in starts:
            window = words[a : a + toxicity.WINDOW]
            x, ids = net.inputs(window or ["_"]), np.arange(max(1, len(window)))[:, None]
            best = max(best, float(net.forward(ids, np.array([len(window)]), x)[0]))
        assert abs(s - (1 / (1 + np.exp(-best)) if words else 0.1)) < 1e-5


def test_fit_windows_of_long_texts():
    words = [f"w{k}" for k in range(5000)]
    text = " ".join(words)
    drawn = toxicity._fit_windows(text, 10)
    assert len(drawn) == 10 and drawn == toxicity._fit_windows(text, 10) and all(len(w) == toxicity.WINDOW for w in drawn)
    assert toxicity._fit_windows(None, 10) == [[]] == toxicity._fit_windows("", 10)
    assert len(toxicity._fit_windows(" ".join(words[:200]), 10)) == 4


def test_windows_cover_and_overlap():
    owner, first, n = toxicity.windows(np.array([0, 10, 64, 65, 200]))
    for text, size in enumerate((0, 10, 64, 65, 200)):
        mine = [(int(a), int(a + k)) for o, a, k in zip(owner, first, n, strict=True) if o == text]
        assert mine[0][0] == 0 and mine[-1][1] == size
        assert all(b > c for (_, b), (c, _) in zip(mine, mine[1:], strict=False))


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(500):
        words = sentence(rng, "aa", 60).split()
        toxic = k % 3 == 0
        for _ in range(4 if toxic else 0):
            words[rng.randrange(60)] = rng.choice(["vile", "nasty", "xkbad" + rng.choice(SYLLABLES["aa"])])
        rows.append((k, " ".join(words), "aa", 0))
        labels.append((k, 1, int(toxic)))
    rows += [(900, "", "aa", 0), (901, None, None, 0), (902, "lo " * 3000 + "vile nasty vile " + "mi " * 3000, "aa", 0)]
    rows += [(903, "!!!", "aa", 0), (904, "", "aa", 0), (905, None, "aa", 0), (None, rows[0][1], "aa", 0)]
    labels += [(904, 1, 0), (905, 1, 0), (3, 1, 0)]  # labelled texts without words, an id with both labels
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, predicted int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, marks).collect()}
    assert toxicity.score(docs, marks).count() == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [k for k in range(500) if got[k].held_out]
    assert sum(got[k].predicted == (k % 3 == 0) for k in held) >= 0.95 * len(held)
    assert got[902].predicted == 1 and got[900].predicted == 0 and got[901].predicted == 0
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if not r.predicted}
    assert toxicity.score(docs, marks.where("toxic = 0")).agg({"score": "max"}).first()[0] == 0
    assert toxicity.score(docs.limit(0), marks).count() == 0
