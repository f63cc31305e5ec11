"""SimHash and vector joins against brute force, with nulls, copies and hot groups."""

import random

import numpy as np
import pytest
import xxhash

from corpusloom.llm import near_copies, simhash, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, rep string"


def linked(ids, near):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            low = min(label[b] for b in ids if near(a, b))
            if low < label[a]:
                label[a], changed = low, True
    return label


def reference_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(r, 42) >> b & 1 for r in runs) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(runs)) if runs else 0


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", 1, "x", "y") for i, t in texts], DOCS)


def test_simhash_matches_brute_force(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(40)}" for _ in range(300)]
    texts = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "a b"), (5, "a b"), (6, "É é x y")]
    for i in range(40):
        words = list(base)
        for _ in range(i % 5):
            words[rng.randrange(300)] = f"z{rng.randrange(99)}"
        texts.append((10 + i, " ".join(words)))
    texts += [(100 + i, " ".join(rng.choices("abcdefgh", k=rng.randrange(1, 9)))) for i in range(60)]
    rows = simhash.simhash_groups(docs_of(spark, texts)).collect()
    assert len(rows) == len(texts)
    fp = {i: reference_fingerprint(t) for i, t in texts}
    want = linked(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    for r in rows:
        assert r.fingerprint == f"{fp[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]


@pytest.mark.parametrize(("radius", "chunk"), [(3, 4096), (3, 16), (7, 4096), (7, 16)])
def test_hamming_links_in_dense_groups(spark, radius, chunk):
    from corpusloom.llm.common import components, workspace

    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(50)}
    centre = rng.getrandbits(64)
    for _ in range(150):
        x = centre
        for _ in range(rng.randrange(1, 10)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    rows = [(k, int(np.uint64(x).astype(np.int64))) for k, x in enumerate(sorted(fps))]
    by = {k: x & (2**64 - 1) for k, x in rows}
    df = spark.createDataFrame(rows, "rep long, fp long")
    found = dict.fromkeys(by)
    for r in components(simhash.hamming_links(df, radius, chunk), workspace(spark)).collect():
        found[r.node] = r.component
    want = linked(sorted(by), lambda a, b: (by[a] ^ by[b]).bit_count() <= radius)
    assert {k: v if v is not None else k for k, v in found.items()} == want


def test_near_duplicates_are_verified(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    near, far = list(base), list(base)
    near[200] = "changed"
    far[0:200] = [f"v{k}" for k in range(200)]
    texts = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base).upper()), (4, " ".join(far)), (5, None), (6, ""), (7, "x"), (1, " ".join(base)), (None, "x")]
    kept = near_copies.drop_near_duplicates(docs_of(spark, texts))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 4, 5, 7]


def test_lone_pairs_at_the_threshold(spark):
    rng = random.Random(11)
    texts, pairs = [], []

    def shingles(words):
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    def similarity(a, b):
        a, b = shingles(a), shingles(b)
        return len(a & b) / len(a | b)

    for k in range(60):
        base = [f"w{rng.randrange(10**5)}" for _ in range(rng.randrange(60, 900))]
        edited = list(base)
        if k % 3 == 0:
            places = list(range(2, len(base), 5))
            rng.shuffle(places)
            for at in places:
                tried = edited[:at] + [f"z{at}"] + edited[at + 1 :]
                if similarity(base, tried) < 0.8:
                    break
                edited = tried
        elif k % 3 == 1:
            edited += [f"z{i}" for i in range(int(0.24 * (len(base) - 4)))]
        else:
            edited = base[: len(base) - int(0.19 * (len(base) - 4))]
        assert 0.8 <= similarity(base, edited) < 0.86
        texts += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edited))]
        pairs += [(2 * k, 2 * k), (2 * k + 1, 2 * k)]
    below = [f"v{i}" for i in range(500)]
    texts += [(1000, " ".join(below)), (1001, " ".join(below[:390]))]  # similarity 0.778
    pairs += [(1000, 1000), (1001, 1001)]
    got = near_copies.near_duplicate_groups(docs_of(spark, texts)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == pairs


def test_repeated_ids_lose_no_text(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    kept = near_copies.drop_near_duplicates(docs_of(spark, [(1, a), (5, b), (5, a), (7, c), (5, b), (None, a), (8, b)])).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == [(-1, a), (1, a), (5, b), (7, c)]


@pytest.mark.parametrize("options", [{}, {"chunk": 8, "chunk_shingles": 300, "drawn": 20}])
def test_dense_groups_match_brute_force(spark, options):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**4)}" for _ in range(90)]
    texts = [(900, None), (901, ""), (902, " \n"), (903, "lone"), (904, "LONE"), (905, "x y"), (906, "x y z v w " * 3000), (907, "x y z v w " * 2000)]
    for k in range(140):
        words = list(base)
        for _ in range(k % 8):
            words[rng.randrange(90)] = f"z{rng.randrange(30)}"
        texts.append((k, " ".join(words)))
    passage = " ".join(f"p{k}" for k in range(30))
    texts += [(500 + k, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 60)))) for k in range(60)]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    of = {i: shingles(t) for i, t in texts}
    want = linked(sorted(of), lambda a, b: of[a] == of[b] or len(of[a] & of[b]) >= 0.8 * len(of[a] | of[b]) - 1e-9)
    assert len(set(want.values())) > 40
    got = near_copies.near_duplicate_groups(docs_of(spark, texts), **options).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_empty_tables(spark):
    assert simhash.simhash_groups(docs_of(spark, [])).count() == 0
    assert near_copies.drop_near_duplicates(docs_of(spark, [])).count() == 0
    assert vectors.vector_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("chunk", [16384, 20])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_match_brute_force(spark, chunk, kind):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((120, 16))
    v[60:110] = v[3] + 0.25 * rng.standard_normal((50, 16))
    v[110:120] = v[7]
    v = v.astype(np.float32).astype(np.float64)
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    odd = [(200, None), (201, [0.0] * 16), (202, [1.0, None] + [0.0] * 14), (203, [float("nan")] * 16), (204, [1.0, 2.0]), (205, [2.0, 4.0]), (206, [float("inf")] * 16), (207, [])]
    df = spark.createDataFrame([(i, x, "l", 1) for i, x in rows + odd], f"vec_id long, embedding array<{kind}>, label string, rep long")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    want = linked(range(120), lambda a, b: near[a, b])
    got = {r.vec_id: r for r in vectors.vector_groups(df, chunk=chunk).collect()}
    assert len(got) == 128
    for k in range(120):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (near[k].sum() - 1, want[k], want[k] == k)
    for k in (200, 201, 202, 203, 206, 207):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert (got[204].n_links, got[205].component_id) == (1, 204)
