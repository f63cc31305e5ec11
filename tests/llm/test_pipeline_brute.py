"""Every stage of the pipeline on 300 documents against a plain version on the stage's own input."""

import random
import re

import corpus_pipeline

from corpusloom.llm import toxicity

WORDS = [a + b for a in ("ba", "lo", "mi", "ru", "te", "so", "ka") for b in ("n", "s", "ra", "ki", "du", "vo")]
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def shingles(words, width=5):
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def made(rng):
    text = lambda n: [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    items = [text(rng.randrange(12, 40)) for _ in range(8)]
    docs = [text(rng.randrange(20, 120)) for _ in range(150)]
    while len(docs) < 300:
        kind, words = rng.randrange(4), list(rng.choice(docs[:150]))
        if kind == 0:  # near copies on both sides of the threshold, by single words, cut ends and added ends
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = "other"
        elif kind == 1:
            words = words[: int(len(words) * rng.uniform(0.7, 1))] if rng.random() < 0.5 else words + text(rng.randrange(len(words) // 3))
        elif kind == 2:  # an item, whole or with holes
            item = [w if rng.random() < 0.97 else "hole" for w in rng.choice(items)]
            words = text(rng.randrange(60)) + item + text(rng.randrange(60))
        else:
            words = text(80)
            for at in rng.sample(range(80), 3):
                words[at] = f"{rng.choice(WORDS)}.{rng.choice(WORDS)}@{rng.choice(WORDS)}.org"
        docs.append(words)
    toxic = set(rng.sample(range(300), 60))
    for k in toxic:
        for at in rng.sample(range(len(docs[k])), len(docs[k]) // 8):
            docs[k][at] = rng.choice(["vilest", "nastiest", "filthy"])
    return [" ".join(w) for w in docs], [" ".join(w) for w in items], toxic


def near_kept(rows):
    sets = {k: shingles(t.lower().split()) for k, t in rows.items()}
    label = {k: k for k in rows}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    ids = sorted(rows)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {k for k in ids if root(k) == k}


def clean_of(rows, items):
    plain = lambda t: re.findall("[a-z0-9]+", t.lower())
    wanted = [shingles(plain(i)) for i in items]
    return {k for k, t in rows.items() if not any(len(w & shingles(plain(t))) >= 0.8 * len(w) - 1e-9 for w in wanted)}


def test_stages_do_what_plain_versions_do(spark, tmp_path):
    rng = random.Random(21)
    texts, items, toxic = made(rng)
    rows = [(k, t, "aa", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), [dict(enumerate(texts))]
    scored = toxicity.score(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    judged = {r.doc_id: r.predicted for r in scored.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append({r.doc_id: r.text for r in docs.collect()})
    assert set(seen[1]) == {k for k in seen[0] if not judged[k]}
    assert len(set(seen[1]) & toxic) <= 4 and len(set(seen[0]) - toxic - set(seen[1])) <= 4
    assert set(seen[2]) == near_kept(seen[1]) and len(seen[2]) < len(seen[1])
    assert set(seen[3]) == clean_of(seen[2], items) and len(seen[3]) < len(seen[2])
    assert seen[4] == {k: EMAIL.sub("[EMAIL]", t) for k, t in seen[3].items()} and seen[4] != seen[3]

    mix = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    sizes = {k: len(t.split()) for k, t in seen[4].items()}
    assert {r.doc_id: r.size for r in mix} == sizes
    assert all(0 <= r.taken <= 2 * r.size for r in mix)
    for s in range(3):
        mine = [r for r in mix if r.doc_id % 3 == s]
        assert all(r.source_size == sum(sizes[x.doc_id] for x in mine) for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(sizes.values())
    assert abs(sum({r.doc_id % 3: r.target for r in mix}.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values())
