"""Near-dedup, redaction and the whole pipeline on tables with clashing names, map columns, nulls, repeated rows, no rows."""

import random
from collections import Counter

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.llm import contamination, near_copies, pii
from corpusloom.llm.common import BATCH_BYTES, WordHashes

WORDS = [a + b for a in ("ba", "lo", "mi", "ru", "te", "so") for b in ("n", "s", "ra", "ki", "du")]


def texts(rng, n, words=30):
    return [" ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(words)) for _ in range(n)]


def test_near_dedup_of_two_columns_with_a_repeated_row(spark):
    a, b, c = texts(random.Random(1), 3)
    rows = [(1, a), (1, a), (2, b), (None, c), (None, c), (3, a), (4, None), (5, ""), (1, b)]
    got = near_copies.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(1, a), (1, b), (None, c), (None, c), (4, None)])


def test_near_dedup_keeps_columns_of_any_name_and_type(spark):
    a, b = texts(random.Random(2), 2)
    names = "__id string, __th long, __gone int, text_hash int, id_of string, HASH_OF int, row_text string, row_place long, th int, n int, rep string, m map<string,int>"
    extra = ("i", 7, 1, 2, "o", 3, "r", 4, 5, 6, "p")
    rows = [(1, a, *extra, {"k": 1}), (1, a, *extra, {"k": 1}), (1, a, "h", *extra[1:], {"k": 2}), (2, b, *extra, None), (3, a, *extra, None)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {names}")
    got = near_copies.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [rows[2], rows[3]]  # the copy with the smallest columns stays


def test_redaction_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a@b.cd x", 1, "s", 9, 4), (2, None, 2, None, 9, 4)], "doc_id long, text string, __base int, __spans string, base_spans int, All_Spans int")
    got = sorted(map(tuple, pii.redact(docs).collect()))
    assert got == [(1, "[EMAIL] x", 1, "s", 9, 4), (2, None, 2, None, 9, 4)]


def written(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __th int, text_hash string, score double").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_with_nulls_empty_texts_repeated_rows_and_extra_columns(spark, tmp_path):
    rng = random.Random(3)
    plain = texts(rng, 60)
    rude = [" ".join(w if k % 6 else "nastiest" for k, w in enumerate(t.split())) for t in texts(rng, 30)]
    rows = [(k, t, "aa", f"s{k % 2}", len(t), 1, "h", 0.5) for k, t in enumerate(plain + rude)]
    rows += [rows[0], rows[1], (200, None, None, None, None, None, None, None), (201, "", None, "s1", 0, 2, "h", None), (None, plain[2] + " end", None, None, 1, 1, "h", 1.0)]
    rows += [(300, " ".join(plain[:20]), "aa", "s0", 9, 1, "h", 0.1)]
    written(spark, tmp_path, rows, [(k, 1, int(k >= 60)) for k in range(90)], [(1, plain[5]), (None, None), (2, "")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        after.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
    left = Counter(r.doc_id for r in docs.collect())
    assert left[0] == left[1] == 1 and left[200] == 1 and left[None] == 1
    assert not left[5] and not left[300]  # they hold the benchmark's item
    mix = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in mix) == left
    assert all(0 <= r.taken <= 2 * r.size for r in mix)


def test_pipeline_without_rows(spark, tmp_path):
    written(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_send_python_workers_a_few_megabytes_at_once(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    spark.conf.unset(BATCH_BYTES)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))
    stages = [lambda: near_copies.drop_near_duplicates(docs.limit(5)), lambda: contamination.decontaminate(docs, docs.limit(0).withColumnRenamed("doc_id", "item_id"))]
    for stage in stages:
        stage()
        got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert len(got) >= 7 and max(got) < 5 << 20
        spark.conf.unset(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, "1m")  # a size that the session sets stands
    stages[1]()
    assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 2 << 20
    spark.conf.unset(BATCH_BYTES)


def test_word_hashes_are_emptied_at_their_bound():
    hashes = WordHashes(10)
    codes = [hashes[str(k % 40).encode()] for k in range(100)]
    assert len(hashes) <= 11 and codes[:20] == codes[40:60] and len(set(codes[:40])) == 40
