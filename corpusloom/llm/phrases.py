"""Phrase mining: word-id n-grams counted in counting quotient filters that shards make and buckets merge.

A phrase is a number: the ids of its words side by side. An invertible permutation spreads these numbers evenly; the
leading bits of the result, the quotient, are stored as run lengths, the rest, the remainder, in full. So a filter is a
compact sorted table that loses nothing: merged, it gives every phrase back with its exact count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stash, release_memory, sorted_groups, stash, workspace

#: Piece ends become a byte that UTF-8 never has, tabs become spaces, A-Z becomes a-z.
_CUT = b"\xff"
_BYTES = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\tABCDEFGHIJKLMNOPQRSTUVWXYZ", _CUT * 10 + b" abcdefghijklmnopqrstuvwxyz")
_ODD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

CHUNKS = "chunk long, lang string, words array<string>, counts array<long>, codes binary"
FILTERS = "segment int, n int, runs binary, rests binary, counts binary, larger binary"


class LocalIds(dict):
    """Numbers words from 1 in the order of their first use; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, with a mark at each end of a piece."""
    return text.translate(_BYTES).replace(_CUT, b" " + _CUT + b" ").split(b" ")


def _chunked(size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts of one language gathered to chunks of some ``size`` bytes; at most that much is held over all languages."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}  # language: [word ids, runs of ids, bytes]
        number = TaskContext.get().partitionId() << 32

        def give(lang: str) -> pa.RecordBatch:
            nonlocal number
            ids, parts, _ = held.pop(lang)
            codes = np.concatenate(parts)
            counts = np.bincount(codes, minlength=len(ids))
            counts[:2] = 0  # the ends of pieces, and what is empty between two spaces
            number += 1
            words = pa.array(list(ids), type=pa.binary())
            words = pa.array([None if w in (_CUT, b"") else w for w in words.to_pylist()], type=pa.binary()).cast(pa.string())
            arrays = [pa.array([number]), pa.array([lang]), pa.ListArray.from_arrays([0, len(ids)], words), pa.ListArray.from_arrays([0, len(ids)], pa.array(counts.astype(np.int64)))]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([codes[codes != 1].astype("<i4").tobytes()], type=pa.binary())], ["chunk", "lang", "words", "counts", "codes"])

        total = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if lang not in held:
                    held[lang] = [LocalIds({_CUT: 0, b"": 1}), [], 0]
                mine, words = held[lang], tokens(text)
                words.append(_CUT)
                mine[1].append(np.fromiter(map(mine[0].__getitem__, words), dtype=np.int32, count=len(words)))
                mine[2] += len(text)
                total += len(text)
                if total >= size:
                    most = max(held, key=lambda x: held[x][2])
                    total -= held[most][2]
                    yield give(most)
        for lang in list(held):
            yield give(lang)
        release_memory()

    return run


def _globally(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's local ids as the ids of the kept vocabulary; all other words become 0, as piece ends are."""
    if not left.num_rows or not right.num_rows:
        return pa.table({"ids": pa.array([], type=pa.binary())})
    codes = np.frombuffer(left["codes"][0].as_py(), dtype="<i4")
    places = right["pos"].to_numpy()
    known = np.zeros(max(int(codes.max(initial=0)), int(places.max())) + 1, dtype="<u4")
    known[places] = right["id"].to_numpy()
    return pa.table({"ids": pa.array([known[codes].tobytes()], type=pa.binary())})


class Packing:
    """Phrases of ``n`` words as permuted numbers of ``n * bits`` bits, in one or two unsigned words."""

    def __init__(self, n: int, bits: int) -> None:
        if bits > 32:
            raise ValueError("a phrase is packed in 128 bits: at most 2**32 - 1 different words can be kept")
        self.n, self.bits, self.first = n, bits, (n + 1) // 2
        self.left, self.right = bits * self.first, bits * (n - self.first)
        self.wide = self.left + self.right > 64
        self.high = self.left if self.wide else self.left + self.right  # bits of the first unsigned word

    @staticmethod
    def _mix(x: np.ndarray, k: int, bits: int) -> np.ndarray:
        y = (x + np.uint64(k + 1)) * np.uint64(_ODD[k])
        y = (y ^ (y >> np.uint64(29))) * np.uint64(_ODD[(k + 1) % 4])
        return (y ^ (y >> np.uint64(32))) & np.uint64((1 << bits) - 1)

    def pack(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """A Feistel network: each half in turn is changed by what the other half holds, so it can be undone."""
        halves = []
        for part in (words[: self.first], words[self.first :]):
            half = np.zeros(len(part[0]), dtype=np.uint64)
            for w in part:
                half = half << np.uint64(self.bits) | w.astype(np.uint64)
            halves.append(half)
        a, b = halves
        for k in (0, 2):
            a = a ^ self._mix(b, k, self.left)
            b = b ^ self._mix(a, k + 1, self.right)
        return (a, b) if self.wide else (a << np.uint64(self.right) | b, np.empty((len(a), 0), dtype=np.uint64))

    def unpack(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        a, b = (high, low) if self.wide else (high >> np.uint64(self.right), high & np.uint64((1 << self.right) - 1))
        for k in (2, 0):
            b = b ^ self._mix(a, k + 1, self.right)
            a = a ^ self._mix(b, k, self.left)
        mask, out = np.uint64((1 << self.bits) - 1), []
        for half, count in ((a, self.first), (b, self.n - self.first)):
            out += [half >> np.uint64(self.bits * k) & mask for k in range(count - 1, -1, -1)]
        return np.stack(out, axis=1).astype(np.int64)

    def summed(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted, equal numbers once with their counts added; sorted runs that are already there merge."""
        if not len(high):
            return high, low, counts
        order = np.lexsort((low, high)) if self.wide else np.argsort(high, kind="stable")
        high, low = high[order], low[order]
        new = np.ones(len(high), dtype=bool)
        new[1:] = high[1:] != high[:-1]
        if self.wide:
            new[1:] |= low[1:] != low[:-1]
        at = np.flatnonzero(new)
        return high[at], low[at], np.add.reduceat(counts[order], at)


class Layout:
    """How a filter is stored: ``segments`` bits choose the bucket, ``quotient`` bits are kept as run lengths."""

    def __init__(self, packing: Packing, segments: int, entries: int) -> None:
        self.packing, self.segments = packing, min(segments, packing.high)
        most = min(packing.high, max(self.segments, entries.bit_length()))
        whole = [q for q in range(self.segments, most + 1) if (packing.high - q) % 8 == 0]
        self.quotient = whole[-1] if whole else most  # remainders in whole bytes
        self.rest, self.low = -(-(packing.high - self.quotient) // 8), -(-packing.right // 8) if packing.wide else 0

    def encode(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
        """A sorted table as rows, one for each segment: run lengths in unary, remainders, counts of a byte and larger ones."""
        drop, inner = np.uint64(self.packing.high - self.quotient), self.quotient - self.segments
        quotient = high >> drop if drop < 64 else np.zeros_like(high)
        segment = (quotient >> np.uint64(inner)).astype(np.int64)
        at = np.append(np.flatnonzero(np.diff(segment, prepend=-1)), len(high))
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            runs = np.zeros((1 << inner) + j - i, dtype=np.uint8)
            runs[(quotient[i:j] & np.uint64((1 << inner) - 1)).astype(np.int64) + np.arange(j - i)] = 1
            rests = [x[i:j].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - k :] for x, k in ((high & np.uint64((1 << int(drop)) - 1), self.rest), (low, self.low)) if k]
            c = counts[i:j]
            yield {
                "segment": int(segment[i]), "n": j - i, "runs": np.packbits(runs).tobytes(), "rests": b"".join(np.ascontiguousarray(x).tobytes() for x in rests),
                "counts": np.minimum(c, 255).astype(np.uint8).tobytes(), "larger": c[c >= 255].astype("<i8").tobytes(),
            }

    def decode(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, inner = row["n"], self.quotient - self.segments
        places = np.flatnonzero(np.unpackbits(np.frombuffer(row["runs"], dtype=np.uint8), count=(1 << inner) + n))
        quotient = (places - np.arange(n)).astype(np.uint64) + np.uint64(row["segment"] << inner)
        raw, parts, at = np.frombuffer(row["rests"], dtype=np.uint8), [], 0
        for k in (self.rest, self.low):
            whole = np.zeros((n, 8), dtype=np.uint8)
            if k:
                whole[:, 8 - k :] = raw[at : at + n * k].reshape(n, k)
            at += n * k
            parts.append(whole.view(">u8").ravel().astype(np.uint64))
        drop = self.packing.high - self.quotient
        high = (quotient << np.uint64(drop) if drop < 64 else 0) | parts[0]
        counts = np.frombuffer(row["counts"], dtype=np.uint8).astype(np.int64)
        counts[counts == 255] = np.frombuffer(row["larger"], dtype="<i8")
        return high, parts[1] if self.packing.wide else np.empty((n, 0), dtype=np.uint64), counts


def _bit_of(words: list[np.ndarray], bits: int) -> np.ndarray:
    h = np.zeros(len(words[0]), dtype=np.uint64)
    for w in words:
        h = (h ^ w.astype(np.uint64)) * np.uint64(_ODD[2])
        h ^= h >> np.uint64(31)
    return (h * np.uint64(_ODD[0])) >> np.uint64(64 - bits)


def _counted(layout: Layout, entries: int, known: tuple | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Phrases of a task's chunks as filters of at most about twice ``entries`` phrases each."""
    part, packing, schema = 1 << 18, layout.packing, pa.schema([("segment", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("runs", "rests", "counts", "larger"))])

    def phrases_in(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = ids[: len(ids) - packing.n + 1] > 0
        for k in range(1, packing.n):
            good &= ids[k : k + len(good)] > 0
        at = np.flatnonzero(good)
        if known is not None:  # a phrase can be frequent only if both that are shorter by a word are
            table, bits = np.frombuffer(known[0].value, dtype=np.uint8), known[1]
            for k in (0, 1):
                bit = _bit_of([ids[at + k + j] for j in range(packing.n - 1)], bits)
                at = at[table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0]
        return packing.pack([ids[at + k] for k in range(packing.n)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (*packing.pack([np.empty(0, dtype=np.uint64)] * packing.n), np.empty(0, dtype=np.int64))
        held, fresh, waiting = empty, [], 0
        for batch in batches:
            for blob in batch.column(0):
                ids = np.frombuffer(blob.as_buffer(), dtype="<u4")
                for i in range(0, len(ids) - packing.n + 1, part):
                    high, low = phrases_in(ids[i : i + part + packing.n - 1])
                    fresh.append((high, low, np.ones(len(high), dtype=np.int64)))
                    waiting += len(high)
                    if waiting >= entries:
                        held = packing.summed(*(np.concatenate(x) for x in zip(held, *fresh, strict=True)))
                        fresh, waiting = [], 0
                        if len(held[0]) >= entries:
                            yield pa.RecordBatch.from_pylist(list(layout.encode(*held)), schema=schema)
                            held = empty
        if fresh:
            held = packing.summed(*(np.concatenate(x) for x in zip(held, *fresh, strict=True)))
        if len(held[0]):
            yield pa.RecordBatch.from_pylist(list(layout.encode(*held)), schema=schema)
        release_memory()

    return run


def _merged(layout: Layout, least: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in sorted_groups(batches, ["segment"]):
            high, low, counts = layout.packing.summed(*(np.concatenate(x) for x in zip(*map(layout.decode, group.to_pylist()), strict=True)))
            kept = counts >= least
            words = layout.packing.unpack(high[kept], low[kept])
            ends = pa.array(np.arange(len(words) + 1, dtype=np.int32) * layout.packing.n)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(words.ravel())), pa.array(counts[kept])], ["p", "f"])
        release_memory()

    return run


def _bitmap(spark: SparkSession, phrases: DataFrame, most: int) -> tuple | None:
    """Which phrases are frequent, as a broadcast bitmap of at most 2**most bits; some others pass, none is missed."""
    bits = max(16, min(most, (16 * phrases.count()).bit_length()))

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                bit = _bit_of([words[:, k] for k in range(words.shape[1])], bits).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bit >> 5), pa.array(np.int64(1) << (bit & 31))], ["place", "bit"])

    set_ = phrases.select("p").mapInArrow(places, "place long, bit long").groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << bits - 5, dtype="<u4")
    table[set_["place"].to_numpy()] = set_["bits"].to_numpy()
    return spark.sparkContext.broadcast(table.tobytes()), bits


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, text: str = "text", lang: str = "lang", chunk: int = 8 << 20, entries: int = 1 << 20, filter_bits: int = 27) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The words and phrases that occur ``least`` times or more in their language, with exact counts.

    Returns (words: id, lang, word, f), (phrases: p, the word ids, and f) and (totals: lang, n). A null text is empty, a
    null language is ``und``. Texts are read once into chunks of some ``chunk`` bytes; a single longer text is held whole.
    Each length is counted in filters of ``entries`` phrases a task, merged by segment. Longer phrases are counted only
    where both of their parts shorter by a word pass a bitmap of ``2**filter_bits`` bits at most (16 MB), whose false
    hits the exact count removes: where it is crowded more phrases travel, none is lost.
    """
    spark = docs.sparkSession
    space = workspace(spark)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chunks = stash(rows.mapInArrow(_chunked(chunk), CHUNKS), space, "chunks")
    totals = chunks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    totals = stash(totals, space, "totals")

    uses = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w")).where("w.counts > 0").select("chunk", "lang", "pos", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    words = uses.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = stash(words.withColumn("mid", F.monotonically_increasing_id()), space, "mids")
    sizes = sorted((r["part"], r["n"]) for r in words.groupBy(F.shiftright("mid", 33).alias("part")).agg(F.count("*").alias("n")).collect())  # a row a partition
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part long, before long")
    words = words.join(F.broadcast(offsets), F.shiftright("mid", 33) == F.col("part")).select((F.col("before") + F.col("mid").bitwiseAND((1 << 33) - 1) + 1).alias("id"), "lang", "word", "f")
    words = stash(words, space, "words")
    bits = max(1, before[-1].bit_length())

    pairs = uses.join(words.select("id", "lang", "word"), ["lang", "word"]).select(F.col("chunk").alias("of"), "pos", "id")
    coded = chunks.select("chunk", "codes").groupBy("chunk").cogroup(pairs.groupBy("of")).applyInArrow(_globally, "ids binary")
    coded = stash(coded, space, "coded")
    drop_stash(spark, space, "chunks")

    tokens_ = totals.agg(F.sum("n")).first()[0] or 0
    segments = max(9, (tokens_ // (2 << 20)).bit_length())
    phrases, known = None, None
    for n in range(2, longest + 1):
        layout = Layout(Packing(n, bits), segments, entries)
        filters = coded.mapInArrow(_counted(layout, entries, known), FILTERS).repartition("segment").sortWithinPartitions("segment")
        found = stash(filters.mapInArrow(_merged(layout, least), "p array<long>, f long"), space, f"phrases{n}")
        known = _bitmap(spark, found, filter_bits) if n < longest else None
        phrases = found if phrases is None else phrases.union(found)
    return words, phrases, totals


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, text: str = "text", lang: str = "lang") -> DataFrame:
    """The best phrases of 2 to 4 words of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is that of its worst cut, floor(2000000 a / (l + r)), in exact decimal arithmetic; ties go to the
    smallest first part. A phrase inside a longer frequent one that has 80 % of its occurrences is left out. Ranks go by
    score, then occurrences, then bytes. Null texts are empty, null languages ``und``; a table without frequent phrases,
    an empty one too, gives no row. Repeated rows count as often as they are there.
    """
    words, phrases, totals = frequent_phrases(docs, least, 4, text, lang)
    known = words.select(F.array("id").alias("p"), "f").union(phrases)
    size = F.size("p")

    cuts = phrases.select("p", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.slice("p", 1, F.col("k")), "others": F.slice("p", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(known.select(F.col("p").alias("first"), F.col("f").alias("l")), "first").join(known.select(F.col("p").alias("others"), F.col("f").alias("r")), "others")
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.groupBy("p").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("b")).select("p", "b.*")

    spans = F.filter(
        F.transform(F.sequence(F.lit(0), size * size - 1), lambda x: F.slice("p", F.floor(x / size).cast("int") + 1, (x % size).cast("int") + 1)),
        lambda s: (F.size(s) >= 2) & (F.size(s) < size),
    )
    inside = phrases.where(size > 2).select(F.col("f").alias("longer"), F.explode(F.array_distinct(spans)).alias("p")).groupBy("p").agg(F.max("longer").alias("longer"))
    kept = best.join(inside, "p", "left").where("longer is null or 5 * longer < 4 * a").drop("longer")

    kept = kept.join(words.select("id", "lang"), F.col("id") == F.col("p")[0]).drop("id")
    rank = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    kept = kept.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")  # ties wait for their words
    spelled = kept.select("*", F.posexplode("p").alias("at", "id")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("p", "lang", "score", "a", "l", "r").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    spelled = spelled.withColumn("phrase", F.array_join(F.transform("w", lambda x: x["word"]), " "))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    ranked = spelled.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
