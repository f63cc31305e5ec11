"""Removal of repeated word windows: super-k-mers travel to their minimiser's bucket, where sorting finds equal windows.

Consecutive windows whose smallest word run (the minimiser) has the same value travel as one packed string of words.
Equal windows have equal minimisers, so they meet in one bucket, whichever documents they come from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, release_memory, shingle_codes, sorted_groups

RUN = 6  #: words of a run that may be a minimiser
PACKED = "bucket int, texts binary, owners binary, starts binary, ends binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _ODD) ^ (b + (a >> np.uint64(31)))
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_codes(codes: np.ndarray, width: int) -> np.ndarray:
    """A code of every window of ``width`` codes, from the codes of its halves."""
    x, span, n = codes, 1, len(codes) - width + 1
    if n <= 0:
        return codes[:0]
    while span * 2 <= width:
        x = _pairs(x[:-span], x[span:])
        span *= 2
    return x[:n] if span == width else _pairs(x[:n], x[width - span : width - span + n])


def sliding_min(codes: np.ndarray, width: int) -> np.ndarray:
    x, span, n = codes, 1, len(codes) - width + 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x[:n] if span == width else np.minimum(x[:n], x[width - span : width - span + n])


def minimisers(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """The smallest code of a run of words in each window of ``width`` words."""
    run = min(RUN, width)
    return sliding_min(shingle_codes(words, run, hashes), width - run + 1) if len(words) >= width else np.empty(0, dtype=np.uint64)


def digest(text: bytes) -> bytes:
    """A text's key: half of its SHA-256."""
    return hashlib.sha256(text).digest()[:16]


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        yield from (t for t in batch.column(0).cast(pa.binary()).to_pylist() if t)


def _minimisers_of(width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for text in _texts(batches):
            if (key := digest(text)) not in seen:
                seen.add(key)
                m = minimisers(text.split(), width, hashes)
                if len(m):
                    m = m[np.flatnonzero(np.diff(m, prepend=~m[:1]))]
                    yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64))], ["m"])
            if len(seen) > 100_000:
                seen.clear()

    return run


class Buffer:
    """Super-k-mers of a task until they are sent: each string once, with the one place where it occurs.

    Places of a string that occurs twice here are known to repeat and are given out as spans at once; so at most one
    place of each string is sent for each buffer, however many copies of it a group has.
    """

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.size, self.held, self.spans, self.seen = 0, {}, [], set()

    def add(self, packed: bytes, bucket: int, owner: bytes, start: int, count: int) -> None:
        there = self.held.get(packed)
        if there is None:
            self.held[packed] = (bucket, owner, start, count)
            self.size += len(packed)
            return
        self.spans.append((owner, start, start + count))
        if there[2] >= 0:
            self.spans.append((there[1], there[2], there[2] + count))
            self.held[packed] = (bucket, owner, -1, count)

    def rows(self) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("texts", "owners", "starts", "ends"))])
        zip_, spread = zstandard.ZstdCompressor(1), {}
        for packed, (bucket, owner, start, _) in self.held.items():
            spread.setdefault(bucket, []).append((packed, owner, start))
        for bucket, all_ in spread.items():
            texts, owners, starts = zip(*all_, strict=True)
            row = {"bucket": bucket, "texts": zip_.compress(b"\n".join(texts)), "owners": b"".join(owners), "starts": np.array(starts, dtype="<i4").tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=schema)
        spread = {}
        for span in self.spans:
            spread.setdefault(int.from_bytes(span[0][:4]) % self.buckets, []).append(span)
        for bucket, all_ in spread.items():
            owners, starts, ends = zip(*all_, strict=True)
            row = {"bucket": bucket, "owners": b"".join(owners), "starts": np.array(starts, dtype="<i4").tobytes(), "ends": np.array(ends, dtype="<i4").tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=schema)
        self.clear()


def _packed(width: int, buckets: int, hot: np.ndarray, size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, buffer = WordHashes(), Buffer(buckets)
        for text in _texts(batches):
            words = text.split()
            m = minimisers(words, width, hashes)
            if not len(m):
                continue
            owner = digest(text)
            if owner in buffer.seen:  # a copy of a whole text: all of it repeats
                buffer.spans.append((owner, 0, len(words)))
                continue
            buffer.seen.add(owner)
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
            begins = np.append(0, ends)
            at = np.flatnonzero(np.diff(m, prepend=~m[:1]))
            to = np.append(at[1:], len(m)) + width - 1  # the last window ends there
            bucket = (m[at] * _ODD >> np.uint64(33)) % np.uint64(buckets)
            often = np.isin(m[at], hot)
            for i, j, b in zip(at[~often].tolist(), to[~often].tolist(), bucket[~often].tolist(), strict=True):
                buffer.add(joined[begins[i] : ends[j - 1] - 1], b, owner, i, j - i)
            if often.any():  # windows of a frequent minimiser travel one by one, dealt by what they say
                codes = window_codes(np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words)), width)
                for i, j in zip(at[often].tolist(), to[often].tolist(), strict=True):
                    for k in range(i, j - width + 1):
                        buffer.add(joined[begins[k] : ends[k + width - 1] - 1], int(codes[k] >> np.uint64(20)) % buckets, owner, k, width)
            if buffer.size >= size:
                yield from buffer.rows()
        yield from buffer.rows()
        release_memory()

    return run


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeated_windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of the packed texts occur twice or more: (text, first word), sorted.

    Sorted by a code of their words; windows of equal codes are compared word by word, so a collision changes nothing.
    """
    sizes = np.fromiter((t.count(b" ") + 1 for t in texts), dtype=np.int64, count=len(texts))
    words, known = b" ".join(texts).split(b" "), Ids()
    ids = np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words))
    begins = np.cumsum(sizes) - sizes
    inside = np.arange(len(ids)) - np.repeat(begins, sizes)
    at = np.flatnonzero(inside <= np.repeat(sizes, sizes) - width)
    codes = window_codes(ids.astype(np.uint64) + np.uint64(1), width)[at]
    order = np.argsort(codes, kind="stable")
    places, codes = at[order], codes[order]
    near = np.flatnonzero(codes[1:] == codes[:-1])
    same, span = np.zeros(len(near), dtype=bool), np.arange(width)
    for k in range(0, len(near), 1 << 16):
        part = near[k : k + (1 << 16)]
        same[k : k + (1 << 16)] = (ids[places[part][:, None] + span] == ids[places[part + 1][:, None] + span]).all(axis=1)
    hit = np.zeros(len(places), dtype=bool)
    hit[near[same]] = hit[near[same] + 1] = True
    for code in np.unique(codes[near[~same]]):  # different windows with one code: count them by their words
        i, j = np.searchsorted(codes, code, "left"), np.searchsorted(codes, code, "right")
        _, of, count = np.unique(ids[places[i:j][:, None] + span], axis=0, return_inverse=True, return_counts=True)
        hit[i:j] = count[of.ravel()] > 1
    found = np.sort(places[hit])
    text = np.searchsorted(begins, found, "right") - 1
    return text, inside[found]


def _judged(width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(owners: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(owners), [None, pa.py_buffer(owners.tobytes())]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([keys, pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32))], ["owner", "start", "end"])

        unzip = zstandard.ZstdDecompressor()
        for _, group in sorted_groups(batches, ["bucket"]):
            texts, owners, starts = [], [], []
            for row in group.to_pylist():
                own, begin = np.frombuffer(row["owners"], dtype="V16"), np.frombuffer(row["starts"], dtype="<i4")
                if row["texts"] is None:
                    yield spans(own, begin, np.frombuffer(row["ends"], dtype="<i4"))
                else:
                    texts += unzip.decompress(row["texts"]).split(b"\n")
                    owners.append(own)
                    starts.append(begin)
            if not texts:
                continue
            owner, start = np.concatenate(owners), np.concatenate(starts)
            text, first = repeated_windows(texts, width)
            asks = start[text] >= 0
            text, first = text[asks], first[asks]
            if len(text):  # windows that touch or overlap make one span
                new = np.ones(len(text), dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (first[1:] > first[:-1] + width)
                a = np.flatnonzero(new)
                z = np.append(a[1:], len(text)) - 1
                yield spans(owner[text[a]], start[text[a]] + first[a], start[text[a]] + first[z] + width)
        release_memory()

    return run


def _without(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words, kept, at, merged = text.split(), [], 0, []
            for s in sorted((s["start"], s["end"]) for s in spans or ()):
                if merged and s[0] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], s[1])
                else:
                    merged.append({"start": s[0], "end": s[1]})
            for s in merged:
                kept += words[at : s["start"]]
                at = s["end"]
            kept += words[at:]
            out.append((len(words), len(words) - len(kept), b" ".join(kept), merged))
        n, removed, kept, merged = map(list, zip(*out, strict=True)) if out else ([], [], [], [])
        spans = pa.array(merged, type=pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), spans], ["id", "n_words", "n_removed", "kept", "spans"])


def frequent_minimisers(texts: DataFrame, width: int, total: int, limit: int, most: int = 100_000) -> np.ndarray:
    """Minimisers of more than about ``limit`` super-k-mers, counted on a sample of the texts.

    Only balance depends on it, no result: at most ``most`` of them, the most frequent ones.
    """
    share = min(1.0, max(16 / limit, (32 << 20) / max(total, 1)))
    sample = texts if share >= 1 else texts.sample(share, seed=1)
    counts = sample.mapInArrow(_minimisers_of(width), "m long").groupBy("m").agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") >= max(8, int(share * limit))).orderBy(F.desc("n")).limit(most).toArrow()
    return np.sort(often["m"].to_numpy().view(np.uint64))


def remove_repeats(docs: DataFrame, width: int = 35, id: str = "doc_id", text: str = "text", bucket: int = 16 << 20, size: int = 32 << 20) -> DataFrame:
    """Texts without the words that lie in a window of ``width`` words which also starts elsewhere, in any document.

    Returns the id, n_words, n_removed, kept (what is left, joined by one space) and spans (of removed words, from 0, end
    exclusive). A null text is empty; shorter texts than a window stay whole. Repeated rows, null ids and ids that occur
    twice are documents of their own; other columns are not read. An empty table gives none.

    A task packs texts in buffers of ``size`` bytes, in which a string or text that repeats is settled on the spot. A
    bucket gets about ``bucket`` bytes of strings and is judged alone, so buckets grow in number with the corpus; windows
    whose minimiser is so frequent that it would fill a bucket are dealt out one by one. Spans come back to texts by
    digest, a join that splits where a text has many copies. A text longer than a buffer is held whole.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    texts, total = rows.select("text"), rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total * 3 // bucket + 1)
    limit = max(32, total * 3 // buckets // 600)  # super-k-mers of about 300 bytes: half a bucket
    hot = frequent_minimisers(texts, width, total, limit)
    packed = texts.mapInArrow(_packed(width, buckets, hot, size), PACKED).repartition("bucket").sortWithinPartitions("bucket")
    spans = packed.mapInArrow(_judged(width), "owner binary, start int, end int")
    spans = spans.groupBy("owner").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    asked = rows.withColumn("owner", F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)))
    whole = asked.join(spans, "owner", "left").select("id", "text", "spans")
    kind = rows.schema["id"].dataType.simpleString()
    out = whole.mapInArrow(_without, f"id {kind}, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>")
    return out.withColumnRenamed("id", id)
