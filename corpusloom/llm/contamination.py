"""Benchmark decontamination: size-partitioned MinHash containment search, exact verification.

An item is contained in a document if at least ``threshold`` of its distinct shingles
occur there. Items are partitioned by their number of shingles, in powers of two; the
sketch of an item is the bottom-k of its shingle hashes, with k of the partition large
enough that an item contained in a document can miss only k - ``hits`` of them. Every
shingle of every document is probed against the sketches, so long documents need no
sketch of their own and no contained item is lost. An item shorter than a shingle is one
shingle of its own width, and documents are probed at the widths that items have. Items
with enough hits are verified on their words. Benchmarks above ``block_bytes`` are searched in blocks of that size, each a
pass over the documents, so what tasks hold stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bounded_batches, bounded_slices, release_memory, shingle_codes, stash, workspace

#: Words are runs of ASCII letters and digits and of non-ASCII bytes; A-Z count as a-z.
_KEEP = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_KEEP).split() if text else []


class ItemBlock:
    """Sketches and words of a bounded number of items."""

    def __init__(self, items: list[tuple[int, bytes]], width: int, threshold: float, hits: int):
        self.width, self.threshold = width, threshold
        self.items: list[tuple[int, list[bytes], int]] = []
        self.widths: set[int] = set()
        codes, owners = [], []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            self.widths.add(min(width, len(words)))
            own = np.unique(shingle_codes(words, min(width, len(words)), WordHashes()))
            most = 2 ** int(len(own)).bit_length() - 1  # the partition's largest size
            k = min(len(own), int(np.floor((1 - threshold) * most + 1e-9)) + hits)
            missing = int(np.floor((1 - threshold) * len(own) + 1e-9))
            codes.append(own[:k])
            owners.append(np.full(k, len(self.items)))
            self.items.append((item_id, words, max(1, k - missing)))
        code = np.concatenate(codes) if codes else np.empty(0, dtype=np.uint64)
        order = np.argsort(code, kind="stable")
        self.codes, self.owners = code[order], (np.concatenate(owners) if owners else np.empty(0, dtype=np.int64))[order]
        self.distinct = np.unique(self.codes)
        self.need = np.array([n for _, _, n in self.items], dtype=np.int64)

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """Places of the items with enough sketch hashes among a document's shingle codes."""
        at = np.minimum(np.searchsorted(self.distinct, codes), len(self.distinct) - 1)
        hit = self.distinct[np.unique(at[self.distinct[at] == codes])]
        if not len(hit):
            return np.empty(0, dtype=np.int64)
        first, last = np.searchsorted(self.codes, hit), np.searchsorted(self.codes, hit, side="right")
        owners = np.concatenate([self.owners[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)])
        return np.flatnonzero(np.bincount(owners, minlength=len(self.items)) >= self.need)

    def matches(self, words: list[bytes], hashes: WordHashes) -> Iterator[tuple[int, int, int]]:
        """(item_id, shingles of the item, those in the document) of the items contained."""
        codes = np.concatenate([np.empty(0, dtype=np.uint64), *(shingle_codes(words, w, hashes) for w in sorted(self.widths))])
        if not len(codes):
            return
        runs: dict[int, set] = {}
        for place in self.candidates(codes).tolist():
            item_id, item, _ = self.items[place]
            width = min(self.width, len(item))
            if width not in runs:
                runs[width] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
            own = {tuple(item[i : i + width]) for i in range(len(item) - width + 1)}
            shared = len(own & runs[width])
            if shared >= self.threshold * len(own) - 1e-9:
                yield item_id, len(own), shared


def item_blocks(items: DataFrame, item_col: str, item_text_col: str, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items with an id and a text, in blocks of bounded size; one empty block if there is none."""
    wanted = items.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull())
    wanted = wanted.select(F.col(item_col).cast("long"), F.col(item_text_col).cast("binary")).distinct()
    block: list[tuple[int, bytes]] = []
    size, blocks = 0, 0
    for item in wanted.toLocalIterator():
        block.append((item[0], bytes(item[1])))
        size += len(item[1]) + 64
        if size >= block_bytes:
            yield block
            block, size, blocks = [], 0, blocks + 1
    if block or not blocks:
        yield block


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    hits: int = 2,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """Pairs (doc_id, item_id, n_shingles, n_shared, containment) with containment >= threshold.

    Shingles are runs of ``width`` words; an item with fewer words is one shingle, contained
    where its words occur in a row. Items without words or with a null id and null texts
    match nothing. Very long texts are probed whole. Repeated rows of a document or item give one pair each document
    id and item id, with the largest containment. Without items or documents the result
    is empty. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = "doc_id long, item_id long, n_shingles long, n_shared long"

    found = None
    for block in item_blocks(items, item_col, item_text_col, block_bytes):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index, hashes = ItemBlock(held.value, width, threshold, hits), WordHashes()
            for part in (p for b in batches for p in bounded_slices(b, 1)):
                out: list[tuple[int, int, int, int]] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if text and doc_id is not None:
                        out += [(doc_id, *m) for m in index.matches(words_of(text), hashes)]
                cols = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "n_shingles", "n_shared"])

        more = rows.mapInArrow(run, "doc_id long, item_id long, n_shingles long, n_shared long")
        found = more if found is None else found.union(more)
    best = found.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).groupBy("doc_id", "item_id")
    best = best.agg(F.max(F.struct("containment", "n_shingles", "n_shared")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_shingles", "m.n_shared", "m.containment")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    hits: int = 2,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """The documents that contain no item, with all their columns: a filter pass for each block of items.

    With several blocks each pass but the last is written to the shared folder, so a task
    holds one block. Items shorter than a shingle count as in ``contained_items``. Null texts contain nothing and stay, as do rows with a null id; repeated rows stay or go
    alike. Without items all documents stay; an empty table stays empty.
    """
    place, space = docs.columns.index(text_col), workspace(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    for k, block in enumerate(item_blocks(items, item_col, item_text_col, block_bytes)):
        if k:
            docs = stash(docs, space, f"pass{k}")
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index, hashes = ItemBlock(held.value, width, threshold, hits), WordHashes(1 << 17)
            for part in (p for b in batches for p in bounded_slices(b, place)):
                texts = part.column(place).to_pylist()
                yield part.filter(pa.array([next(index.matches(words_of((t or "").encode()), hashes), None) is None for t in texts], pa.bool_()))
            hashes.clear()
            release_memory()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
