"""SimHash near-duplicates: segment-popcount embedding, grid range join, exact verification.

A fingerprint of 64 bits is cut into parts and each part into 2-bit segments whose bit
counts (0, 1 or 2) embed it in a small grid. The Manhattan distance of two such vectors
never exceeds the Hamming distance of the fingerprints, so of two fingerprints within
``radius`` bits at least one part has vectors at Manhattan distance ``radius // parts``,
kept at 0 or 1 here, or less. Every fingerprint goes to its own grid cell of each part
and to the cells one step up; pairs at distance one meet because the lower one steps up.
Inside a cell the candidates are compared exactly on all 64 bits, and a cell returns a
spanning forest of its links, never its pairs, so dense groups stay linear in output.
Cells above ``chunk`` rows are split into chunks and all pairs of chunks are compared in
tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, merge_labels, sorted_groups, stash, workspace

SEGMENT_BITS = 2
SEED = 42


def shingle_hashes(words: list[bytes], width: int, distinct: bool = False) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words; fewer words make one run, none make none."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)),
        dtype=np.uint64,
        count=n - width + 1,
    )
    return np.unique(h) if distinct else h


def simhash(words: list[bytes], width: int = 3, distinct: bool = False) -> int:
    """The 64-bit fingerprint: a bit is 1 if set in over half the shingle hashes."""
    h = shingle_hashes(words, width, distinct)
    if not h.size:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, h.size, 65536):
        bits = np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > h.size).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distinct: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long; null texts have no words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(
                (simhash(t.lower().split(), width, distinct) if t else 0 for t in batch.column(1).to_pylist()),
                dtype=np.uint64,
                count=batch.num_rows,
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def grid_cells(fp: np.ndarray, parts: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of fingerprints: (cell, position in fp, whether it is the fingerprint's own cell)."""
    dims = 64 // parts // SEGMENT_BITS
    bits = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    counts = bits.reshape(-1, parts, dims, SEGMENT_BITS).sum(axis=3).astype(np.int64)
    base = (SEGMENT_BITS + 1) ** np.arange(dims, dtype=np.int64)
    own = counts @ base + np.arange(parts, dtype=np.int64) * (SEGMENT_BITS + 1) ** dims
    at = np.broadcast_to(np.arange(len(fp))[:, None], own.shape)
    cells, rows, mine = [own.ravel()], [at.ravel()], [np.ones(own.size, dtype=bool)]
    if step:
        i, p, d = np.nonzero(counts < SEGMENT_BITS)
        cells.append(own[i, p] + base[d])
        rows.append(i)
        mine.append(np.zeros(len(i), dtype=bool))
    return np.concatenate(cells), np.concatenate(rows), np.concatenate(mine)


def _forest(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, label: np.ndarray, radius: int) -> np.ndarray:
    """Link positions x of left fingerprints with y of right ones within radius bits, tile by tile."""
    for a in range(0, len(left), 512):
        for b in range(0, len(right), 4096):
            near = np.bitwise_count(left[a : a + 512, None] ^ right[None, b : b + 4096]) <= radius
            i, j = np.nonzero(near)
            if i.size:
                label = merge_labels(label, x[a + i], y[b + j])
    return label


def _first_near(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, first: np.ndarray, radius: int) -> None:
    """Lower first[p] to the smallest position q < p within radius bits, of pairs of left and right."""
    for a in range(0, len(left), 512):
        for b in range(0, len(right), 4096):
            i, j = np.nonzero(np.bitwise_count(left[a : a + 512, None] ^ right[None, b : b + 4096]) <= radius)
            p, q = x[a + i], y[b + j]
            np.minimum.at(first, np.maximum(p, q), np.minimum(p, q))


def hamming_links(reps: DataFrame, radius: int = 3, chunk: int = 4096, actual: bool = False) -> DataFrame:
    """Links (a, b) between fingerprints within ``radius`` bits, as spanning forests by cell.

    reps: distinct rows (rep, fp). The links' components equal those of all pairs. With
    ``actual``, rows are pairs within the radius themselves, each fingerprint's first in
    each cell, for callers that verify pairs.
    radius: at most 63; parts are the power of two that leaves one step a part.
    """
    parts = 1
    while radius // parts > 1:
        parts *= 2
    step = radius // parts

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for at in range(0, len(fp), 20_000):
                cell, row, own = grid_cells(fp[at : at + 20_000].view(np.uint64), parts, step)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(rep[at + row]), pa.array(fp[at + row]), pa.array(own)],
                    names=["cell", "rep", "fp", "own"],
                )

    cells = reps.select("rep", "fp").mapInArrow(spread, "cell long, rep long, fp long, own boolean")
    whole = Window.partitionBy("cell")
    met = cells.withColumns({"n": F.count("*").over(whole), "owners": F.sum(F.col("own").cast("int")).over(whole)})
    met = met.where("n > 1 and owners > 0").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    met = met.withColumn("own_chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("cell", F.least("own_chunk", "other").alias("i"), F.greatest("own_chunk", "other").alias("j"), "own_chunk", "rep", "fp", "own")

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a: list[int] = []
        out_b: list[int] = []
        for (_, i, j), rows in sorted_groups(batches, ["cell", "i", "j"]):
            if rows.num_rows < 2:
                continue
            own = rows["own"].to_numpy(zero_copy_only=False)
            if rows.num_rows <= 6 and i == j:  # nearly all cells
                rep, fp, own = rows["rep"].to_pylist(), rows["fp"].to_pylist(), own.tolist()
                for x in range(len(rep)):
                    for y in range(x):
                        if (own[x] or own[y]) and ((fp[x] ^ fp[y]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius:
                            out_a.append(rep[x])
                            out_b.append(rep[y])
                continue
            rep, fp, part = (rows[k].to_numpy() for k in ("rep", "fp", "own_chunk"))
            order = np.argsort(rep, kind="stable")
            rep, fp, part, own = rep[order], fp[order].view(np.uint64), part[order], own[order]
            label = np.arange(len(rep))
            for p, q in {(i, j), (j, i)}:
                x, y = np.flatnonzero(part == p), np.flatnonzero((part == q) & own)
                if actual:
                    _first_near(fp[x], fp[y], x, y, label, radius)
                else:
                    label = _forest(fp[x], fp[y], x, y, label, radius)
            linked = np.flatnonzero(label != np.arange(len(rep)))
            out_a += rep[linked].tolist()
            out_b += rep[label[linked]].tolist()
            if len(out_a) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
                out_a, out_b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return met.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(link, "a long, b long")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distinct: bool = False, radius: int = 3
) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of ``radius`` bits or fewer.
    Null and empty texts and texts without words have fingerprint zero and link like any
    other. Very long texts are hashed whole, a bounded number of shingles at a time; a bit
    set in exactly half of the hashes is 0. Repeated rows each get a row. A null doc_id gets its fingerprint and a null
    component, and links nothing. Equal fingerprints are one node, so groups of copies of
    any size cost one row in the join. An empty table gives an empty result; other
    columns are not read.
    """
    space = workspace(docs.sparkSession)
    fps = stash(fingerprints(docs, id_col, text_col, width, distinct), space, "fingerprints")
    reps = stash(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), space, "reps")
    found = components(hamming_links(reps, radius), space)
    named = reps.join(found, reps["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
