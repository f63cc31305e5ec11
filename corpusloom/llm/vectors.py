"""Near-duplicate vectors by cosine: subspace pigeonhole join over rotated blocks, exact verification.

Unit vectors at cosine c are at squared distance 2 - 2c. After a rotation the coordinates
are cut into blocks of ``block_dims``; each block gets its proportional share of the
squared-distance budget, so a linked pair keeps within the share of at least one block.
A block's first coordinate, on a grid as wide as the share's root, sends a vector to its
own cell and to the one below, where its range partners are. In a cell the block
distance selects candidates, the first block that admits a pair owns it, and the cosine
of the given components, in double precision, decides. Equal vectors are one node; a
task returns link counts and a spanning forest, never its pairs. Cells above ``chunk``
vectors are split and their chunks compared pair by pair in tasks of their own; other
cells take their own and their neighbour's vectors in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, merge_labels, sorted_groups, stash, workspace

KEYS = ["dims", "block", "cell", "i", "j"]


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Rotated unit vectors. einsum adds in one order for any number of rows, so tasks agree to the last bit."""
    unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    return np.einsum("ij,jk->ik", unit, rotation(vectors.shape[1]), optimize=False)


def budgets(dims: int, threshold: float, block_dims: int) -> list[tuple[slice, float]]:
    """Blocks of coordinates and their shares of the squared distance, a hair above exact."""
    whole = 2 - 2 * threshold
    return [
        (slice(a, min(a + block_dims, dims)), whole * (min(a + block_dims, dims) - a) / dims * (1 + 1e-9) + 1e-12)
        for a in range(0, dims, block_dims)
    ]


def _cells(points: np.ndarray, threshold: float, block_dims: int) -> Iterator[tuple[int, np.ndarray]]:
    for b, (block, share) in enumerate(budgets(points.shape[1], threshold, block_dims)):
        yield b, np.floor(points[:, block.start] / (np.sqrt(share) * (1 + 1e-9))).astype(np.int64)


def _matrices(batch: pa.RecordBatch, dtype: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, rows, vectors in double) of a batch of (rep, n, vec)."""
    vecs = batch.column(2).to_pylist()
    sizes = np.array([len(v) for v in vecs], dtype=np.int64) // np.dtype(dtype).itemsize
    for dims in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dims)
        yield dims, rows, np.frombuffer(b"".join([vecs[r] for r in rows.tolist()]), dtype=dtype).reshape(-1, dims).astype(np.float64)


def _lift(x: np.ndarray, left: bool) -> np.ndarray:
    """Vectors of two more components, so that left @ right.T is minus the squared distance."""
    square, one = np.einsum("ij,ij->i", x, x)[:, None], np.ones((len(x), 1))
    return np.concatenate([2 * x, -square, -one] if left else [x, one, square], axis=1).astype(np.float32)


def _pairs(v: np.ndarray, home: np.ndarray, other: np.ndarray | None, b: int, shares: list, threshold: float):
    """Linked positions of home x other (home x home above the diagonal if None) that block b owns.

    Single precision, with room for its error, selects candidates; the cosine of the given
    components and the blocks' distances are in double precision.
    """
    block, share = shares[b]
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    x = (v / norm[:, None]) @ rotation(v.shape[1])[:, block]
    right = home if other is None else other
    lifted, against = _lift(x[home], True), _lift(x[right], False)
    for at in range(0, len(home), 512):
        for to in range(0 if other is not None else at, len(right), 4096):
            near = lifted[at : at + 512] @ against[to : to + 4096].T >= -share - 1e-5
            i, j = np.divmod(np.flatnonzero(near), near.shape[1])
            p, q = home[at + i], right[to + j]
            if other is None:
                above = at + i < to + j
                p, q = p[above], q[above]
            linked = np.einsum("ij,ij->i", v[p], v[q]) / (norm[p] * norm[q]) >= threshold
            p, q = p[linked], q[linked]
            if not len(p):
                continue
            some, place = np.unique(np.concatenate([p, q]), return_inverse=True)
            points = rotated(v[some])
            d = points[place[: len(p)]] - points[place[len(p) :]]
            d *= d
            mine = d[:, block].sum(axis=1) <= share
            for earlier, most in shares[:b]:
                mine &= d[:, earlier].sum(axis=1) > most
            yield p[mine], q[mine]


def vector_groups(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    block_dims: int = 8,
    chunk: int = 16384,
) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    n_links counts the other vectors at cosine ``threshold`` or more; component_id is the
    smallest vec_id reachable over links; kept marks that one. Vectors that are null, zero
    or hold null or non-finite components, and rows with a null vec_id, link with nothing
    (n_links 0; component their own id; kept false only without an id). Vectors of
    different lengths never link. Repeated rows count as vectors of their own. Other
    columns are not read; an empty table gives an empty result.
    """
    space = workspace(vectors.sparkSession)
    dtype = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = batch.column(0), batch.column(1)
            digests: list[bytes | None] = []
            packed: list[bytes | None] = []
            for known, x in zip(ids.is_valid().to_pylist(), vecs, strict=True):
                raw = None
                if known and x.is_valid and len(x) and not x.values.null_count:
                    v = np.asarray(x.values, dtype=dtype) + 0.0
                    wide = v.astype(np.float64)
                    if np.isfinite(square := float(wide @ wide)) and square > 0:
                        raw = v.tobytes()
                packed.append(raw)
                digests.append(None if raw is None else hashlib.md5(raw, usedforsecurity=False).digest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["vec_id", "digest", "vec"])

    kind = "array<float>" if dtype == "<f4" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind))
    rows = stash(rows.mapInArrow(keyed, "vec_id long, digest binary, vec binary"), space, "vectors")
    reps = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    reps = stash(reps, space, "reps")
    nodes = reps.select("rep", "n", "vec")

    def celled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, _, v in _matrices(batch, dtype):
                for b, cell in _cells(rotated(v), threshold, block_dims):
                    c, n = np.unique(cell, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(c), pa.int64()) for x in (dims, b)] + [pa.array(c), pa.array(n)], names=["dims", "block", "cell", "n"])

    # A row for each grid cell: coordinates lie in [-1, 1], so their number has a bound for each length.
    counts = nodes.mapInArrow(celled, "dims long, block long, cell long, n long").groupBy("dims", "block", "cell").agg(F.sum("n").alias("n"))
    chunks = {(r["dims"], r["block"], r["cell"]): -(-r["n"] // chunk) for r in counts.collect()}

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = batch.column(0).to_numpy()
            for dims, rows, v in _matrices(batch, dtype):
                for b, cells in _cells(rotated(v), threshold, block_dims):
                    out: list[tuple[np.ndarray, int, int, int, bool]] = []
                    for c in np.unique(cells).tolist():
                        here, up, down = (chunks.get((dims, b, x), 0) for x in (c, c + 1, c - 1))
                        inside = rows[cells == c]
                        part = ((rep[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(here)
                        for p in range(here):
                            mine = inside[part == p]
                            out += [(mine, c, p, j, True) for j in range(p, here + (up if here > 1 or up > 1 else 0))]
                            out += [(mine, c, i, p, False) for i in range(p)]
                            out += [(mine, c - 1, i, down + p if down > 1 or here > 1 else i, False) for i in range(down)]
                    for mine, c, i, j, home in out:
                        if len(mine):
                            keys = [pa.array(np.full(len(mine), x, dtype=np.int64)) for x in (dims, b, c, i, j)]
                            got = batch.take(pa.array(mine))
                            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.full(len(mine), home)), *got.columns], names=[*KEYS, "home", "rep", "n", "vec"])

    tasks = nodes.mapInArrow(spread, ", ".join(f"{k} long" for k in KEYS) + ", home boolean, rep long, n long, vec binary")

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dims, b, _, i, j), group in sorted_groups(batches, KEYS):
            rep, n = group["rep"].to_numpy(), group["n"].to_numpy()
            order = np.argsort(rep, kind="stable")
            rep, n = rep[order], n[order]
            home = group["home"].to_numpy(zero_copy_only=False)[order]
            packed = group["vec"].combine_chunks()
            packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
            first = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset]
            v = np.frombuffer(packed.buffers()[2], dtype=dtype, offset=int(first), count=len(packed) * dims)
            v = v.reshape(-1, dims).astype(np.float64)[order]
            inner, outer = np.flatnonzero(home), np.flatnonzero(~home)
            shares = budgets(dims, threshold, block_dims)
            links, label = np.zeros(len(rep), dtype=np.int64), np.arange(len(rep))
            for side in ([None] if i == j else []) + ([outer] if len(outer) else []):
                for p, q in _pairs(v, inner, side, b, shares, threshold):
                    np.add.at(links, p, n[q])
                    np.add.at(links, q, n[p])
                    label = merge_labels(label, p, q)
            got = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(rep[got]), pa.array(links[got]), pa.array(rep[label[got]])], names=["rep", "links", "root"])

    found = tasks.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(link, "rep long, links long, root long")
    found = stash(found, space, "links")
    named = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), space)
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.select("digest", "rep", "n").join(totals, "rep", "left").join(named, F.col("rep") == F.col("node"), "left")
    known = known.select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.drop("vec").join(known, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
