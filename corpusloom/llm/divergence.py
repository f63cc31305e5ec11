"""How the sources of a language differ in their words: a minimal acyclic transducer is the vocabulary.

Kept terms are sorted by ranges and built into minimal automata whose edges carry how many terms come before: the sum
along a term's path is its lexicographic ordinal. Text is streamed through them byte by byte, all terms of a slice in
step, and what comes out are counts by ordinal. Later work knows terms by ordinal alone, for ties too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release_memory, stash, workspace

#: Letters and bytes of non-ASCII characters stay, A-Z as a-z; all else becomes a space.
_KEEP = bytes(range(97, 123)) + bytes(range(128, 256))
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEEP else 32 for c in range(256))
END = 32  #: the space after a term is the edge out of a state where a term may end
BLOCK = 4096  #: ordinals of a block
TILE = 64  #: sources of a tile
SCALE = 1_000_000_000

MACHINE = "lang string, first string, terms array<string>, n int, root int, base binary, check binary, target binary, skip binary"
COUNTS = "lang string, source string, block int, ords array<int>, counts array<long>"


def _document_counts(most: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """In how many of a task's documents each term of a language is, in parts of some ``most`` terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def give() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                terms = pa.array(list(counts), type=pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), terms, pa.array(list(counts.values()), pa.int64())], ["lang", "term", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(set(text.translate(_BYTES).split()))
            if sum(map(len, held.values())) > most:
                yield from give()
        yield from give()
        release_memory()

    return run


class Transducer:
    """A minimal acyclic automaton of sorted terms; numbers on its edges add up to a term's place.

    Edges lie in one table: that of byte b out of state s is at base[s] + b if check there is s.
    """

    def __init__(self, root: int, base: np.ndarray, check: np.ndarray, target: np.ndarray, skip: np.ndarray) -> None:
        self.root, self.base, self.check, self.target, self.skip = root, base, check, target, skip

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From terms in byte order, none twice: a state is made final as soon as no later term can reach it."""
        known: dict[tuple, int] = {}
        path: list[list[tuple[int, int]]] = [[]]

        def settle(edges: list[tuple[int, int]]) -> int:
            return known.setdefault(tuple(edges), len(known) + 1)  # 0 is the end of a term

        def cut(last: bytes, depth: int) -> None:
            for k in range(len(last), depth, -1):
                state = settle(path.pop())
                path[-1].append((last[k - 1], state))

        last = b""
        for term in terms:
            depth = 0
            for a, b in zip(last, term, strict=False):
                if a != b:
                    break
                depth += 1
            cut(last, depth)
            path += [[] for _ in term[depth:]]
            path[-1].append((END, 0))
            last = term
        cut(last, 0)
        root = settle(path[0])

        behind = [1]  # terms that can still follow from a state
        base, taken, free, target, skip, check = [0] * (len(known) + 1), bytearray(512), 256, {}, {}, {}
        for edges, state in known.items():  # a state stands after those that it leads to
            behind.append(sum(behind[t] for _, t in edges))
            while taken[free]:
                free += 1
            at = max(0, free - edges[0][0]) if edges else 0
            for _ in range(64):
                if len(taken) < at + 512:
                    taken += bytes(len(taken))
                if not any(taken[at + b] for b, _ in edges):
                    break
                at += 1
            else:
                at = max(check, default=0) + 1
                taken += bytes(512)
            base[state], before = at, 0
            for b, t in edges:
                taken[at + b], check[at + b], target[at + b], skip[at + b] = 1, state, t, before
                before += behind[t]
        size = max(base) + 256
        out = []
        for given, none in ((check, -1), (target, 0), (skip, 0)):
            array = np.full(size, none, dtype=np.int32)
            array[list(given)] = list(given.values())
            out.append(array)
        return cls(root, np.array(base, dtype=np.int32), *out)

    def ordinals(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The place of the term that begins at each start and ends before the next space; -1 for other terms."""
        found = np.full(len(starts), -1, dtype=np.int64)
        index, at = np.arange(len(starts)), starts.copy()
        state, sums = np.full(len(starts), self.root, dtype=np.int32), np.zeros(len(starts), dtype=np.int32)
        while len(index):
            edge = self.base[state] + data[at]
            goes = np.flatnonzero(self.check[edge] == state)
            index, at, edge = index[goes], at[goes] + 1, edge[goes]
            state, sums = self.target[edge], sums[goes] + self.skip[edge]
            ended = state == 0
            found[index[ended]] = sums[ended]
            on = np.flatnonzero(~ended)
            index, at, state, sums = index[on], at[on], state[on], sums[on]
        return found


def _machines(most: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted terms to transducers of at most ``most`` terms of one language."""
    schema = pa.schema([("lang", pa.string()), ("first", pa.string()), ("terms", pa.list_(pa.string())), ("n", pa.int32()), ("root", pa.int32()), *((c, pa.binary()) for c in ("base", "check", "target", "skip"))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give() -> pa.RecordBatch:
            m = Transducer.build(t.encode() for t in held)
            row = {"lang": of, "first": held[0], "terms": held, "n": len(held), "root": m.root} | {c: getattr(m, c).tobytes() for c in ("base", "check", "target", "skip")}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        held, of = [], None
        for batch in batches:
            for lang, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (lang != of or len(held) >= most):
                    yield give()
                    held = []
                of = lang
                held.append(term)
        if held:
            yield give()
        release_memory()

    return run


def _recounted(machines, most: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts by language, source and ordinal of a task's texts, in rows of a block of ordinals."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list[tuple[int, Transducer]]] = {}
        for lang, start, root, *arrays in machines.value:
            by_lang.setdefault(lang, []).append((start, Transducer(root, *(np.frombuffer(a, dtype=np.int32) for a in arrays))))
        fresh: dict[tuple[str, str], list[np.ndarray]] = {}
        held: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}
        waiting = 0

        def merge() -> None:
            for key, parts in fresh.items():
                ords, counts = np.unique(np.concatenate(parts), return_counts=True)
                if key in held:
                    ords, counts = np.append(held[key][0], ords), np.append(held[key][1], counts)
                    ords, of = np.unique(ords, return_inverse=True)
                    counts = np.bincount(of, weights=counts).astype(np.int64)
                held[key] = ords, counts
            fresh.clear()

        def give() -> Iterator[pa.RecordBatch]:
            for (lang, source), (ords, counts) in held.items():
                blocks = ords // BLOCK
                at = np.append(np.flatnonzero(np.diff(blocks, prepend=-1)), len(ords)).astype(np.int32)
                rows = len(at) - 1
                arrays = [pa.array([lang] * rows, pa.string()), pa.array([source] * rows, pa.string()), pa.array(blocks[at[:-1]].astype(np.int32))]
                arrays += [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (ords.astype(np.int32), counts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "block", "ords", "counts"])
            held.clear()

        def stream(lang: str, sources: list[str], texts: list[bytes]) -> None:
            nonlocal waiting
            data = np.frombuffer((b" " + b" ".join(texts) + b" ").translate(_BYTES), dtype=np.uint8)
            letter = data != END
            starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
            rows = np.cumsum([1, *(len(t) + 1 for t in texts)])
            found = np.full(len(starts), -1, dtype=np.int64)
            for first, machine in by_lang.get(lang, ()):
                open_ = np.flatnonzero(found < 0)
                ords = machine.ordinals(data, starts[open_])
                found[open_[ords >= 0]] = ords[ords >= 0] + first
            edges = np.searchsorted(starts, rows)
            for source, i, j in zip(sources, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                ords = found[i:j]
                if (ords := ords[ords >= 0]).size:
                    fresh.setdefault((lang, source), []).append(ords.astype(np.int32))
                    waiting += len(ords)

        for batch in batches:
            texts: dict[str, tuple[list, list]] = {}
            sizes: Counter = Counter()
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                for part, x in zip(texts.setdefault(lang, ([], [])), (source, text), strict=True):
                    part.append(x)
                sizes[lang] += len(text)
                if sizes[lang] > 2 << 20:
                    stream(lang, *texts.pop(lang))
                    sizes[lang] = 0
            for lang, (sources, of) in texts.items():
                stream(lang, sources, of)
            if waiting > most:
                merge()
                waiting = 0
                if sum(len(o) for o, _ in held.values()) > most:
                    yield from give()
        merge()
        yield from give()
        release_memory()

    return run


def _added(keys: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of counts by ordinal of rows that come sorted by their first ``keys`` columns; holds one block of sums."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums, names = None, np.zeros(BLOCK, dtype=np.int64), None

        def give() -> pa.RecordBatch:
            at = np.flatnonzero(sums)
            row = [pa.array([k], t) for k, t in zip(key, names[1], strict=True)]
            row += [pa.array([at + key[-1] * BLOCK], pa.list_(pa.int32())), pa.array([sums[at]], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(row, names[0])

        for batch in batches:
            names = batch.schema.names, [f.type for f in batch.schema][:keys]
            for *own, ords, counts in zip(*(c.to_pylist() for c in batch.columns[:keys]), *batch.columns[keys:], strict=True):
                if own != key:
                    if key is not None:
                        yield give()
                    key = own
                    sums[:] = 0
                sums[ords.values.to_numpy() - key[-1] * BLOCK] += counts.values.to_numpy()
        if key is not None:
            yield give()

    return run


def chance(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE (count + 2) / (total + 2 terms)), in 64 bits by long division, three digits at a time."""
    d = total + 2 * terms
    whole, rest = np.divmod(counts.astype(np.int64) + 2, d)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, d)
        whole = whole * 1000 + digits
    return 1 + whole


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _typical(top: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first terms of each block of a group, by value and then ordinal."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ords, all_ords = np.array(r["ords"]), np.array(r["all_ords"])
                p = chance(np.array(r["counts"]), r["total"], r["terms"])
                q = chance(np.array(r["all_counts"])[np.searchsorted(all_ords, ords)], r["all_total"], r["terms"])
                more = p > q
                ords, value = ords[more], distance(p[more], q[more])
                best = np.lexsort((ords, -value))[:top]
                if len(best):
                    names = [pa.array([r[c]] * len(best), pa.string()) for c in ("lang", "source")]
                    yield pa.RecordBatch.from_arrays([*names, pa.array(ords[best].astype(np.int32)), pa.array(value[best])], ["lang", "source", "ord", "value"])

    return run


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of distances over a block for the pairs of sources of two tiles; rows come sorted by block and pair of tiles."""
    key, held = None, []

    def give() -> Iterator[pa.RecordBatch]:
        lang, block, i, j = key
        size = max(0, min(BLOCK, held[0]["terms"] - block * BLOCK))
        number = np.array([r["number"] for r in held])
        p = np.zeros((len(held), size), dtype=np.int64)
        for k, r in enumerate(held):
            counts = np.zeros(size, dtype=np.int64)
            if r["ords"]:
                counts[np.array(r["ords"]) - block * BLOCK] = r["counts"]
            if size:
                p[k] = chance(counts, r["total"], r["terms"])
        for a in range(len(held)):
            b = np.flatnonzero((number > number[a]) & (number // TILE == j)) if number[a] // TILE == i else []
            if len(b):
                sums = np.zeros(len(b), dtype=np.int64)
                for at in range(0, size, 512):
                    sums += distance(p[a, at : at + 512], p[b, at : at + 512]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b), pa.string()), pa.array([number[a]] * len(b), pa.int32()), pa.array(number[b].astype(np.int32)), pa.array(sums)], ["lang", "a", "b", "value"])

    for batch in batches:
        for r in batch.to_pylist():
            if (own := (r["lang"], r["block"], r["i"], r["j"])) != key:
                if held:
                    yield from give()
                key, held = own, []
            held.append(r)
    if held:
        yield from give()


def audit(docs: DataFrame, least: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source", terms: int = 50_000, held: int = 64 << 20) -> DataFrame:
    """Distances between the sources of a language, and the terms that mark each: lang, source, part, item, value, rank.

    Terms are runs of ASCII letters and non-ASCII characters, A-Z as a-z; a language keeps those in ``least`` of its
    documents. Part ``pair`` has every other source with the summed distance of term shares, part ``term`` the ``top``
    terms that are more frequent than in the language. Null texts, languages and sources are empty strings; a group
    without terms has counts of zero; a language without kept terms has pairs of value 0; an empty table gives no row.
    Repeated rows are documents of their own.

    Transducers hold ``terms`` terms at most. They are broadcast in loads of about ``held`` bytes, and each load takes a
    pass over the texts, so memory has a bound whatever the vocabulary; one load is some 4 million terms.
    """
    spark = docs.sparkSession
    space = workspace(spark)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))

    found = rows.select("lang", "text").mapInArrow(_document_counts(300_000), "lang string, term string, n long")
    kept = stash(found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term"), space, "kept")
    ranges = kept.repartitionByRange(kept.count() // terms + 1, "lang", "term").sortWithinPartitions("lang", "term")
    machines = stash(ranges.mapInArrow(_machines(terms), MACHINE), space, "machines")
    sizes = machines.groupBy("lang").agg(F.sum("n").alias("terms"))

    listed = machines.select("lang", "first", "n", F.octet_length("base").alias("s"), F.octet_length("check").alias("e")).collect()  # a row a machine
    listed.sort(key=lambda r: (r["lang"].encode(), r["first"].encode()))
    loads, starts, at = [[]], [], Counter()
    for r in listed:
        if loads[-1] and sum(x["s"] + 3 * x["e"] for x in loads[-1]) + r["s"] + 3 * r["e"] > held:
            loads.append([])
        loads[-1].append(r)
        starts.append((r["lang"], r["first"], at[r["lang"]]))
        at[r["lang"]] += r["n"]
    starts = spark.createDataFrame(starts, "lang string, first string, start int")
    machines = machines.join(F.broadcast(starts), ["lang", "first"])  # one row for each machine

    counts = []
    for load in loads:
        if load:
            begin = F.struct(F.col("lang").cast("binary"), F.col("first").cast("binary"))
            low, high = (F.struct(F.lit(r["lang"].encode()), F.lit(r["first"].encode())) for r in (load[0], load[-1]))
            loaded = machines.where((begin >= low) & (begin <= high)).select("lang", "start", "root", "base", "check", "target", "skip").collect()  # about ``held`` bytes
            counts.append(rows.mapInArrow(_recounted(spark.sparkContext.broadcast([tuple(r) for r in loaded]), 1 << 20), COUNTS))
    counted = counts[0] if counts else spark.createDataFrame([], COUNTS)
    for more in counts[1:]:
        counted = counted.union(more)
    counted = counted.repartition("lang", "source", "block").sortWithinPartitions("lang", "source", "block")
    counted = stash(counted.mapInArrow(_added(3), COUNTS), space, "counts")

    def total(by: list[str], name: str) -> DataFrame:
        return counted.groupBy(*by).agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias(name))

    groups = rows.select("lang", "source").distinct().join(total(["lang", "source"], "total"), ["lang", "source"], "left").join(sizes, "lang", "left")
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int")
    groups = groups.fillna(0, ["total", "terms"]).withColumns({"number": number, "sources": F.count("*").over(Window.partitionBy("lang"))})
    groups = stash(groups, space, "groups")

    all_ = counted.select("lang", "block", "ords", "counts").repartition("lang", "block").sortWithinPartitions("lang", "block")
    all_ = all_.mapInArrow(_added(2), "lang string, block int, ords array<int>, counts array<long>")
    all_ = all_.select("lang", "block", F.col("ords").alias("all_ords"), F.col("counts").alias("all_counts")).join(total(["lang"], "all_total"), "lang")
    best = counted.join(all_, ["lang", "block"]).join(groups.select("lang", "source", "total", "terms"), ["lang", "source"]).mapInArrow(_typical(top), "lang string, source string, ord int, value long")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ord"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= top)
    spelled = machines.select("lang", "start", F.posexplode("terms").alias("k", "item")).select("lang", (F.col("start") + F.col("k")).alias("ord"), "item")
    best = best.join(spelled, ["lang", "ord"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    blocks = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK)).cast("int") - 1)
    cells = groups.where("sources > 1").select("*", F.explode(blocks).alias("block")).join(counted, ["lang", "source", "block"], "left")
    own, tiles = F.floor(F.col("number") / TILE).cast("int"), F.ceil(F.col("sources") / TILE).cast("int")
    cells = cells.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    cells = cells.select("lang", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "number", "total", "terms", "ords", "counts")
    cells = cells.repartition("lang", "block", "i", "j").sortWithinPartitions("lang", "block", "i", "j")
    pairs = cells.mapInArrow(_compared, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("lang", "value", "p.*")
    names = groups.select("lang", "number", "source")
    both = both.join(names.withColumnRenamed("number", "a"), ["lang", "a"]).join(names.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
    return both.union(best)
