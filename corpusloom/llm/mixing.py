"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. The patterns' words are
routed to the sources' quotas by a min-cost flow in which the k-th repetition of a word
costs k, so repetitions are spread and grow only where quotas need them. Each pattern's
flow becomes whole passes over all its documents and one partial pass, whose documents
are drawn in the order of a seeded hash: a histogram of the hashes finds where the pass
ends, and the few documents around the end are fitted to the words still missing.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stash, workspace

HASH_BITS, LEVEL_BITS = 60, 12


def cycled_targets(sizes: dict, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict:
    """Targets of sources in code-point order, null last: weights repeat, targets stop at ``most`` times the size.

    What is cut off is shared again by weight among the sources below their stop.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, targets = share * sum(sizes.values()), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            targets |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            targets[s] = float(most * sizes[s])
        left -= sum(targets[s] for s in over)
        free = [s for s in free if s not in targets]
    return targets


def route(patterns: dict[tuple, int], quotas: dict, passes: int = 2) -> dict[tuple[tuple, object], int]:
    """Min-cost flow of words from patterns to their sources: (pattern, source) -> words.

    Word k of a pattern's pass p costs p; shortest augmenting paths with potentials, on a
    graph of patterns and sources only. A pattern of one source that no other pattern has
    gives what its quota takes and needs no graph.
    """
    shared: dict = {}
    for p in patterns:
        for q in dict.fromkeys(p):
            shared[q] = shared.get(q, 0) + 1
    alone = {p: p[0] for p in patterns if len(set(p)) == 1 and shared[p[0]] == 1}
    simple = {(p, q): min(quotas.get(q, 0), passes * patterns[p]) for p, q in alone.items()}
    simple = {k: n for k, n in simple.items() if n > 0}
    patterns = {p: n for p, n in patterns.items() if p not in alone}
    quotas = {q: n for q, n in quotas.items() if q not in alone.values()}
    return simple | _flow(patterns, quotas, passes)


def _flow(patterns: dict[tuple, int], quotas: dict, passes: int) -> dict[tuple[tuple, object], int]:
    names = ["s", "t", *(("p", p) for p in sorted(patterns, key=repr)), *(("q", q) for q in sorted(quotas, key=repr))]
    number = {x: i for i, x in enumerate(names)}
    graph: list[list[list]] = [[] for _ in names]  # [to, capacity, cost, place of the reverse edge]

    def edge(a, b, capacity: int, cost: int) -> list:
        x, y = number[a], number[b]
        graph[x].append([y, capacity, cost, len(graph[y])])
        graph[y].append([x, 0, -cost, len(graph[x]) - 1])
        return graph[x][-1]

    links = {}
    for p, words in patterns.items():
        for k in range(passes):
            edge("s", ("p", p), words, k + 1)
        for q in dict.fromkeys(p):
            if q in quotas:
                links[p, q] = (edge(("p", p), ("q", q), words * passes, 0), words * passes)
    for q, words in quotas.items():
        edge(("q", q), "t", words, 0)
    potential = [0] * len(names)
    while True:
        best, via = [float("inf")] * len(names), [None] * len(names)
        best[0] = 0
        heap = [(0, 0)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > best[x]:
                continue
            for k, (y, capacity, cost, _) in enumerate(graph[x]):
                if capacity > 0 and d + cost + potential[x] - potential[y] < best[y]:
                    best[y] = d + cost + potential[x] - potential[y]
                    via[y] = (x, k)
                    heapq.heappush(heap, (best[y], y))
        if via[1] is None:
            return {key: whole - e[1] for key, (e, whole) in links.items() if whole - e[1] > 0}
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, best, strict=True)]
        path, x = [], 1
        while x:
            path.append(via[x])
            x = via[x][0]
        flow = min(graph[a][k][1] for a, k in path)
        for a, k in path:
            e = graph[a][k]
            e[1] -= flow
            graph[e[0]][e[3]][1] += flow


def words_in(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def take(docs: DataFrame, flows: dict[str, int], sizes: dict[str, int], seed: int, most: int = 2, tail: int = 256) -> DataFrame:
    """Add ``taken`` to rows (doc_id, pattern, size, key, copy): whole passes and a seeded partial pass.

    flows and sizes: words by pattern. The partial pass takes documents in the order of
    their seeded hash, by a histogram of ``LEVEL_BITS`` bits of the hash a level, until the
    place where it ends holds ``tail`` documents at most; from there on the next ``tail``
    documents are taken where they still fit, those already taken in the pass last and only
    up to ``most`` times.
    """
    spark = docs.sparkSession
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "key", "copy")), 1, HASH_BITS // 4), 16, 10).cast("long")
    drawn = docs.withColumn("draw", draw)
    state = {p: [flows.get(p, 0) // n if n else 0, flows.get(p, 0) % n if n else 0] for p, n in sizes.items()}
    # Of each pattern: whole passes, words of the partial pass still to take, first hash not yet taken, bits fixed.
    open_ = {p: (rest, 0, 0) for p, (_, rest) in state.items() if rest}
    ends = {p: 0 for p in sizes}
    left = {p: rest for p, (_, rest) in state.items()}
    while open_:
        width = HASH_BITS - LEVEL_BITS * (1 + next(iter(open_.values()))[2])
        at = spark.createDataFrame([(p, start) for p, (_, start, _) in open_.items()], "p string, start long")
        inside = drawn.join(F.broadcast(at), F.col("pattern") == F.col("p"))
        span = 1 << (width + LEVEL_BITS)
        inside = inside.where((F.col("draw") >= F.col("start")) & (F.col("draw") < F.col("start") + F.lit(span)))
        bucket = F.shiftright(F.col("draw") - F.col("start"), width)
        bars = inside.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket"))
        need = spark.createDataFrame([(p, rest) for p, (rest, _, _) in open_.items()], "p string, need long")
        bars = bars.withColumn("upto", upto).join(F.broadcast(need), F.col("pattern") == F.col("p")).where("upto > need")
        cut = bars.groupBy("pattern").agg(F.min(F.struct("bucket", "upto", "words", "n")).alias("c")).select("pattern", "c.*").collect()
        found, more = {r["pattern"]: r for r in cut}, {}
        for p, (rest, start, depth) in open_.items():
            if p not in found:  # all that is here is needed
                ends[p], left[p] = start + span, 0
                continue
            r = found[p]
            start, rest = start + (r["bucket"] << width), rest - (r["upto"] - r["words"])
            ends[p], left[p] = start, rest
            if rest and r["n"] > tail and width:
                more[p] = (rest, start, depth + 1)
        open_ = more
    params = [(p, state[p][0], ends[p], left[p]) for p in sizes]
    given = F.broadcast(spark.createDataFrame(params, "p string, passes long, end long, missing long"))
    joined = drawn.join(given, F.col("pattern") == F.col("p"))
    near = joined.where((F.col("missing") > 0) & (F.col("size") > 0) & ((F.col("draw") >= F.col("end")) | (F.col("passes") + 2 <= most)))
    place = F.row_number().over(Window.partitionBy("pattern").orderBy(F.col("draw") < F.col("end"), "draw", "doc_id"))
    near = near.withColumn("place", place).where(F.col("place") <= tail).groupBy("pattern").agg(
        F.sort_array(F.collect_list(F.struct("place", "doc_id", "draw", "size"))).alias("rows"), F.max("missing").alias("missing")
    )
    zero = F.struct(F.col("missing").alias("left"), F.array().cast("array<struct<draw:bigint,doc_id:bigint>>").alias("got"))
    fitted = F.aggregate(
        "rows",
        zero,
        lambda a, x: F.when(
            x["size"] <= a["left"],
            F.struct((a["left"] - x["size"]).alias("left"), F.concat(a["got"], F.array(F.struct(x["draw"].alias("draw"), x["doc_id"].alias("doc_id")))).alias("got")),
        ).otherwise(a),
    )
    extra = near.select("pattern", F.explode(fitted["got"]).alias("x"))
    extra = extra.select(F.col("pattern").alias("xp"), F.col("x.draw").alias("xd"), F.col("x.doc_id").alias("xi")).distinct().withColumn("more", F.lit(1))
    out = joined.join(extra, (F.col("pattern") == F.col("xp")) & (F.col("draw") == F.col("xd")) & F.col("doc_id").eqNullSafe(F.col("xi")), "left")
    partial = F.when(F.col("draw") < F.col("end"), 1).otherwise(0) + F.coalesce("more", F.lit(0))
    return out.select(*docs.columns, (F.col("size") * (F.col("passes") + partial)).alias("taken"))


def numbered_copies(rows: DataFrame) -> DataFrame:
    """Add ``copy``, 0, 1, ... among the rows with words that share ``key``; key and part (the writing task) are columns.

    Rows of one key are alike, so any numbering gives the same result. They are numbered
    within their parts, after the counts of earlier parts: a key with many rows isn't
    gathered in one task.
    """
    held = rows.where("size > 0").groupBy("key", "part").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("key").orderBy("part")
    before = F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = held.withColumns({"before": before, "all": F.sum("n").over(Window.partitionBy("key"))}).where("all > 1").select("key", "part", "before")
    known = rows.join(counts, ["key", "part"], "left")
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy("size")) - 1
    twice = known.where("before is not null and size > 0").withColumn("copy", F.col("before") + place)
    once = known.where("before is null or size = 0").withColumn("copy", F.lit(0).cast("long"))
    return twice.unionByName(once).drop("before", "part")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sources_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: int = 17,
    max_patterns: int = 100_000,
) -> DataFrame:
    """One row a document: doc_id, sources, size, source_size, target, taken.

    sources_col is a source name or an array of names for overlapping sources; source_size
    and target are those of the document's first source in code-point order. Texts that are
    null or without words have size 0 and give 0 words. A null source is a source; a null
    or empty array belongs to none and gives 0 words. No document gives more than ``most``
    times its size. Every row is a document of its own, also where ids are null or repeated
    or whole rows are: copies are numbered and drawn one by one, and results of copies that
    are alike are the same up to their order. Very long texts are counted whole. Only the table of patterns is handled on the driver:
    more than ``max_patterns`` is an error. Reruns agree; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    many = docs.schema[sources_col].dataType.typeName() == "array"
    source = F.array_sort(F.array_distinct(sources_col)) if many else F.array(F.col(sources_col).cast("string"))
    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("sources"), words_in(text_col).alias("size"), text_key.alias("th"))
    sized = sized.withColumn("pattern", F.coalesce(F.to_json("sources"), F.lit("[]"))).withColumn("part", F.spark_partition_id())
    sized = sized.withColumn("key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "pattern", "th"))).drop("th")
    space = workspace(spark)
    sized = stash(numbered_copies(stash(sized, space, "rows")), space, "sizes")
    rows = sized.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("words")).limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = {tuple(r["sources"] or ()): r["words"] for r in rows}
    name = {tuple(r["sources"] or ()): r["pattern"] for r in rows}
    sizes: dict = {}
    for p, words in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + words
    targets = cycled_targets(sizes, weights, share, most)
    flows: dict[str, int] = {}
    for (p, _), words in route(patterns, {s: round(t) for s, t in targets.items()}, most).items():
        flows[name[p]] = flows.get(name[p], 0) + words
    taken = take(sized, flows, {name[p]: w for p, w in patterns.items()}, seed, most)
    lead = [(name[p], *((sizes[p[0]], targets[p[0]]) if p else (0, 0.0))) for p in patterns]
    known = spark.createDataFrame(lead, "pattern string, source_size long, target double")
    return taken.join(F.broadcast(known), "pattern").select("doc_id", "sources", "size", "source_size", "target", "taken")
