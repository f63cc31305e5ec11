"""Samples under quotas on two axes: an integer transportation over the counts of cells, then hash order in each cell."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transported(counts: Mapping[tuple[str, str], int], first: Mapping[str, int], second: Mapping[str, int]) -> dict[tuple[str, str], int]:
    """How many rows of each cell to take: as many in all as the quotas of both axes allow, none beyond a cell's count.

    Begins with each cell's share of its tighter quota and mends by shortest paths, on which rows may move between
    cells. Values without a quota get none.
    """
    cells = {k: n for k, n in sorted(counts.items()) if n > 0 and first.get(k[0], 0) > 0 and second.get(k[1], 0) > 0}
    rows, columns = ({v: sum(n for k, n in cells.items() if k[axis] == v) for v in {k[axis] for k in cells}} for axis in (0, 1))
    taken = {(a, b): min(n * min(rows[a], first[a]) // rows[a], n * min(columns[b], second[b]) // columns[b]) for (a, b), n in cells.items()}
    left = {a: first[a] - sum(taken[k] for k in cells if k[0] == a) for a in rows}, {b: second[b] - sum(taken[k] for k in cells if k[1] == b) for b in columns}
    beside: dict[tuple[int, str], list[str]] = {}
    for a, b in cells:
        beside.setdefault((0, a), []).append(b)
        beside.setdefault((1, b), []).append(a)
    while True:
        came: dict[tuple[int, str], tuple[int, str] | None] = {(0, a): None for a in sorted(rows) if left[0][a] > 0}
        todo, end = deque(came), None
        while todo and end is None:
            axis, v = node = todo.popleft()
            for w in beside.get(node, ()):
                cell = (v, w) if axis == 0 else (w, v)
                room = cells[cell] - taken[cell] if axis == 0 else taken[cell]
                if room > 0 and (1 - axis, w) not in came:
                    came[1 - axis, w] = node
                    todo.append((1 - axis, w))
                    if axis == 0 and left[1][w] > 0:
                        end = (1, w)
                        break
        if end is None:
            return taken
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        steps = [((u[1], v[1]), 1) if u[0] == 0 else ((v[1], u[1]), -1) for v, u in zip(path, path[1:], strict=False)]
        more = min(left[1][end[1]], left[0][path[-1][1]], *(cells[c] - taken[c] if s > 0 else taken[c] for c, s in steps))
        for c, s in steps:
            taken[c] += s * more
        left[1][end[1]] -= more
        left[0][path[-1][1]] -= more


def two_quota_sample(df: DataFrame, label: str, source: str, labels: Mapping[str, int], sources: Mapping[str, int], key: Column, cells: int = 100_000) -> DataFrame:
    """Rows under a quota for each label and one for each source, as many as both allow, in order of ``key`` in each cell.

    Only the counts of (label, source) cells come to the driver, for labels and sources with a quota, at most ``cells``
    of them. Columns hash and place, the place in the cell, are added; the cut of each partition comes before its shuffle.
    """
    asked = df.where(F.col(label).isin(*labels) & F.col(source).isin(*sources))
    counted = asked.groupBy(label, source).agg(F.count("*").alias("n")).limit(cells + 1).collect()
    if len(counted) > cells:
        raise ValueError(f"more than {cells} cells of labels and sources")
    taken = transported({(r[0], r[1]): r[2] for r in counted}, labels, sources)
    wanted = [(a, b, n) for (a, b), n in taken.items() if n]
    spark = df.sparkSession
    limits = spark.createDataFrame(wanted, f"`{label}` {df.schema[label].dataType.simpleString()}, `{source}` {df.schema[source].dataType.simpleString()}, quota long")
    place = F.row_number().over(Window.partitionBy(label, source).orderBy("hash"))
    most = max((n for *_, n in wanted), default=0)
    ranked = asked.withColumn("hash", key).withColumn("place", place).where(F.col("place") <= most)
    return ranked.join(F.broadcast(limits), [label, source]).where("place <= quota").select(*df.columns, "hash", "place")
