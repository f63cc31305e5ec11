"""Rules as rows: material conditions, their order, and parents for more specific labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import boards as B
from corpusloom.functions.outcomes import side_rule

PIECES = "QRBNP"


@dataclass(frozen=True)
class Rule:
    """Least and most counts of the own and the other side's pieces; pieces not named must be absent."""

    stem: str
    own: dict[str, tuple[int, int]] = field(default_factory=dict)
    other: dict[str, tuple[int, int]] = field(default_factory=dict)
    parents: tuple[str, ...] = ()

    def holds(self, board: Column, white: bool) -> Column:
        """Whether it holds with white, or black, as the own side."""
        met = F.lit(True)
        for named, mine in ((self.own, white), (self.other, not white)):
            for p in PIECES:
                low, high = named.get(p, (0, 0))
                met = met & B.count_of(board, p if mine else p.lower()).between(low, high)
        return met


def side_of(rule: Rule, board: Column) -> Column:
    return side_rule(rule.holds(board, True), rule.holds(board, False))


def first_match(rules: Sequence[Rule], board: Column) -> Column:
    """The stem and favoured side of the first rule that holds for either side, else null."""
    out = None
    for r in rules:
        met = r.holds(board, True) | r.holds(board, False)
        hit = F.struct(F.lit(r.stem).alias("stem"), side_of(r, board).alias("side"))
        out = F.when(met, hit) if out is None else out.when(met, hit)
    return out


def all_labels(df: DataFrame, rules: Sequence[Rule], board: str) -> DataFrame:
    """A row for each rule that holds and for each of its parents; all rules in one pass."""
    b = F.col(board)
    hits = [F.when(r.holds(b, True) | r.holds(b, False), F.array(*(F.lit(s) for s in (r.stem, *r.parents)))) for r in rules]
    found = F.array_distinct(F.flatten(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    return df.withColumn("label", F.explode(found))
