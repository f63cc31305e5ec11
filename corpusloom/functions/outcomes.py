"""Outcomes of results, scores and evaluations, seen from a favoured side."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE, BLACK, SYMMETRIC = "white", "black", "symmetric"


def result_outcome(result: Column, side: Column) -> Column:
    """win, draw or loss for the favoured side; decisive where no side is favoured; else unknown."""
    return (
        F.when(result == "1/2-1/2", "draw")
        .when(~result.isin("1-0", "0-1") | result.isNull(), "unknown")
        .when(side == WHITE, F.when(result == "1-0", "win").otherwise("loss"))
        .when(side == BLACK, F.when(result == "0-1", "win").otherwise("loss"))
        .when(side == SYMMETRIC, "decisive")
        .otherwise("unknown")
    )


def winner_outcome(winner: Column, side: Column) -> Column:
    """The same for an evaluation's winner (white, black, draw)."""
    return (
        F.when(winner == "draw", "draw")
        .when(winner.isNull(), "unknown")
        .when(side.isin(WHITE, BLACK), F.when(winner == side, "win").otherwise("loss"))
        .when(side == SYMMETRIC, "decisive")
        .otherwise("unknown")
    )


def winner_from_sign(sign: Column, mover: Column) -> Column:
    """The winner from the sign of a value of the side to move."""
    other = F.when(mover == WHITE, BLACK).otherwise(WHITE)
    return F.when(sign == 0, "draw").when(sign > 0, mover).when(sign < 0, other)


def winner_from_score(score: Column, band: float, inclusive: bool = True) -> Column:
    """The winner from white's score; within the band it is a draw, with its edge or without."""
    drawn = F.abs(score) <= band if inclusive else F.abs(score) < band
    return F.when(drawn, "draw").when(score > 0, WHITE).when(score < 0, BLACK)


def winning_chance(score: Column, scale: float = 0.00368208, bound: int = 1000) -> Column:
    """Logistic winning chance between -1 and 1 of a bounded score."""
    bounded = F.greatest(F.lit(-bound), F.least(F.lit(bound), score))
    return 2 / (1 + F.exp(-scale * bounded)) - 1


def side_rule(own: Column, opposite: Column) -> Column:
    """The favoured side from whether a rule holds for white and for black."""
    return F.when(own & opposite, SYMMETRIC).when(own, WHITE).when(opposite, BLACK).otherwise("unknown")


def rating_band(ratings: Column) -> Column:
    """The band of the mean of the known ratings, in whole numbers: below 1600, steps of 200, 2600 and over."""
    known = F.filter(ratings, lambda r: r.isNotNull() & (r > 0))
    total = F.aggregate(known, F.lit(0).cast("long"), lambda a, r: a + r.cast("long"))
    mean = F.floor(total / F.size(known))
    low = (F.floor(mean / 200) * 200).cast("int")
    step = F.concat(low.cast("string"), F.lit("-"), (low + 199).cast("string"))
    return F.when(F.size(known) == 0, "Unknown").when(mean < 1600, "<1600").when(mean >= 2600, "2600+").otherwise(step)


def predicates(outcome: Column, evaluation: Column) -> Mapping[str, Column]:
    """Counters of outcomes, evaluations, and both together."""
    results, evals = ("win", "draw", "loss", "decisive", "unknown"), ("win", "draw", "loss", "decisive", "unknown")
    out = {f"result_{r}": outcome == r for r in results} | {f"eval_{e}": evaluation == e for e in evals}
    return out | {f"eval_{e}_result_{r}": (evaluation == e) & (outcome == r) for e in ("win", "draw", "loss", "decisive") for r in ("win", "draw", "loss", "decisive", "unknown")}


def ending_counters(status: Column, source: Column, winner: Column, result: Column, pieces: Column, evaluated: Column, outcome: Column, small: int = 5) -> Mapping[str, Column]:
    """The 39 counters of an ending: its positions and their evaluation, actual results, and both together."""
    ok = status == "ok"
    out = {
        "total_positions": F.lit(True), "evaluated_positions": ok, "tablebase_eligible_positions": pieces <= small,
        "tablebase_positions": ok & (source == "tablebase"), "stockfish_positions": ok & (source == "stockfish"),
        "skipped_non_tablebase_positions": status == "skipped_non_tablebase", "tablebase_error_positions": status == "tablebase_error",
        "white_wins": ok & (winner == "white"), "draws": ok & (winner == "draw"), "black_wins": ok & (winner == "black"),
    }
    sides = {"side_wins": "win", "side_draws": "draw", "side_losses": "loss", "symmetric_decisive": "decisive"}
    out |= {name: evaluated == told for name, told in sides.items()} | {"unknown_positions": evaluated == "unknown"}
    out |= {"actual_white_wins": result == "1-0", "actual_draws": result == "1/2-1/2", "actual_black_wins": result == "0-1"}
    out |= {f"actual_{name}": outcome == told for name, told in sides.items()} | {"actual_unknown_results": outcome == "unknown"}
    both = {"win": ("win", "draw", "loss", "unknown"), "draw": ("win", "draw", "loss", "decisive", "unknown"), "loss": ("win", "draw", "loss", "unknown"), "decisive": ("decisive", "draw", "unknown")}
    return out | {f"tb_{e}_result_{r}": (evaluated == e) & (outcome == r) for e, results in both.items() for r in results}


def is_sharp(best: Column, second: Column, gap: float) -> Column:
    """Whether the winning chances of the two best lines are ``gap`` or more apart, or there is one line only."""
    return second.isNull() | (F.abs(winning_chance(best) - winning_chance(second)) >= gap)
