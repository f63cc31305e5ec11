"""Automata of lines of repeated parts, whose every step is a function of a few states, so that steps compose."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple


class Part(NamedTuple):
    """``least`` to ``most`` steps (None: any number) whose symbol is, or with ``but`` is not, one of ``symbols``."""

    symbols: str
    least: int = 1
    most: int | None = 1
    but: bool = False


class Automaton(NamedTuple):
    """By state and symbol (0 for all others): the state that follows and new hits; by state: hits if the steps end there."""

    symbols: str
    following: list[list[int]]
    hits: list[list[int]]
    left: list[int]


#: A scan: threads (part, steps taken in it), the most wanted first, and what holds if its best hit ends where it last did:
#: the scan that began there, with the hits it has since had.
_Scan = tuple


def automaton(line: Sequence[Part], most_states: int = 2000) -> Automaton:
    """All scans that can come about, by symbol from the first.

    A hit begins as early as it can, and each part takes as many steps as it can. Whether a longer hit comes may be
    open; then the scan after the shorter hit runs along, and takes over once no longer hit is possible. A line that
    can hold open ever more hits has no finite automaton and is an error beyond ``most_states``.
    """
    if not any(p.least for p in line) or any(p.most is not None and p.most < p.least for p in line):
        raise ValueError("a line needs a step at least, and no part may end before it begins")
    symbols = "".join(sorted({c for p in line for c in p.symbols}))

    def threads(part: int, taken: int) -> Iterator[tuple[int, int] | None]:
        """Where a thread can take its next step, the most wanted first; None is a hit."""
        if part == len(line):
            yield None
            return
        p = line[part]
        if p.most is None or taken < p.most:
            yield part, min(taken, p.least) if p.most is None else taken
        if taken >= p.least:
            yield from threads(part + 1, 0)

    def fits(part: int, symbol: str) -> bool:
        return (symbol != "" and symbol in line[part].symbols) != line[part].but

    first: _Scan = (tuple(threads(0, 0)), None)

    def step(scan: _Scan, symbol: str) -> tuple[_Scan, int]:
        on, open_ = scan
        new, hit = [], False
        for part, taken in on:
            if fits(part, symbol):
                for t in threads(part, taken + 1):
                    if t is None:
                        hit = True
                        break
                    if t not in new:
                        new.append(t)
            if hit:
                break  # later threads are less wanted than this hit
        if not hit and open_ is None:
            new += [t for t in first[0] if t not in new]  # a hit may begin with the next step
            return (tuple(new), None), 0
        hits = int(open_ is None)
        if hit:
            open_ = first, 0
        else:
            after, more = step(open_[0], symbol)
            open_ = after, open_[1] + more
        return ((tuple(new), open_), hits) if new else (open_[0], hits + open_[1])

    def left(scan: _Scan) -> int:
        return scan[1][1] + left(scan[1][0]) if scan[1] else 0

    known, order, following, hits = {first: 0}, [first], [], []
    for scan in order:
        edges = [step(scan, c) for c in ("", *symbols)]
        for after, _ in edges:
            if after not in known:
                known[after] = len(order)
                order.append(after)
        if len(order) > most_states:
            raise ValueError(f"this line needs more than {most_states} states")
        following.append([known[after] for after, _ in edges])
        hits.append([n for _, n in edges])
    return Automaton(symbols, following, hits, [left(s) for s in order])
