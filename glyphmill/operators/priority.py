"""Priority lists: ordered rows under conditions, of which the first that holds wins."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Guarded:
    """A value that holds if all conditions do."""

    conditions: tuple
    value: object


def denials(rows: list[Guarded]) -> list[list]:
    """For each row the conditions that must be false when it is reached: those by which alone an earlier row differs."""
    out = []
    for i, row in enumerate(rows):
        own = set(row.conditions)
        out.append([lacking[0] for earlier in rows[:i] if len(lacking := [c for c in earlier.conditions if c not in own]) == 1])
    return out


def join(lists: Iterable[list[Guarded]], combine: Callable[[list], object]) -> list[Guarded]:
    """Combinations of one row of each list, in priority order.

    Combinations that contradict themselves are passed over. Where what holds so far implies a
    row's conditions, later rows of that list can't be reached.
    """
    states: list[tuple[tuple, list, list]] = [((), [], [])]
    for rows in lists:
        refused = denials(rows)
        after = []
        for held, denied, values in states:
            for row, no in zip(rows, refused):
                all_held = (*held, *(c for c in row.conditions if c not in held))
                all_denied = [*denied, *no]
                if not any(c in all_denied for c in all_held):
                    after.append((all_held, all_denied, [*values, row.value]))
                    if set(row.conditions) <= set(held):
                        break
        states = after
    return [Guarded(held, combine(values)) for held, _, values in states]


def first_that_holds(rows: list[Guarded], facts: set):
    """The value of the first row whose conditions are among the facts."""
    return next((r.value for r in rows if set(r.conditions) <= facts), None)
