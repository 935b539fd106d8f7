"""Price grids, rounding, reflection and volume-profile ticks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_tick(price: Column, tick: float, direction: str = "nearest") -> Column:
    steps = F.round(price / tick, 9)
    if direction == "up":
        n = F.ceil(steps)
    elif direction == "down":
        n = F.floor(steps)
    else:
        n = F.floor(steps + 0.5)
    return n * tick


def round_half_away(x: Column) -> Column:
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("bigint")


def to_cents(price: Column) -> Column:
    return F.floor(price * 100 + 0.5).cast("bigint")


def grid_distance(cents: Column, grid: int, offset: int = 0) -> Column:
    """Cents to the nearest point of offset + k*grid."""
    r = F.pmod(cents - offset, F.lit(grid))
    return F.least(r, grid - r)


def reflect(price: Column, pivot: Column | None = None) -> Column:
    """The short side of a long rule: negate, or mirror about a price."""
    return -price if pivot is None else 2 * pivot - price
