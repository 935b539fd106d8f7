"""Row rules: symbol exclusions, quote and spread guards, clause explainers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published exchange test symbols and the shape the others follow.
TEST_SYMBOLS = (
    "ATEST CTEST MTEST NTEST PTEST QTEST ZAZZT ZBZZT ZCZZT ZEXIT ZIEXT ZJZZT ZTEST ZTST ZVV ZVZZC "
    "ZVZZT ZWZZT ZXIET ZXZZT ZZZ ZZZZ"
).split()
TEST_PATTERN = r"^(Z[A-Z]ZZ[TC]|[A-Z]?TEST[A-Z]?|.*\.TEST)$"

CHANGE_EPS = 1e-9


def is_test_symbol(symbol: Column) -> Column:
    s = F.upper(F.coalesce(symbol, F.lit("")))
    return s.isin(TEST_SYMBOLS) | s.rlike(TEST_PATTERN)


def usable_quote(bid: Column, ask: Column, locked_ok: bool = True) -> Column:
    """Two-sided, and not crossed; a locked book passes for matching but not for book features."""
    two_sided = (bid > 0) & (ask > 0)
    return F.coalesce(two_sided & ((ask >= bid) if locked_ok else (ask > bid)), F.lit(False))


def usable_reference(ref: Column, bid: Column, ask: Column, max_away: float = 0.05) -> Column:
    """A slippage reference is believed when it is positive and near a two-sided mid."""
    mid = (bid + ask) / 2
    return F.coalesce((ref > 0) & usable_quote(bid, ask) & (F.abs(F.try_divide(ref, mid) - 1) <= max_away), F.lit(False))


def spread_pct(bid: Column, ask: Column) -> Column:
    return F.when(usable_quote(bid, ask), (ask - bid) / ((ask + bid) / 2) * 100)


def spread_guard_ok(bid: Column, ask: Column, limit_pct: float) -> Column:
    """Refuse a wide spread; a quote that is missing passes."""
    return F.coalesce(spread_pct(bid, ask) < limit_pct, F.lit(True))


def drift_guard_ok(ask: Column, ref: Column, limit: float) -> Column:
    return F.coalesce(F.abs(F.try_divide(ask, ref) - 1) <= limit, F.lit(True))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def ceiling_gate(ret: Column, ceiling: float | None = None, dist: Column | None = None, floor: float | None = None) -> Column:
    """Entry allowed when the run-up is small and/or the high is near; a missing value refuses."""
    ok = F.lit(True)
    if ceiling is not None:
        ok = ok & finite(ret) & (ret <= ceiling)
    if floor is not None:
        ok = ok & finite(dist) & (dist >= floor)
    return F.coalesce(ok, F.lit(False))


def cold_gate(minute: Column, cold: Column, from_minute: int = 420) -> Column:
    """True before 07:00; on a cold session false from then on."""
    return (minute < from_minute) | ~F.coalesce(cold, F.lit(False))


_OPS = {
    "greater": lambda c, r: c > r,
    "egreater": lambda c, r: c >= r,
    "less": lambda c, r: c < r,
    "eless": lambda c, r: c <= r,
    "in_range": lambda c, r: (c >= r[0]) & (c <= r[1]),
}


def failing_clauses(filters: Sequence[dict]) -> Column:
    """Names of the clauses a row fails. A missing value fails; an unknown operation is skipped."""
    tests = []
    for f in filters:
        op = _OPS.get(f["op"])
        if op is None:
            continue
        passed = F.coalesce(op(F.col(f["column"]), f["right"]), F.lit(False))
        tests.append(F.when(~passed, F.lit(f["column"])))
    return F.array_compact(F.array(*tests))


def failed_conditions(names: Sequence[str]) -> Column:
    """Names of the boolean columns that are false or missing."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(F.col(n), F.lit(False)), F.lit(n)) for n in names]))


def first_failure(rules: Sequence[tuple[str, Column]]) -> Column:
    """First failing reason in the written order, NULL when all pass."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])


def decision_errors() -> Column:
    """Row rules on an order decision: prices positive, stop below and target above a long entry,
    whole size, horizon within a year."""
    long = F.col("side") == "LONG"
    rules = {
        "side": F.col("side").isin("LONG", "SHORT"),
        "entry": F.col("entry") > 0,
        "stop": F.when(long, F.col("stop") < F.col("entry")).otherwise(F.col("stop") > F.col("entry")),
        "target": F.when(long, F.col("target") > F.col("entry")).otherwise(F.col("target") < F.col("entry")),
        "size": (F.col("size") > 0) & (F.col("size") == F.floor("size")),
        "horizon": F.col("horizon").between(1, 365),
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
