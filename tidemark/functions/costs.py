"""Commission schedules, futures costs and position sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published broker schedules.
FIXED_PER_SHARE, FIXED_MIN, FIXED_MAX_PCT = 0.005, 1.00, 0.01
TIERED_PER_SHARE, TIERED_MIN, TIERED_MAX_PCT = 0.0035, 0.35, 0.01
CLEARING_PER_SHARE = 0.00020
REMOVE_PER_SHARE, REMOVE_SUB_DOLLAR_PCT, ADD_REBATE = 0.0030, 0.0030, 0.0013
PASSTHROUGH = 0.000175 + 0.000563
SEC_PCT, TAF_PER_SHARE, CAT_PER_SHARE = 0.0000206, 0.000195, 0.000003
TZ_PER_SHARE, TZ_MIN_SUB_DOLLAR, TZ_MAX_SUB_DOLLAR = 0.005, 0.99, 7.95
TZ_FREE_FROM, TZ_FREE_TO, TZ_FREE_MIN_PRICE = 420, 1200, 1.00
TZ_ECN_REMOVE, TZ_ROUTING, TZ_ADD_REBATE, TZ_TAF = 0.0030, 0.0002, 0.0032, 0.000166
FINANCING_RATE = 0.0713


def flat_commission(qty: Column) -> Column:
    """Two sides of a per-share fee with an order minimum; the ledger's commission."""
    return F.greatest(F.lit(TIERED_MIN), TIERED_PER_SHARE * qty) * 2


def regulatory(qty: Column, price: Column, is_sell: Column) -> Column:
    sells = SEC_PCT * qty * price + TAF_PER_SHARE * qty
    return CAT_PER_SHARE * qty + F.when(is_sell, sells).otherwise(0.0)


def _clipped(per_share: float, minimum: float, max_pct: float, qty: Column, price: Column) -> Column:
    return F.least(F.greatest(per_share * qty, F.lit(minimum)), max_pct * qty * price)


def fixed_cost(qty: Column, price: Column, is_sell: Column) -> Column:
    return _clipped(FIXED_PER_SHARE, FIXED_MIN, FIXED_MAX_PCT, qty, price) + regulatory(qty, price, is_sell)


def tiered_cost(qty: Column, price: Column, is_sell: Column, removing: bool = True) -> Column:
    commission = _clipped(TIERED_PER_SHARE, TIERED_MIN, TIERED_MAX_PCT, qty, price)
    if removing:
        exchange = F.when(price >= 1.0, REMOVE_PER_SHARE * qty).otherwise(REMOVE_SUB_DOLLAR_PCT * qty * price)
    else:
        exchange = F.when(price >= 1.0, -ADD_REBATE * qty).otherwise(0.0)
    return (
        commission * (1 + PASSTHROUGH) + exchange + CLEARING_PER_SHARE * qty + regulatory(qty, price, is_sell)
    )


def zero_plan_cost(
    qty: Column, price: Column, is_sell: Column, minute: Column | None = None, removing: bool = True,
    free_needs_passive: bool = True,
) -> Column:
    """The free-commission plan: free only in its clock window, and only for passive orders."""
    inside = F.lit(True) if minute is None else (minute >= TZ_FREE_FROM) & (minute < TZ_FREE_TO)
    free = (price >= TZ_FREE_MIN_PRICE) & inside & F.lit(not (free_needs_passive and removing))
    sub = F.least(F.greatest(TZ_PER_SHARE * qty, F.lit(TZ_MIN_SUB_DOLLAR)), F.lit(TZ_MAX_SUB_DOLLAR))
    commission = F.when(free, 0.0).when(price < TZ_FREE_MIN_PRICE, sub).otherwise(TZ_PER_SHARE * qty)
    exchange = (TZ_ECN_REMOVE + TZ_ROUTING) * qty if removing else -TZ_ADD_REBATE * qty
    return commission + exchange + F.when(is_sell, TZ_TAF * qty).otherwise(0.0)


def order_cost(
    qty: Column, price: Column, is_sell: Column, plan: str = "tiered", removing: bool = True,
    minute: Column | None = None,
) -> Column:
    if plan == "fixed":
        cost = fixed_cost(qty, price, is_sell)
    elif plan == "tiered":
        cost = tiered_cost(qty, price, is_sell, removing)
    elif plan == "zero":
        cost = zero_plan_cost(qty, price, is_sell, minute, removing)
    elif plan == "legacy":
        cost = FIXED_PER_SHARE * qty
    else:
        raise ValueError(f"unknown plan {plan!r}")
    return F.when(qty > 0, cost).otherwise(0.0)


def round_trip_cost(qty: Column, price: Column, plan: str, removing: bool = True) -> Column:
    return order_cost(qty, price, F.lit(False), plan, removing) + order_cost(
        qty, price, F.lit(True), plan, removing
    )


def futures_side_cost(fee: Column, ticks: Column, tick_value: Column) -> Column:
    return fee + ticks * tick_value


def futures_pnl(direction: Column, entry: Column, exit_: Column, point_value: Column, contracts: Column) -> Column:
    return direction * (exit_ - entry) * point_value * contracts


def financing(entry_notional: Column, nights: Column) -> Column:
    """Interest on half the notional for every night held."""
    return entry_notional * 0.5 * FINANCING_RATE / 365 * nights


def bps_friction(entry_notional: Column, exit_notional: Column, entry_bps: Column, exit_bps: Column,
                 stop_fill: Column) -> Column:
    """Half spreads on both legs in basis points; a stop fill pays half as much again."""
    return (entry_notional * entry_bps + exit_notional * exit_bps * F.when(stop_fill, 1.5).otherwise(1.0)) / 1e4


def size_for(price: Column, equity: Column, max_shares: int = 1000, pct: float = 0.25) -> Column:
    return F.floor(F.least(F.lit(float(max_shares)), F.try_divide(equity * pct, price))).cast("bigint")


def equal_risk_size(entry: Column, stop: Column, risk: float = 100.0, lo: int = 1, hi: int = 1000) -> Column:
    distance = F.abs(entry - stop)
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.floor(F.try_divide(F.lit(risk), distance)))).cast("bigint")
