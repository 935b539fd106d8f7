"""Dated joins, session series, splits, rolls and held futures series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import joins
from tidemark.operators import windows as W
from tidemark.session import staged


def asof_daily(left: DataFrame, right: DataFrame, available: str, cols: Sequence[str], on=("symbol",), date: str = "date") -> DataFrame:
    """As-of on dates. A symbol's dates are bounded by the calendar, so whole symbols are sorted."""
    l = left.withColumn("__one", F.lit(1))
    r = right.withColumn("__one", F.lit(1))
    return joins.asof_join(l, r, on, cols, left_ts=date, right_ts=available, left_seq="__one", right_seq="__one", bucket_s=None).drop("__one")


def facts_known(days: DataFrame, facts: DataFrame, stale_days: int = 200) -> DataFrame:
    """Latest FILED fact at each symbol-day, with the reason when there is none. Filing order
    decides; the period end is never consulted."""
    per_day = facts.groupBy("symbol", "filed").agg(F.max_by("val", "row_id").alias("val"))
    f = per_day.withColumn("filed_on", F.col("filed"))
    j = asof_daily(days, f, "filed", ["val", "filed_on"])
    listed = facts.select("symbol").distinct().withColumn("__listed", F.lit(True))
    j = j.join(listed, "symbol", "left")
    status = (
        F.when(F.col("__listed").isNull(), "no_facts").when(F.col("val").isNull(), "before_first_filing")
        .when(F.datediff("date", "filed_on") > stale_days, "stale").otherwise("known")
    )
    return j.withColumn("status", status).drop("__listed")


def trailing_event_labels(points: DataFrame, events: DataFrame, a_days: int = 2, b_days: int = 30, shelf_days: int = 90, shelf_min: int = 2) -> DataFrame:
    """Trigger flags per symbol-day from events in (t - N days, t].

    Events are counted per symbol-day first; a RANGE frame over days then reads each window, so
    no event is paired with a point.
    """
    per = events.groupBy("symbol", F.col("day").alias("date")).agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"__{k}") for k in ("A", "B", "SHELF")])
    u = points.withColumn("__p", F.lit(1)).unionByName(per.withColumn("__p", F.lit(0)), allowMissingColumns=True)
    u = u.withColumn("__d", F.unix_date("date"))
    base = Window.partitionBy("symbol").orderBy("__d")
    since = F.max(F.when(F.col("__A") > 0, F.col("__d"))).over(base.rangeBetween(-(shelf_days - 1), 0))
    n = lambda k, days: F.coalesce(F.sum(f"__{k}").over(base.rangeBetween(-(days - 1), 0)), F.lit(0))
    u = (
        u.withColumn("trigger_a", n("A", a_days) > 0).withColumn("trigger_b", n("B", b_days) > 0)
        .withColumn("shelf", n("SHELF", shelf_days) >= shelf_min).withColumn("__age", F.col("__d") - since)
    )
    recency = F.when(F.col("__age").isNull(), "none").when(F.col("__age") < a_days, "fresh").when(F.col("__age") < b_days, "month").otherwise("quarter")
    return u.filter("__p = 1").select("symbol", "date", "trigger_a", "trigger_b", "shelf", recency.alias("recency"))


def event_windows(trades: DataFrame, sessions: DataFrame, events: DataFrame, date: str = "session_date") -> DataFrame:
    """One row per trade, event and part: W0 the session before, W1 the same, W2 the next."""
    t = trades.join(F.broadcast(sessions.select(F.col("date").alias(date), "ordinal")), date)
    parts = F.array(*[F.struct(F.lit(p).alias("part"), (F.col("event_ordinal") + o).alias("ordinal")) for p, o in (("W0", -1), ("W1", 0), ("W2", 1))])
    e = events.select("event_ordinal", F.explode(parts).alias("s")).select("event_ordinal", "s.*")
    return t.join(F.broadcast(e), "ordinal")


def bar_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tapes' bars: coverage each way, mean absolute close difference and volume ratio."""
    l = a.select("symbol", "ts", F.col("close").alias("ca"), F.col("volume").alias("va"))
    r = b.select("symbol", "ts", F.col("close").alias("cb"), F.col("volume").alias("vb"))
    return l.join(r, ["symbol", "ts"], "full_outer").groupBy("symbol").agg(
        F.count(F.when(F.col("ca").isNotNull() & F.col("cb").isNotNull(), 1)).alias("both"),
        F.count(F.when(F.col("cb").isNull(), 1)).alias("only_a"),
        F.count(F.when(F.col("ca").isNull(), 1)).alias("only_b"),
        F.avg(F.abs(F.col("ca") - F.col("cb"))).alias("mean_abs"),
        F.try_divide(F.sum("va"), F.sum("vb")).alias("volume_ratio"),
    )


def tape_conflicts(bars: DataFrame, daily: DataFrame, cents: float = 0.01, share: float = 0.005) -> DataFrame:
    """Symbol-days whose minute extremes leave the daily range by more than the allowance."""
    b = bars.groupBy("symbol", "session_date").agg(F.max("high").alias("bh"), F.min("low").alias("bl"))
    j = b.join(daily, ["symbol", "session_date"])
    allow = F.greatest(F.lit(cents), share * (F.col("hi") - F.col("lo")))
    over, under = F.col("bh") - F.col("hi"), F.col("lo") - F.col("bl")
    return j.filter((over > allow) | (under > allow)).select(
        "symbol", "session_date", F.greatest(over, F.lit(0.0)).alias("above"), F.greatest(under, F.lit(0.0)).alias("below"))


def cover_check(scope: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Counts of scoped keys with no, one and several verdict rows; anything but one refuses."""
    v = verdicts.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    n = F.coalesce(F.col("__n"), F.lit(0))
    return scope.join(v, key, "left").agg(
        F.count(F.when(n == 0, 1)).alias("missing"), F.count(F.when(n > 1, 1)).alias("duplicated"),
        F.count(F.when(n == 1, 1)).alias("matched")).withColumn("refused", (F.col("missing") > 0) | (F.col("duplicated") > 0))


def momentum_sessions(clock_prices: DataFrame, first: str = "p600", late: str = "p930", last: str = "p960", date: str = "session_date") -> DataFrame:
    """Prior session's close, the first half-hour's return against it and the last one's."""
    prior = F.lag(last).over(Window.partitionBy("symbol").orderBy(date))
    return clock_prices.withColumn("prior_close", prior).withColumn("r1", F.try_divide(F.col(first), F.col("prior_close")) - 1).withColumn(
        "r13", F.try_divide(F.col(last), F.col(late)) - 1)


# ---- session validity and regular closes

def session_validity(bars: DataFrame, first_minute: int = 570, window_end: int = 630, max_gap: int = 5) -> DataFrame:
    """Valid when the first bar is present and no gap in the check window exceeds `max_gap` minutes."""
    rth = bars.filter((F.col("minute") >= first_minute) & (F.col("minute") < 960))
    gap = F.col("minute") - W.lag("minute", W.SESSION, "ts")
    rows = rth.withColumn("__g", F.when(F.col("minute") <= window_end, gap))
    return rows.groupBy(*W.SESSION).agg(F.min("minute").alias("first_minute"), F.coalesce(F.max("__g"), F.lit(0)).alias("widest_gap")).withColumn(
        "valid", (F.col("first_minute") == first_minute) & (F.col("widest_gap") <= max_gap))


def session_window(bars: DataFrame, calendar: DataFrame, pad: int = 0) -> DataFrame:
    """Bars of the regular session, 13:00 on early closes, widened by `pad` minutes each side."""
    c = calendar.select(F.col("date").alias("session_date"), F.when(F.col("early_close"), 780).otherwise(960).alias("__close"))
    j = bars.join(F.broadcast(c), "session_date")
    return j.filter((F.col("minute") >= 570 - pad) & (F.col("minute") < F.col("__close") + pad)).drop("__close")


def regular_close_readings(ticks: DataFrame, close_minute: int = 960) -> DataFrame:
    """Readings of the session close: last print before the close, first at or after it, largest
    print of the closing minutes, last of the day and the mean of the last half hour."""
    m, order = F.col("minute"), F.struct("ts", "seq")
    return ticks.groupBy("symbol", "session_date").agg(
        F.max_by(F.when(m < close_minute, F.col("px")), F.when(m < close_minute, order)).alias("last_before"),
        F.min_by(F.when(m >= close_minute, F.col("px")), F.when(m >= close_minute, order)).alias("first_after"),
        F.max_by(F.when(m.between(close_minute - 30, close_minute + 30), F.col("px")),
                 F.when(m.between(close_minute - 30, close_minute + 30), F.struct("size", "ts", "seq"))).alias("largest_near"),
        F.max_by("px", order).alias("last_of_day"),
        F.avg(F.when(m.between(close_minute - 30, close_minute - 1), F.col("px"))).alias("mean_half_hour"),
    )


def score_readings(readings: DataFrame, truth: DataFrame, names: Sequence[str], tolerance: float = 0.005) -> DataFrame:
    """Hit rate of each reading against a known close, over rows where the readings differ."""
    j = readings.join(truth, ["symbol", "session_date"])
    differ = F.greatest(*[F.col(n) for n in names]) - F.least(*[F.col(n) for n in names]) > tolerance
    rows = F.array(*[F.struct(F.lit(n).alias("reading"), F.count(F.when(F.col(n).isNotNull(), 1)).alias("n"),
                              F.avg((F.abs(F.col(n) - F.col("truth")) <= tolerance).cast("int")).alias("hit_rate")) for n in names])
    return j.filter(differ).agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")


# ---- splits

# The split ratios looked for, each way.
SPLIT_FACTORS = (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 1 / 2, 1 / 3, 1 / 4, 1 / 5, 1 / 6, 1 / 8, 1 / 10)


def detect_splits(daily: DataFrame, factors: Sequence[float] = SPLIT_FACTORS, price_tol: float = 3.0, volume_tol: float = 25.0) -> DataFrame:
    """Split factor per row when both the price and the volume ratio fit; nearest factor wins."""
    pr = F.try_divide(W.lag("close", W.DAY, "date"), F.col("close"))
    vr = F.try_divide(F.col("volume"), W.lag("volume", W.DAY, "date"))
    d = daily.withColumn("__p", pr).withColumn("__v", vr)
    fits = F.array(*[F.when((F.abs(F.col("__p") / f - 1) * 100 <= price_tol) & (F.abs(F.col("__v") / f - 1) * 100 <= volume_tol),
                            F.struct(F.abs(F.col("__p") / f - 1).alias("d"), F.lit(float(f)).alias("f"))) for f in factors])
    return d.withColumn("factor", F.array_min(F.array_compact(fits))["f"]).drop("__p", "__v")


def adjust_splits(marked: DataFrame) -> DataFrame:
    """Earlier bars divided by the product of the later factors."""
    later = W.frame(W.DAY, "date", 1, Window.unboundedFollowing)
    scale = F.exp(F.coalesce(F.sum(F.log("factor")).over(later), F.lit(0.0)))
    return marked.withColumn("scale", scale).withColumn("adj_close", F.col("close") / scale).withColumn("adj_volume", F.col("volume") * scale)


def ratio_steps(a: DataFrame, b: DataFrame, step: float = 0.2, reverse_within: int = 5, bad: float = 0.05) -> DataFrame:
    """Steps in the ratio of two close series: one that reverses soon marks bad sessions, any other
    a split; sessions off their segment's median are bad."""
    r = a.select("symbol", "date", F.col("close").alias("ca")).join(b.select("symbol", "date", F.col("close").alias("cb")), ["symbol", "date"])
    r = r.withColumn("ratio", F.round(F.try_divide("ca", "cb"), 9))
    move = F.round(F.try_divide(F.col("ratio"), W.lag("ratio", W.DAY, "date")), 9)
    r = r.withColumn("__m", move).withColumn("step", F.coalesce(F.abs(F.log("__m")) > step, F.lit(False)))
    ahead = W.frame(W.DAY, "date", 1, reverse_within)
    back = W.frame(W.DAY, "date", -reverse_within, -1)
    signed = F.when(F.col("step"), F.signum(F.log("__m")))
    r = r.withColumn("__s", signed)
    undone = (F.col("__s") * F.coalesce(F.min(F.col("__s")).over(ahead), F.col("__s")) < 0) | (F.col("__s") * F.coalesce(F.max(F.col("__s")).over(ahead), F.col("__s")) < 0)
    undoes = (F.col("__s") * F.coalesce(F.min(F.col("__s")).over(back), F.col("__s")) < 0) | (F.col("__s") * F.coalesce(F.max(F.col("__s")).over(back), F.col("__s")) < 0)
    r = r.withColumn("kind", F.when(~F.col("step"), "none").when(undone | undoes, "reversed").otherwise("split"))
    r = r.withColumn("segment", F.sum((F.col("kind") == "split").cast("int")).over(W.frame(W.DAY, "date", Window.unboundedPreceding, 0)))
    med = F.percentile("ratio", F.lit(0.5)).over(Window.partitionBy("symbol", "segment"))
    return r.withColumn("bad_session", F.coalesce(F.abs(F.try_divide(F.col("ratio"), med) - 1) > bad, F.lit(False))).drop("__m", "__s")


# ---- futures

def roll_schedule(contracts: DataFrame, sessions: DataFrame, offset: int = 5) -> DataFrame:
    """Roll session per contract: `offset` sessions before the first session at or after expiry.

    contracts: root, contract, expiry. sessions: date, ordinal.
    """
    s = sessions.select("date", "ordinal")
    ends = s.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).filter("lo is not null")
    # Every day of the calendar with the session at or after it, so that an expiry is an equal key.
    days = ends.select(F.explode(F.sequence("lo", "hi")).alias("date")).join(s, "date", "left")
    ahead = Window.partitionBy().orderBy("date").rowsBetween(0, Window.unboundedFollowing)
    days = days.select(F.col("date").alias("day"), F.first("ordinal", ignorenulls=True).over(ahead).alias("k"))
    at = contracts.join(F.broadcast(ends.select("lo")), how="cross").withColumn("day", F.greatest("expiry", "lo"))
    at = at.join(days, "day").select("root", "contract", "expiry", "k").distinct()
    r = s.select(F.col("date").alias("roll"), (F.col("ordinal") + offset).alias("k"))
    return at.join(r, "k").select("root", "contract", "expiry", "roll")


def held_contract(schedule: DataFrame, days: DataFrame) -> DataFrame:
    """First contract whose roll is strictly after each (root, date)."""
    from tidemark.operators.joins import asof_join

    w = Window.partitionBy("root").orderBy("roll")
    spells = schedule.withColumn("start", F.lag("roll").over(w))
    r = spells.select("root", "contract", "roll", F.col("roll").alias("until"))
    l = days.withColumn("__one", F.lit(1))
    out = asof_join(l, r.withColumn("__one", F.lit(1)), ["root"], ["contract", "until"], left_ts="date", right_ts="roll", left_seq="__one", right_seq="__one",
                    direction="forward", strict=True, bucket_s=None)
    return out.drop("__one")


def with_rolls(held: DataFrame) -> DataFrame:
    """held with `rolled`: the root's previous row held another contract."""
    prev = F.lag("contract").over(Window.partitionBy("root").orderBy("date"))
    return held.withColumn("rolled", F.coalesce(F.col("contract") != prev, F.lit(False)))


def held_series(held: DataFrame, prices: DataFrame) -> DataFrame:
    """Raw, change, base, return, roll gap, back-adjusted level and staleness per (root, date).

    held: root, date, contract. prices: root, contract, date, close. A missing price carries the
    contract's last one and is counted stale. diff(cont) equals the change earned.

    Both sides are dealt out once, by root: a day's prices are a small array on its held row, and the
    array of the row before holds the new contract's price on the roll's eve.
    """
    p = prices.select("root", "date", F.struct("contract", F.col("close").alias("px")).alias("__p"))
    u = held.withColumn("__held", F.lit(True)).unionByName(p, allowMissingColumns=True).repartition("root")
    day = F.collect_list("__p").over(Window.partitionBy("root", "date"))
    h = u.withColumn("__day", F.when(F.col("root").isNotNull() & F.col("date").isNotNull(), day)).filter("__held").drop("__p", "__held")
    price = lambda rows: F.try_element_at(F.filter(rows, lambda x: x["contract"] == F.col("contract")), F.lit(1))["px"]
    root = Window.partitionBy("root").orderBy("date")
    # The new contract's price on the roll's eve gives both the base of the change and the gap.
    h = with_rolls(h).withColumn("__px", price(F.col("__day"))).withColumn("__eve", F.when(F.col("rolled"), price(F.lag("__day").over(root)))).drop("__day")
    w = Window.partitionBy("root", "contract").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    j = h.withColumn("raw", F.last("__px", ignorenulls=True).over(w)).withColumn("stale", F.col("__px").isNull())
    j = j.withColumn("__prev", F.lag("raw").over(root))
    base = F.when(F.col("rolled"), F.coalesce("__eve", "raw")).otherwise(F.col("__prev"))
    j = j.withColumn("base", base).withColumn("change", F.coalesce(F.col("raw") - F.col("base"), F.lit(0.0)))
    j = j.withColumn("gap", F.when(F.col("rolled"), F.coalesce(F.col("base") - F.col("__prev"), F.lit(0.0))).otherwise(0.0))
    # Read backwards, the later gaps are a running sum.
    later = Window.partitionBy("root").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("cont", F.col("raw") + F.coalesce(F.sum("gap").over(later), F.lit(0.0)))
    return j.withColumn("ret", F.try_divide("change", F.nullif(F.col("base"), F.lit(0.0)))).drop("__px", "__eve", "__prev")


def roll_check(a: DataFrame, b: DataFrame, sessions: DataFrame) -> DataFrame:
    """Two readings of the roll calendar: rolls that disagree by more than one session."""
    s = F.broadcast(sessions.select("date", "ordinal"))
    l = a.join(s, F.col("roll") == F.col("date")).select("root", "contract", F.col("ordinal").alias("ka"))
    r = b.join(s, F.col("roll") == F.col("date")).select("root", "contract", F.col("ordinal").alias("kb"))
    return l.join(r, ["root", "contract"]).groupBy("root").agg(F.count(F.lit(1)).alias("rolls"), F.count(F.when(F.abs(F.col("ka") - F.col("kb")) > 1, 1)).alias("off"),
                                                              F.avg((F.abs(F.col("ka") - F.col("kb")) > 1).cast("int")).alias("share_off"))


def roll_volume_share(series: DataFrame, volumes: DataFrame) -> DataFrame:
    """Held contract's share of its root's volume on roll sessions. series: root, date, contract, rolled."""
    rolls = series.filter("rolled").select("root", "date", F.col("contract").alias("__held"))
    own = F.coalesce(F.sum(F.when(F.col("contract") == F.col("__held"), F.col("volume"))), F.lit(0))
    v = volumes.join(rolls, ["root", "date"]).groupBy("root", "date", "__held").agg(F.try_divide(own, F.sum("volume")).alias("share"))
    return v.select("root", "date", F.col("__held").alias("contract"), "share")


def roll_legs(series: DataFrame, ahead: int) -> DataFrame:
    """Contract changes in (entry, exit] for an exit `ahead` rows after each entry: a difference of
    running roll counts, both read in one pass."""
    w = Window.partitionBy("root").orderBy("date")
    n = series.select("root", "date", F.sum(F.col("rolled").cast("int")).over(w).alias("n"))
    legs = n.select("root", F.col("date").alias("entry_date"), F.lead("date", ahead).over(w).alias("exit_date"), (F.lead("n", ahead).over(w) - F.col("n")).alias("roll_legs"))
    return legs.filter("exit_date is not null")



def tranche_book(series: DataFrame, signal: str, vol: str, equity: float, target: float = 0.1, tranches: int = 5, point_value: float = 1.0, sessions: DataFrame | None = None) -> DataFrame:
    """Volatility-scaled positions in tranches that rebalance on different sessions of the month.

    Each tranche resets on its own session ordinal modulo `tranches`; sizes are rounded half away
    from zero and carried between resets; the book is the mean of the tranches.
    """
    kept = staged(series.select("root", "date", "raw", "change", "rolled", F.col(signal).alias("__signal"), F.col(vol).alias("__vol")))
    roots = kept.groupBy("date").agg(F.count(F.when(F.col("__signal").isNotNull() & F.col("__vol").isNotNull(), 1)).alias("live"))
    s = kept.join(F.broadcast(roots), "date").join(F.broadcast(sessions.select("date", "ordinal")), "date")
    dollars = F.col("live") * F.col("raw") * F.col("__vol") * point_value
    raw = F.when(F.col("__vol") > 0, F.try_divide(F.lit(equity * target) * F.col("__signal"), F.nullif(dollars, F.lit(0.0))))
    s = s.withColumn("__set", F.coalesce(F.signum(raw) * F.floor(F.abs(raw) + 0.5), F.lit(0.0)))
    # One column a tranche: all of a root's tranches are read in one sorted pass.
    w = Window.partitionBy("root").orderBy("date")
    each = range(tranches)
    last = lambda k: F.last(F.when(F.col("ordinal") % tranches == k, F.col("__set")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = s.withColumns({f"__now{k}": F.coalesce(last(k), F.lit(0.0)) for k in each})
    t = t.withColumns({f"__was{k}": F.coalesce(F.lag(f"__now{k}").over(w), F.lit(0.0)) for k in each})
    now, was = [F.col(f"__now{k}") for k in each], [F.col(f"__was{k}") for k in each]
    total = lambda cols: reduce(Column.__add__, cols)
    sides = [F.abs(n - o) + F.when(F.col("rolled"), 2 * F.abs(o)).otherwise(0.0) for n, o in zip(now, was)]
    return t.select("root", "date", (total([o * F.col("change") for o in was]) * point_value / tranches).alias("pnl"), (total(sides) / tranches).alias("sides"), (total(now) / tranches).alias("size"))
