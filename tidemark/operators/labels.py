"""Outcome labels of entries: each entry meets its later bars inside its own session (or a bar
horizon) and the first barrier touched decides. Nothing simulates orders; every label is an
aggregate over (entry, later bar) rows that share the entry's key, so the rows are never shuffled
again after the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import windows as W

STOP, TARGET, TIME, SIGNAL, END = 1, 2, 3, 4, 5
REASONS = {STOP: "stop", TARGET: "target", TIME: "time", SIGNAL: "signal", END: "end"}


def numbered(bars: DataFrame, by: Sequence[str] = W.SESSION, order: str = "ts") -> DataFrame:
    return bars.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def later_bars(entries: DataFrame, bars: DataFrame, by: Sequence[str] = W.SESSION, horizon: int | None = None, cols: Sequence[str] = ("open", "high", "low", "close"),
               include_entry: bool = False) -> DataFrame:
    """(entry, bar) rows for bars after the entry's own. `entries` carries entry_id, i and `by`.

    With a horizon, bars and entries meet in bins of its length, so an entry meets at most two bins.
    """
    b = bars.select(*by, F.col("i").alias("j"), *[F.col(c).alias(f"b_{c}") for c in cols])
    first = F.col("j") >= F.col("i") if include_entry else F.col("j") > F.col("i")
    if horizon is None:
        return entries.join(b, list(by)).filter(first)
    bin_of = lambda c: F.floor(c / max(1, horizon)).cast("bigint")
    e = entries.withColumn("__bin", F.explode(F.sequence(bin_of(F.col("i")), bin_of(F.col("i") + horizon))))
    out = e.join(b.withColumn("__bin", bin_of(F.col("j"))), [*by, "__bin"]).drop("__bin")
    return out.filter(first & (F.col("j") <= F.col("i") + horizon))


def first_touch(pairs: DataFrame, by: Sequence[str] = W.SESSION, max_bars: int | None = None, through: float = 0.0, signal: str | None = None) -> DataFrame:
    """First of stop > target > time > signal > end per long entry.

    A bar that opens beyond a level fills at its open; a stop wins a tie within a bar. Targets may
    need a print `through` beyond them. Needs stop_px and target_px (NULL when absent).
    """
    o, h, l, c = (F.col(f"b_{x}") for x in ("open", "high", "low", "close"))
    stop, target = F.col("stop_px"), F.col("target_px")
    age = F.col("j") - F.col("i")
    code = F.when(l <= stop, STOP).when(h >= target + through, TARGET)
    if max_bars is not None:
        code = code.when(age >= max_bars, TIME)
    if signal is not None:
        code = code.when(F.coalesce(F.col(f"b_{signal}"), F.lit(False)), SIGNAL)
    px = F.when(code == STOP, F.least(stop, o)).when(code == TARGET, F.greatest(target, o)).otherwise(c)
    hit = F.when(code.isNotNull(), F.struct(F.col("j").alias("j"), code.alias("code"), px.alias("px")))
    last = F.struct(F.col("j").alias("j"), F.lit(END).alias("code"), c.alias("px"))
    g = pairs.groupBy(*by, "entry_id").agg(
        F.max("entry_px").alias("entry_px"), F.max("i").alias("i"), F.min(hit).alias("__hit"), F.max(last).alias("__last"))
    e = F.coalesce("__hit", "__last")
    reason = F.element_at(F.create_map(*[x for k, v in REASONS.items() for x in (F.lit(k), F.lit(v))]), e["code"])
    return g.select(*by, "entry_id", "entry_px", e["px"].alias("exit_px"), reason.alias("reason"), (e["j"] - F.col("i")).alias("bars_held"))


def trailing_exit(pairs: DataFrame, pct: float, by: Sequence[str] = W.SESSION, seed: Column | None = None, ratchet: tuple[float, float] | None = None, atr_mult: float | None = None) -> DataFrame:
    """Stop that follows the running high since entry and takes effect on the next bar.

    `seed` is where the maximum starts (the entry price by default). `ratchet` (gain, lock) lifts
    the level to entry*(1+lock) once the high reached entry*(1+gain); levels never loosen because
    the running high never falls. With `atr_mult` the distance is that many entry ATRs.
    """
    key = Window.partitionBy(*by, "entry_id").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("entry_px") if seed is None else seed
    top = F.greatest(start, F.coalesce(F.max("b_high").over(key), start))
    level = top - atr_mult * F.col("entry_atr") if atr_mult is not None else top * (1 - pct)
    if ratchet is not None:
        gain, lock = ratchet
        level = F.greatest(level, F.when(top >= F.col("entry_px") * (1 + gain), F.col("entry_px") * (1 + lock)).otherwise(level))
    staged = pairs.drop("stop_px", "target_px").withColumn("stop_px", level).withColumn("target_px", F.lit(None).cast("double"))
    return first_touch(staged, by)


def flag_exit(pairs: DataFrame, flag: str, by: Sequence[str] = W.SESSION) -> DataFrame:
    """Leave at the close of the first later bar that carries the flag, else at the end."""
    none = F.lit(None).cast("double")
    return first_touch(pairs.drop("stop_px", "target_px").withColumn("stop_px", none).withColumn("target_px", none), by, signal=flag)


def exit_flags(bars: DataFrame, ema: str = "ema9", reds: int = 3, by=W.SESSION, order="ts") -> DataFrame:
    """Bar flags of the average-trail, red-run, reversal-candle and jump exits."""
    red = (F.col("close") < F.col("open")).cast("int")
    df = bars.withColumn("__red", red)
    run = F.sum("__red").over(W.frame(by, order, -(reds - 1), 0)) == reds
    body, rng = F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")
    reversal = (rng > 0) & ((F.col("high") - F.greatest("open", "close")) >= 2 * body) & (F.col("close") < F.col("open"))
    return (
        df.withColumn("below_ema", F.coalesce(F.col("close") < F.col(ema), F.lit(False)))
        .withColumn("red_run", F.coalesce(run, F.lit(False)))
        .withColumn("reversal", F.coalesce(reversal, F.lit(False)))
        .withColumn("jump", F.coalesce(F.col("close") >= 1.5 * W.lag("close", by, order), F.lit(False)))
        .drop("__red")
    )


def excursions(bars: DataFrame, by=W.SESSION, order="ts", horizon: int | None = None) -> DataFrame:
    """MFE and MAE of entering at each bar's close, from the next bar to the session's end or a
    horizon, and which extreme came first. A frame over following rows: no pairs."""
    w = W.frame(by, order, 1, Window.unboundedFollowing if horizon is None else horizon)
    df = bars if "i" in bars.columns else numbered(bars, by, order)
    c = F.col("close")
    top = F.max(F.struct(F.col("high").alias("p"), (-F.col("i")).alias("at"))).over(w)
    low = F.min(F.struct(F.col("low").alias("p"), F.col("i").alias("at"))).over(w)
    df = df.withColumn("__t", top).withColumn("__l", low)
    return (
        df.withColumn("mfe", F.coalesce(F.try_divide(F.col("__t.p") - c, c), F.lit(0.0))).withColumn("mae", F.coalesce(F.try_divide(c - F.col("__l.p"), c), F.lit(0.0)))
        .withColumn("high_first", F.when(F.col("__t").isNotNull(), -F.col("__t.at") < F.col("__l.at"))).drop("__t", "__l")
    )


def rebounds(pairs: DataFrame, by=W.SESSION, worse: float = 0.05) -> DataFrame:
    """For each entry: did it go under water, when was it back at entry, how long below, and whether
    it was back before falling `worse` further."""
    e = F.col("entry_px")
    under, back_cond = F.col("b_low") < e, F.col("b_high") >= e
    g = pairs.groupBy(*by, "entry_id").agg(
        F.min(F.when(under, F.col("j"))).alias("under_at"), F.min(F.when(F.col("b_low") <= e * (1 - worse), F.col("j"))).alias("worse_at"),
        F.max("b_high").alias("best"), F.min("b_low").alias("worst"), F.max("entry_px").alias("entry_px"), F.max("i").alias("i"))
    again = pairs.join(g.select(*by, "entry_id", "under_at"), [*by, "entry_id"]).filter(back_cond & (F.col("j") > F.col("under_at"))).groupBy(
        *by, "entry_id").agg(F.min("j").alias("back_at"))
    out = g.join(again, [*by, "entry_id"], "left")
    first = F.when(F.col("back_at").isNull() & F.col("worse_at").isNull(), "neither").when(
        F.col("worse_at").isNull() | (F.col("back_at") < F.col("worse_at")), "back").otherwise("worse")
    return out.withColumn("went_under", F.col("under_at").isNotNull()).withColumn("bars_under", F.col("back_at") - F.col("under_at")).withColumn(
        "first", F.when(F.col("under_at").isNotNull(), first))


def rung_survival(outcomes: DataFrame, bands: Sequence[float] = (0.9, 0.95, 1.0, 1.05, 1.1, 1.21)) -> DataFrame:
    """Share of trades whose exit/entry lies in each band and whose best moment reached each rung."""
    ratio = F.try_divide(F.col("exit_px"), F.col("entry_px"))
    rows = []
    for a, b in zip((0.0, *bands), (*bands, None)):
        inside = (ratio >= a) & (ratio < b) if b is not None else ratio >= a
        rows.append(F.struct(F.lit(float(a)).alias("from_ratio"), F.avg(inside.cast("int")).alias("share"), F.avg((1 + F.col("mfe") >= a).cast("int")).alias("reached")))
    return outcomes.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def perfect_exit(outcomes: DataFrame, friction: float) -> DataFrame:
    """The book had each trade left at its own best moment, and the share that could never pay."""
    best = F.col("mfe") * F.col("entry_px")
    return outcomes.agg(F.count(F.lit(1)).alias("trades"), F.sum(best - friction).alias("ceiling"), F.avg((best < friction).cast("int")).alias("never_covered"))


def stop_scan(outcomes: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Book result had a stop at each level been in force, from MAE alone; one pass for all levels."""
    ret = F.try_divide(F.col("exit_px"), F.col("entry_px")) - 1
    rows = [F.struct(F.lit(float(s)).alias("stop_level"), F.sum(F.when(F.col("mae") >= s, -s).otherwise(ret)).alias("total"),
                     F.avg((F.col("mae") >= s).cast("int")).alias("stopped")) for s in levels]
    return outcomes.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def n_day_exit(picks: DataFrame, calendar: DataFrame, prices: DataFrame, n: int) -> DataFrame:
    """Enter at the next session's price and leave n sessions later; unfilled rows keep a reason.

    prices: symbol, date, px. Ordinals turn session offsets into equi-joins.
    """
    cal = calendar.select("date", "ordinal")
    p = prices.join(F.broadcast(cal), "date").select("symbol", "ordinal", "px")
    k = picks.join(F.broadcast(cal), "date").select("symbol", "date", F.col("ordinal").alias("k"))
    e = p.select("symbol", (F.col("ordinal") - 1).alias("k"), F.col("px").alias("entry_px"))
    x = p.select("symbol", (F.col("ordinal") - 1 - n).alias("k"), F.col("px").alias("exit_px"))
    out = k.join(e, ["symbol", "k"], "left").join(x, ["symbol", "k"], "left")
    last = cal.agg(F.max("ordinal").alias("__max"))
    out = out.join(F.broadcast(last), how="cross")
    status = F.when(F.col("k") + 1 + n > F.col("__max"), "past_end").when(F.col("entry_px").isNull(), "no_entry").when(
        F.col("exit_px").isNull(), "no_exit").otherwise("filled")
    return out.withColumn("status", status).withColumn("ret", F.when(status == "filled", F.try_divide(F.col("exit_px"), F.col("entry_px")) - 1)).drop("k", "__max")


def entry_minute_order(entries: DataFrame, ticks: DataFrame, by: Sequence[str] = ("symbol", "session_date", "minute")) -> DataFrame:
    """Inside the entry minute: did the stop print before the trigger, after it, or not at all."""
    t = ticks.select(*by, F.struct("ts", "seq").alias("at"), "px")
    j = entries.join(t, list(by))
    g = j.groupBy("entry_id").agg(
        F.min(F.when(F.col("px") >= F.col("trigger_px"), F.col("at"))).alias("trig"), F.min(F.when(F.col("px") <= F.col("stop_px"), F.col("at"))).alias("stop"),
        F.max(F.when(F.col("px") <= F.col("stop_px"), F.col("at"))).alias("stop_last"))
    kind = F.when(F.col("trig").isNull(), "no_trigger").when(F.col("stop").isNull(), "clean").when(
        F.col("stop_last") > F.col("trig"), "stop_after").otherwise("stop_before")
    return g.select("entry_id", kind.alias("order_in_minute"))


def post_stop_rally(outcomes: DataFrame, bars: DataFrame, horizon: int, by=W.SESSION) -> DataFrame:
    """Best move within `horizon` bars after each stop exit."""
    s = outcomes.filter("reason = 'stop'")
    b = bars.select(*by, F.col("i").alias("j"), "high")
    at = F.col("i0") + F.col("bars_held")
    return s.join(b, list(by)).filter((F.col("j") > at) & (F.col("j") <= at + horizon)).groupBy("entry_id").agg(
        (F.try_divide(F.max("high"), F.max("exit_px")) - 1).alias("rally"))
