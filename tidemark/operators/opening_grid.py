"""The opening-range grid: every cell of four axes from one pass over the session's bars.

Axes: length of the range, where the stop goes, whether a retest is asked for, and the exit. A cell shares
all it can with its neighbours: ranges are conditional aggregates of one scan, triggers and retests are
first bars per length, and the exits of an entry are first touches on the same joined rows. A session
that gives no trade is counted under the reason, for every cell.

Conventions: entry is the open of the bar after the one that decides; the stop wins a bar that holds stop and
target; a stop that is gapped through fills at the open, a target never better than its level; what moves
a stop (peak, break-even) is known from earlier bars only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import windows as W
from tidemark.operators.grids import cells

AXES = ("minutes", "stop", "retest", "exit")
REASONS = ("no_range", "too_narrow", "too_wide", "no_trigger", "retest_failed", "no_entry_bar", "too_late", "risk_not_positive", "risk_too_wide")


@dataclass(frozen=True)
class OpeningGrid:
    minutes: tuple[int, ...] = (5, 15, 30)
    stops: tuple[str, ...] = ("structure", "range_share")
    retests: tuple[str, ...] = ("none", "level", "zone")
    exits: tuple[str, ...] = ("r_2", "r_1_5", "r_3_trim", "range_1x", "trail")
    open_minute: int = 570
    last_entry: int = 950
    last_bar: int = 955
    range_pct: tuple[float, float] = (0.5, 25.0)
    risk_pct: float = 12.0
    stop_buffer: float = 0.001
    stop_share: float = 0.5
    zone: float = 0.62
    retest_bars: int = 6
    trail: float = 0.05

    def cells(self) -> list[dict]:
        return cells(minutes=self.minutes, stop=self.stops, retest=self.retests, exit=self.exits)

    def neighbours(self) -> list[tuple[int, int]]:
        """Numbers of cells that differ by one step of one axis."""
        axes = (self.minutes, self.stops, self.retests, self.exits)
        at = [tuple(axis.index(c[name]) for name, axis in zip(AXES, axes)) for c in self.cells()]
        return [(i, j) for i, a in enumerate(at) for j, b in enumerate(at) if sum(abs(x - y) for x, y in zip(a, b)) == 1]


def _one_of(column: str, ways: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, value in ways.items():
        out = F.when(F.col(column) == name, value).otherwise(out)
    return out


def _percent(x: Column, base: Column) -> Column:
    """x in percent of a price; of a price of zero it is beyond every limit."""
    return F.when(base == 0, float("inf")).otherwise(F.try_divide(x, base) * 100)


def _spread(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))


def setups(bars: DataFrame, g: OpeningGrid) -> DataFrame:
    """A row per session, length and retest rule: the range, the number of the entry bar, and why there is none."""
    by, keys = list(W.SESSION), [*W.SESSION, "minutes"]
    inside = lambda m: (F.col("minute") < g.open_minute + m)
    spans = [F.struct(F.lit(m).alias("minutes"), F.max(F.when(inside(m), F.col("high"))).alias("hi"), F.min(F.when(inside(m), F.col("low"))).alias("lo")) for m in g.minutes]
    ranges = bars.groupBy(*by).agg(F.array(*spans).alias("r")).select(*by, F.explode("r").alias("r")).select(*by, "r.*")
    pct = _percent(F.col("hi") - F.col("lo"), F.col("lo"))
    ranges = ranges.withColumn("width", F.col("hi") - F.col("lo")).withColumn(
        "refused", F.when(F.col("hi").isNull(), "no_range").when(pct < g.range_pct[0], "too_narrow").when(pct > g.range_pct[1], "too_wide"))
    later = bars.join(ranges.filter("refused IS NULL"), by).filter(F.col("minute") >= g.open_minute + F.col("minutes"))
    trigger = later.filter("close > hi").groupBy(*keys).agg(F.min("i").alias("trigger"))
    # A retest looks at the bars after the trigger until one closes below the range.
    tried = later.join(trigger, keys).filter((F.col("i") > F.col("trigger")) & (F.col("i") < F.col("trigger") + g.retest_bars))
    upto = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    depth = {"level": F.col("hi"), "zone": F.col("lo") + g.zone * F.col("width")}
    back = {name: (F.max((F.col("low") <= d).cast("int")).over(upto) == 1) & (F.col("close") > F.col("hi")) for name, d in depth.items()}
    tried = tried.select(*keys, "i", (F.col("close") < F.col("lo")).alias("dead"), *[c.alias(name) for name, c in back.items()])
    tests = tried.groupBy(*keys).agg(F.min(F.when(F.col("dead"), F.col("i"))).alias("dead"), *[F.min(F.when(F.col(name), F.col("i"))).alias(name) for name in back])
    every = _spread(ranges.join(trigger, keys, "left").join(tests, keys, "left"), "retest", g.retests)
    alive = lambda c: F.when(F.col("dead").isNull() | (F.col(c) < F.col("dead")), F.col(c))
    decided = _one_of("retest", {"none": F.col("trigger"), "level": alive("level"), "zone": alive("zone")})
    every = every.withColumn("entry_i", decided + 1)
    why = F.coalesce("refused", F.when(F.col("trigger").isNull(), "no_trigger").when(F.col("entry_i").isNull(), "retest_failed"))
    return every.select(*keys, "retest", "hi", "lo", "width", "entry_i", why.alias("refused"))


def _exits(rows: DataFrame, keys: Sequence[str], g: OpeningGrid) -> DataFrame:
    """Result per share of every exit rule, for the bars from the entry on."""
    before = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    o, h, l, e, r = (F.col(c) for c in ("open", "high", "low", "entry", "risk"))
    peak = F.greatest(e, F.max("high").over(before))
    armed = F.coalesce(F.max((h >= e + 0.5 * F.col("width")).cast("int")).over(before), F.lit(0)) == 1
    levels = {"plain": F.col("stop_px"), "be": F.when(armed, F.greatest("stop_px", "entry")).otherwise(F.col("stop_px")), "trailed": F.greatest(F.col("stop_px"), peak * (1 - g.trail))}
    goals = {"t15": e + 1.5 * r, "t2": e + 2 * r, "t3": e + 3 * r, "tw": e + F.col("width")}
    rows = rows.select("*", *[F.when(l <= v, F.struct("i", F.least(o, v).alias("px"))).alias(n) for n, v in levels.items()], *[F.when(h >= v, F.col("i")).alias(n) for n, v in goals.items()])
    rows = rows.withColumn("half_at", F.min("t2").over(Window.partitionBy(*keys)))
    firsts = [F.min(c).alias(c) for c in [*levels, "t15", "t2", "tw"]] + [F.min(F.when(F.col("t3") > F.col("half_at"), F.col("t3"))).alias("t3")]
    x = rows.groupBy(*keys).agg(F.max("entry").alias("entry"), F.max("risk").alias("risk"), F.max("width").alias("width"), F.max_by("close", "i").alias("end"), *firsts)
    gain = lambda stop: F.coalesce(F.col(f"{stop}.px"), F.col("end")) - F.col("entry")
    hits = lambda goal, stop: F.col(goal).isNotNull() & (F.col(f"{stop}.i").isNull() | (F.col(goal) < F.col(f"{stop}.i")))
    result = {
        "r_2": F.when(hits("t2", "plain"), 2 * F.col("risk")).otherwise(gain("plain")),
        "r_1_5": F.when(hits("t15", "plain"), 1.5 * F.col("risk")).otherwise(gain("plain")),
        "r_3_trim": F.when(hits("t2", "plain"), 0.5 * (2 * F.col("risk")) + 0.5 * F.when(hits("t3", "plain"), 3 * F.col("risk")).otherwise(gain("plain"))).otherwise(gain("plain")),
        "range_1x": F.when(hits("tw", "be"), F.col("width")).otherwise(gain("be")),
        "trail": gain("trailed"),
    }
    return x.select(*keys, "entry", F.explode(F.array(*[F.struct(F.lit(n).alias("exit"), c.alias("gain")) for n, c in result.items() if n in g.exits])).alias("x")).select(*keys, "x.exit", (F.col("x.gain") / F.col("entry")).alias("ret"))


def opening_results(bars: DataFrame, g: OpeningGrid = OpeningGrid()) -> DataFrame:
    """A row per session and cell: `refused` (null where there was a trade) and its return."""
    by, base = list(W.SESSION), [*W.SESSION, "minutes", "retest"]
    session = Window.partitionBy(*by).orderBy("ts")
    used = bars.filter((F.col("minute") >= g.open_minute) & (F.col("minute") <= g.last_bar)).select(
        *by, "minute", "open", "high", "low", "close", F.row_number().over(session).alias("i"), F.lag("low").over(session).alias("anchor"))
    plans = setups(used, g)
    at = used.select(*by, F.col("i").alias("entry_i"), F.col("minute").alias("entry_minute"), F.col("open").alias("entry"), "anchor")
    plans = plans.join(at, [*by, "entry_i"], "left")
    plans = plans.withColumn("refused", F.coalesce("refused", F.when(F.col("entry").isNull(), "no_entry_bar").when(F.col("entry_minute") >= g.last_entry, "too_late")))
    plans = _spread(plans, "stop", g.stops)
    stop = _one_of("stop", {"structure": F.col("anchor") - F.col("entry") * g.stop_buffer, "range_share": F.col("entry") - g.stop_share * F.col("width")})
    plans = plans.withColumn("stop_px", stop).withColumn("risk", F.col("entry") - F.col("stop_px"))
    risky = F.when(F.col("risk") <= 0, "risk_not_positive").when(_percent(F.col("risk"), F.col("entry")) > g.risk_pct, "risk_too_wide")
    plans = plans.withColumn("refused", F.coalesce("refused", risky))
    keys = [*base, "stop"]
    held = plans.filter("refused IS NULL").select(*keys, "entry_i", "entry", "stop_px", "risk", "width")
    rows = held.join(used.drop("anchor"), by).filter("i >= entry_i")
    return _spread(plans.select(*keys, "refused"), "exit", g.exits).join(_exits(rows, keys, g), [*keys, "exit"], "left")


def opening_report(results: DataFrame, g: OpeningGrid = OpeningGrid(), least: int = 1) -> DataFrame:
    """Every cell, never ordered by result: trades, net, the sessions refused by reason, and the share of
    neighbours (one step of one axis away) whose net is above zero."""
    counts = [F.count(F.when(F.col("refused") == c, 1)).alias(c) for c in REASONS]
    traded = F.col("refused").isNull()
    summed = results.groupBy(*AXES).agg(
        F.count(F.lit(1)).alias("sessions"), F.count(F.when(traded, 1)).alias("trades"), F.coalesce(F.sum(F.when(traded, F.col("ret"))), F.lit(0.0)).alias("net"),
        F.count(F.when(traded & (F.col("ret") > 0), 1)).alias("wins"), *counts)
    number = F.array(*[F.struct(F.lit(k).alias("cell"), *[F.lit(c[a]).alias(a) for a in AXES]) for k, c in enumerate(g.cells())])
    numbered = results.sparkSession.range(1).select(F.explode(number).alias("c")).select("c.*")
    table = F.broadcast(numbered).join(summed, list(AXES), "left").fillna(0)  # cells without a session are rows too
    pairs = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(j).alias("other")) for i, j in g.neighbours()])
    near = results.sparkSession.range(1).select(F.explode(pairs).alias("p")).select("p.*")
    others = near.join(table.select(F.col("cell").alias("other"), F.col("net").alias("__net")), "other").groupBy("cell").agg(
        F.count(F.lit(1)).alias("neighbours"), F.avg((F.col("__net") > 0).cast("int")).alias("neighbours_positive"))
    return table.join(others, "cell").withColumn("thin", F.col("trades") < least)
