"""Point-in-time screens: what a live screen could have seen at each moment."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.functions.clock import micros


@dataclass(frozen=True)
class Screen:
    change_min: float = 20.0
    price_range: tuple[float, float] = (2.0, 25.0)
    volume_min: int = 100_000
    capture: float = 1.0
    top: int = 40
    bar_seconds: int = 60
    open_minute: int = 240
    last_minute: int = 570
    cadence_minutes: int = 5
    ladder: tuple[tuple[int, float], ...] = ()

    def volume_threshold(self, minute: Column) -> Column:
        """Whole shares at a clock minute: the step at or before it, else the first step."""
        if not self.ladder:
            return F.lit(int(round(self.volume_min * self.capture)))
        steps = sorted(self.ladder)
        share = F.lit(float(steps[0][1]))
        for m, c in steps:
            share = F.when(minute >= m, F.lit(float(c))).otherwise(share)
        return F.bround(self.volume_min * share).cast("bigint")


def stage1(features: DataFrame, price=(0.5, 50.0), dollars: float = 25_000.0) -> Column:
    """Knowable before the session."""
    return F.coalesce(
        F.col("prior_close").between(*price) & (F.col("prior_avg_dollar_vol") >= dollars), F.lit(False)
    )


def stage2(rvol: float = 5.0, range_pct: float = 10.0) -> Column:
    """Uses the day's own bar: chooses what to fetch, never what to trade."""
    return F.coalesce((F.col("rvol") >= rvol) & (F.col("range_pct") >= range_pct), F.lit(False))


def select_candidates(features: DataFrame, keep: Column, cap: int) -> DataFrame:
    """Per day the `cap` highest relative volumes, ties by symbol."""
    w = Window.partitionBy("date").orderBy(F.desc("rvol"), "symbol")
    return (
        features.filter(keep & ~P.is_test_symbol(F.col("symbol")))
        .withColumn("day_rank", F.row_number().over(w))
        .filter(F.col("day_rank") <= cap)
    )


def prior_closes(daily: DataFrame, repaired: DataFrame | None = None, require_repaired: bool = False) -> DataFrame:
    """(symbol, date) with the previous session's close and the source it came from.

    A repaired close replaces the daily one; the shift carries close and source together.
    """
    d = daily.select("symbol", "date", "close")
    if repaired is None:
        d = d.withColumn("src", F.lit("daily"))
    else:
        r = repaired.select("symbol", "date", F.col("close").alias("__fixed"))
        d = d.join(r, ["symbol", "date"], "left").select(
            "symbol", "date", F.coalesce("__fixed", "close").alias("close"),
            F.when(F.col("__fixed").isNotNull(), "repaired").otherwise("daily").alias("src"),
        )
    before = F.lag(F.struct("close", "src")).over(Window.partitionBy("symbol").orderBy("date"))
    out = d.withColumn("__p", before).select(
        "symbol", "date", F.col("__p.close").alias("prior_close"), F.col("__p.src").alias("prior_source")
    )
    return out.filter("prior_source = 'repaired'") if require_repaired else out


def tick_grid(bars: DataFrame, cfg: Screen) -> DataFrame:
    """One row per session and screen tick. `session_date` rows are few: one per trading day."""
    minutes = F.sequence(
        F.lit(cfg.open_minute + cfg.cadence_minutes), F.lit(cfg.last_minute), F.lit(cfg.cadence_minutes)
    )
    return bars.select("session_date").distinct().withColumn("tick", F.explode(minutes))


def running_screen(bars: DataFrame, prior: DataFrame, cfg: Screen = Screen()) -> DataFrame:
    """The screen's list at every tick: last close and running volume per symbol, three clauses,
    a sort and a cap.

    A bar counts from the first tick at or after its close. Each symbol-session is first cut to
    those that could ever pass (highest change and total volume over the window), so quiet
    symbols never meet the tick grid; the survivors' bars are folded to one row per tick and
    carried forward only between the first tick they appear and the last tick of the session.
    """
    inside = bars.filter((F.col("minute") >= cfg.open_minute) & (F.col("minute") * 60 + cfg.bar_seconds <= cfg.last_minute * 60))
    known = inside.join(
        prior.select("symbol", F.col("date").alias("session_date"), "prior_close"), ["symbol", "session_date"]
    ).filter((F.col("prior_close") > 0) & ~P.is_test_symbol(F.col("symbol")))
    c = cfg.cadence_minutes
    offset = F.col("minute") * 60 + cfg.bar_seconds - cfg.open_minute * 60
    tick = F.greatest(F.ceil(offset / (c * 60)) * c + cfg.open_minute, F.lit(cfg.open_minute + c)).cast("int")
    per_tick = (
        known.withColumn("tick", tick)
        .groupBy("session_date", "symbol", "tick")
        .agg(F.max_by("close", "minute").alias("close"), F.sum("volume").alias("vol"),
             F.max("prior_close").alias("prior_close"), F.max("close").alias("__top"))
    )
    key = Window.partitionBy("session_date", "symbol")
    ordered = key.orderBy("tick")
    change = (F.try_divide("close", "prior_close") - 1) * 100
    runs = (
        per_tick.withColumn("__best", F.max((F.col("__top") / F.col("prior_close") - 1) * 100).over(key))
        .withColumn("cum_volume", F.sum("vol").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__next", F.lead("tick").over(ordered))
        .filter(F.col("__best") >= cfg.change_min - P.CHANGE_EPS)
        .withColumn("change", change)
        .filter((F.col("change") >= cfg.change_min - P.CHANGE_EPS) & F.col("close").between(*cfg.price_range))
    )
    last = F.coalesce(F.col("__next") - c, F.lit(cfg.last_minute))
    held = runs.withColumn("tick", F.explode(F.sequence(F.col("tick"), last, F.lit(c))))
    passed = held.filter(F.col("cum_volume") >= cfg.volume_threshold(F.col("tick")))
    w = Window.partitionBy("session_date", "tick").orderBy(F.desc("change"), "symbol")
    return (
        passed.withColumn("position", F.row_number().over(w))
        .filter(F.col("position") <= cfg.top)
        .select("session_date", "tick", "symbol", "close", "cum_volume", "change", "position")
    )


def first_seen(selection: DataFrame) -> DataFrame:
    """One row per symbol-session that ever held a place."""
    return selection.groupBy("session_date", "symbol").agg(
        F.min("tick").alias("first_seen"),
        F.min_by("position", "tick").alias("first_rank"),
        F.min("position").alias("best_rank"),
        F.count(F.lit(1)).alias("ticks_on"),
    )


def screen_at(bars: DataFrame, prior: DataFrame, minute: int, cfg: Screen = Screen()) -> DataFrame:
    """The list at one clock minute of every session, from the bars closed by then."""
    seen = bars.filter(
        (F.col("minute") >= cfg.open_minute) & (F.col("minute") * 60 + cfg.bar_seconds <= minute * 60)
    )
    state = seen.groupBy("session_date", "symbol").agg(
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("cum_volume")
    )
    p = prior.select("symbol", F.col("date").alias("session_date"), "prior_close")
    df = state.join(p, ["symbol", "session_date"]).filter(F.col("prior_close") > 0)
    df = df.withColumn("change", (F.col("close") / F.col("prior_close") - 1) * 100)
    df = df.filter(
        (F.col("change") >= cfg.change_min - P.CHANGE_EPS)
        & F.col("close").between(*cfg.price_range)
        & (F.col("cum_volume") >= cfg.volume_threshold(F.lit(minute)))
        & ~P.is_test_symbol(F.col("symbol"))
    )
    w = Window.partitionBy("session_date").orderBy(F.desc("change"), "symbol")
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= cfg.top)


def clause_margins(df: DataFrame, clauses: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Relative distance of every clause from its threshold, the smallest one and its name.

    Each clause is (column, 'min' or 'max', threshold); a positive margin clears it.
    """
    names = []
    for col, kind, cut in clauses:
        m = (F.col(col) - cut) / abs(cut) if kind == "min" else (F.lit(cut) - F.col(col)) / abs(cut)
        df = df.withColumn(f"{col}_margin", m)
        names.append(f"{col}_margin")
    df = df.withColumn("slack", F.least(*[F.col(n) for n in names]))
    binds = F.coalesce(*[F.when(F.col(n) == F.col("slack"), F.lit(n[:-7])) for n in names])
    return df.withColumn("binding", binds)


def rank_and_slice(df: DataFrame, by: Sequence[str], score: str, hit: Column, tops: Sequence[int], tie: str = "symbol") -> DataFrame:
    """Hit rate of the top n of each group against the whole pool."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    ranked = df.withColumn("__rk", F.row_number().over(w)).withColumn("__hit", hit.cast("int"))
    aggs = []
    for n in tops:
        aggs += [
            F.sum(F.when(F.col("__rk") <= n, F.col("__hit")).otherwise(0)).alias(f"hits_{n}"),
            F.count(F.when(F.col("__rk") <= n, 1)).alias(f"rows_{n}"),
        ]
    out = ranked.agg(F.sum("__hit").alias("hits"), F.count(F.lit(1)).alias("rows_all"), *aggs)
    cols = []
    for n in tops:
        rate = F.try_divide(F.col(f"hits_{n}"), F.col(f"rows_{n}"))
        base = F.try_divide(F.col("hits"), F.col("rows_all"))
        cols.append(F.struct(F.lit(n).alias("top"), rate.alias("rate"), base.alias("pool_rate"),
                             F.try_divide(rate, base).alias("lift")))
    return out.select(F.explode(F.array(*cols)).alias("s")).select("s.*")


def tiers(state: DataFrame, cap: int = 40) -> DataFrame:
    """HOT: in the list now and in band; WARM: now, out of band; COLD: remembered, latest first."""
    tier = F.when(F.col("current") & F.col("in_band"), 0).when(F.col("current"), 1).otherwise(2)
    w = Window.partitionBy("session_date").orderBy("tier", F.desc("last_seen"), "symbol")
    return (
        state.withColumn("tier", tier)
        .withColumn("position", F.row_number().over(w))
        .filter(F.col("position") <= cap)
    )


def bottom_decile(df: DataFrame, by: Sequence[str], value: str, code: str = "symbol") -> DataFrame:
    """Worst values first, ties by code; the count is a tenth rounded half to even, at least one."""
    w = Window.partitionBy(*by)
    n = F.greatest(F.lit(1), F.bround(F.count(value).over(w) / 10).cast("int"))
    return (
        df.filter(F.col(value).isNotNull())
        .withColumn("picks", n)
        .withColumn("place", F.row_number().over(w.orderBy(value, code)))
        .filter(F.col("place") <= F.col("picks"))
    )


def pit_epoch(ts: str) -> Column:
    return micros(ts)
