"""Bars: ticks folded to intervals, bars to coarser bars, sessions to summary rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import clock


def first_by(value: str, *order: str) -> Column:
    return F.min_by(value, F.struct(*order))


def last_by(value: str, *order: str) -> Column:
    return F.max_by(value, F.struct(*order))


def resample_ticks(
    ticks: DataFrame, seconds: int, by: Sequence[str] = ("symbol",), px="px", size="size", seq="seq"
) -> DataFrame:
    """First/max/min/last/sum per key and interval, stamped with the interval's start.

    Intervals without a trade have no row. Partial aggregation runs before the shuffle, so a
    hot key sends one row per task and interval.
    """
    return (
        ticks.withColumn("__start", clock.floor_to("ts", seconds))
        .groupBy(*by, F.col("__start"))
        .agg(
            first_by(px, "ts", seq).alias("open"),
            F.max(px).alias("high"),
            F.min(px).alias("low"),
            last_by(px, "ts", seq).alias("close"),
            F.sum(size).alias("volume"),
            F.count(F.lit(1)).alias("trades"),
        )
        .withColumnRenamed("__start", "ts")
    )


def coarsen(bars: DataFrame, by: Sequence[str], order: str = "ts") -> DataFrame:
    """Bars to one coarser bar per key; `by` holds the coarser interval."""
    return bars.groupBy(*by).agg(
        first_by("open", order).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        last_by("close", order).alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("bars"),
    )


def stamp_session(bars: DataFrame) -> DataFrame:
    return bars.withColumn("session_date", clock.session_date("ts")).withColumn(
        "minute", clock.minute_of_day("ts")
    )


def resample_bars(bars: DataFrame, minutes: int, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Minute bars to wider bars on the UTC grid, left-labelled."""
    keyed = bars.withColumn("bucket_ts", clock.floor_to("ts", minutes * 60))
    return coarsen(keyed, [*by, "bucket_ts"]).withColumnRenamed("bucket_ts", "ts")


def session_slots(bars: DataFrame, start: int = 570, end: int = 960, width: int = 60) -> DataFrame:
    """Session bars on a clock grid: slot 0 starts at `start`."""
    keyed = bars.filter((F.col("minute") >= start) & (F.col("minute") < end)).withColumn(
        "slot", clock.hour_slot(F.col("minute"), start, width)
    )
    return coarsen(keyed, ["symbol", "session_date", "slot"])


def futures_bars(bars: DataFrame, hours: int = 4) -> DataFrame:
    """Around-the-clock bars bucketed by wall-clock hours since the 18:00 open.

    The 17:00 settlement hour is dropped; the bar keeps the stamp of its last source bar.
    """
    wall = clock.local("ts")
    keyed = (
        bars.filter(F.hour(wall) != 17)
        .withColumn("futures_date", clock.futures_session("ts"))
        .withColumn("slot", F.floor(((F.hour(wall) + 6) % 24) / hours).cast("int"))
    )
    return keyed.groupBy("symbol", "futures_date", "slot").agg(
        first_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        last_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
        F.max("ts").alias("last_ts"),
    )


def iso_week(date) -> Column:
    """ISO year and week as one sortable number."""
    return F.year(F.date_add(F.date_trunc("week", date).cast("date"), 3)) * 100 + F.weekofyear(date)


def weekly_bars(daily: DataFrame) -> DataFrame:
    keyed = daily.withColumn("week", iso_week("date"))
    out = coarsen(keyed, ["symbol", "week"], order="date")
    last = keyed.groupBy("symbol", "week").agg(F.max("date").alias("week_end"))
    return out.join(last, ["symbol", "week"])


def monthly_bars(daily: DataFrame) -> DataFrame:
    keyed = daily.withColumn("month", F.year("date") * 100 + F.month("date"))
    return coarsen(keyed, ["symbol", "month"], order="date")


def fold_weekend(daily: DataFrame, max_gap_days: int = 3) -> DataFrame:
    """A Sunday row joins the same symbol's next row when that is at most `max_gap_days` away."""
    w = Window.partitionBy("symbol").orderBy("date")
    nxt = F.lead("date").over(w)
    folds = (F.dayofweek("date") == 1) & (F.datediff(nxt, "date") <= max_gap_days)
    keyed = daily.withColumn("fold_date", F.when(folds, nxt).otherwise(F.col("date")))
    return coarsen(keyed, ["symbol", "fold_date"], order="date")


def session_summary(bars: DataFrame, ranges: Sequence[int] = (5, 15)) -> DataFrame:
    """One row per symbol-session of regular hours: OHLCV, first/last minute, widest gap and
    the opening ranges. Bars per session are bounded by the clock, so the lag window is small."""
    rth = bars.filter((F.col("minute") >= 570) & (F.col("minute") < 960))
    w = Window.partitionBy("symbol", "session_date").orderBy("ts")
    rows = rth.withColumn("__gap", F.col("minute") - F.lag("minute").over(w) - 1)
    aggs = [
        first_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        last_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("bars"),
        F.min("minute").alias("first_minute"),
        F.max("minute").alias("last_minute"),
        F.coalesce(F.max("__gap"), F.lit(0)).alias("max_gap"),
    ]
    for n in ranges:
        inside = F.col("minute") < 570 + n
        aggs += [
            F.min_by(F.when(inside, F.col("open")), F.when(inside, F.col("ts"))).alias(f"or{n}_open"),
            F.max(F.when(inside, F.col("high"))).alias(f"or{n}_high"),
            F.min(F.when(inside, F.col("low"))).alias(f"or{n}_low"),
            F.max_by(F.when(inside, F.col("close")), F.when(inside, F.col("ts"))).alias(f"or{n}_close"),
            F.coalesce(F.sum(F.when(inside, F.col("volume"))), F.lit(0)).alias(f"or{n}_volume"),
        ]
    return rows.groupBy("symbol", "session_date").agg(*aggs)


def minute_volume(ticks: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    return ticks.groupBy(*by, clock.floor_to("ts", 60).alias("ts")).agg(F.sum("size").alias("volume"))


def aggressor_share(ticks: DataFrame, by: Sequence[str], side: str = "side") -> DataFrame:
    """Share of volume that bought, per key; NULL when no sided volume."""
    return ticks.groupBy(*by).agg(
        F.sum(F.when(F.col(side) == "B", F.col("size")).otherwise(0)).alias("buy_volume"),
        F.sum(F.when(F.col(side) == "A", F.col("size")).otherwise(0)).alias("sell_volume"),
        F.sum("size").alias("total_volume"),
    ).withColumn(
        "buy_share", F.try_divide(F.col("buy_volume"), F.col("buy_volume") + F.col("sell_volume"))
    )


def dollar_volume(bars: DataFrame, wanted: DataFrame) -> DataFrame:
    """close*volume per wanted symbol-day."""
    return (
        bars.join(wanted.select("symbol", "session_date").distinct(), ["symbol", "session_date"], "left_semi")
        .groupBy("symbol", "session_date")
        .agg(F.sum(F.col("close") * F.col("volume")).alias("dollar_volume"))
    )
