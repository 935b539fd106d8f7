"""What is true at a decision bar: 27 columns from the bar and the bars before it.

Session-to-date sums and rolling means are windows over bars, whose rows per symbol are bounded by the
calendar; nothing is sliced or recomputed per bar. A quantity that is not known yet is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import recursive as R, windows as W

TAPE = ("vol_over_trail", "vol_multiple", "floor_margin", "mins_since_open", "price", "extension", "range_pct", "dollar_vol_session", "dollar_vol_bar", "tape_density",
        "trail_over_range", "close_in_bar", "body_ratio", "vwap_dist", "ma20_dist", "ma20_slope", "bb_pos", "bb_width", "vol_over_ma20")
MOMENTUM = ("macd_margin", "macd_level", "rsi", "rsi_slope", "mfi", "mfi_slope", "ema9_dist", "ema200_dist")


def _away(line: Column) -> Column:
    """Close over a line, in percent above it."""
    return (F.try_divide(F.col("close"), line) - 1) * 100


def tape_features(bars: DataFrame, trail_pct: float = 5.0, by: Sequence[str] = ("symbol",), session: str = "session_date", order: str = "ts") -> DataFrame:
    """Volume, liquidity, bar shape, averages and bands. Needs `minute` (of the day) and OHLCV."""
    close, volume = F.col("close"), F.col("volume")
    rows = Window.partitionBy(*by).orderBy(order)
    today = Window.partitionBy(*by, session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda n: rows.rowsBetween(1 - n, 0)
    full = lambda value, n: F.when(F.count(value).over(last(n)) == n, F.avg(value).over(last(n)))
    spread = F.col("high") - F.col("low")
    df = bars.withColumn("__prior", F.lag("volume").over(rows)).withColumn("__trail", W.prior(F.avg, "volume", by, order, 60, 60))
    df = df.withColumn("__ma", full("close", 20)).withColumn("__sd", F.when(F.col("__ma").isNotNull(), F.stddev_pop("close").over(last(20))))
    df = df.withColumn("__held", F.sum("volume").over(today)).withColumn("__paid", F.sum((F.col("high") + F.col("low") + close) / 3 * volume).over(today))
    df = df.withColumn("__seen", F.sum((volume > 0).cast("int")).over(today)).withColumn("__first", F.first("close").over(today)).withColumn("__start", F.first(order).over(today))
    minutes = (F.unix_micros(order) - F.unix_micros("__start")) / 60_000_000 + 1
    df = df.withColumn("__span", F.avg(spread).over(last(14)))
    ratio = lambda a, b: F.try_divide(a, F.col(b))
    return df.select(
        *by, order, session, ratio(volume, "__trail").alias("vol_over_trail"), ratio(volume, "__prior").alias("vol_multiple"), ratio(F.col("__prior"), "__trail").alias("floor_margin"),
        (F.col("minute") - 240).alias("mins_since_open"), close.alias("price"), _away(F.col("__first")).alias("extension"), (F.avg(F.try_divide(spread, close)).over(last(14)) * 100).alias("range_pct"),
        (close * F.col("__held")).alias("dollar_vol_session"), (close * volume).alias("dollar_vol_bar"), (F.col("__seen") / minutes * 100).alias("tape_density"),
        ratio(trail_pct / 100 * close, "__span").alias("trail_over_range"), F.when(spread > 0, (close - F.col("low")) / spread).alias("close_in_bar"), F.when(spread > 0, F.abs(close - F.col("open")) / spread).alias("body_ratio"),
        _away(ratio(F.col("__paid"), "__held")).alias("vwap_dist"), _away(F.col("__ma")).alias("ma20_dist"), ((F.try_divide(F.col("__ma"), F.lag("__ma", 3).over(rows)) - 1) * 100).alias("ma20_slope"),
        F.when(F.col("__sd") > 1e-9, (close - F.col("__ma") + 2 * F.col("__sd")) / (4 * F.col("__sd"))).alias("bb_pos"), (ratio(4 * F.col("__sd"), "__ma") * 100).alias("bb_width"), F.try_divide(volume, full("volume", 20)).alias("vol_over_ma20"),
    )


def momentum_features(bars: DataFrame, by: Sequence[str] = ("symbol",), order: str = "ts") -> DataFrame:
    """Oscillators, their change over three bars, and distances from seeded averages."""
    df = R.with_indicators(W.money_flow(bars, 14, by, order), ["macd", "macd_signal", "rsi14", "ema9_seeded", "ema200_seeded"], by, order)
    rows = Window.partitionBy(*by).orderBy(order)
    return df.select(
        *by, order, (F.col("macd") - F.col("macd_signal")).alias("macd_margin"), F.col("macd").alias("macd_level"), F.col("rsi14").alias("rsi"), (F.col("rsi14") - F.lag("rsi14", 3).over(rows)).alias("rsi_slope"),
        "mfi", (F.col("mfi") - F.lag("mfi", 3).over(rows)).alias("mfi_slope"), _away(F.col("ema9_seeded")).alias("ema9_dist"), _away(F.col("ema200_seeded")).alias("ema200_dist"),
    )
