"""Window features over bars.

Bars have one row per interval, so a symbol's rows are bounded by the calendar and a symbol's
window fits a task however many trades the symbol had. Frames are ROWS and end strictly before
the row wherever a value must be knowable at the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scale import running_sums, time_bucket

DAY = ("symbol",)
SESSION = ("symbol", "session_date")


def frame(by: Sequence[str], order: str, start: int, end: int) -> Window:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(start, end)


def full(value: Column, count: Column, need: int) -> Column:
    """The value only when the frame held enough rows."""
    return F.when(count >= need, value)


def prior(agg, col: Column | str, by, order, n: int, need: int | None = None) -> Column:
    """agg over the n rows before this one, NULL below `need` non-null values."""
    w = frame(by, order, -n, -1)
    return full(agg(col).over(w), F.count(col).over(w), n if need is None else need)


def trailing(agg, col: Column | str, by, order, n: int, need: int | None = None) -> Column:
    """agg over the last n rows including this one."""
    w = frame(by, order, -(n - 1), 0)
    return full(agg(col).over(w), F.count(col).over(w), n if need is None else need)


def lag(col, by, order, n: int = 1) -> Column:
    return F.lag(col, n).over(Window.partitionBy(*by).orderBy(order))


def lead(col, by, order, n: int = 1) -> Column:
    return F.lead(col, n).over(Window.partitionBy(*by).orderBy(order))


def median(col) -> Column:
    return F.percentile(col, F.lit(0.5))


def true_range(by=DAY, order="date") -> Column:
    pc = lag("close", by, order)
    return F.greatest(
        F.col("high") - F.col("low"),
        F.abs(F.col("high") - F.coalesce(pc, F.col("low"))),
        F.abs(F.col("low") - F.coalesce(pc, F.col("high"))),
    )


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def screen_features(daily: DataFrame, days: int = 10, need: int = 3) -> DataFrame:
    """Prior close, prior averages (shifted before rolled), relative volume, range, gap."""
    dv = F.col("close") * F.col("volume")
    df = daily.withColumn("dollar_vol", dv).withColumn("prior_close", lag("close", DAY, "date"))
    df = df.withColumn("prior_avg_dollar_vol", prior(F.avg, "dollar_vol", DAY, "date", days, need))
    df = df.withColumn("prior_avg_vol", prior(F.avg, "volume", DAY, "date", days, need))
    pc = F.col("prior_close")
    return (
        df.withColumn("rvol", F.try_divide("volume", "prior_avg_vol"))
        .withColumn("range_pct", F.try_divide(F.col("high") - F.col("low"), pc) * 100)
        .withColumn("gap_pct", F.try_divide(F.col("open") - pc, pc) * 100)
    )


def session_vwap(df: DataFrame, by=SESSION, order="ts") -> DataFrame:
    w = frame(by, order, Window.unboundedPreceding, 0)
    pv = F.sum(typical() * F.col("volume")).over(w)
    v = F.sum("volume").over(w)
    return df.withColumn("vwap", F.try_divide(pv, v.cast("double"))).withColumn(
        "cum_dollar_volume", F.sum(F.col("close") * F.col("volume")).over(w)
    )


def running_extremes(df: DataFrame, by=SESSION, order="ts") -> DataFrame:
    w = frame(by, order, Window.unboundedPreceding, 0)
    return (
        df.withColumn("session_high", F.max("high").over(w))
        .withColumn("session_low", F.min("low").over(w))
        .withColumn("dist_from_high", F.try_divide(F.col("close"), F.max("high").over(w)) - 1)
    )


def run_up_features(df: DataFrame, by=SESSION, order="ts", seed: str = "7") -> DataFrame:
    """Eleven features of the session so far, at each bar."""
    so_far = frame(by, order, Window.unboundedPreceding, 0)
    med = median("volume").over(so_far)
    n = F.count(F.lit(1)).over(so_far)
    c = F.col("close")

    def ret(k: int) -> Column:
        return F.try_divide(c, F.nullif(lag("close", by, order, k), F.lit(0.0))) - 1

    up = (c > lag("close", by, order)).cast("int")
    last5 = frame(by, order, -4, 0)
    df = df.withColumn("__up", up)
    high, low = F.max("high").over(so_far), F.min("low").over(so_far)
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "symbol", F.unix_seconds(order))), 1, 8), 16, 10)
    return (
        df.withColumn("rvol_1", F.when(med > 0, F.try_divide(F.col("volume").cast("double"), med)))
        .withColumn("rvol_5", F.when((med > 0) & (n >= 5), F.sum("volume").over(last5) / (5 * med)))
        .withColumn("ret_1", ret(1))
        .withColumn("ret_3", ret(3))
        .withColumn("ret_5", ret(5))
        .withColumn("up_bars_5", F.when(n >= 6, F.sum("__up").over(last5)))
        .withColumn("accel", ret(1) - ret(3) / 3)
        .withColumn("pos_in_range", F.when(high > low, (c - low) / (high - low)))
        .withColumn("dist_from_high", F.when(high > 0, c / high - 1))
        .withColumn("minutes_since_open", F.col("minute") - 240)
        .withColumn("rand", draw.cast("bigint") / 4294967296.0)
        .drop("__up")
    )


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, by=DAY, order="date", rank_n: int = 50) -> DataFrame:
    """Bands with the population deviation, width, %b and the width's rank in a trailing window."""
    mid = trailing(F.avg, "close", by, order, n)
    sd = trailing(F.stddev_pop, "close", by, order, n)
    df = df.withColumn("bb_mid", mid).withColumn("bb_sd", sd)
    df = (
        df.withColumn("bb_upper", F.col("bb_mid") + k * F.col("bb_sd"))
        .withColumn("bb_lower", F.col("bb_mid") - k * F.col("bb_sd"))
        .withColumn("bb_width", F.try_divide(2 * k * F.col("bb_sd"), F.col("bb_mid")))
        .withColumn("bb_pos", F.try_divide(F.col("close") - F.col("bb_mid") + k * F.col("bb_sd"), 2 * k * F.col("bb_sd")))
    )
    w = frame(by, order, -(rank_n - 1), 0)
    # Rounded so that two engines' last-bit differences cannot change a comparison.
    df = df.withColumn("__w", F.round("bb_width", 9)).withColumn("__ws", F.collect_list("__w").over(w))
    rank = F.size(F.filter("__ws", lambda x: x <= F.col("__w"))) / F.size("__ws")
    return df.withColumn("bb_width_rank", F.when(F.col("__w").isNotNull() & (F.size("__ws") == rank_n), rank)).drop("__w", "__ws")


def ols_slope(col: str, n: int, by=DAY, order="date") -> Column:
    """Least-squares slope over the last n rows, as a weighted sum of lags."""
    xbar = (n - 1) / 2
    denom = sum((i - xbar) ** 2 for i in range(n))
    terms = [(i - xbar) * lag(col, by, order, n - 1 - i) if n - 1 - i else (i - xbar) * F.col(col) for i in range(n)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total / denom


def fitted_change(col: str, n: int = 3, floor: float = 5.0, by=DAY, order="date") -> Column:
    """Percent change along the fitted line, its start floored."""
    span = ols_slope(col, n, by, order) * (n - 1)
    start = F.greatest(trailing(F.avg, col, by, order, n) - span / 2, F.lit(floor))
    return span / start * 100


def rising(col: str, n: int = 3, by=DAY, order="date") -> Column:
    return F.coalesce(F.col(col) > lag(col, by, order, n), F.lit(False))


def falling(col: str, n: int = 3, by=DAY, order="date") -> Column:
    return F.coalesce(F.col(col) < lag(col, by, order, n), F.lit(False))


def past_apex(col: str, lookback: int = 20, n: int = 3, by=DAY, order="date") -> Column:
    top = trailing(F.max, col, by, order, lookback)
    return falling(col, n, by, order) & ~F.coalesce(F.col(col) >= top, F.lit(False))


def money_flow(df: DataFrame, n: int = 14, by=DAY, order="date") -> DataFrame:
    """Flow index of rising over falling typical-price volume; 50 where no falling flow or short."""
    df = df.withColumn("__tp", F.round(typical(), 8))
    df = df.withColumn("__d", F.col("__tp") - lag("__tp", by, order))
    raw = F.col("__tp") * F.col("volume")
    w = frame(by, order, -(n - 1), 0)
    up = F.sum(F.when(F.col("__d") > 0, raw).otherwise(0.0)).over(w)
    down = F.sum(F.when(F.col("__d") < 0, raw).otherwise(0.0)).over(w)
    have = F.count(F.lit(1)).over(w) == n
    ratio = F.when(have, F.try_divide(up, F.nullif(down, F.lit(0.0))))
    return df.withColumn("mfi", F.coalesce(100 - 100 / (1 + ratio), F.lit(50.0))).drop("__tp", "__d")


def with_efficiency(df: DataFrame, n: int = 10, by=DAY, order="date") -> DataFrame:
    df = df.withColumn("__step", F.abs(F.col("close") - lag("close", by, order)))
    path = trailing(F.sum, "__step", by, order, n)
    move = F.abs(F.col("close") - lag("close", by, order, n))
    return df.withColumn("efficiency", F.try_divide(move, F.nullif(path, F.lit(0.0)))).drop("__step")


def log_returns(by=DAY, order="date", held: str | None = None) -> Column:
    """ln(close/previous close); NULL where the held contract changed."""
    r = F.log(F.try_divide(F.col("close"), lag("close", by, order)))
    return r if held is None else F.when(F.col(held) == lag(held, by, order), r)


def lagged_autocorrelation(df: DataFrame, col: str, k: int = 5, n: int = 20, by=DAY, order="date") -> DataFrame:
    """Pearson correlation of x with its own k-lag over the last n complete pairs."""
    df = df.withColumn("__lag", lag(col, by, order, k))
    pair = F.col("__lag").isNotNull() & F.col(col).isNotNull()
    w = frame(by, order, -(n - 1), 0)
    ok = F.count(F.when(pair, 1)).over(w) == n
    return df.withColumn("autocorr", F.when(ok, F.corr(col, "__lag").over(w))).drop("__lag")


def hurst_proxy(df: DataFrame, n: int = 20, by=DAY, order="date") -> DataFrame:
    """100 ln(n-bar range / n-bar mean true range) / ln n."""
    df = df.withColumn("__tr", true_range(by, order))
    rng = trailing(F.max, "high", by, order, n) - trailing(F.min, "low", by, order, n)
    mean_tr = trailing(F.avg, "__tr", by, order, n)
    ratio = F.try_divide(rng, F.nullif(mean_tr, F.lit(0.0)))
    return df.withColumn("hurst", F.when(ratio > 0, 100 * F.log(ratio) / F.log(F.lit(float(n))))).drop("__tr")


def bars_since_high(df: DataFrame, n: int = 20, by=DAY, order="date") -> DataFrame:
    """Bars since the n-bar high (oldest wins a tie) and the close's place in the n-bar range."""
    df = df.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    w = frame(by, order, -(n - 1), 0)
    at = F.max(F.struct(F.col("high").alias("h"), (-F.col("__i")).alias("i"))).over(w)
    hh, ll = F.max("high").over(w), F.min("low").over(w)
    ok = F.count(F.lit(1)).over(w) == n
    return (
        df.withColumn("since_high", F.when(ok, F.col("__i") + at["i"]))
        .withColumn("range_pos", F.when(ok & (hh > ll), (F.col("close") - ll) / (hh - ll)))
        .drop("__i")
    )


def donchian(df: DataFrame, n: int = 20, by=DAY, order="date") -> DataFrame:
    """Channel of the n bars ending here and of the n bars before this one."""
    return (
        df.withColumn("hh", trailing(F.max, "high", by, order, n))
        .withColumn("ll", trailing(F.min, "low", by, order, n))
        .withColumn("prior_hh", prior(F.max, "high", by, order, n))
        .withColumn("prior_ll", prior(F.min, "low", by, order, n))
    )


def swing_pivots(df: DataFrame, r: int = 3, by=DAY, order="date") -> DataFrame:
    """Pivots (ties allowed) and the stamp at which each is known, r bars later."""
    w = frame(by, order, -r, r)
    full_frame = F.count(F.lit(1)).over(w) == 2 * r + 1
    return (
        df.withColumn("pivot_high", full_frame & (F.col("high") == F.max("high").over(w)))
        .withColumn("pivot_low", full_frame & (F.col("low") == F.min("low").over(w)))
        .withColumn("known_at", lead(order, by, order, r))
    )


def last_confirmed_pivot(df: DataFrame, r: int = 3, by=DAY, order="date") -> DataFrame:
    """At each bar the latest pivot value confirmed by then (the pivot r bars back, or earlier)."""
    p = swing_pivots(df, r, by, order)
    up = lag(F.when(F.col("pivot_high"), F.col("high")), by, order, r)
    down = lag(F.when(F.col("pivot_low"), F.col("low")), by, order, r)
    p = p.withColumn("__u", up).withColumn("__d", down)
    w = frame(by, order, Window.unboundedPreceding, 0)
    return (
        p.withColumn("last_high", F.last("__u", ignorenulls=True).over(w))
        .withColumn("last_low", F.last("__d", ignorenulls=True).over(w))
        .drop("__u", "__d")
    )


def rank_at_each_minute(df: DataFrame, value: str, top: int, at: Sequence[str]) -> DataFrame:
    """Rank among the names present at each stamp; ties share the better rank."""
    w = Window.partitionBy(*at)
    return (
        df.filter(F.col(value).isNotNull())
        .withColumn("visible", F.count(F.lit(1)).over(w))
        .withColumn("value_rank", F.rank().over(w.orderBy(F.desc(value))))
        .withColumn("gate", F.col("value_rank") <= top)
    )


def trailing_percentile_gate(df: DataFrame, col: str, n: int, q: float, by=DAY, order="date") -> DataFrame:
    w = frame(by, order, -n, -1)
    cut = F.when(F.count(col).over(w) == n, F.percentile(col, F.lit(q)).over(w))
    return df.withColumn("cut", cut).withColumn("gate", F.coalesce(F.col(col) >= F.col("cut"), F.lit(False)))


def window_volatility(bars: DataFrame, start: int = 570, end: int = 600) -> DataFrame:
    """Deviation of bar returns inside a clock window, per session."""
    inside = bars.filter((F.col("minute") >= start) & (F.col("minute") < end))
    r = inside.withColumn("__r", F.try_divide(F.col("close"), lag("close", SESSION, "ts")) - 1)
    return r.groupBy(*SESSION).agg(F.stddev_samp("__r").alias("sigma"), F.count("__r").alias("returns"))


def running_range_pct(bars: DataFrame, by=SESSION, order="ts") -> DataFrame:
    """Mean of the earlier bars' range in percent, using bars strictly before each stamp."""
    pct = F.try_divide(F.col("high") - F.col("low"), F.nullif(F.col("open"), F.lit(0.0))) * 100
    df = bars.withColumn("__p", pct)
    return df.withColumn("range_pct_before", F.avg("__p").over(frame(by, order, Window.unboundedPreceding, -1))).drop("__p")


def range_on_minute_grid(bars: DataFrame, start: int, end: int, step: int = 5) -> DataFrame:
    """`running_range_pct` read at every grid minute, carried over minutes without a bar."""
    known = running_range_pct(bars).withColumn(
        "__next", F.avg(F.try_divide(F.col("high") - F.col("low"), F.nullif(F.col("open"), F.lit(0.0))) * 100).over(
            frame(SESSION, "ts", Window.unboundedPreceding, 0))
    )
    grid = bars.select(*SESSION).distinct().withColumn(
        "minute", F.explode(F.sequence(F.lit(start), F.lit(end), F.lit(step)))
    )
    rows = known.select(*SESSION, F.col("minute"), F.col("__next").alias("v"), F.lit(0).alias("g")).unionByName(
        grid.select(*SESSION, "minute", F.lit(None).cast("double").alias("v"), F.lit(1).alias("g"))
    )
    w = Window.partitionBy(*SESSION).orderBy("minute").rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("range_pct", F.last("v", ignorenulls=True).over(w)).filter("g = 1").drop("v", "g")


def centred_outliers(df: DataFrame, k: int = 5, ratio: float = 0.2, col: str = "close", by=DAY, order="date") -> DataFrame:
    """Prints further than `ratio` from the centred median."""
    med = F.percentile(col, F.lit(0.5)).over(frame(by, order, -k, k))
    return df.withColumn("centred_median", med).withColumn("wild", F.coalesce(F.abs(F.try_divide(F.col(col), med) - 1) > ratio, F.lit(False)))


def loss_streaks(df: DataFrame, by: Sequence[str], order: Sequence[str], net: str = "net") -> DataFrame:
    """Per key the longest losing run and the worst sum over one.

    Runs are numbered by a running count of winners, split by exit day, so a key with many trades is
    spread; a run is a group, folded before it is shuffled.
    """
    won = df.withColumn("__won", F.when(F.col(net) >= 0, 1).otherwise(0))
    numbered = running_sums(won, by, order, {"__run": "__won"}, time_bucket(order[0], 86400))
    runs = numbered.filter(F.col(net) < 0).groupBy(*by, "__run").agg(
        F.count(F.lit(1)).alias("length"), F.sum(net).alias("total")
    )
    return runs.groupBy(*by).agg(
        F.max("length").alias("longest_loss_run"),
        F.min("total").alias("worst_run_total"),
        F.sum(F.floor(F.col("length") / 3)).cast("bigint").alias("three_loss_events"),
    )


def volume_weighted_mean(n: int, by=DAY, order="date") -> Column:
    w = frame(by, order, -(n - 1), 0)
    v = F.sum("volume").over(w)
    return F.when(F.count(F.lit(1)).over(w) == n, F.try_divide(F.sum(F.col("close") * F.col("volume")).over(w), v.cast("double")))


def simple_mean(n: int, by=DAY, order="date", col: str = "close") -> Column:
    return trailing(F.avg, col, by, order, n)
