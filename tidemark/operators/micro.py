"""Executions and microstructure: slippage, positions, markouts, order flow, halts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.functions.clock import micros
from tidemark.operators import joins
from tidemark.operators.scale import exact_quantiles, running_sums, time_bucket, with_edges

DAY_S = 86400


def slippage(priced: DataFrame) -> DataFrame:
    """Against the touch and the mid, adverse positive, in dollars and basis points of mid."""
    mid = (F.col("bid") + F.col("ask")) / 2
    buy = F.col("side") == "BUY"
    touch = F.when(buy, F.col("price") - F.col("ask")).otherwise(F.col("bid") - F.col("price"))
    vs_mid = F.when(buy, F.col("price") - mid).otherwise(mid - F.col("price"))
    return (
        priced.withColumn("mid", mid).withColumn("slip_touch", touch).withColumn("slip_mid", vs_mid)
        .withColumn("slip_mid_bps", F.try_divide(vs_mid, mid) * 1e4)
    )


def fill_quotes(fills: DataFrame, quotes: DataFrame, tolerance_s: float = 60.0) -> DataFrame:
    """Last usable quote at or before each fill; fills without one are dropped."""
    usable = quotes.filter(P.usable_quote(F.col("bid"), F.col("ask")))
    out = joins.asof_join(fills, usable, ["symbol"], ["bid", "ask"], tolerance_s=tolerance_s,
                          bucket_s=max(int(tolerance_s), joins.HOUR))
    return out.filter(F.col("bid").isNotNull())


def horizon_quotes(fills: DataFrame, quotes: DataFrame, horizons: Sequence[int], tolerance_s: float | None = None) -> DataFrame:
    """Mid prevailing at each fill plus each horizon; the fill's own stamp is horizon 0."""
    q = quotes.select("symbol", "ts", "seq", ((F.col("bid") + F.col("ask")) / 2).alias("mid"), F.col("seq").alias("quote_seq"))
    later = fills.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in (0, *horizons)]))).withColumn("fill_ts", F.col("ts"))
    later = later.withColumn("ts", F.timestamp_micros(micros("ts") + F.col("horizon").cast("bigint") * 1_000_000))
    out = joins.asof_join(later, q, ["symbol"], ["mid", "quote_seq"], tolerance_s=tolerance_s, bucket_s=DAY_S)
    return out.withColumn("ts", F.col("fill_ts")).drop("fill_ts")


def assign_positions(fills: DataFrame, bucket_s: int = DAY_S, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Flat-to-flat position numbers and the role of each fill.

    The position after a fill is a running sum; the one before it needs no neighbour, so both the
    sum and the count of position starts are two-level running totals that split a busy symbol by
    time.
    """
    signed = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))
    rows = fills.withColumn("signed_qty", signed)
    rows = running_sums(rows, by, ["ts", "seq"], {"pos_after": "signed_qty"}, time_bucket("ts", bucket_s))
    rows = rows.withColumn("pos_before", F.col("pos_after") - F.col("signed_qty"))
    rows = rows.withColumn("starts", (F.col("pos_before") == 0).cast("int"))
    rows = running_sums(rows, by, ["ts", "seq"], {"position": "starts"}, time_bucket("ts", bucket_s))
    role = F.when(F.abs("pos_after") > F.abs("pos_before"), "entry").otherwise("exit")
    return rows.withColumn("role", role).drop("starts")


def round_trips(positions: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    entry = F.col("role") == "entry"
    notional = F.col("qty") * F.col("price")
    return positions.groupBy(*by, "position").agg(
        F.min("ts").alias("opened"), F.max("ts").alias("last_fill"), F.count(F.lit(1)).alias("fills"),
        F.sum("qty").alias("shares"), F.max(F.abs("pos_after")).alias("max_position"),
        F.try_divide(F.sum(F.when(entry, notional)), F.sum(F.when(entry, F.col("qty")))).alias("avg_entry"),
        F.try_divide(F.sum(F.when(~entry, notional)), F.sum(F.when(~entry, F.col("qty")))).alias("avg_exit"),
        F.sum(-F.col("signed_qty") * F.col("price")).alias("cash"),
        (F.sum("signed_qty") != 0).alias("open_at_end"),
    )


def markout_identity(priced: DataFrame) -> DataFrame:
    """gross = spread paid + drift after entries + drift after exits + rest, per closed position.

    `priced` has one row per fill with mid_0 and mid_h; a position counts only when closed and
    every fill is priced.
    """
    q, p, m0, mh = F.col("signed_qty"), F.col("price"), F.col("mid_0"), F.col("mid_h")
    entry = F.col("role") == "entry"
    out = priced.groupBy("symbol", "position").agg(
        F.count(F.lit(1)).alias("fills"),
        F.count(F.when(m0.isNotNull() & mh.isNotNull(), 1)).alias("priced"),
        F.sum(q).alias("open_qty"),
        F.sum(-q * p).alias("gross"),
        F.sum(q * (m0 - p)).alias("spread"),
        F.sum(F.when(entry, q * (mh - m0)).otherwise(0.0)).alias("drift_in"),
        F.sum(F.when(~entry, q * (mh - m0)).otherwise(0.0)).alias("drift_out"),
    )
    out = out.filter("fills = priced and open_qty = 0")
    return out.withColumn("rest", F.col("gross") - F.col("spread") - F.col("drift_in") - F.col("drift_out")).drop("priced", "open_qty")


def leg_class(reason: Column, side: Column) -> Column:
    return F.when(side == "BUY", "ENTRY").when(reason == "stop", "TRAIL").when(reason == "time", "WCLOSE").otherwise("OTHER")


def leg_costs(legs: DataFrame, min_n: int = 5) -> DataFrame:
    """Mean cost per leg, falling back to the mean over all legs below `min_n` rows."""
    per = legs.groupBy("leg").agg(F.count(F.lit(1)).alias("n"), F.avg("cost").alias("own"), F.sum("cost").alias("__s"))
    total = per.agg((F.sum("__s") / F.sum("n")).alias("pooled"))
    return per.join(F.broadcast(total), how="cross").select(
        "leg", "n", F.when(F.col("n") >= min_n, F.col("own")).otherwise(F.col("pooled")).alias("cost"),
        (F.col("n") < min_n).alias("fallback"))


def pair_sells(fills: DataFrame) -> DataFrame:
    """Each sell with the last buy before it, per symbol, in file order."""
    buys = fills.filter("side = 'BUY'").select(
        "symbol", "ts", "seq", F.col("ts").alias("buy_ts"), F.col("price").alias("buy_px"), F.col("qty").alias("buy_qty"))
    sells = fills.filter("side = 'SELL'")
    return joins.asof_join(sells, buys, ["symbol"], ["buy_ts", "buy_px", "buy_qty"], strict=True, bucket_s=DAY_S)


def decision_to_fill(pairs: DataFrame) -> DataFrame:
    """Loss from the decision bar's close to the fill: gap to the alert, drift, execution."""
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    return (
        pairs.withColumn("bar_gap", sign * (F.col("alert_px") - F.col("bar_close")))
        .withColumn("drift", sign * (F.col("ref_px") - F.col("alert_px")))
        .withColumn("execution", sign * (F.col("price") - F.col("ref_px")))
        .withColumn("total", sign * (F.col("price") - F.col("bar_close")))
    )


def quote_imbalance(points: DataFrame, quotes: DataFrame, window_s: int = 60, on=("symbol",), bucket_s: int = joins.HOUR) -> DataFrame:
    """Time-weighted (bid - ask)/(bid + ask) size over [t - w, t), state before the window carried in.

    With I(t) the running integral of state times duration, the window's sum is I(t) - I(t - w).
    Both ends are as-of reads of one prefix-summed quote table, so no quote is paired with a point.
    """
    valid = P.usable_quote(F.col("bid"), F.col("ask"), False)
    total = F.col("bid_sz") + F.col("ask_sz")
    v = F.when(valid & (total > 0), (F.col("bid_sz") - F.col("ask_sz")) / total)
    q = quotes.select(*on, "ts", "seq", v.alias("v"))
    stamp = micros("ts") / 1e6
    return _time_weighted(points, q.withColumn("__x", stamp), on, window_s, bucket_s)


def _time_weighted(points: DataFrame, states: DataFrame, on, window_s: int, bucket_s: int) -> DataFrame:
    """Time-weighted mean of a step function `v` over the window before each point; NULL states
    carry no weight. Weight 0 gives NULL."""
    rows = states.withColumn("__b", time_bucket("ts", bucket_s))
    inner = Window.partitionBy(*on, "__b").orderBy("ts", "seq")
    ends = rows.groupBy(*on, "__b").agg(F.min("ts").alias("__first"))
    nxt = ends.withColumn("__next_first", F.lead("__first").over(Window.partitionBy(*on).orderBy("__b"))).drop("__first")
    rows = rows.join(nxt, [*on, "__b"]).withColumn("__until", F.coalesce(F.lead("ts").over(inner), F.col("__next_first")))
    span = (micros("__until") - micros("ts")) / 1e6
    rows = rows.withColumn("__area", F.coalesce(F.col("v") * span, F.lit(0.0))).withColumn(
        "__time", F.when(F.col("v").isNotNull(), F.coalesce(span, F.lit(0.0))).otherwise(0.0)).drop("__next_first", "__until", "__b")
    rows = running_sums(rows, on, ["ts", "seq"], {"__ia": "__area", "__it": "__time"}, time_bucket("ts", bucket_s))
    rows = rows.select(*on, "ts", "seq", "v", F.col("__ia") .alias("ia"), F.col("__it").alias("it"), "__area", "__time",
                       F.col("ts").alias("since"))
    rows = rows.withColumn("ia", F.col("ia") - F.col("__area")).withColumn("it", F.col("it") - F.col("__time")).drop("__area", "__time")
    cols = ["v", "ia", "it", "since"]
    at_end = joins.asof_join(points, rows, on, cols, strict=True, bucket_s=bucket_s)
    for c in cols:
        at_end = at_end.withColumnRenamed(c, f"e_{c}")
    begin = at_end.withColumn("__t", F.col("ts")).withColumn("ts", F.timestamp_micros(micros("ts") - window_s * 1_000_000))
    both = joins.asof_join(begin, rows, on, cols, bucket_s=bucket_s)
    for c in cols:
        both = both.withColumnRenamed(c, f"b_{c}")

    def integral(side: str, at: Column, base: str) -> Column:
        age = (micros(at) - micros(F.col(f"{side}_since"))) / 1e6
        live = F.when(F.col(f"{side}_v").isNotNull(), age).otherwise(0.0)
        return F.coalesce(F.col(f"{side}_{base}") + (live * F.coalesce(F.col(f"{side}_v"), F.lit(0.0)) if base == "ia" else live), F.lit(0.0))

    area = integral("e", F.col("__t"), "ia") - integral("b", F.col("ts"), "ia")
    time = integral("e", F.col("__t"), "it") - integral("b", F.col("ts"), "it")
    out = both.withColumn("imbalance", F.when(time > 1e-9, area / time)).withColumn("ts", F.col("__t"))
    return out.drop("__t", *[f"{s}_{c}" for s in ("e", "b") for c in cols])


def flow_events(quotes: DataFrame, by: Sequence[str] = ("symbol", "session_date")) -> DataFrame:
    """Order-flow event between consecutive valid quotes of a key: size added at or above the old
    bid less size lost, mirrored on the ask."""
    q = quotes.filter(P.usable_quote(F.col("bid"), F.col("ask"), False))
    q = with_edges(q, by, ["ts", "seq"], time_bucket("ts", joins.HOUR))
    w = Window.partitionBy(*by, "__b").orderBy("ts", "seq")
    pb, pa, pbs, pas = (F.lag(c).over(w) for c in ("bid", "ask", "bid_sz", "ask_sz"))
    b, a = F.col("bid"), F.col("ask")
    zero = F.lit(0)
    e = (
        F.when(b >= pb, F.col("bid_sz")).otherwise(zero) - F.when(b <= pb, pbs).otherwise(zero)
        - F.when(a <= pa, F.col("ask_sz")).otherwise(zero) + F.when(a >= pa, pas).otherwise(zero)
    )
    return q.withColumn("flow", F.when(pb.isNotNull(), e).otherwise(0)).filter("NOT __seed").drop("__b", "__seed")


def quote_rule(trades: DataFrame, quotes: DataFrame, on=("symbol",), bucket_s: int = joins.HOUR) -> DataFrame:
    """B at or above the prior ask, A at or below the prior bid, else N; the quote is strictly earlier."""
    t = joins.asof_join(trades, quotes, on, ["bid", "ask"], strict=True, bucket_s=bucket_s)
    return t.withColumn("rule_side", F.when(F.col("px") >= F.col("ask"), "B").when(F.col("px") <= F.col("bid"), "A").otherwise("N"))


def depth_imbalance(levels: str = "levels") -> Column:
    """(sum of bid sizes - sum of ask sizes) / total over an array of levels."""
    bid = F.aggregate(levels, F.lit(0.0), lambda acc, x: acc + x["bid_sz"])
    ask = F.aggregate(levels, F.lit(0.0), lambda acc, x: acc + x["ask_sz"])
    return F.try_divide(bid - ask, bid + ask)


def depth_change(points: DataFrame, books: DataFrame, window_s: int = 60, on=("symbol",), bucket_s: int = joins.HOUR) -> DataFrame:
    """Ask depth strictly before t over ask depth at t - w, and the spread then."""
    now = joins.asof_join(points, books, on, ["ask_depth", "bid", "ask"], strict=True, bucket_s=bucket_s)
    now = now.withColumn("spread_pct", P.spread_pct(F.col("bid"), F.col("ask"))).withColumnRenamed("ask_depth", "depth_now").drop("bid", "ask")
    back = now.withColumn("__t", F.col("ts")).withColumn("ts", F.timestamp_micros(micros("ts") - window_s * 1_000_000))
    out = joins.asof_join(back, books, on, ["ask_depth"], bucket_s=bucket_s)
    return out.withColumn("ts", F.col("__t")).withColumn(
        "depth_ratio", F.try_divide(F.col("depth_now"), F.nullif(F.col("ask_depth"), F.lit(0)))).drop("__t", "ask_depth")


def halts(status: DataFrame, by: Sequence[str] = ("symbol", "session_date")) -> DataFrame:
    """Halt intervals per key and day: opens at the first halt record, closes at the next trading
    record; one still open ends at 20:00."""
    hour = time_bucket("ts", joins.HOUR)
    status = with_edges(status, by, ["ts", "seq"], hour)
    w = Window.partitionBy(*by, "__b").orderBy("ts", "seq")
    turn = F.col("halted") & ~F.coalesce(F.lag("halted").over(w), F.lit(False))
    rows = status.withColumn("__turn", turn.cast("int")).filter("NOT __seed").drop("__b", "__seed")
    rows = running_sums(rows, by, ["ts", "seq"], {"__run": "__turn"}, hour)
    return rows.filter("__run > 0").groupBy(*by, "__run").agg(
        F.min(F.when(F.col("halted"), F.col("minute"))).alias("start_minute"),
        F.coalesce(F.min(F.when(~F.col("halted"), F.col("minute"))), F.lit(1200)).alias("end_minute"),
        F.min(F.when(~F.col("halted"), F.col("ts"))).alias("resumed_at"),
        F.min(F.when(F.col("halted"), F.col("ts"))).alias("halted_at"),
    ).drop("__run")


def trades_in_halts(trades: DataFrame, stops: DataFrame) -> DataFrame:
    """Per trade: whether a halt began inside it, and whether its exit is on a resume minute.

    One bounded aggregate per (symbol, date) key and trade; only the trade id travels.
    """
    h = stops.select("symbol", "session_date", "start_minute", "end_minute")
    j = trades.join(h, ["symbol", "session_date"], "left")
    inside = (F.col("start_minute") >= F.col("entry_minute")) & (F.col("start_minute") <= F.col("exit_minute"))
    return j.groupBy("trade_id").agg(
        F.coalesce(F.max(inside), F.lit(False)).alias("halted_inside"),
        F.coalesce(F.max(F.col("end_minute") == F.col("exit_minute")), F.lit(False)).alias("exit_on_resume"))


def first_fill_at(entries: DataFrame, quotes: DataFrame, limit: Column, window_s: int, min_size: int = 1) -> DataFrame:
    """First quote in the window whose bid meets the limit with size. Limits are a column, so a
    ladder is a few rows per entry."""
    e = entries.withColumn("limit_px", limit)
    sized = quotes.filter(F.col("bid_sz") >= min_size).select("symbol", F.col("ts").alias("q_ts"), "bid")
    hits = joins.range_join(e, sized, ["symbol"], F.col("ts"), F.timestamp_micros(micros("ts") + window_s * 1_000_000), "q_ts", bin_s=max(window_s, 60), also=F.col("bid") >= F.col("limit_px"))
    return hits.groupBy("seq", "limit_px").agg(F.min("q_ts").alias("filled_at"), F.min_by("bid", "q_ts").alias("fill_bid"))


def fill_in_bar(fills: DataFrame, bars: DataFrame) -> DataFrame:
    """Place of the fill inside its bar and the share of the bar's volume."""
    from tidemark.functions.clock import floor_to

    f = fills.withColumn("bar_ts", floor_to("ts", 60))
    b = bars.select("symbol", F.col("ts").alias("bar_ts"), "high", "low", "volume")
    return f.join(b, ["symbol", "bar_ts"]).withColumn(
        "place", F.try_divide(F.col("price") - F.col("low"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))
    ).withColumn("participation", F.try_divide(F.col("qty"), F.col("volume")))


def capture_ratio(own: DataFrame, whole: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """Cumulative volume by clock cutoffs on two tapes and their ratio, per symbol-day."""
    def wide(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("symbol", "session_date").agg(
            *[F.sum(F.when(F.col("minute") < c, F.col("volume")).otherwise(0)).alias(f"{tag}{c}") for c in cutoffs])

    j = wide(whole, "w").join(wide(own, "o"), ["symbol", "session_date"], "left")
    rows = F.array(*[F.struct(F.lit(c).alias("cutoff"), F.coalesce(F.col(f"o{c}"), F.lit(0)).alias("own"), F.col(f"w{c}").alias("whole")) for c in cutoffs])
    out = j.select("symbol", "session_date", F.explode(rows).alias("s")).select("symbol", "session_date", "s.*")
    return out.withColumn("ratio", F.try_divide(F.col("own"), F.nullif(F.col("whole"), F.lit(0))))


def spike_bars() -> Column:
    body_high, body_low = F.greatest("open", "close"), F.least("open", "close")
    return (F.col("high") > body_high * 1.25) | (F.col("low") * 1.25 < body_low)


def isolated_ticks(ticks: DataFrame, by=("symbol", "session_date"), away: float = 0.5, within_s: float = 3600, max_share: float = 0.2) -> DataFrame:
    """A print far from both neighbours that agree, reverting soon on little volume."""
    ticks = with_edges(ticks, by, ["ts", "seq"], time_bucket("ts", joins.HOUR), 2, 2)
    w = Window.partitionBy(*by, "__b").orderBy("ts", "seq")
    p0, p1 = F.lag("px").over(w), F.lead("px").over(w)
    near = F.avg("size").over(w.rowsBetween(-2, 2))
    quick = (micros(F.lead("ts").over(w)) - micros("ts")) / 1e6 <= within_s
    bad = (F.abs(F.try_divide(F.col("px"), p0) - 1) > away) & (F.abs(F.try_divide(F.col("px"), p1) - 1) > away) & quick & (F.col("size") < near * (1 + max_share))
    return ticks.withColumn("bad_tick", F.coalesce(bad, F.lit(False))).filter("NOT __seed").drop("__b", "__seed")


def cost_quantiles(priced: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    return exact_quantiles(priced, by, col, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
