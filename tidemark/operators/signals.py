"""Entry rules as boolean columns on bars. Windows where the rule is a frame, one grouped pass per
key where it carries state from bar to bar; bars per key are bounded by the calendar."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import windows as W
from tidemark.operators.folds import before, fold_keys, trailing_columns
from tidemark.operators.intervals import non_overlapping

UP, FLAT, DOWN = 1, 0, -1


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def momentum_one_minute(df: DataFrame, by=W.DAY, order="date", surge: float = 3.0, floor_n: int = 60, floor: float = 0.5) -> DataFrame:
    """MACD above its signal and zero, MFI and RSI rising, a volume surge over a live base.

    Needs macd, macd_signal, rsi14 and mfi columns.
    """
    prev = W.lag("volume", by, order)
    df = df.withColumn("trail_avg", W.prior(F.avg, "volume", by, order, floor_n)).withColumn("prev_vol", prev)
    no = F.lit(False)
    df = (
        df.withColumn("c_macd", (F.col("macd") > F.col("macd_signal")) & (F.col("macd") > 0))
        .withColumn("c_mfi", W.rising("mfi", 3, by, order))
        .withColumn("c_rsi", W.rising("rsi14", 3, by, order))
        .withColumn("c_vol", F.coalesce((F.col("volume") >= F.col("prev_vol") * surge) & (F.col("prev_vol") > 0), no))
        .withColumn("c_floor", F.coalesce((F.col("trail_avg") > 0) & (F.col("prev_vol") >= F.col("trail_avg") * floor), no))
    )
    return df.withColumn("entry", F.col("c_macd") & F.col("c_mfi") & F.col("c_rsi") & F.col("c_vol") & F.col("c_floor"))


def momentum_five_minute(df: DataFrame, by=W.DAY, order="date", entry_roc: float = 5.0, exit_roc: float = 0.0) -> DataFrame:
    """Fitted RSI change, fast over slow average, MACD over signal; exit on both gradients falling."""
    df = df.withColumn("rsi_roc", W.fitted_change("rsi14", 3, 5.0, by, order)).withColumn(
        "macd_slope", W.ols_slope("macd", 3, by, order))
    no = F.lit(False)
    entry = (F.col("rsi_roc") >= entry_roc) & (F.col("ema9") > F.col("ema21")) & (F.col("macd") > F.col("macd_signal"))
    leave = (F.col("rsi_roc") <= exit_roc) & (F.col("macd_slope") < 0)
    return df.withColumn("entry", F.coalesce(entry, no)).withColumn("exit_signal", F.coalesce(leave, no))


def first_flag(df: DataFrame, flag: Column, by=W.SESSION, order="ts") -> Column:
    """True on the first row of the key where the flag holds."""
    w = W.frame(by, order, Window.unboundedPreceding, 0)
    return F.coalesce(flag, F.lit(False)) & (F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(w) == 1)


def opening_hypotheses(bars: DataFrame, from_minute: int = 270, open_minute: int = 240) -> DataFrame:
    """H0: first bar at 04:30. H1: first close above all earlier highs on twice the mean volume.
    H2: first close after 04:30 above the range before it."""
    b = bars.filter(F.col("minute") >= open_minute)
    before = W.frame(W.SESSION, "ts", Window.unboundedPreceding, -1)
    key = Window.partitionBy(*W.SESSION)
    range_high = F.max(F.when(F.col("minute") < from_minute, F.col("high"))).over(key)
    h1 = (F.col("close") > F.max("high").over(before)) & (F.col("volume") >= 2 * F.avg("volume").over(before))
    b = b.withColumn("__h0", F.col("minute") >= from_minute).withColumn("__h1", h1).withColumn(
        "__h2", (F.col("minute") >= from_minute) & (F.col("close") > range_high))
    out = b
    for i in range(3):
        out = out.withColumn(f"h{i}", first_flag(b, F.col(f"__h{i}")))
    return out.drop("__h0", "__h1", "__h2")


def opening_range(bars: DataFrame, minutes: int = 15, open_minute: int = 570) -> DataFrame:
    inside = (F.col("minute") >= open_minute) & (F.col("minute") < open_minute + minutes)
    r = bars.filter(inside).groupBy(*W.SESSION).agg(
        F.min_by("open", "ts").alias("or_open"), F.max("high").alias("or_high"),
        F.min("low").alias("or_low"), F.max_by("close", "ts").alias("or_close"))
    side = F.when(F.col("or_close") > F.col("or_open"), 1).when(F.col("or_close") < F.col("or_open"), -1).otherwise(0)
    return r.withColumn("side", side)


def trigger_touch(bars: DataFrame, ranges: DataFrame, minutes: int = 15, open_minute: int = 570, last_minute: int = 960) -> DataFrame:
    """First later bar that trades through the range on the opening side; fills at the level or the
    open beyond it. Doji ranges give no trade."""
    later = bars.filter((F.col("minute") >= open_minute + minutes) & (F.col("minute") < last_minute))
    j = later.join(ranges.filter("side <> 0"), list(W.SESSION))
    long = F.col("side") == 1
    hit = F.when(long, F.col("high") >= F.col("or_high")).otherwise(F.col("low") <= F.col("or_low"))
    fill = F.when(long, F.greatest("or_high", "open")).otherwise(F.least("or_low", "open"))
    return j.filter(hit).withColumn("fill", fill).groupBy(*W.SESSION, "side").agg(
        F.min("minute").alias("trigger_minute"), F.min_by("fill", "ts").alias("fill"))


def clock_prices(bars: DataFrame, minutes: Sequence[int]) -> DataFrame:
    """Close of the last bar that starts before each clock minute, one column per minute."""
    return bars.groupBy(*W.SESSION).agg(
        *[F.max_by(F.when(F.col("minute") < c, F.col("close")), F.when(F.col("minute") < c, F.col("ts"))).alias(f"p{c}") for c in minutes])


def sign_rule(sessions: DataFrame) -> DataFrame:
    """Long when the first half-hour return is positive, else short, into the close."""
    side = F.when(F.col("r1") > 0, 1).when(F.col("r1").isNotNull(), -1)
    return sessions.withColumn("side", side).withColumn("result", F.col("side") * F.col("r13"))


def overnight_pairs(sessions: DataFrame, date: str = "session_date", held: str | None = None) -> DataFrame:
    """Last close to the next session's first open; void when the contract changes."""
    w = Window.partitionBy("symbol").orderBy(date)
    out = sessions.withColumn("next_open", F.lead("open").over(w)).withColumn("next_date", F.lead(date).over(w))
    move = F.try_divide(F.col("next_open"), F.col("close")) - 1
    if held is not None:
        move = F.when(F.col(held) == F.lead(held).over(w), move)
    return out.withColumn("overnight", move)


def side_flips(bars: DataFrame, confirm: int = 2) -> DataFrame:
    """Position side after `confirm` consecutive closes on one side of VWAP, and the flips."""
    df = W.session_vwap(bars).withColumn("__s", F.when(F.col("close") > F.col("vwap"), 1).when(F.col("close") < F.col("vwap"), -1).otherwise(0))
    w = W.frame(W.SESSION, "ts", -(confirm - 1), 0)
    steady = (F.min("__s").over(w) == F.max("__s").over(w)) & (F.count(F.lit(1)).over(w) == confirm) & (F.col("__s") != 0)
    df = df.withColumn("__p", F.when(steady, F.col("__s")))
    df = df.withColumn("position", F.coalesce(F.last("__p", ignorenulls=True).over(W.frame(W.SESSION, "ts", Window.unboundedPreceding, 0)), F.lit(0)))
    return df.withColumn("flip", F.col("position") != F.coalesce(W.lag("position", W.SESSION, "ts"), F.lit(0))).drop("__s", "__p")


def flip_legs(flips: DataFrame) -> DataFrame:
    """Each flip closed by the next flip of the session, or at the session's last close."""
    key = Window.partitionBy(*W.SESSION)
    last = F.max_by("close", "ts").over(key)
    rows = flips.withColumn("__last", last).filter("flip and position <> 0")
    w = key.orderBy("ts")
    return rows.withColumn("exit_px", F.coalesce(F.lead("close").over(w), F.col("__last"))).withColumn(
        "exit_ts", F.lead("ts").over(w)).withColumn("points", F.col("position") * (F.col("exit_px") - F.col("close"))).drop("__last")


def drift_states(bars: DataFrame, change: float = 0.02, hour_bars: int = 4) -> DataFrame:
    """Side of VWAP, VWAP slope and the hour's change, agreeing or not."""
    df = W.session_vwap(bars)
    slope = F.col("vwap") - W.lag("vwap", W.SESSION, "ts")
    move = F.try_divide(F.col("close"), W.lag("close", W.SESSION, "ts", hour_bars)) - 1
    state = F.when((F.col("close") > F.col("vwap")) & (slope > 0) & (move >= change), 1).when(
        (F.col("close") < F.col("vwap")) & (slope < 0) & (move <= -change), -1).otherwise(0)
    return df.withColumn("drift", state)


def bar_setups(df: DataFrame, by=W.DAY, order="date", atr: str = "atr14") -> DataFrame:
    """Band dip, shooting star, range breakout, three-bar sweep and narrow-range squeeze."""
    lag = lambda c, n=1: W.lag(c, by, order, n)
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body, rng = F.abs(c - o), h - l
    mean = W.trailing(F.avg, "close", by, order, 20)
    no = F.lit(False)
    df = df.withColumn("__r", rng)
    narrow = F.min("__r").over(W.frame(by, order, -3, 0))
    n4 = F.count(F.lit(1)).over(W.frame(by, order, -3, 0)) == 4
    return (
        df.withColumn("band_dip", F.coalesce(c < mean - F.col(atr), no))
        .withColumn("shooting_star", F.coalesce((rng > 0) & ((h - F.greatest(o, c)) >= 2 * body) & ((F.least(o, c) - l) <= 0.25 * rng), no))
        .withColumn("range_breakout", F.coalesce(c > W.prior(F.max, "high", by, order, 20), no))
        .withColumn("sweep", F.coalesce((lag("low") < lag("low", 2)) & (lag("close") > lag("low", 2)) & (c > lag("high")), no))
        .withColumn("narrow_range", n4 & (F.col("__r") == narrow))
        .drop("__r")
    )


def impulse_dips(df: DataFrame, lookback: int = 20, impulse: float = 0.10, dip: float = 0.05, hold: float = 0.5, by=W.SESSION, order="ts") -> DataFrame:
    """A close well under the peak of the last bars while most of the impulse is kept, once per peak.

    The peak is the first highest high of the previous `lookback` bars; the base the lowest low from
    the frame's start to the peak. The frame is walked one place at a time for all bars of a task.
    """

    def fold(cols: list[np.ndarray], at: np.ndarray) -> list[pa.Array]:
        high, low = cols
        peak, base, first, least = (np.full(len(at), np.nan) for _ in range(4))
        for n in range(lookback, 0, -1):
            h = before(high, at, n)
            least = np.fmin(least, before(low, at, n))
            up = (h > peak) | (np.isnan(peak) & ~np.isnan(h))
            peak, base, first = np.where(up, h, peak), np.where(up, least, base), np.where(up, at + 1 - n, first)
        return [pa.array(at + 1, pa.int32()), pa.array(peak, from_pandas=True), pa.array(first, pa.float64(), from_pandas=True).cast(pa.int32()), pa.array(base, from_pandas=True)]

    df = trailing_columns(df, by, order, ["high", "low"], fold, "__i int, peak double, peak_i int, base double")
    c = F.col("close")
    ok = (
        (F.col("base") > 0) & (F.col("peak") > F.col("base"))
        & (F.try_divide(F.col("peak") - F.col("base"), F.col("base")) >= impulse)
        & (F.try_divide(F.col("peak") - c, F.col("peak")) >= dip)
        & (F.try_divide(c - F.col("base"), F.col("peak") - F.col("base")) >= hold)
    )
    hits = df.filter(ok)
    prev = F.lag("peak_i").over(Window.partitionBy(*by).orderBy(order))
    hits = hits.withColumn("__prev", prev).filter(F.col("__prev").isNull() | (F.col("__prev") != F.col("peak_i")))
    return hits.drop("__prev").withColumn(
        "retained", F.least(F.lit(1.0), (c - F.col("base")) / (F.col("peak") - F.col("base"))))


def framing_states(df: DataFrame, rule: str = "strict", by=W.DAY, order="date") -> DataFrame:
    """One-time-framing state after each bar: up, down or balanced around a reference bar.

    A trend persists while each bar keeps framing in its direction; the bar that fails becomes the
    reference of the balance, which only a close outside that bar ends.
    """

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order).reset_index(drop=True)
        h, l, c = g["high"].to_numpy(), g["low"].to_numpy(), g["close"].to_numpy()
        ph, pl = np.roll(h, 1), np.roll(l, 1)
        if rule == "strict":
            up, down = (h > ph) & (l > pl) & (c > ph), (l < pl) & (h < ph) & (c < pl)
        else:
            up, down = l > pl, h < ph
        states = np.zeros(len(g), dtype=int)
        ref = 0
        for t in range(1, len(g)):
            s = states[t - 1]
            if s == FLAT:
                states[t] = UP if c[t] > h[ref] else DOWN if c[t] < l[ref] else FLAT
            elif (s == UP and up[t]) or (s == DOWN and down[t]):
                states[t] = s
            elif (s == UP and down[t]) or (s == DOWN and up[t]):
                states[t] = -s
            else:
                ref = t
        g["state"] = states
        return g

    return df.groupBy(*by).applyInPandas(fold, _fields(df) + ", state int")


def framing_gate(states: DataFrame, variant: str = "strict") -> DataFrame:
    """Keep mask and removal reason from day/week/month states and a trade direction."""
    d, w, m, s = (F.col(c) for c in ("d", "w", "m", "direction"))
    undefined = d.isNull() | w.isNull() | m.isNull()
    agree = (d == s) & (w == s) & (m == s)
    rules = {
        "strict": agree,
        "day_week": (d == s) & (w == s),
        "soft": ~((d == -s) | (w == -s) | (m == -s)),
        "opposite": (d == -s) & (w == -s) & (m == -s),
    }
    known = d.isNotNull() & w.isNotNull() if variant == "day_week" else ~undefined
    keep = F.coalesce(known & rules[variant], F.lit(False))
    kept = F.coalesce(~undefined & agree, F.lit(False))
    reason = F.when(kept, "").when(undefined, "undefined").when((d == 0) | (w == 0) | (m == 0), "any_bal").when(
        ~((d == w) & (w == m)), "disagree").otherwise("against")
    return states.withColumn("keep", keep).withColumn("reason", reason)


def reclaim_setups(df: DataFrame, below: int = 2, lookback: int = 5, ctrl_atr: float = 1.0, max_bars: int = 4, impulse: int = 3,
                   by=W.SESSION, order="ts") -> DataFrame:
    """Setup A: back above VWAP and average after a run below. Setup B: a short, controlled dip
    under the average inside a fresh impulse, closed by strength.

    Needs regime, atr14 and mature columns. One row per setup.
    """
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by, order).schema.fields)

    def track(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order).reset_index(drop=True)
        reg = g["regime"].fillna("").to_numpy()
        close, low, atr = g["close"].to_numpy(), g["low"].to_numpy(), g["atr14"].to_numpy()
        below_run = pd.Series(reg == "BEARISH")
        run = below_run.groupby((~below_run).cumsum()).cumsum().to_numpy()
        fresh = g["high"] >= g["high"].cummax()
        age = (~fresh).groupby(fresh.cumsum()).cumsum().to_numpy()
        drop = -np.diff(close, prepend=close[0])
        wild = drop > ctrl_atr * atr
        rows, start = [], None
        for t in range(1, len(g)):
            if reg[t] == "STRONG" and run[t - 1] >= below:
                rows.append((*key, g[order][t], "A", close[t], low[max(0, t - min(lookback, run[t - 1])):t].min()))
            if start is not None:
                span = t - start
                if reg[t] == "STRONG" and span <= max_bars and not wild[t]:
                    rows.append((*key, g[order][t], "B", close[t], low[start:t + 1].min()))
                if reg[t] != "WEAK_BULL" or wild[t] or span > max_bars:
                    start = None
            elif reg[t] == "WEAK_BULL" and reg[t - 1] == "STRONG" and age[t] <= impulse and not wild[t]:
                start = t
        return pd.DataFrame(rows, columns=[*by, order, "kind", "entry_ref", "structure_low"])

    return df.groupBy(*by).applyInPandas(track, keys + ", kind string, entry_ref double, structure_low double")


def pullback_breaks(df: DataFrame, reds: int = 2, limit: int = 20, volume_n: int = 10, by=W.SESSION, order="ts") -> DataFrame:
    """Swing highs armed by red bars and broken by a close above them on live volume.

    A swing high is a bar above its predecessor's high; a higher high moves it, red bars arm it. A
    break is the first bar through the level within the time limit; the lowest armed level decides.
    """
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by, order).schema.fields)

    def walk(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order).reset_index(drop=True)
        h, c, v = g["high"].to_numpy(), g["close"].to_numpy(), g["volume"].to_numpy()
        red = (g["close"] < g["open"]).to_numpy()
        base = g["volume"].rolling(volume_n).mean().shift(1).to_numpy()
        armed, forming, rows = [], None, []
        for t in range(1, len(g)):
            armed = [a for a in armed if t - a[1] <= limit]
            broken = sorted(a for a in armed if h[t] > a[0])
            if broken:
                level, at = broken[0]
                why = "close" if c[t] <= level else "volume" if not v[t] > base[t] else "entry"
                rows.append((*key, g[order][t], float(level), t - at, why))
                if why == "entry":
                    armed = [a for a in armed if a not in broken]
            if forming is None:
                forming = [h[t], t, int(red[t])] if h[t] > h[t - 1] else None
            elif h[t] > forming[0]:
                forming = [h[t], t, int(red[t])]
            else:
                forming[2] += int(red[t])
            if forming is not None and forming[2] >= reds:
                armed.append((forming[0], forming[1]))
                forming = None
        return pd.DataFrame(rows, columns=[*by, order, "level", "age", "outcome"])

    return df.groupBy(*by).applyInPandas(walk, keys + ", level double, age int, outcome string")


def _pivots(x: np.ndarray, r: int, high: bool) -> np.ndarray:
    if len(x) < 2 * r + 1:
        return np.zeros(0, dtype=int)
    near = np.lib.stride_tricks.sliding_window_view(x, 2 * r + 1)
    return r + np.flatnonzero(x[r : len(x) - r] == (near.max(axis=1) if high else near.min(axis=1)))


def trend_lines(df: DataFrame, r: int = 3, kind: str = "high", buffer: float = 0.10, max_span: int = 400, by=W.DAY, order="date") -> DataFrame:
    """Value of the line through the two latest confirmed pivots, and its break.

    A line lives when its slope has the right sign, the pivots are near enough and no close between
    them crossed it by the buffer. The first close beyond it by the buffer is the break; the line
    stays cold until a new valid pair. Needs atr14.
    """
    high = kind == "high"
    sign = 1.0 if high else -1.0

    def walk(x, c, room, line, broke):
        n, piv = len(x), _pivots(x, r, high)
        starts = piv[1:] + r
        for k, begin in enumerate(starts):
            a, b = piv[k], piv[k + 1]
            stop = starts[k + 1] if k + 1 < len(starts) else n
            if begin >= n or sign * (x[b] - x[a]) >= 0 or b - a > max_span:
                continue
            near = slice(a + 1, stop)  # the line is valued from its first pivot to the next pair only
            at = x[b] + (x[b] - x[a]) / (b - a) * (np.arange(a + 1, stop) - b)
            beyond = sign * (c[near] - at) > room[near]
            if beyond[: begin - a - 1].any():
                continue
            crossing = np.flatnonzero(beyond[begin - a - 1 :])
            end = begin + crossing[0] + 1 if len(crossing) else stop
            line[begin:end] = at[begin - a - 1 : end - a - 1]
            if len(crossing):
                broke[end - 1] = True

    def fold(g: pd.DataFrame, firsts: np.ndarray) -> pd.DataFrame:
        x, c, room = g[kind].to_numpy(), g["close"].to_numpy(), buffer * g["atr14"].to_numpy()
        line, broke = np.full(len(g), np.nan), np.zeros(len(g), dtype=bool)
        for a, z in zip(firsts, [*firsts[1:], len(g)]):
            walk(x[a:z], c[a:z], room[a:z], line[a:z], broke[a:z])
        return g.assign(line=line, line_break=broke)

    out = fold_keys(df.repartition(*by), by, order, fold, _fields(df) + ", line double, line_break boolean")
    return out.withColumn("line", F.nanvl("line", F.lit(None).cast("double")))


def anchor_lines(df: DataFrame, r: int = 3, kind: str = "high", window: int = 120, buffer: float = 0.10, max_span: int = 400, by=W.DAY, order="date") -> DataFrame:
    """Line from the most extreme confirmed pivot of the window to the later pivot, at most max_span bars
    away, that gives the flattest line no close has crossed; the next extreme pivot where it has none.
    With its touches and span. A bar looks at its window only. Needs atr14."""
    high = kind == "high"
    sign = 1.0 if high else -1.0

    def walk(x, c, room, line, broke, touches, span):
        n, piv = len(x), _pivots(x, r, high)
        free = np.ones(n, dtype=bool)
        for a in piv[np.lexsort((piv, -sign * x[piv]))]:  # the most extreme first; it serves the bars none before it did
            upto = min(n, a + window)
            best = np.full(upto - a, np.nan)
            for b in piv[(piv > a) & (piv + r < upto) & (piv <= a + max_span)]:
                slope = (x[b] - x[a]) / (b - a)
                if not sign * slope < 0:
                    continue
                crossed = sign * (c[a:upto] - (x[a] + slope * (np.arange(a, upto) - a))) > room[a:upto]
                first = 1 + int(np.argmax(crossed[1:])) if crossed[1:].any() else upto - a
                at = best[b + r - a : first + 1]  # known from b + r on, until the bar after the first crossing
                at[np.isnan(at) | (abs(slope) < np.abs(at))] = slope
            t = a + np.flatnonzero(~np.isnan(best) & free[a:upto])
            if not len(t):
                continue
            best = best[t - a]
            free[t] = False
            line[t] = x[a] + best * (t - a)
            p = piv[(piv >= a) & (piv + r < upto)]
            near = np.abs(x[p] - (x[a] + best[:, None] * (p - a))) <= room[p]
            touches[t], span[t] = (near & (p + r <= t[:, None])).sum(axis=1), t - a
            broke[t] = sign * (c[t] - line[t]) > room[t]

    def fold(g: pd.DataFrame, firsts: np.ndarray) -> pd.DataFrame:
        x, c, room = g[kind].to_numpy(), g["close"].to_numpy(), buffer * g["atr14"].to_numpy()
        n = len(g)
        line, broke = np.full(n, np.nan), np.zeros(n, dtype=bool)
        touches, span = np.zeros(n, dtype=int), np.zeros(n, dtype=int)
        for a, z in zip(firsts, [*firsts[1:], n]):
            walk(x[a:z], c[a:z], room[a:z], line[a:z], broke[a:z], touches[a:z], span[a:z])
        return g.assign(line=line, line_break=broke, touches=touches, span=span)

    out = fold_keys(df.repartition(*by), by, order, fold, _fields(df) + ", line double, line_break boolean, touches int, span int")
    return out.withColumn("line", F.nanvl("line", F.lit(None).cast("double")))


def a_plus(lines: DataFrame, min_touches: int = 3, min_span: int = 20, efficiency_cut: float = 0.3) -> DataFrame:
    eff = F.coalesce(F.col("efficiency") >= efficiency_cut, F.lit(False))
    score = (F.col("touches") >= min_touches).cast("int") + (F.col("span") >= min_span).cast("int") + eff.cast("int")
    return lines.withColumn("checks", score).withColumn("a_plus", score == 3)


def break_retests(lines: DataFrame, n: int = 10, near: float = 0.25, fail: float = 0.5, by=W.DAY, order="date") -> DataFrame:
    """What followed each upward break: entry on the first touch of the extended line, failed on a
    close through it, no_retest after n bars, open_at_end; a break while another is pending is
    ignored_pending.

    Outcomes of all breaks come from one frame of the next n bars; only the choice of which break
    is pending is a path, and that runs over break rows alone.
    """
    w = W.frame(by, order, 1, n)
    idx = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    slope = F.coalesce(F.col("line") - W.lag("line", by, order), F.lit(0.0))
    b = lines.withColumn("i", idx).withColumn("__s", slope).withColumn(
        "__next", F.collect_list(F.struct("i", "low", "close", "atr14")).over(w)).filter("line_break")
    level = lambda x: F.col("line") + F.col("__s") * (x["i"] - F.col("i"))
    failed = F.array_min(F.transform(F.filter("__next", lambda x: x["close"] < level(x) - fail * x["atr14"]), lambda x: x["i"]))
    touched = F.array_min(F.transform(F.filter("__next", lambda x: x["low"] <= level(x) + near * x["atr14"]), lambda x: x["i"]))
    b = b.withColumn("__failed", failed).withColumn("__touched", touched)
    first = F.least(F.col("__failed"), F.col("__touched"))
    outcome = (
        F.when(F.col("__failed").isNotNull() & (F.col("__failed") == first), "failed")
        .when(F.col("__touched").isNotNull(), "entry").when(F.size("__next") < n, "open_at_end").otherwise("no_retest")
    )
    rows = b.withColumn("outcome", outcome).withColumn("until", F.coalesce(first, F.col("i") + F.size("__next"))).select(
        *by, order, "i", "until", "outcome", "line")
    return non_overlapping(rows, "i", "until", by, refused="ignored_pending")


def forward_runs(df: DataFrame, rise: float = 0.10, dip: float = 0.05, n: int = 10, by=W.DAY, order="date") -> DataFrame:
    """Bars from which a close reaches +rise within n bars before any low falls more than `dip`,
    greedily non-overlapping. `k` is the first completing bar."""
    w = W.frame(by, order, 1, n)
    df = df.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    df = df.withColumn("__next", F.collect_list(F.struct("i", "close", "low")).over(w))
    floor, goal = F.col("close") * (1 - dip), F.col("close") * (1 + rise)
    dead = F.array_min(F.transform(F.filter("__next", lambda x: x["low"] < floor), lambda x: x["i"]))
    done = F.array_min(F.transform(F.filter("__next", lambda x: x["close"] >= goal), lambda x: x["i"]))
    hits = df.withColumn("__dead", dead).withColumn("done_i", done).filter(
        F.col("done_i").isNotNull() & (F.col("__dead").isNull() | (F.col("done_i") < F.col("__dead"))))
    hits = hits.select(*by, order, "i", "done_i", (F.col("done_i") - F.col("i")).alias("k"))
    return non_overlapping(hits, "i", "done_i", by)


def prior_spikes(df: DataFrame, lookback: int = 60, quiet: int = 5, spike: float = 0.5, need: int = 10, high=0.5, low=0.25, by=W.DAY, order="date") -> DataFrame:
    """Largest rise over a running minimum in the `lookback` bars ending `quiet` bars before each
    row (itself excluded), the share kept at the window's end, and its label. The window is walked
    one place at a time for all bars of a task."""

    def fold(cols: list[np.ndarray], at: np.ndarray) -> list[pa.Array]:
        close = cols[0]
        least, last = (np.full(len(at), np.nan) for _ in range(2))
        best, peak, base = (np.zeros(len(at)) for _ in range(3))
        seen = np.zeros(len(at), dtype=np.int32)
        with np.errstate(divide="ignore", invalid="ignore"):
            for n in range(lookback + quiet, quiet, -1):
                x = before(close, at, n)
                gain = np.where(least != 0, (x - least) / least, 0.0)
                up = gain > best
                best, peak, base = np.where(up, gain, best), np.where(up, x, peak), np.where(up, least, base)
                there = ~np.isnan(x)
                least, last, seen = np.fmin(least, x), np.where(there, x, last), seen + there
        return [pa.array(a, from_pandas=True) for a in (best, peak, base, last)] + [pa.array(seen, pa.int32())]

    df = trailing_columns(df, by, order, ["close"], fold, "__gain double, __peak double, __base double, __last double, __n int")
    gain = F.when((F.col("__n") > 0) & (F.col("__gain") >= spike), F.col("__gain"))
    kept = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("__last") - F.col("__base"), F.col("__peak") - F.col("__base"))))
    df = df.withColumn("run_pct", gain).withColumn("retained", F.when(gain.isNotNull(), kept))
    label = (
        F.when(F.col("__n") < need, "too new to judge").when(F.col("run_pct").isNull(), "no prior spike")
        .when(F.col("retained") >= high, "former runner").when(F.col("retained") < low, "pump and dump").otherwise("partial hold")
    )
    return df.withColumn("history", label).drop("__gain", "__peak", "__base", "__last", "__n")


def veto_tags(daily: DataFrame, gap: float = 30.0, volume: float = 60, block: float = 50_000.0, band: float = 0.1, lookback: int = 20,
              min_run: int = 2, run_range: float = 20.0, giveback_skip: float = 50.0) -> DataFrame:
    """Crowded gap, overhead dollar block and the day after the first red day, per symbol-day, from
    rows before it (and the day's own running high and volume for the gap)."""
    by, order = W.DAY, "date"
    lag = lambda c, n=1: W.lag(c, by, order, n)
    df = daily.withColumn("dollars", F.col("close") * F.col("volume")).withColumn("pc", lag("close")).withColumn("pd", lag("dollars"))
    df = df.withColumn("gap_pct", (F.try_divide(F.col("high"), F.col("pc")) - 1) * 100)
    crowded = F.coalesce((F.col("gap_pct") >= gap) & (F.col("volume") > volume), F.lit(False))
    w = W.frame(by, order, -lookback, -1)
    top = F.max(F.struct("dollars", "close")).over(w)
    blocked = F.coalesce((top["dollars"] >= block) & (F.abs(F.try_divide(F.col("high"), top["close"]) - 1) <= band), F.lit(False))
    green = F.coalesce((F.col("close") > F.col("pc")) & (F.col("dollars") > F.col("pd")), F.lit(False))
    df = df.withColumn("green", green)
    upto = W.frame(by, order, Window.unboundedPreceding, 0)
    i = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    df = df.withColumn("i", i).withColumn("__brk", F.max(F.when(~F.col("green"), F.col("i"))).over(upto))
    df = df.withColumn("run_len", F.col("i") - F.col("__brk")).withColumn(
        "__base", F.last(F.when(~F.col("green"), F.col("close")), ignorenulls=True).over(upto))
    red = lag("close") < lag("close", 2)
    run, base, peak = lag("run_len", 2), lag("__base", 2), lag("close", 2)
    rise = (F.try_divide(peak, base) - 1) * 100
    back = F.try_divide(peak - lag("low"), F.nullif(peak - base, F.lit(0.0))) * 100
    first_red = F.coalesce(red & (run >= min_run) & (rise >= run_range) & (back <= giveback_skip), F.lit(False))
    return df.withColumn("crowded_gap", crowded).withColumn("dollar_block", blocked).withColumn("first_red", first_red).drop("__brk", "__base", "i", "green", "pd")


def chart_features(df: DataFrame, by=W.DAY, order="date") -> DataFrame:
    """Features at a decision bar. Needs ema9, ema21, atr14, macd and macd_signal columns."""
    hist = F.col("macd") - F.col("macd_signal")
    df = df.withColumn("hist", hist)
    w20 = W.frame(by, order, -19, 0)
    side = (F.col("close") > F.col("ema21")).cast("int")
    df = df.withColumn("__side", side)
    turn = F.coalesce((F.col("__side") != W.lag("__side", by, order)).cast("int"), F.lit(0))
    df = df.withColumn("__turn", turn).withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    hh, ll = F.max("high").over(w20), F.min("low").over(w20)
    last_turn = F.max(F.when(F.col("__turn") == 1, F.col("__i"))).over(W.frame(by, order, Window.unboundedPreceding, 0))
    atr = F.nullif(F.col("atr14"), F.lit(0.0))
    return (
        df.withColumn("ema_spread_atr", F.try_divide(F.col("ema9") - F.col("ema21"), atr))
        .withColumn("hist_change", F.col("hist") - W.lag("hist", by, order))
        .withColumn("close_to_ema_atr", F.try_divide(F.col("close") - F.col("ema9"), atr))
        .withColumn("range20", hh - ll)
        .withColumn("range20_pos", F.try_divide(F.col("close") - ll, F.nullif(hh - ll, F.lit(0.0))))
        .withColumn("side_changes", F.sum("__turn").over(w20))
        .withColumn("upper_wick", F.try_divide(F.col("high") - F.greatest("open", "close"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0))))
        .withColumn("since_cross", F.least(F.lit(50), F.col("__i") - last_turn))
        .withColumn("weekday", F.dayofweek(order))
        .drop("__side", "__turn", "__i")
    )


def context_flags(df: DataFrame, by=W.DAY, order="date") -> DataFrame:
    """Trend and momentum context at the close, an avoid flag and the tier."""
    up = (F.col("close") > F.col("ema21")) & (F.col("ema9") > F.col("ema21"))
    strong = F.col("macd") > F.col("macd_signal")
    wide = (F.col("high") - F.col("low")) > 2 * F.col("atr14")
    tier = F.when(wide, "avoid").when(up & strong, "A").when(up | strong, "B").otherwise("C")
    return df.withColumn("trend", up).withColumn("momentum", strong).withColumn("avoid", wide).withColumn("tier", tier)


def curl_triggers(df: DataFrame, by=W.DAY, order="date", window: int = 10) -> DataFrame:
    """Histogram below zero and rising two bars (mirrored short), and the range-ratio filter."""
    df = df.withColumn("hist", F.round(F.col("macd") - F.col("macd_signal"), 9))
    h, h1, h2 = F.col("hist"), W.lag("hist", by, order), W.lag("hist", by, order, 2)
    no = F.lit(False)
    w = W.frame(by, order, -(window - 1), 0)
    ratio = F.try_divide(F.max(F.abs("hist")).over(w), F.nullif(F.col("atr14"), F.lit(0.0)))
    return (
        df.withColumn("curl_long", F.coalesce((h < 0) & (h > h1) & (h1 > h2), no))
        .withColumn("curl_short", F.coalesce((h > 0) & (h < h1) & (h1 < h2), no))
        .withColumn("hist_ratio", ratio)
    )


def squeeze_states(df: DataFrame, rank_cut: float = 0.2, timeout: int = 10) -> DataFrame:
    """squeeze while the band width ranks low, trend after a close outside the bands, mean_revert
    otherwise. The run of one episode is islands of the squeeze flag. Needs bollinger columns."""
    by, order = W.DAY, "date"
    sq = F.coalesce(F.col("bb_width_rank") <= rank_cut, F.lit(False))
    df = df.withColumn("__q", sq.cast("int")).withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    w = W.frame(by, order, Window.unboundedPreceding, 0)
    start = F.coalesce((F.col("__q") == 1) & (F.coalesce(W.lag("__q", by, order), F.lit(0)) == 0), F.lit(False))
    df = df.withColumn("episode", F.sum(start.cast("int")).over(w)).withColumn("__last", F.max(F.when(F.col("__q") == 1, F.col("__i"))).over(w))
    recent = (F.col("__i") - F.col("__last")) <= timeout
    out = F.when(F.col("close") > F.col("bb_upper"), "trend_up").when(F.col("close") < F.col("bb_lower"), "trend_down")
    state = F.when(F.col("__q") == 1, "squeeze").when(recent & out.isNotNull(), out).when(recent, "armed").otherwise("mean_revert")
    return df.withColumn("state", state).drop("__q", "__i", "__last")


def held_runs(df: DataFrame, min_bars: int = 3, by=W.DAY, order="date") -> DataFrame:
    """Runs of bars that hold the prior low (or high), graded by length, speed and a volume spike."""
    no = F.lit(False)
    holds = F.coalesce(F.col("low") >= W.lag("low", by, order), no)
    df = df.withColumn("__hold", holds).withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    w = W.frame(by, order, Window.unboundedPreceding, 0)
    df = df.withColumn("__run", F.sum((~F.col("__hold")).cast("int")).over(w))
    df = df.withColumn("__vr", F.try_divide("volume", W.prior(F.avg, "volume", by, order, 10, 3)))
    g = df.groupBy(*by, "__run").agg(
        F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("bars"),
        (F.try_divide(F.max_by("close", order), F.min_by("close", order)) - 1).alias("move"), F.max("__vr").alias("volume_spike"))
    score = (F.col("bars") >= min_bars + 1).cast("int") + (F.col("move") / F.col("bars") >= 0.05).cast("int") + (F.coalesce(F.col("volume_spike"), F.lit(0.0)) >= 2).cast("int")
    grade = F.when(score == 3, "A").when(score == 2, "B").when(score == 1, "C").otherwise("D")
    return g.filter(F.col("bars") >= min_bars).withColumn("grade", grade).drop("__run")


def acceptance(bars: DataFrame, areas: DataFrame, n: int = 2, bracket: int = 30, open_minute: int = 570) -> DataFrame:
    """Open outside the prior session's value area, then n consecutive bracket closes inside it."""
    w = Window.partitionBy("symbol").orderBy("session_date")
    prev = areas.select("symbol", F.lead("session_date").over(w).alias("session_date"), "val", "vah").filter("session_date is not null")
    rth = bars.filter((F.col("minute") >= open_minute) & (F.col("minute") < 960))
    br = rth.withColumn("bracket", F.floor((F.col("minute") - open_minute) / bracket).cast("int")).groupBy(*W.SESSION, "bracket").agg(
        F.min_by("open", "ts").alias("open"), F.max_by("close", "ts").alias("close"))
    key = Window.partitionBy(*W.SESSION)
    j = br.join(prev, list(W.SESSION)).withColumn("first_open", F.min_by("open", "bracket").over(key))
    side = F.when(F.col("first_open") > F.col("vah"), "above").when(F.col("first_open") < F.col("val"), "below")
    inside = F.col("close").between(F.col("val"), F.col("vah"))
    j = j.withColumn("open_side", side).withColumn("__in", inside.cast("int"))
    run = F.sum("__in").over(key.orderBy("bracket").rowsBetween(-(n - 1), 0)) == n
    return j.withColumn("__acc", run).filter(F.col("open_side").isNotNull()).groupBy(*W.SESSION, "open_side").agg(
        F.min(F.when(F.col("__acc"), F.col("bracket"))).alias("accepted_bracket"), F.max("val").alias("val"), F.max("vah").alias("vah"))


def trailing_signs(held: DataFrame, months: Sequence[int] = (1, 3, 12), price: str = "cont", date: str = "date", by=("symbol",)) -> DataFrame:
    """Sign of the change over each of k calendar months, and their mean when all are known."""
    from tidemark.operators.series import asof_daily

    out = held
    past = held.select(*by, F.col(date).alias("__d"), F.col(price).alias("__p"))
    for k in months:
        probe = out.withColumn("__at", F.add_months(date, -k))
        out = asof_daily(probe, past, "__d", ["__p"], by, "__at").drop("__at").withColumn(
            f"sign_{k}", F.signum(F.col(price) - F.col("__p"))).drop("__p")
    total = sum((F.col(f"sign_{k}") for k in months), F.lit(0.0))
    return out.withColumn("ensemble", total / len(months))
