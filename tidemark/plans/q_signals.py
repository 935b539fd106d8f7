"""Signals (2.12) and intraday session rows (2.10.3)."""

from pyspark.sql import functions as F

from tidemark.functions import prices as P
from tidemark.operators import recursive as R, rollups as G, series as Y, signals as X, windows as W
from tidemark.plans.registry import query, view
from tidemark.session import staged

D = "PARTITION BY symbol ORDER BY date"
S = "PARTITION BY symbol, session_date ORDER BY ts"

view("mfi", f"""WITH a AS (SELECT *, round((high + low + close) / 3, 8) AS tp FROM daily), b AS (SELECT *, tp - lag(tp) OVER ({D}) AS d FROM a),
 c AS (SELECT *, sum(CASE WHEN d > 0 THEN tp * volume ELSE 0 END) OVER w AS u, sum(CASE WHEN d < 0 THEN tp * volume ELSE 0 END) OVER w AS dn, count(*) OVER w AS n FROM b WINDOW w AS ({D} ROWS 13 PRECEDING))
 SELECT symbol, date, round(CASE WHEN n = 14 AND dn <> 0 THEN 100 - 100 / (1 + u / dn) ELSE 50 END, 9) AS mfi FROM c""")
view("ind", """SELECT d.*, round(f.e9, 9) AS ema9, round(f.e21, 9) AS ema21, round(f.atr, 9) AS atr14, round(f.macd, 9) AS macd, round(f.sig, 9) AS macd_signal,
  round(CASE WHEN f.dn IS NULL OR f.dn = 0 THEN 100 ELSE 100 - 100 / (1 + f.up / f.dn) END, 9) AS rsi14, f.i FROM daily d JOIN fold f USING (symbol, date)""")

NAMES = ["ema9", "ema21", "atr14", "macd", "macd_signal", "rsi14"]


def indicators(m):
    """Indicator columns rounded to nine places, so comparisons do not hang on the last bits."""
    df = R.with_indicators(m.daily(), NAMES)
    for n in NAMES:
        df = df.withColumn(n, F.round(n, 9))
    return df


@query("momentum_entry_1m", "2.12.1 2.20.28", f"""
WITH a AS (SELECT i.*, m.mfi, lag(volume) OVER ({D}) AS pv, CASE WHEN count(*) OVER w = 20 THEN avg(volume) OVER w END AS ta, lag(m.mfi, 3) OVER ({D}) AS m3, lag(rsi14, 3) OVER ({D}) AS r3
 FROM ind i JOIN mfi m USING (symbol, date) WINDOW w AS ({D} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, macd > macd_signal AND macd > 0 AS c1, coalesce(mfi > m3, false) AS c2, coalesce(rsi14 > r3, false) AS c3, coalesce(volume >= pv * 1.5 AND pv > 0, false) AS c4, coalesce(ta > 0 AND pv >= ta * 0.5, false) AS c5 FROM a)
SELECT symbol, @D(date) AS date, @I(c1) AS c_macd, @I(c2) AS c_mfi, @I(c3) AS c_rsi, @I(c4) AS c_vol, @I(c5) AS c_floor, @I(c1 AND c2 AND c3 AND c4 AND c5) AS entry FROM b""")
def _(m):
    df = W.money_flow(indicators(m)).withColumn("mfi", F.round("mfi", 9))
    return X.momentum_one_minute(df, surge=1.5, floor_n=20).select("symbol", "date", "c_macd", "c_mfi", "c_rsi", "c_vol", "c_floor", "entry")


@query("momentum_entry_5m", "2.12.2", f"""
WITH a AS (SELECT *, (rsi14 - lag(rsi14, 2) OVER ({D})) / 2 AS s, CASE WHEN count(*) OVER w = 3 THEN avg(rsi14) OVER w END AS mean, (macd - lag(macd, 2) OVER ({D})) / 2 AS ms FROM ind WINDOW w AS ({D} ROWS 2 PRECEDING)),
b AS (SELECT *, s * 2 / greatest(mean - s, 5) * 100 AS roc FROM a)
SELECT symbol, @D(date) AS date, @I(coalesce(roc >= 5 AND ema9 > ema21 AND macd > macd_signal, false)) AS entry, @I(coalesce(roc <= 0 AND ms < 0, false)) AS exit_signal FROM b""")
def _(m):
    return X.momentum_five_minute(indicators(m)).select("symbol", "date", "entry", "exit_signal")


@query("opening_hypotheses", "2.12.3 2.20.103", f"""
WITH a AS (SELECT *, max(high) OVER p AS ph, avg(volume) OVER p AS pv, max(high) FILTER (minute < 270) OVER (PARTITION BY symbol, session_date) AS rh FROM bars5 WHERE minute >= 240
  WINDOW p AS ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, minute >= 270 AS f0, coalesce(close > ph AND volume >= 2 * pv, false) AS f1, coalesce(minute >= 270 AND close > rh, false) AS f2 FROM a)
SELECT symbol, @T(ts) AS ts, @I(f0 AND sum(CAST(f0 AS INT)) OVER w = 1) AS h0, @I(f1 AND sum(CAST(f1 AS INT)) OVER w = 1) AS h1, @I(f2 AND sum(CAST(f2 AS INT)) OVER w = 1) AS h2 FROM b WINDOW w AS ({S})""")
def _(m):
    return X.opening_hypotheses(m.bars()).select("symbol", "ts", "h0", "h1", "h2")


view("ranges", """SELECT symbol, session_date, first(open ORDER BY ts) AS o, max(high) AS h, min(low) AS l, last(close ORDER BY ts) AS c FROM bars5 WHERE minute >= 570 AND minute < 600 GROUP BY 1, 2""")


@query("opening_range_direction", "2.12.4 2.20.93", """
SELECT symbol, @D(session_date) AS session_date, @R(o) AS or_open, @R(h) AS or_high, @R(l) AS or_low, @R(c) AS or_close, @I(CASE WHEN c > o THEN 1 WHEN c < o THEN -1 ELSE 0 END) AS side FROM ranges""")
def _(m):
    return X.opening_range(m.bars(), 30)


@query("range_trigger_touch", "2.12.5", """
WITH j AS (SELECT b.*, h, l, CASE WHEN c > o THEN 1 ELSE -1 END AS side FROM bars5 b JOIN ranges r USING (symbol, session_date) WHERE minute >= 600 AND minute < 960 AND c <> o)
SELECT symbol, @D(session_date) AS session_date, @I(side) AS side, @I(min(minute)) AS trigger_minute, @R(arg_min(CASE WHEN side = 1 THEN greatest(h, open) ELSE least(l, open) END, ts)) AS fill
FROM j WHERE CASE WHEN side = 1 THEN high >= h ELSE low <= l END GROUP BY symbol, session_date, side""")
def _(m):
    return X.trigger_touch(m.bars(), X.opening_range(m.bars(), 30), 30)


view("clock_px", """SELECT symbol, session_date, last(close ORDER BY ts) FILTER (minute < 600) AS p600, last(close ORDER BY ts) FILTER (minute < 930) AS p930, last(close ORDER BY ts) FILTER (minute < 960) AS p960 FROM bars5 GROUP BY 1, 2""")
view("momentum_sessions", """SELECT *, p600 / pc - 1 AS r1, p960 / p930 - 1 AS r13 FROM (SELECT *, lag(p960) OVER (PARTITION BY symbol ORDER BY session_date) AS pc FROM clock_px)""")


@query("intraday_momentum_sessions", "2.10.3 2.12.6 2.20.75", """
SELECT symbol, @D(session_date) AS session_date, @R(pc) AS prior_close, @R(r1) AS r1, @R(r13) AS r13, @R(CASE WHEN r1 > 0 THEN 1 WHEN r1 IS NOT NULL THEN -1 END) AS side,
 @R(CASE WHEN r1 > 0 THEN 1 WHEN r1 IS NOT NULL THEN -1 END * r13) AS result FROM momentum_sessions""")
def _(m):
    s = Y.momentum_sessions(X.clock_prices(m.bars(), [600, 930, 960]))
    return X.sign_rule(s).select("symbol", "session_date", "prior_close", "r1", "r13", F.col("side").cast("double").alias("side"), "result")


@query("overnight_pair", "2.12.7", """
WITH s AS (SELECT symbol, session_date, first(open ORDER BY ts) AS o, last(close ORDER BY ts) AS c, session_date < DATE '2024-01-15' AS held FROM bars5 WHERE minute >= 570 AND minute < 960 GROUP BY 1, 2)
SELECT symbol, @D(session_date) AS session_date, @R(CASE WHEN held = lead(held) OVER w THEN lead(o) OVER w / c - 1 END) AS overnight FROM s WINDOW w AS (PARTITION BY symbol ORDER BY session_date)""")
def _(m):
    from tidemark.operators.bars import session_summary
    s = session_summary(m.bars(), ()).withColumn("held", F.col("session_date") < F.lit("2024-01-15").cast("date"))
    return X.overnight_pairs(s, held="held").select("symbol", "session_date", "overnight")


view("flips", f"""WITH v AS (SELECT *, sum((high + low + close) / 3 * volume) OVER ({S}) / sum(volume) OVER ({S}) AS vwap FROM bars5), s AS (SELECT *, CASE WHEN close > vwap THEN 1 WHEN close < vwap THEN -1 ELSE 0 END AS s FROM v),
 p AS (SELECT *, CASE WHEN s <> 0 AND s = lag(s) OVER ({S}) THEN s END AS p FROM s), q AS (SELECT *, coalesce(last_value(p IGNORE NULLS) OVER ({S} ROWS UNBOUNDED PRECEDING), 0) AS position FROM p)
 SELECT *, position <> coalesce(lag(position) OVER ({S}), 0) AS flip FROM q""")


@query("vwap_side_flips", "2.12.8 2.20.114", f"""
WITH l AS (SELECT *, last(close) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lc FROM flips), f AS (SELECT * FROM l WHERE flip AND position <> 0)
SELECT symbol, @T(ts) AS ts, @I(position) AS position, @R(close) AS close, @R(coalesce(lead(close) OVER ({S}), lc)) AS exit_px, @R(position * (coalesce(lead(close) OVER ({S}), lc) - close)) AS points FROM f""")
def _(m):
    return X.flip_legs(X.side_flips(m.bars())).select("symbol", "ts", "position", "close", "exit_px", "points")


@query("drift_states", "2.12.9 2.20.116", f"""
WITH v AS (SELECT *, sum((high + low + close) / 3 * volume) OVER ({S}) / sum(volume) OVER ({S}) AS vwap FROM bars5), w AS (SELECT *, vwap - lag(vwap) OVER ({S}) AS sl, close / nullif(lag(close, 4) OVER ({S}), 0) - 1 AS mv FROM v)
SELECT symbol, @T(ts) AS ts, @I(CASE WHEN close > vwap AND sl > 0 AND mv >= 0.02 THEN 1 WHEN close < vwap AND sl < 0 AND mv <= -0.02 THEN -1 ELSE 0 END) AS drift FROM w""")
def _(m):
    return X.drift_states(m.bars()).select("symbol", "ts", "drift")


@query("bar_only_setups", "2.12.10 2.20.115", f"""
WITH a AS (SELECT *, CASE WHEN count(*) OVER w20 = 20 THEN avg(close) OVER w20 END AS mean, CASE WHEN count(*) OVER p20 = 20 THEN max(high) OVER p20 END AS top, count(*) OVER w4 AS n4, min(high - low) OVER w4 AS nr,
 lag(low) OVER ({D}) AS l1, lag(low, 2) OVER ({D}) AS l2, lag(close) OVER ({D}) AS c1, lag(high) OVER ({D}) AS h1 FROM ind WINDOW w20 AS ({D} ROWS 19 PRECEDING), p20 AS ({D} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), w4 AS ({D} ROWS 3 PRECEDING))
SELECT symbol, @D(date) AS date, @I(coalesce(close < mean - atr14, false)) AS band_dip, @I(high > low AND high - greatest(open, close) >= 2 * abs(close - open) AND least(open, close) - low <= 0.25 * (high - low)) AS shooting_star,
 @I(coalesce(close > top, false)) AS range_breakout, @I(coalesce(l1 < l2 AND c1 > l2 AND close > h1, false)) AS sweep, @I(n4 = 4 AND high - low = nr) AS narrow_range FROM a""")
def _(m):
    return X.bar_setups(indicators(m)).select("symbol", "date", "band_dip", "shooting_star", "range_breakout", "sweep", "narrow_range")


@query("impulse_dips", "2.12.11 2.20.14", f"""
WITH b AS (SELECT *, row_number() OVER ({D}) AS i FROM daily), f AS (SELECT *, list(struct_pack(i := i, h := high, l := low)) OVER w AS f, max(high) OVER w AS peak FROM b WINDOW w AS ({D} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, list_min(list_transform(list_filter(f, lambda x: x.h = peak), lambda x: x.i)) AS pi FROM f), q AS (SELECT *, list_min(list_transform(list_filter(f, lambda x: x.i <= pi), lambda x: x.l)) AS base FROM p),
h AS (SELECT * FROM q WHERE base > 0 AND peak > base AND (peak - base) / base >= 0.1 AND (peak - close) / peak >= 0.05 AND (close - base) / (peak - base) >= 0.5)
SELECT symbol, @D(date) AS date, @R(peak) AS peak, @R(base) AS base, @R(least(1, (close - base) / (peak - base))) AS retained FROM h QUALIFY coalesce(lag(pi) OVER ({D}) <> pi, true)""")
def _(m):
    return X.impulse_dips(m.daily(), by=W.DAY, order="date").select("symbol", "date", "peak", "base", "retained")


@query("vwap_reclaim_setups", "2.12.12 2.20.113 2.20.112")
def _(m):
    return X.reclaim_setups(R.session_indicators(m.bars()))


@query("pullback_break_setups", "2.12.13 2.20.58")
def _(m):
    return X.pullback_breaks(m.bars())


view("tl_pairs", """SELECT symbol, lag(i) OVER w AS a, lag(x) OVER w AS xa, i AS b, x AS xb, i + 3 AS beg, lead(i) OVER w + 3 AS stop FROM (
  SELECT symbol, i, high AS x FROM (SELECT *, max(high) OVER k AS m, count(*) OVER k AS n FROM ind WINDOW k AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) WHERE n = 7 AND high = m) WINDOW w AS (PARTITION BY symbol ORDER BY i)""")
view("tl_hits", """SELECT *, coalesce(close - line > 0.1::DOUBLE * atr14, false) AS beyond FROM (SELECT p.*, t.i AS t, t.date, t.close, t.atr14, xb + (xb - xa) / (b - a) * (t.i - b) AS line
  FROM tl_pairs p JOIN ind t ON t.symbol = p.symbol AND t.i > p.a AND (p.stop IS NULL OR t.i < p.stop) WHERE xb < xa AND b - a <= 400)""")
view("tl_live", "SELECT symbol, b, min(t) FILTER (beyond AND t >= beg) AS crossed FROM tl_hits GROUP BY 1, 2 HAVING NOT bool_or(beyond AND t < beg)")
view("tlines", "SELECT d.symbol, d.date, d.i, d.low, d.close, d.atr14, l.line, coalesce(l.broke, false) AS broke FROM ind d LEFT JOIN (SELECT symbol, t, line, coalesce(t = crossed, false) AS broke FROM tl_hits JOIN tl_live USING (symbol, b) WHERE t >= beg AND (crossed IS NULL OR t <= crossed)) l ON l.symbol = d.symbol AND l.t = d.i")
view("tl_breaks", """WITH s AS (SELECT *, coalesce(line - lag(line) OVER (PARTITION BY symbol ORDER BY i), 0) AS s FROM tlines), j AS (SELECT b.symbol, b.date, b.i, b.line, min(x.i) FILTER (x.close < b.line + b.s * (x.i - b.i) - 0.5::DOUBLE * x.atr14) AS failed,
  min(x.i) FILTER (x.low <= b.line + b.s * (x.i - b.i) + 0.25::DOUBLE * x.atr14) AS touched, count(x.i) AS n FROM s b LEFT JOIN ind x ON x.symbol = b.symbol AND x.i > b.i AND x.i <= b.i + 10 WHERE b.broke GROUP BY ALL)
 SELECT *, CASE WHEN failed IS NOT NULL AND failed = least(failed, touched) THEN 'failed' WHEN touched IS NOT NULL THEN 'entry' WHEN n < 10 THEN 'open_at_end' ELSE 'no_retest' END AS own, coalesce(least(failed, touched), i + n) AS until FROM j""")
view("tl_taken", """SELECT * FROM (SELECT symbol, i, until FROM tl_breaks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i) = 1)
 UNION ALL SELECT n.symbol, n.i, n.until FROM tl_taken p JOIN LATERAL (SELECT symbol, i, until FROM tl_breaks o WHERE o.symbol = p.symbol AND o.i > p.until ORDER BY o.i LIMIT 1) n ON true""")
view("tl_outcomes", "SELECT b.*, CASE WHEN t.i IS NULL THEN 'ignored_pending' ELSE own END AS outcome FROM tl_breaks b LEFT JOIN tl_taken t USING (symbol, i)")


@query("trend_line_breaks", "2.12.14 2.20.128", "SELECT symbol, @D(date) AS date, @R(line) AS line, @I(broke) AS line_break FROM tlines")
def _(m):
    return X.trend_lines(indicators(m)).select("symbol", "date", "line", "line_break")


@query("extreme_anchor_lines", "2.12.15 2.20.129")
def _(m):
    df = W.with_efficiency(R.with_indicators(m.daily(), ["atr14"]))
    return X.a_plus(X.anchor_lines(df, window=60)).filter("line is not null").select("symbol", "date", "line", "line_break", "touches", "span", "a_plus")


@query("break_retest_outcomes", "2.12.16 2.20.130", "SELECT symbol, @D(date) AS date, outcome, @R(line) AS line FROM tl_outcomes")
def _(m):
    return X.break_retests(X.trend_lines(indicators(m))).drop("i", "until")


@query("line_signal_frame", "2.12.21", """
SELECT symbol, @D(l.date) AS date, @I(broke) AS raw_break, @I(broke AND outcome = 'entry') AS entry, CASE WHEN NOT broke OR outcome = 'entry' THEN '' ELSE outcome END AS reason FROM tlines l LEFT JOIN (SELECT symbol, i, outcome FROM tl_outcomes) o USING (symbol, i)""")
def _(m):
    lines = staged(X.trend_lines(indicators(m)).select("symbol", "date", "low", "close", "atr14", "line", "line_break")).withColumn("broke", F.col("line_break"))
    outcomes = X.break_retests(lines).select("symbol", "date", "outcome")
    j = lines.join(outcomes, ["symbol", "date"], "left")
    reason = F.when(~F.col("broke"), "").when(F.col("outcome") == "entry", "").otherwise(F.col("outcome"))
    return j.select("symbol", "date", F.col("broke").alias("raw_break"), (F.col("broke") & (F.col("outcome") == "entry")).alias("entry"), reason.alias("reason"))


view("framed", f"""SELECT *, row_number() OVER ({D}) AS k, lag(high) OVER ({D}) AS ph, lag(low) OVER ({D}) AS pl FROM daily""")
view("framing", """SELECT symbol, date, k, 0 AS state, high AS rh, low AS rl FROM framed WHERE k = 1
 UNION ALL SELECT s.symbol, s.date, s.k, s.state, CASE WHEN s.state = 0 AND s.prev <> 0 THEN s.high ELSE s.rh END, CASE WHEN s.state = 0 AND s.prev <> 0 THEN s.low ELSE s.rl END FROM (
  SELECT b.symbol, b.date, b.k, b.high, b.low, f.state AS prev, f.rh, f.rl,
   CASE WHEN f.state = 0 THEN CASE WHEN b.close > f.rh THEN 1 WHEN b.close < f.rl THEN -1 ELSE 0 END
    WHEN b.high > b.ph AND b.low > b.pl AND b.close > b.ph THEN 1 WHEN b.low < b.pl AND b.high < b.ph AND b.close < b.pl THEN -1 ELSE 0 END AS state
  FROM framing f JOIN framed b ON b.symbol = f.symbol AND b.k = f.k + 1) s""")


@query("one_time_framing", "2.12.17 2.20.89", "SELECT symbol, @D(date) AS date, @I(state) AS state FROM framing")
def _(m):
    return X.framing_states(m.daily()).select("symbol", "date", "state")


@query("framing_gate", "2.2.21 2.20.147", """
WITH j AS (SELECT *, lag(state, 5) OVER (PARTITION BY symbol ORDER BY date) AS w, lag(state, 21) OVER (PARTITION BY symbol ORDER BY date) AS mo, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS dir FROM framing)
SELECT symbol, @D(date) AS date, @I(coalesce(state = dir AND w = dir AND mo = dir, false)) AS keep, CASE WHEN coalesce(state = dir AND w = dir AND mo = dir, false) THEN '' WHEN w IS NULL OR mo IS NULL THEN 'undefined'
 WHEN state = 0 OR w = 0 OR mo = 0 THEN 'any_bal' WHEN NOT (state = w AND w = mo) THEN 'disagree' ELSE 'against' END AS reason FROM j""")
def _(m):
    st = X.framing_states(m.daily())
    k = F.row_number().over(W.Window.partitionBy("symbol").orderBy("date"))
    st = st.withColumn("d", F.col("state")).withColumn("w", W.lag("state", W.DAY, "date", 5)).withColumn("m", W.lag("state", W.DAY, "date", 21)).withColumn(
        "direction", F.when(k % 2 == 0, 1).otherwise(-1))
    return X.framing_gate(st).select("symbol", "date", "keep", "reason")


@query("squeeze_states", "2.12.18 2.20.136", f"""
WITH b AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS mid, CASE WHEN count(*) OVER w = 20 THEN stddev_pop(close) OVER w END AS sd FROM daily WINDOW w AS ({D} ROWS 19 PRECEDING)),
c AS (SELECT *, round(4 * sd / mid, 9) AS rw FROM b), d AS (SELECT *, list_filter(list(rw) OVER ({D} ROWS 49 PRECEDING), lambda x: x IS NOT NULL) AS ws FROM c),
q AS (SELECT *, coalesce(CASE WHEN rw IS NOT NULL AND len(ws) = 50 THEN len(list_filter(ws, lambda x: x <= rw)) / len(ws) END <= 0.2, false) AS sq, row_number() OVER ({D}) AS k FROM d),
e AS (SELECT *, sum(CAST(fresh AS INT)) OVER ({D}) AS episode, max(k) FILTER (sq) OVER ({D}) AS seen FROM (SELECT *, sq AND NOT coalesce(lag(sq) OVER ({D}), false) AS fresh FROM q))
SELECT symbol, @D(date) AS date, @I(episode) AS episode, CASE WHEN sq THEN 'squeeze' WHEN k - seen <= 10 AND close > mid + 2 * sd THEN 'trend_up' WHEN k - seen <= 10 AND close < mid - 2 * sd THEN 'trend_down' WHEN k - seen <= 10 THEN 'armed' ELSE 'mean_revert' END AS state FROM e""")
def _(m):
    return X.squeeze_states(W.bollinger(m.daily())).select("symbol", "date", "episode", "state")


@query("graded_runs", "2.12.19 2.20.137", f"""
WITH a AS (SELECT *, coalesce(low >= lag(low) OVER ({D}), false) AS h, volume / CASE WHEN count(*) OVER p >= 3 THEN avg(volume) OVER p END AS vr FROM daily WINDOW p AS ({D} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, sum(CAST(NOT h AS INT)) OVER ({D}) AS run FROM a), g AS (SELECT symbol, run, min(date) AS s, max(date) AS e, count(*) AS n, last(close ORDER BY date) / first(close ORDER BY date) - 1 AS mv, max(vr) AS vs FROM b GROUP BY 1, 2 HAVING count(*) >= 3),
k AS (SELECT *, CAST(n >= 4 AS INT) + CAST(mv / n >= 0.05 AS INT) + CAST(coalesce(vs, 0) >= 2 AS INT) AS sc FROM g)
SELECT symbol, @D(s) AS start, @D(e) AS "end", n AS bars, @R(mv) AS move, @R(vs) AS volume_spike, CASE sc WHEN 3 THEN 'A' WHEN 2 THEN 'B' WHEN 1 THEN 'C' ELSE 'D' END AS grade FROM k""")
def _(m):
    return X.held_runs(m.daily())


@query("mirrored_channel", "2.12.20", f"""
SELECT symbol, @D(date) AS date, @R(CASE WHEN count(*) OVER p = 20 THEN 100 - min(low) OVER p END) AS mirrored_high, @I(coalesce(CASE WHEN count(*) OVER p = 20 THEN close < min(low) OVER p END, false)) AS short_break FROM daily WINDOW p AS ({D} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def _(m):
    pivot = F.lit(50.0)
    d = m.daily()
    flipped = d.select("symbol", "date", P.reflect(F.col("low"), pivot).alias("high"), P.reflect(F.col("high"), pivot).alias("low"), P.reflect(F.col("close"), pivot).alias("close"))
    top = W.prior(F.max, "high", W.DAY, "date", 20)
    return flipped.select("symbol", "date", top.alias("mirrored_high"), F.coalesce(F.col("close") > top, F.lit(False)).alias("short_break"))


@query("context_and_tiers", "2.12.22 2.20.138", """
SELECT symbol, @D(date) AS date, @I(close > ema21 AND ema9 > ema21) AS trend, @I(macd > macd_signal) AS momentum, @I(high - low > 2 * atr14) AS avoid,
 CASE WHEN high - low > 2 * atr14 THEN 'avoid' WHEN close > ema21 AND ema9 > ema21 AND macd > macd_signal THEN 'A' WHEN (close > ema21 AND ema9 > ema21) OR macd > macd_signal THEN 'B' ELSE 'C' END AS tier FROM ind""")
def _(m):
    return X.context_flags(indicators(m)).select("symbol", "date", "trend", "momentum", "avoid", "tier")


@query("curl_triggers", "2.12.23 2.20.133", f"""
WITH a AS (SELECT *, round(macd - macd_signal, 9) AS h FROM ind), b AS (SELECT *, lag(h) OVER ({D}) AS h1, lag(h, 2) OVER ({D}) AS h2, max(abs(h)) OVER ({D} ROWS 9 PRECEDING) AS mh FROM a)
SELECT symbol, @D(date) AS date, @I(coalesce(h < 0 AND h > h1 AND h1 > h2, false)) AS curl_long, @I(coalesce(h > 0 AND h < h1 AND h1 < h2, false)) AS curl_short, @R(mh / nullif(atr14, 0)) AS hist_ratio FROM b""")
def _(m):
    return X.curl_triggers(indicators(m)).select("symbol", "date", "curl_long", "curl_short", "hist_ratio")


view("areas", "SELECT symbol, session_date, arg_max(a, step) AS val, arg_max(b, step) AS vah FROM value_walk GROUP BY 1, 2")


@query("value_area_acceptance", "2.12.24 2.20.99", """
WITH p AS (SELECT symbol, lead(session_date) OVER (PARTITION BY symbol ORDER BY session_date) AS session_date, val, vah FROM areas),
b AS (SELECT symbol, session_date, (minute - 570) // 30 AS br, first(open ORDER BY ts) AS o, last(close ORDER BY ts) AS c FROM bars5 WHERE minute >= 570 AND minute < 960 GROUP BY ALL),
j AS (SELECT b.*, val, vah, first(o) OVER (PARTITION BY symbol, session_date ORDER BY br) AS fo, CAST(c BETWEEN val AND vah AS INT) AS i FROM b JOIN p USING (symbol, session_date)),
k AS (SELECT *, sum(i) OVER (PARTITION BY symbol, session_date ORDER BY br ROWS 1 PRECEDING) = 2 AS acc, CASE WHEN fo > vah THEN 'above' WHEN fo < val THEN 'below' END AS side FROM j)
SELECT symbol, @D(session_date) AS session_date, side AS open_side, @R(min(br) FILTER (acc)) AS accepted_bracket, @R(max(val)) AS val, @R(max(vah)) AS vah FROM k WHERE side IS NOT NULL GROUP BY symbol, session_date, side""")
def _(m):
    out = X.acceptance(m.bars(), G.value_areas(m.bars()))
    return out.withColumn("accepted_bracket", F.col("accepted_bracket").cast("double"))


@query("trailing_month_signs", "2.12.25", """
WITH s AS (SELECT d.symbol, d.date, d.close, sign(d.close - a.close) AS s1 FROM (SELECT *, CAST(date - INTERVAL 1 MONTH AS DATE) AS b FROM daily) d ASOF LEFT JOIN daily a ON d.symbol = a.symbol AND d.b >= a.date),
t AS (SELECT s.*, sign(s.close - a.close) AS s6 FROM (SELECT *, CAST(date - INTERVAL 6 MONTH AS DATE) AS b FROM s) s ASOF LEFT JOIN daily a ON s.symbol = a.symbol AND s.b >= a.date)
SELECT symbol, @D(date) AS date, @R(s1) AS sign_1, @R(s6) AS sign_6, @R((s1 + s6) / 2) AS ensemble FROM t""")
def _(m):
    return X.trailing_signs(m.daily(), (1, 6), "close").select("symbol", "date", "sign_1", "sign_6", "ensemble")


view("run_hits", f"""SELECT a.symbol, a.date, a.k AS i, min(b.k) FILTER (b.close >= a.close * 1.1) AS done, min(b.k) FILTER (b.low < a.close * 0.95::DOUBLE) AS dead FROM framed a JOIN framed b ON a.symbol = b.symbol AND b.k BETWEEN a.k + 1 AND a.k + 10 GROUP BY 1, 2, 3""")
view("run_ok", "SELECT symbol, date, i, done FROM run_hits WHERE done IS NOT NULL AND (dead IS NULL OR done < dead)")
view("run_pick", """SELECT symbol, i, done, date FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i) AS r FROM run_ok) WHERE r = 1
 UNION ALL SELECT n.symbol, n.i, n.done, n.date FROM run_pick p JOIN LATERAL (SELECT * FROM run_ok o WHERE o.symbol = p.symbol AND o.i > p.done ORDER BY o.i LIMIT 1) n ON true""")


@query("forward_run_labels", "2.12.27 2.20.68", "SELECT symbol, @D(date) AS date, @I(done - i) AS k FROM run_pick")
def _(m):
    return X.forward_runs(m.daily()).select("symbol", "date", "k")


@query("veto_tags", "2.12.28 2.20.16", f"""
WITH a AS (SELECT *, close * volume AS dollars, lag(close) OVER ({D}) AS pc, lag(close * volume) OVER ({D}) AS pd, row_number() OVER ({D}) AS i, max(struct_pack(d := close * volume, c := close)) OVER ({D} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS top FROM daily),
b AS (SELECT *, coalesce(close > pc AND dollars > pd, false) AS green FROM a), c AS (SELECT *, i - max(CASE WHEN NOT green THEN i END) OVER ({D}) AS run, last_value(CASE WHEN NOT green THEN close END IGNORE NULLS) OVER ({D} ROWS UNBOUNDED PRECEDING) AS base FROM b),
d AS (SELECT *, lag(close) OVER ({D}) AS c1, lag(close, 2) OVER ({D}) AS peak, lag(run, 2) OVER ({D}) AS r2, lag(base, 2) OVER ({D}) AS b2, lag(low) OVER ({D}) AS l1 FROM c)
SELECT symbol, @D(date) AS date, @I(coalesce((high / pc - 1) * 100 >= 30 AND volume > 60, false)) AS crowded_gap, @I(coalesce(top.d >= 50000 AND abs(high / top.c - 1) <= 0.1, false)) AS dollar_block,
 @I(coalesce(c1 < peak AND r2 >= 2 AND (peak / b2 - 1) * 100 >= 20 AND (peak - l1) / nullif(peak - b2, 0) * 100 <= 50, false)) AS first_red FROM d""")
def _(m):
    return X.veto_tags(m.daily()).select("symbol", "date", "crowded_gap", "dollar_block", "first_red")


@query("prior_spike_labels", "2.12.29 2.20.56", f"""
WITH a AS (SELECT symbol, date, list(close) OVER ({D} ROWS BETWEEN 65 PRECEDING AND 6 PRECEDING) AS h FROM daily),
m AS (SELECT symbol, date, h, len(h) AS n, list_reduce(list_transform(h, lambda x: struct_pack(lo := x, gain := 0::DOUBLE, peak := 0::DOUBLE, base := 0::DOUBLE)),
  lambda acc, x: CASE WHEN (x.lo - acc.lo) / acc.lo > acc.gain THEN struct_pack(lo := least(acc.lo, x.lo), gain := (x.lo - acc.lo) / acc.lo, peak := x.lo, base := acc.lo) ELSE struct_pack(lo := least(acc.lo, x.lo), gain := acc.gain, peak := acc.peak, base := acc.base) END) AS s FROM a WHERE len(h) > 0),
r AS (SELECT symbol, date, n, CASE WHEN s.gain >= 0.5 THEN s.gain END AS g, CASE WHEN s.gain >= 0.5 THEN greatest(0, least(1, (h[n] - s.base) / (s.peak - s.base))) END AS kept FROM m)
SELECT d.symbol, @D(d.date) AS date, @R(g) AS run_pct, @R(kept) AS retained, CASE WHEN coalesce(n, 0) < 10 THEN 'too new to judge' WHEN g IS NULL THEN 'no prior spike' WHEN kept >= 0.5 THEN 'former runner' WHEN kept < 0.25 THEN 'pump and dump' ELSE 'partial hold' END AS history FROM daily d LEFT JOIN r USING (symbol, date)""")
def _(m):
    return X.prior_spikes(m.daily()).select("symbol", "date", "run_pct", "retained", "history")


@query("chart_features", "2.12.30", f"""
WITH a AS (SELECT *, macd - macd_signal AS h, CAST(close > ema21 AS INT) AS side FROM ind), b AS (SELECT *, h - lag(h) OVER ({D}) AS hc, coalesce(CAST(side <> lag(side) OVER ({D}) AS INT), 0) AS turn, max(high) OVER ({D} ROWS 19 PRECEDING) AS hh, min(low) OVER ({D} ROWS 19 PRECEDING) AS ll FROM a)
SELECT symbol, @D(date) AS date, @R((ema9 - ema21) / nullif(atr14, 0)) AS ema_spread_atr, @R(hc) AS hist_change, @R((close - ema9) / nullif(atr14, 0)) AS close_to_ema_atr, @R(hh - ll) AS range20, @R((close - ll) / nullif(hh - ll, 0)) AS range20_pos,
 @I(sum(turn) OVER ({D} ROWS 19 PRECEDING)) AS side_changes, @R((high - greatest(open, close)) / nullif(high - low, 0)) AS upper_wick, @R(least(50, i - max(CASE WHEN turn = 1 THEN i END) OVER ({D}))) AS since_cross, @I(dayofweek(date) + 1) AS weekday FROM b""", digits=4)
def _(m):
    return X.chart_features(indicators(m)).select(
        "symbol", "date", "ema_spread_atr", "hist_change", "close_to_ema_atr", "range20", "range20_pos", "side_changes", "upper_wick",
        F.col("since_cross").cast("double").alias("since_cross"), "weekday")
