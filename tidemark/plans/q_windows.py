"""Window features (2.5) on supplier-day bars and on market sessions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.operators import entry as E, windows as W
from tidemark.plans.registry import query, view

D = "PARTITION BY symbol ORDER BY date"
S = "PARTITION BY symbol, session_date ORDER BY ts"

view("screen_features", f"""SELECT *, CASE WHEN prior_close > 0 THEN (high - low) / prior_close * 100 END AS range_pct,
  CASE WHEN prior_close > 0 THEN (open - prior_close) / prior_close * 100 END AS gap_pct, volume / prior_avg_vol AS rvol FROM (
  SELECT *, close * volume AS dollar_vol, lag(close) OVER ({D}) AS prior_close,
   CASE WHEN count(*) OVER ({D} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) >= 3 THEN
     avg(close * volume) OVER ({D} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS prior_avg_dollar_vol,
   CASE WHEN count(*) OVER ({D} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) >= 3 THEN
     avg(volume) OVER ({D} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS prior_avg_vol FROM daily)""")


@query("screen_features", "2.2.1 2.5.1", """
SELECT symbol, @D(date) AS date, @R(prior_close) AS prior_close, @R(prior_avg_dollar_vol) AS prior_avg_dollar_vol,
 @R(prior_avg_vol) AS prior_avg_vol, @R(rvol) AS rvol, @R(range_pct) AS range_pct, @R(gap_pct) AS gap_pct FROM screen_features""")
def _(m):
    return W.screen_features(m.daily()).select(
        "symbol", "date", "prior_close", "prior_avg_dollar_vol", "prior_avg_vol", "rvol", "range_pct", "gap_pct")


@query("prior_mean_exact_count", "2.5.2", f"""
SELECT symbol, @D(date) AS date, @R(CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END) AS prior_atr14 FROM (
 SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER ({D})), 0), coalesce(abs(low - lag(close) OVER ({D})), 0)) AS tr FROM daily)
WINDOW w AS ({D} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)""")
def _(m):
    df = m.daily().withColumn("tr", W.true_range())
    return df.select("symbol", "date", W.prior(F.avg, "tr", W.DAY, "date", 14).alias("prior_atr14"))


@query("rolling_median_shifted", "2.5.3", f"""
SELECT symbol, @D(date) AS date, @R(CASE WHEN count(*) OVER w >= 5 THEN quantile_cont(volume, 0.5) OVER w END) AS median_volume
FROM daily WINDOW w AS ({D} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def _(m):
    return m.daily().select("symbol", "date", W.prior(W.median, "volume", W.DAY, "date", 20, 5).alias("median_volume"))


@query("centred_median_outliers", "2.5.4", f"""
SELECT symbol, @D(date) AS date, @R(quantile_cont(close, 0.5) OVER w) AS centred_median,
 @I(abs(close / quantile_cont(close, 0.5) OVER w - 1) > 0.2) AS wild FROM daily
WINDOW w AS ({D} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def _(m):
    return W.centred_outliers(m.daily()).select("symbol", "date", "centred_median", "wild")


@query("donchian_channel", "2.5.5", f"""
SELECT symbol, @D(date) AS date,
 @R(CASE WHEN count(*) OVER a = 20 THEN max(high) OVER a END) AS hh, @R(CASE WHEN count(*) OVER a = 20 THEN min(low) OVER a END) AS ll,
 @R(CASE WHEN count(*) OVER b = 20 THEN max(high) OVER b END) AS prior_hh, @R(CASE WHEN count(*) OVER b = 20 THEN min(low) OVER b END) AS prior_ll
FROM daily WINDOW a AS ({D} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS ({D} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def _(m):
    return W.donchian(m.daily()).select("symbol", "date", "hh", "ll", "prior_hh", "prior_ll")


@query("running_session_extremes", "2.5.6", f"""
SELECT symbol, @T(ts) AS ts, @R(max(high) OVER w) AS session_high, @R(min(low) OVER w) AS session_low,
 @R(close / max(high) OVER w - 1) AS dist_from_high FROM bars5 WINDOW w AS ({S} ROWS UNBOUNDED PRECEDING)""")
def _(m):
    return W.running_extremes(m.bars()).select("symbol", "ts", "session_high", "session_low", "dist_from_high")


@query("k_bar_return", "2.5.7", f"""
SELECT symbol, @T(ts) AS ts, @R(close / nullif(lag(close, 5) OVER ({S}), 0) - 1) AS ret_5 FROM bars5""")
def _(m):
    r = F.try_divide(F.col("close"), F.nullif(W.lag("close", W.SESSION, "ts", 5), F.lit(0.0))) - 1
    return m.bars().select("symbol", "ts", r.alias("ret_5"))


@query("run_up_features", "2.5.8", f"""
WITH b AS (SELECT *, lag(close) OVER ({S}) AS c1, lag(close, 3) OVER ({S}) AS c3, lag(close, 5) OVER ({S}) AS c5,
  quantile_cont(volume, 0.5) OVER ({S} ROWS UNBOUNDED PRECEDING) AS med, row_number() OVER ({S}) AS n,
  max(high) OVER ({S} ROWS UNBOUNDED PRECEDING) AS hi, min(low) OVER ({S} ROWS UNBOUNDED PRECEDING) AS lo FROM bars5)
SELECT symbol, @T(ts) AS ts, @R(CASE WHEN med > 0 THEN volume / med END) AS rvol_1,
 @R(CASE WHEN med > 0 AND n >= 5 THEN sum(volume) OVER ({S} ROWS 4 PRECEDING) / (5 * med) END) AS rvol_5,
 @R(close / nullif(c1, 0) - 1) AS ret_1, @R(close / nullif(c3, 0) - 1) AS ret_3, @R(close / nullif(c5, 0) - 1) AS ret_5,
 @I(CASE WHEN n >= 6 THEN sum(CAST(close > c1 AS INT)) OVER ({S} ROWS 4 PRECEDING) END) AS up_bars_5,
 @R(close / nullif(c1, 0) - 1 - (close / nullif(c3, 0) - 1) / 3) AS accel, @R(CASE WHEN hi > lo THEN (close - lo) / (hi - lo) END) AS pos_in_range,
 @R(close / nullif(hi, 0) - 1) AS dist_from_high, @I(minute - 240) AS minutes_since_open,
 @R(CAST('0x' || substr(md5('7|' || symbol || '|' || CAST(CAST(epoch(ts) AS BIGINT) AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0) AS rand FROM b""")
def _(m):
    return W.run_up_features(m.bars()).select(
        "symbol", "ts", "rvol_1", "rvol_5", "ret_1", "ret_3", "ret_5", "up_bars_5", "accel", "pos_in_range",
        "dist_from_high", "minutes_since_open", "rand")


@query("session_vwap", "2.5.9", f"""
SELECT symbol, @T(ts) AS ts, @R(sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0)) AS vwap,
 @R(sum(close * volume) OVER w) AS cum_dollar_volume FROM bars5 WINDOW w AS ({S} ROWS UNBOUNDED PRECEDING)""")
def _(m):
    return W.session_vwap(m.bars()).select("symbol", "ts", "vwap", "cum_dollar_volume")


@query("running_range_on_grid", "2.5.10", f"""
WITH b AS (SELECT *, avg((high - low) / nullif(open, 0) * 100) OVER ({S} ROWS UNBOUNDED PRECEDING) AS v FROM bars5),
g AS (SELECT DISTINCT symbol, session_date, CAST(unnest(range(240, 571, 30)) AS INT) AS minute FROM bars5)
SELECT symbol, @D(session_date) AS session_date, @I(minute) AS minute,
 @R((SELECT arg_max(v, b.minute) FROM b WHERE b.symbol = g.symbol AND b.session_date = g.session_date AND b.minute < g.minute)) AS range_pct FROM g""")
def _(m):
    return W.range_on_minute_grid(m.bars(), 240, 570, 30)


@query("bars_since_high", "2.5.11", f"""
WITH b AS (SELECT *, row_number() OVER ({D}) AS i FROM daily)
SELECT symbol, @D(date) AS date, @I(CASE WHEN n = 20 THEN i - oldest END) AS since_high, @R(CASE WHEN n = 20 AND hh > ll THEN (close - ll) / (hh - ll) END) AS range_pos
FROM (SELECT *, count(*) OVER w AS n, max(high) OVER w AS hh, min(low) OVER w AS ll,
   list_min(list_transform(list_filter(list(struct_pack(h := high, i := i)) OVER w, lambda x: x.h = max(high) OVER w), lambda x: x.i)) AS oldest
   FROM b WINDOW w AS ({D} ROWS 19 PRECEDING))""")
def _(m):
    return W.bars_since_high(m.daily()).select("symbol", "date", "since_high", "range_pos")


@query("bollinger_bands", "2.5.12", f"""
WITH b AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS mid,
  CASE WHEN count(*) OVER w = 20 THEN stddev_pop(close) OVER w END AS sd FROM daily WINDOW w AS ({D} ROWS 19 PRECEDING)),
c AS (SELECT *, 4 * sd / mid AS width, round(4 * sd / mid, 9) AS rw FROM b),
d AS (SELECT *, list_filter(list(rw) OVER ({D} ROWS 49 PRECEDING), lambda x: x IS NOT NULL) AS ws FROM c)
SELECT symbol, @D(date) AS date, @R(mid) AS bb_mid, @R(mid + 2 * sd) AS bb_upper, @R(mid - 2 * sd) AS bb_lower, @R(width) AS bb_width,
 @R(CASE WHEN sd > 1e-9 THEN (close - mid + 2 * sd) / (4 * sd) END) AS bb_pos,
 @R(CASE WHEN rw IS NOT NULL AND len(ws) = 50 THEN len(list_filter(ws, lambda x: x <= rw)) / len(ws) END) AS bb_width_rank FROM d""")
def _(m):
    return W.bollinger(m.daily()).select("symbol", "date", "bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pos", "bb_width_rank")


@query("ols_slope_and_change", "2.5.13", f"""
WITH b AS (SELECT *, (close - lag(close, 2) OVER ({D})) / 2 AS slope,
  CASE WHEN count(*) OVER ({D} ROWS 2 PRECEDING) = 3 THEN avg(close) OVER ({D} ROWS 2 PRECEDING) END AS mean FROM daily)
SELECT symbol, @D(date) AS date, @R(slope) AS slope, @R(slope * 2 / greatest(mean - slope, 5) * 100) AS fitted_change FROM b""")
def _(m):
    return m.daily().select("symbol", "date", W.ols_slope("close", 3).alias("slope"), W.fitted_change("close", 3).alias("fitted_change"))


@query("rising_falling_apex", "2.5.14", f"""
WITH b AS (SELECT *, lag(close, 3) OVER ({D}) AS c3, CASE WHEN count(*) OVER w = 20 THEN max(close) OVER w END AS top FROM daily WINDOW w AS ({D} ROWS 19 PRECEDING))
SELECT symbol, @D(date) AS date, @I(coalesce(close > c3, false)) AS is_rising, @I(coalesce(close < c3, false)) AS is_falling,
 @I(coalesce(close < c3, false) AND NOT coalesce(close >= top, false)) AS is_past_apex FROM b""")
def _(m):
    return m.daily().select("symbol", "date", W.rising("close").alias("is_rising"), W.falling("close").alias("is_falling"),
                            W.past_apex("close").alias("is_past_apex"))


@query("money_flow_index", "2.5.15", f"""
WITH a AS (SELECT *, round((high + low + close) / 3, 8) AS tp FROM daily), b AS (SELECT *, tp - lag(tp) OVER ({D}) AS d FROM a),
c AS (SELECT *, sum(CASE WHEN d > 0 THEN tp * volume ELSE 0 END) OVER w AS up, sum(CASE WHEN d < 0 THEN tp * volume ELSE 0 END) OVER w AS down,
  count(*) OVER w AS n FROM b WINDOW w AS ({D} ROWS 13 PRECEDING))
SELECT symbol, @D(date) AS date, @R(CASE WHEN n = 14 AND down <> 0 THEN 100 - 100 / (1 + up / down) ELSE 50 END) AS mfi FROM c""")
def _(m):
    return W.money_flow(m.daily()).select("symbol", "date", "mfi")


@query("true_range", "2.5.16", f"""
SELECT symbol, @D(date) AS date, @R(greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0))) AS tr
FROM (SELECT *, lag(close) OVER ({D}) AS pc FROM daily)""")
def _(m):
    return m.daily().select("symbol", "date", W.true_range().alias("tr"))


@query("efficiency_ratio", "2.5.17", f"""
WITH b AS (SELECT *, abs(close - lag(close) OVER ({D})) AS step FROM daily)
SELECT symbol, @D(date) AS date, @R(abs(close - lag(close, 10) OVER ({D})) / nullif(CASE WHEN count(step) OVER w = 10 THEN sum(step) OVER w END, 0)) AS efficiency
FROM b WINDOW w AS ({D} ROWS 9 PRECEDING)""")
def _(m):
    return W.with_efficiency(m.daily()).select("symbol", "date", "efficiency")


@query("lag5_autocorrelation", "2.5.18 2.5.20", f"""
WITH r AS (SELECT *, ln(close / lag(close) OVER ({D})) AS r FROM daily), p AS (SELECT *, lag(r, 5) OVER ({D}) AS r5 FROM r)
SELECT symbol, @D(date) AS date, @R(r) AS log_return, @R(CASE WHEN count(r5) OVER w = 20 AND count(r) OVER w = 20 THEN corr(r, r5) OVER w END) AS autocorr
FROM p WINDOW w AS ({D} ROWS 19 PRECEDING)""")
def _(m):
    df = m.daily().withColumn("log_return", W.log_returns())
    return W.lagged_autocorrelation(df, "log_return").select("symbol", "date", "log_return", "autocorr")


@query("hurst_proxy", "2.5.19", f"""
WITH a AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER ({D})), 0), coalesce(abs(low - lag(close) OVER ({D})), 0)) AS tr FROM daily)
SELECT symbol, @D(date) AS date, @R(CASE WHEN count(*) OVER w = 20 AND avg(tr) OVER w > 0 AND max(high) OVER w > min(low) OVER w
  THEN 100 * ln((max(high) OVER w - min(low) OVER w) / avg(tr) OVER w) / ln(20) END) AS hurst
FROM a WINDOW w AS ({D} ROWS 19 PRECEDING)""")
def _(m):
    return W.hurst_proxy(m.daily()).select("symbol", "date", "hurst")


@query("swing_pivots", "2.5.22 2.5.23", f"""
WITH a AS (SELECT *, count(*) OVER w = 7 AND high = max(high) OVER w AS ph, count(*) OVER w = 7 AND low = min(low) OVER w AS pl,
  lead(date, 3) OVER ({D}) AS known FROM daily WINDOW w AS ({D} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
b AS (SELECT *, lag(CASE WHEN ph THEN high END, 3) OVER ({D}) AS u, lag(CASE WHEN pl THEN low END, 3) OVER ({D}) AS d FROM a)
SELECT symbol, @D(date) AS date, @I(ph) AS pivot_high, @I(pl) AS pivot_low, @D(known) AS known_at,
 @R(last_value(u IGNORE NULLS) OVER ({D} ROWS UNBOUNDED PRECEDING)) AS last_high,
 @R(last_value(d IGNORE NULLS) OVER ({D} ROWS UNBOUNDED PRECEDING)) AS last_low FROM b""")
def _(m):
    return W.last_confirmed_pivot(m.daily()).select("symbol", "date", "pivot_high", "pivot_low", "known_at", "last_high", "last_low")


@query("cross_sectional_rank", "2.5.24", f"""
WITH b AS (SELECT *, avg((high - low) / nullif(open, 0) * 100) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM bars5)
SELECT symbol, @T(ts) AS ts, @R(v) AS range_pct_before, @I(count(*) OVER (PARTITION BY ts)) AS visible,
 @I(rank() OVER (PARTITION BY ts ORDER BY round(v, 9) DESC)) AS value_rank, @I(rank() OVER (PARTITION BY ts ORDER BY round(v, 9) DESC) <= 2) AS gate
FROM b WHERE v IS NOT NULL""")
def _(m):
    df = W.running_range_pct(m.bars()).withColumn("v", F.round("range_pct_before", 9))
    return W.rank_at_each_minute(df, "v", 2, ["ts"]).select("symbol", "ts", "range_pct_before", "visible", "value_rank", "gate")


@query("trailing_percentile_gate", "2.5.28", f"""
WITH a AS (SELECT *, CASE WHEN count(*) OVER w = 60 THEN quantile_cont(volume, 0.67) OVER w END AS cut FROM daily
 WINDOW w AS ({D} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT symbol, @D(date) AS date, @R(cut) AS cut, @I(coalesce(volume >= cut, false)) AS gate FROM a""")
def _(m):
    return W.trailing_percentile_gate(m.daily(), "volume", 60, 0.67).select("symbol", "date", "cut", "gate")


@query("clock_window_volatility", "2.5.29", """
WITH r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol, session_date ORDER BY ts) - 1 AS r FROM bars5 WHERE minute >= 570 AND minute < 780)
SELECT symbol, @D(session_date) AS session_date, @R(stddev_samp(r)) AS sigma, count(r) AS returns FROM r GROUP BY 1, 2""")
def _(m):
    return W.window_volatility(m.bars(), 570, 780)


@query("loss_streaks", "2.5.32", """
WITH a AS (SELECT *, sum(CASE WHEN net >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY exit_ts, trade_id) AS run FROM ledger),
r AS (SELECT symbol, run, count(*) AS n, sum(net) AS total FROM a WHERE net < 0 GROUP BY 1, 2)
SELECT symbol, max(n) AS longest_loss_run, @R(min(total)) AS worst_run_total, @I(sum(n // 3)) AS three_loss_events FROM r GROUP BY 1""")
def _(m):
    return W.loss_streaks(m.ledger(), ["symbol"], ["exit_ts", "trade_id"])


@query("moving_averages", "2.6.7", f"""
SELECT symbol, @D(date) AS date, @R(CASE WHEN count(*) OVER w = 20 THEN sum(close * volume) OVER w / sum(volume) OVER w END) AS vwma,
 @R(CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END) AS sma FROM daily WINDOW w AS ({D} ROWS 19 PRECEDING)""")
def _(m):
    return m.daily().select("symbol", "date", W.volume_weighted_mean(20).alias("vwma"), W.simple_mean(20).alias("sma"))


@query("entry_tape_features", "2.5.21", """
WITH a AS (SELECT *, lag(volume) OVER r AS pv, CASE WHEN count(volume) OVER p = 60 THEN avg(volume) OVER p END AS ta, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS ma, CASE WHEN count(*) OVER w = 20 THEN stddev_pop(close) OVER w END AS sd,
  CASE WHEN count(*) OVER w = 20 THEN avg(volume) OVER w END AS mv, sum(volume) OVER d AS held, sum((high + low + close) / 3 * volume) OVER d AS paid, count(*) FILTER (volume > 0) OVER d AS seen, first(close) OVER d AS fc, first(ts) OVER d AS ft,
  avg(high - low) OVER f AS span, avg((high - low) / nullif(close, 0)) OVER f AS rel
 FROM bars5 WINDOW r AS (PARTITION BY symbol ORDER BY ts), p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), f AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING),
  d AS (PARTITION BY symbol, session_date ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT symbol, @T(ts) AS ts, @D(session_date) AS session_date, @R(volume / nullif(ta, 0)) AS vol_over_trail, @R(volume / nullif(pv, 0)) AS vol_multiple, @R(pv / nullif(ta, 0)) AS floor_margin, @I(minute - 240) AS mins_since_open, @R(close) AS price,
 @R((close / nullif(fc, 0) - 1) * 100) AS extension, @R(rel * 100) AS range_pct, @R(close * held) AS dollar_vol_session, @R(close * volume) AS dollar_vol_bar, @R(seen / ((epoch_us(ts) - epoch_us(ft)) / 60000000 + 1) * 100) AS tape_density, @R(0.05 * close / nullif(span, 0)) AS trail_over_range,
 @R(CASE WHEN high > low THEN (close - low) / (high - low) END) AS close_in_bar, @R(CASE WHEN high > low THEN abs(close - open) / (high - low) END) AS body_ratio, @R((close / nullif(paid / nullif(held, 0), 0) - 1) * 100) AS vwap_dist, @R((close / nullif(ma, 0) - 1) * 100) AS ma20_dist,
 @R((ma / nullif(lag(ma, 3) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1) * 100) AS ma20_slope, @R(CASE WHEN sd > 1e-9 THEN (close - ma + 2 * sd) / (4 * sd) END) AS bb_pos, @R(4 * sd / nullif(ma, 0) * 100) AS bb_width, @R(volume / nullif(mv, 0)) AS vol_over_ma20 FROM a""", digits=5)
def _(m):
    return E.tape_features(m.bars())


@query("entry_momentum_features", "2.5.21")
def _(m):
    return E.momentum_features(m.bars())
