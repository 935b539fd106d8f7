"""Bars, sessions, clocks and rollups (2.1, 2.4, 2.9, 2.10)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import clock, costs as C, prices as P, text as X
from tidemark.operators import bars, calendar as K, rollups as G, scale, windows as W
from tidemark.plans.registry import query, view

RTH = "minute >= 570 AND minute < 960"
D = "PARTITION BY symbol ORDER BY date"


@query("bars_from_ticks", "2.4.1", """
SELECT symbol, @T(ts) AS ts, @R(open) AS open, @R(high) AS high, @R(low) AS low, @R(close) AS close,
  @I(volume) AS volume, @I(trades) AS trades FROM bars5""")
def _(m):
    return bars.resample_ticks(m.market_ticks(), 300).select("symbol", "ts", "open", "high", "low", "close", "volume", "trades")


@query("bars_from_minute_bars", "2.4.1", """
SELECT symbol, @T(time_bucket(INTERVAL 15 MINUTE, ts)) AS ts, @R(first(open ORDER BY ts)) AS open, @R(max(high)) AS high, @R(min(low)) AS low,
 @R(last(close ORDER BY ts)) AS close, @I(sum(volume)) AS volume FROM bars1 GROUP BY symbol, time_bucket(INTERVAL 15 MINUTE, ts)""")
def _(m):
    return bars.resample_bars(m.bars(1), 15).select("symbol", "ts", "open", "high", "low", "close", "volume")


@query("trade_ledger", "2.3.1", """
SELECT @I(trade_id) AS trade_id, symbol, @D(session_date) AS session_date, @T(entry_ts) AS entry_ts,
  @T(exit_ts) AS exit_ts, @R(entry_px) AS entry_px, @R(exit_px) AS exit_px, @I(qty) AS qty, @R(net) AS net FROM ledger""")
def _(m):
    return m.ledger().select("trade_id", "symbol", "session_date", "entry_ts", "exit_ts", "entry_px", "exit_px", "qty", "net")


@query("daily_bars", "2.1.3", """
SELECT symbol, @D(date) AS date, @R(open) AS open, @R(high) AS high, @R(low) AS low, @R(close) AS close, volume FROM daily""")
def _(m):
    return m.daily()


@query("wide_market_summary", "2.4.2", f"""
WITH r AS (SELECT *, minute - lag(minute) OVER (PARTITION BY symbol, session_date ORDER BY ts) - 1 AS gap FROM bars5 WHERE {RTH})
SELECT symbol, @D(session_date) AS session_date, @R(first(open ORDER BY ts)) AS open, @R(max(high)) AS high, @R(min(low)) AS low, @R(last(close ORDER BY ts)) AS close,
 @I(sum(volume)) AS volume, count(*) AS bars, @I(min(minute)) AS first_minute, @I(max(minute)) AS last_minute, @I(coalesce(max(gap), 0)) AS max_gap,
 @R(first(open ORDER BY ts) FILTER (minute < 585)) AS or15_open, @R(max(high) FILTER (minute < 585)) AS or15_high, @R(min(low) FILTER (minute < 585)) AS or15_low,
 @R(last(close ORDER BY ts) FILTER (minute < 585)) AS or15_close, @I(coalesce(sum(volume) FILTER (minute < 585), 0)) AS or15_volume FROM r GROUP BY 1, 2""")
def _(m):
    return bars.session_summary(m.bars(), (15,))


@query("session_slot_bars", "2.4.3", f"""
SELECT symbol, @D(session_date) AS session_date, @I((minute - 570) // 60) AS slot, @R(first(open ORDER BY ts)) AS open, @R(max(high)) AS high,
 @R(min(low)) AS low, @R(last(close ORDER BY ts)) AS close, @I(sum(volume)) AS volume, count(*) AS bars FROM bars5 WHERE {RTH} GROUP BY ALL""")
def _(m):
    return bars.session_slots(m.bars())


view("et_bars5", "SELECT *, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS wall FROM bars5")


@query("futures_session_bars", "2.4.4", """
SELECT symbol, @D(CAST(wall + INTERVAL 6 HOUR AS DATE)) AS futures_date, @I(((hour(wall) + 6) % 24) // 4) AS slot, @R(first(open ORDER BY ts)) AS open,
 @R(max(high)) AS high, @R(min(low)) AS low, @R(last(close ORDER BY ts)) AS close, @I(sum(volume)) AS volume, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts
FROM et_bars5 WHERE hour(wall) <> 17 GROUP BY symbol, CAST(wall + INTERVAL 6 HOUR AS DATE), ((hour(wall) + 6) % 24) // 4""")
def _(m):
    return bars.futures_bars(m.bars())


@query("weekly_bars", "2.4.5", """
SELECT symbol, @I(isoyear(date) * 100 + week(date)) AS week, @R(first(open ORDER BY date)) AS open, @R(max(high)) AS high, @R(min(low)) AS low,
 @R(last(close ORDER BY date)) AS close, @I(sum(volume)) AS volume, count(*) AS bars, @D(max(date)) AS week_end FROM daily GROUP BY symbol, isoyear(date) * 100 + week(date)""")
def _(m):
    return bars.weekly_bars(m.daily())


@query("monthly_bars", "2.4.5", """
SELECT symbol, @I(year(date) * 100 + month(date)) AS month, @R(first(open ORDER BY date)) AS open, @R(max(high)) AS high, @R(min(low)) AS low,
 @R(last(close ORDER BY date)) AS close, @I(sum(volume)) AS volume, count(*) AS bars FROM daily GROUP BY symbol, year(date) * 100 + month(date)""")
def _(m):
    return bars.monthly_bars(m.daily())


@query("sunday_fold", "2.4.6", f"""
WITH f AS (SELECT *, CASE WHEN dayofweek(date) = 0 AND lead(date) OVER ({D}) - date <= 3 THEN lead(date) OVER ({D}) ELSE date END AS fd FROM daily)
SELECT symbol, @D(fd) AS fold_date, @R(first(open ORDER BY date)) AS open, @R(max(high)) AS high, @R(min(low)) AS low, @R(last(close ORDER BY date)) AS close,
 @I(sum(volume)) AS volume, count(*) AS bars FROM f GROUP BY symbol, fd""")
def _(m):
    return bars.fold_weekend(m.daily())


@query("dollar_volume", "2.4.7", """
SELECT symbol, @D(session_date) AS session_date, @R(sum(close * volume)) AS dollar_volume FROM sbars1
WHERE (symbol, session_date) IN (SELECT symbol, session_date FROM ledger) GROUP BY 1, session_date""")
def _(m):
    return bars.dollar_volume(m.symbol_bars(1), m.ledger())


@query("symbol_day_rollup", "2.4.8", """
SELECT symbol, @D(session_date) AS session_date, count(*) AS fills, @I(sum(qty)) AS shares, @R(sum(CASE WHEN side = 'BUY' THEN qty * price ELSE 0 END)) AS buy_notional,
 @R(sum(CASE WHEN side = 'SELL' THEN qty * price ELSE 0 END)) AS sell_notional, @R(sum(CASE WHEN side = 'BUY' THEN qty * price END) / sum(CASE WHEN side = 'BUY' THEN qty END)) AS avg_buy,
 @R(sum(CASE WHEN side = 'SELL' THEN qty * price END) / sum(CASE WHEN side = 'SELL' THEN qty END)) AS avg_sell FROM fills GROUP BY 1, session_date""")
def _(m):
    f = m.fills()
    buy, sell, notional = F.col("side") == "BUY", F.col("side") == "SELL", F.col("qty") * F.col("price")
    return f.groupBy("symbol", "session_date").agg(
        F.count(F.lit(1)).alias("fills"), F.sum("qty").alias("shares"),
        F.sum(F.when(buy, notional).otherwise(0.0)).alias("buy_notional"), F.sum(F.when(sell, notional).otherwise(0.0)).alias("sell_notional"),
        F.try_divide(F.sum(F.when(buy, notional)), F.sum(F.when(buy, F.col("qty")))).alias("avg_buy"),
        F.try_divide(F.sum(F.when(sell, notional)), F.sum(F.when(sell, F.col("qty")))).alias("avg_sell"))


@query("book_summary", "2.4.9", """
SELECT trades, @R(net) AS net, @R(win_rate) AS win_rate, @R(avg_win) AS avg_win, @R(avg_loss) AS avg_loss, @R(avg_win / -avg_loss) AS payoff,
 @R(net - (SELECT sum(net) FROM (SELECT net FROM ledger ORDER BY net DESC, trade_id LIMIT 5))) AS total_without FROM
 (SELECT count(*) AS trades, sum(net) AS net, avg(CAST(net > 0 AS INT)) AS win_rate, avg(net) FILTER (net > 0) AS avg_win, avg(net) FILTER (net < 0) AS avg_loss FROM ledger)""")
def _(m):
    led = m.ledger()
    dropped = G.drop_best(led, 5).select("total_without")
    return G.book_summary(led).join(F.broadcast(dropped), how="cross")


view("reasoned", "SELECT *, CASE WHEN trade_id % 4 = 0 THEN 'target' WHEN trade_id % 4 = 1 THEN 'stop' WHEN trade_id % 4 = 2 THEN 'time' ELSE 'signal' END AS reason FROM ledger")


def reasoned(m):
    k = F.col("trade_id") % 4
    return m.ledger().withColumn("reason", F.when(k == 0, "target").when(k == 1, "stop").when(k == 2, "time").otherwise("signal"))


@query("grouped_rollups", "2.4.10", """
SELECT month, @R(weekday) AS weekday, reason, @R(block) AS block, count(*) AS trades, @R(sum(net)) AS net, @R(avg(net)) AS per_trade, @R(avg(CAST(net > 0 AS INT))) AS win_rate FROM
 (SELECT *, strftime(session_date, '%Y-%m') AS month, dayofweek(session_date) + 1 AS weekday, entry_minute // 30 * 30 AS block FROM reasoned)
GROUP BY GROUPING SETS ((month), (weekday), (reason), (block), ())""")
def _(m):
    out = G.grouping_rollup(reasoned(m))
    return out.withColumn("weekday", F.col("weekday").cast("double")).withColumn("block", F.col("block").cast("double"))


@query("year_table", "2.4.10", """
SELECT @I(y) AS year, count(date) AS trades, @R(coalesce(sum(close - open), 0)) AS net FROM (SELECT unnest(range(a, b + 1)) AS y FROM (SELECT min(year(date)) AS a, max(year(date)) AS b FROM daily)) LEFT JOIN daily ON year(date) = y GROUP BY y""")
def _(m):
    return G.year_table(m.daily().withColumn("net", F.col("close") - F.col("open")), "date", "net")


@query("cross_tab", "2.4.11", """
SELECT market, count(*) FILTER (size <= 33) AS small, count(*) FILTER (size > 33 AND size <= 66) AS medium, count(*) FILTER (size > 66) AS large FROM ticks GROUP BY 1""")
def _(m):
    band = F.when(F.col("size") <= 33, "small").when(F.col("size") <= 66, "medium").otherwise("large")
    return m.ticks().withColumn("band", band).groupBy("market").pivot("band", ["small", "medium", "large"]).agg(
        F.count(F.lit(1))).na.fill(0)


@query("quantiles_two_rules", "2.4.12", """
SELECT side, count(*) AS n, @R(quantile_cont(price, 0.1)) AS p10, @R(quantile_cont(price, 0.5)) AS p50, @R(quantile_cont(price, 0.9)) AS p90,
 @R(list_sort(list(price))[CAST(floor(0.9::DOUBLE * (count(*) - 1)) AS BIGINT) + 1]) AS low90 FROM fills GROUP BY 1""")
def _(m):
    f = m.fills()
    a = scale.exact_quantiles(f, ["side"], "price", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    b = scale.exact_quantiles(f, ["side"], "price", {"low90": 0.9}, "lower").drop("n")
    return a.join(b, "side")


view("day_features", f"""WITH a AS (SELECT *, lag(close) OVER ({D}) AS pc,
  coalesce(volume / nullif(CASE WHEN count(*) OVER w >= 5 THEN quantile_cont(volume, 0.5) OVER w END, 0), 1.2) AS rel FROM daily WINDOW w AS ({D} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
 b AS (SELECT *, high / pc - 1 AS raw, CASE WHEN rel >= 1.2 THEN high / pc - 1 ELSE -1 END AS gain FROM a WHERE pc BETWEEN 50 AND 2000)
 SELECT date, count(*) AS n_names, count(*) FILTER (gain >= 0.3) AS n_movers, count(*) FILTER (gain >= 1) AS n_big, greatest(max(gain), 0) AS lead,
  coalesce(avg(CAST(least(1, greatest(0, (close / pc - 1) / gain)) < 0.5 AS INT)) FILTER (gain >= 0.3), 0) AS round_trip,
  coalesce(quantile_cont(pc, 0.5) FILTER (gain >= 0.3), 0) AS med_price, count(*) FILTER (raw >= 1 AND rel < 1.2) AS n_suspect FROM b GROUP BY 1""")


def day_features(m):
    return G.day_features(m.daily(), band=(50.0, 2000.0), live_volume=1.2)


@query("market_day_features", "2.4.13", """
SELECT @D(date) AS date, n_names, n_movers, n_big, @R(lead) AS lead, @R(round_trip) AS round_trip, @R(med_price) AS med_price, n_suspect FROM day_features""")
def _(m):
    return day_features(m)


view("regimes", """WITH r AS (SELECT *, n_movers >= 5 AS rated FROM day_features), p AS (SELECT *, count(*) OVER (PARTITION BY rated) AS n,
   rank() OVER (PARTITION BY rated ORDER BY n_movers) + (count(*) OVER (PARTITION BY rated, n_movers) - 1) / 2 AS r1,
   rank() OVER (PARTITION BY rated ORDER BY lead) + (count(*) OVER (PARTITION BY rated, lead) - 1) / 2 AS r2,
   rank() OVER (PARTITION BY rated ORDER BY -round_trip) + (count(*) OVER (PARTITION BY rated, round_trip) - 1) / 2 AS r3 FROM r),
  c AS (SELECT *, CASE WHEN rated AND n >= 3 THEN round((r1 + r2 + r3) / (3 * n), 9) END AS composite FROM p),
  q AS (SELECT quantile_cont(composite, 1/3.0::DOUBLE) AS lo, quantile_cont(composite, 2/3.0::DOUBLE) AS hi FROM c WHERE rated)
  SELECT date, composite, CASE WHEN NOT rated THEN 'cold' WHEN composite IS NULL THEN 'unrated' WHEN composite <= lo + 1e-12 THEN 'cold' WHEN composite > hi + 1e-12 THEN 'hot' ELSE 'mixed' END AS label FROM c, q""")


@query("regime_terciles", "2.5.26", "SELECT @D(date) AS date, @R(composite) AS composite, label FROM regimes")
def _(m):
    return G.regime_labels(day_features(m)).select("date", "composite", "label")


@query("lagged_regime", "2.5.27", """
WITH l AS (SELECT label, lag(label) OVER (ORDER BY date) AS yesterday FROM regimes)
SELECT yesterday, label, count(*) AS n FROM l WHERE yesterday IS NOT NULL GROUP BY 1, 2""")
def _(m):
    return G.label_persistence(G.regime_labels(day_features(m))).filter("yesterday is not null").groupBy("yesterday", "label").agg(F.count(F.lit(1)).alias("n"))


@query("cold_session_labels", "2.5.25", """
WITH a AS (SELECT date, n_movers, lead, -round_trip AS held, row_number() OVER (ORDER BY date) AS k FROM day_features WHERE n_movers >= 5),
p AS (SELECT x.date, x.k, round((avg(CAST(y.n_movers <= x.n_movers AS INT)) + avg(CAST(y.lead <= x.lead AS INT)) + avg(CAST(y.held <= x.held AS INT))) / 3, 9) AS composite
  FROM a x LEFT JOIN a y ON y.k < x.k GROUP BY 1, 2),
c AS (SELECT date, composite, count(composite) OVER w AS n, quantile_cont(composite, 1/3.0::DOUBLE) OVER w AS cut FROM p WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT @D(date) AS date, @R(composite) AS composite, CASE WHEN composite IS NULL OR n < 10 THEN 'inert' WHEN composite <= cut + 1e-12 THEN 'cold' ELSE 'warm' END AS kind FROM c
UNION ALL SELECT @D(date), NULL, 'count' FROM day_features WHERE n_movers < 5""")
def _(m):
    return G.cold_sessions(day_features(m).withColumnRenamed("n_movers", "n_visible"))


@query("share_profitable", "2.4.14", """
SELECT count(*) FILTER (total > 0) AS profitable, count(*) AS symbols, @R(avg(CAST(total > 0 AS INT))) AS share FROM
 (SELECT symbol, sum(CAST(net AS DECIMAL(28, 6))) AS total, count(*) AS n FROM ledger GROUP BY 1) WHERE n BETWEEN 5 AND 20""")
def _(m):
    return G.share_profitable(m.ledger(), 5, 20)


@query("population_measure", "2.4.15", """
WITH k AS (SELECT symbol, session_date, CASE WHEN max(size) > 66 THEN 'big' ELSE 'small' END AS population FROM ticks GROUP BY 1, 2),
t AS (SELECT symbol, session_date, count(*) AS n, sum(net) AS net FROM ledger GROUP BY 1, 2)
SELECT population, count(*) AS symbol_days, @I(coalesce(sum(n), 0)) AS entries, @R(coalesce(sum(n), 0) / count(*)) AS entries_per_day, @R(avg(CAST(n IS NOT NULL AS INT))) AS days_traded,
 @R(sum(net) / count(n)) AS net_per_traded_day, @R(sum(net) / sum(n)) AS net_per_trade FROM k LEFT JOIN t USING (symbol, session_date) GROUP BY 1""")
def _(m):
    keys = m.ticks().groupBy("symbol", "session_date").agg(F.when(F.max("size") > 66, "big").otherwise("small").alias("population"))
    return G.population_measure(m.ledger(), keys)


@query("variance_split", "2.4.16", """
WITH s AS (SELECT symbol, var_pop(ln(volume)) AS v, avg(ln(volume)) AS m FROM daily WHERE volume > 0 GROUP BY 1 HAVING count(*) >= 2)
SELECT @R(avg(v)) AS within, @R(var_pop(m)) AS between, @R(var_pop(m) / (var_pop(m) + avg(v))) AS icc FROM s""")
def _(m):
    return G.variance_split(m.daily(), "volume")


@query("lag1_autocorrelation", "2.4.17", f"""
WITH c AS (SELECT symbol, date, volume - avg(volume) OVER (PARTITION BY symbol) AS d FROM daily), n AS (SELECT *, lead(d) OVER ({D}) AS nx FROM c)
SELECT symbol, count(*) AS n, @R(sum(d * nx) / nullif(sum(d * d), 0)) AS rho FROM n GROUP BY 1 HAVING count(*) >= 5""")
def _(m):
    return G.lag1_autocorrelation(m.daily(), "volume", "date")


view("profile", """SELECT symbol, session_date, tick, round(sum(volume / (hi - lo + 1)), 9) AS volume FROM (SELECT *, unnest(range(lo, hi + 1)) AS tick FROM
  (SELECT symbol, session_date, volume, CAST(round_even(low, 0) AS BIGINT) AS lo, CAST(round_even(high, 0) AS BIGINT) AS hi FROM bars5)) GROUP BY 1, 2, 3""")


@query("volume_profile", "2.4.18", "SELECT symbol, @D(session_date) AS session_date, @I(tick) AS tick, @R(volume) AS volume FROM profile")
def _(m):
    return G.volume_profile(m.bars())


view("value_grid", """SELECT s.symbol, s.session_date, s.tick, coalesce(p.volume, 0) AS v FROM (SELECT symbol, session_date, unnest(range(min(tick), max(tick) + 1)) AS tick FROM profile GROUP BY 1, 2) s
  LEFT JOIN profile p USING (symbol, session_date, tick)""")
view("value_start", """SELECT g.symbol, g.session_date, arg_min(tick, (-v, abs(tick - l.c), tick)) AS poc, max(v) AS pv, sum(v) AS total, min(tick) AS lo, max(tick) AS hi,
   map_from_entries(list((tick, v))) AS vols FROM value_grid g JOIN (SELECT symbol, session_date, last(close ORDER BY ts) AS c FROM bars5 GROUP BY 1, 2) l USING (symbol, session_date) GROUP BY 1, 2""")
view("value_walk", """SELECT symbol, session_date, poc, poc AS a, poc AS b, pv AS held, total, lo, hi, vols, 0 AS step FROM value_start
 UNION ALL SELECT symbol, session_date, poc, CASE WHEN up >= dn THEN a ELSE a - 1 END, CASE WHEN up >= dn THEN b + 1 ELSE b END, held + greatest(up, dn), total, lo, hi, vols, step + 1 FROM (
  SELECT *, CASE WHEN b < hi THEN vols[b + 1] ELSE -1 END AS up, CASE WHEN a > lo THEN vols[a - 1] ELSE -1 END AS dn FROM value_walk) WHERE held < 0.7::DOUBLE * total - 1e-9 * greatest(total, 1) AND (a > lo OR b < hi)""")


@query("value_area", "2.4.18", """
SELECT symbol, @D(session_date) AS session_date, @R(poc) AS poc, @R(arg_max(a, step)) AS val, @R(arg_max(b, step)) AS vah, @R(max(total)) AS total FROM value_walk GROUP BY 1, session_date, poc""")
def _(m):
    return G.value_areas(m.bars())


@query("basket_index", "2.4.19", f"""
WITH r AS (SELECT date, close / lag(close) OVER ({D}) - 1 AS step FROM daily), d AS (SELECT date, avg(step) AS step, count(*) AS names FROM r WHERE step IS NOT NULL GROUP BY 1)
SELECT @D(date) AS date, @R(step) AS step, names, @R(sum(ln(1 + step)) OVER (ORDER BY date)) AS log_level FROM d""")
def _(m):
    return G.basket_index(m.daily())


@query("eligible_universe_return", "2.4.20", """
WITH d AS (SELECT symbol, date, close, lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) AS x, lead(date, 5) OVER (PARTITION BY symbol ORDER BY date) AS xd FROM daily),
s AS (SELECT symbol, min(start) AS a, max(start) AS b FROM spells GROUP BY 1)
SELECT @D(d.date) AS date, count(*) AS names, @R(avg(x / close - 1)) AS mean_return FROM d JOIN s USING (symbol) WHERE d.date >= a AND d.date < b AND x IS NOT NULL GROUP BY d.date""")
def _(m):
    d = m.daily().withColumn("x", W.lead("close", W.DAY, "date", 5))
    span = m.spells().groupBy("symbol").agg(F.min("start").alias("start"), F.max("start").alias("end"))
    from tidemark.operators.joins import interval_join
    return interval_join(d.filter("x is not null"), span, ["symbol"], "date").groupBy("date").agg(
        F.count(F.lit(1)).alias("names"), F.avg(F.col("x") / F.col("close") - 1).alias("mean_return"))


@query("minute_volume", "2.4.21", """
SELECT symbol, @T(date_trunc('minute', ts)) AS ts, @I(sum(size)) AS volume FROM ticks GROUP BY 1, date_trunc('minute', ts)""")
def _(m):
    return bars.minute_volume(m.ticks())


@query("aggressor_share", "2.4.21", """
SELECT symbol, @I(sum(CASE WHEN market = 'purchase' THEN size ELSE 0 END)) AS buy_volume, @I(sum(CASE WHEN market = 'signup' THEN size ELSE 0 END)) AS sell_volume,
 @I(sum(size)) AS total_volume, @R(sum(CASE WHEN market = 'purchase' THEN size ELSE 0 END) / nullif(sum(CASE WHEN market IN ('purchase', 'signup') THEN size ELSE 0 END), 0)) AS buy_share FROM ticks GROUP BY 1""")
def _(m):
    side = F.when(F.col("market") == "purchase", "B").when(F.col("market") == "signup", "A").otherwise("N")
    return bars.aggressor_share(m.ticks().withColumn("side", side), ["symbol"])


@query("spread_distribution", "2.4.23 2.20.95", """
WITH q AS (SELECT *, CASE WHEN seq % 13 = 0 THEN ask * 1.01::DOUBLE WHEN seq % 17 = 0 THEN 0 ELSE bid END AS b, minute // 30 * 30 AS block FROM quotes JOIN (SELECT seq, minute FROM ticks) USING (seq)),
r AS (SELECT *, CASE WHEN NOT (b > 0 AND ask > 0) THEN 'one_sided' WHEN ask < b THEN 'crossed' WHEN (ask - b) / b > 0.5 THEN 'wide' ELSE 'ok' END AS reason FROM q)
SELECT @I(block) AS block, count(*) AS n, @R(quantile_cont(ask - b, 0.1)) AS p10, @R(quantile_cont(ask - b, 0.5)) AS p50, @R(quantile_cont(ask - b, 0.9)) AS p90,
 @R(quantile_cont(ask - b, 0.99)) AS p99 FROM r WHERE reason = 'ok' GROUP BY block""")
def _(m):
    k = F.col("seq")
    q = m.quotes().withColumn("minute", clock.minute_of_day("ts")).withColumn("block", (F.floor(F.col("minute") / 30) * 30).cast("int"))
    q = q.withColumn("bid", F.when(k % 13 == 0, F.col("ask") * 1.01).when(k % 17 == 0, 0.0).otherwise(F.col("bid")))
    return G.spread_percentiles(q)


@query("spread_rejects", "2.4.23", """
WITH q AS (SELECT *, CASE WHEN seq % 13 = 0 THEN ask * 1.01::DOUBLE WHEN seq % 17 = 0 THEN 0 ELSE bid END AS b FROM quotes)
SELECT CASE WHEN NOT (b > 0 AND ask > 0) THEN 'one_sided' WHEN ask < b THEN 'crossed' WHEN (ask - b) / b > 0.5 THEN 'wide' ELSE 'ok' END AS reason, count(*) AS n FROM q GROUP BY 1""")
def _(m):
    k = F.col("seq")
    q = m.quotes().withColumn("bid", F.when(k % 13 == 0, F.col("ask") * 1.01).when(k % 17 == 0, 0.0).otherwise(F.col("bid")))
    return G.spread_distribution(q).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---- clock and scalar functions (2.9)

@query("eastern_clock", "2.9.1 2.9.2", """
SELECT @I(seq) AS seq, @D(session_date) AS session_date, @I(minute) AS minute, printf('%02d:%02d', minute // 60, minute % 60) AS hhmm,
 CASE WHEN minute < 570 THEN 'PRE' WHEN minute < 960 THEN 'RTH' ELSE 'POST' END AS block, printf('%02d:%02d', minute // 30 * 30 // 60, minute // 30 * 30 % 60) AS half_hour FROM ticks""")
def _(m):
    k = F.col("minute")
    return m.ticks().select("seq", "session_date", "minute", clock.hhmm(k).alias("hhmm"), clock.session_block(k).alias("block"),
                            clock.half_hour_block(k).alias("half_hour"))


view("all_days", """SELECT CAST(d AS DATE) AS date, year(d) AS y, month(d) AS mo, day(d) AS dd, dayofweek(d) AS dow FROM
 (SELECT unnest(range(CAST((SELECT min(o_orderdate) FROM orders) AS TIMESTAMP), CAST((SELECT max(o_orderdate) FROM orders) AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d)""")
view("holidays", """WITH e AS (SELECT *, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM all_days), e2 AS (SELECT *, (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30 AS h FROM e),
  e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2), e4 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM e3),
  e5 AS (SELECT *, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS easter FROM e4),
  f AS (SELECT *, unnest([make_date(y, 1, 1), make_date(y + 1, 1, 1), make_date(y, 7, 4), make_date(y, 12, 25)]) AS fixed FROM e5),
  o AS (SELECT DISTINCT CASE dayofweek(fixed) WHEN 0 THEN fixed + 1 WHEN 6 THEN fixed - 1 ELSE fixed END AS date FROM f)
  SELECT e5.date, dow, mo, dd, coalesce(dow BETWEEN 1 AND 5 AND (o.date IS NOT NULL OR (mo = 1 AND dow = 1 AND dd BETWEEN 15 AND 21) OR (mo = 2 AND dow = 1 AND dd BETWEEN 15 AND 21)
    OR e5.date = easter - 2 OR (mo = 5 AND dow = 1 AND dd >= 25) OR (mo = 9 AND dow = 1 AND dd <= 7) OR (mo = 11 AND dow = 4 AND dd BETWEEN 22 AND 28)
    OR strftime(e5.date, '%Y-%m-%d') IN ('2001-09-11', '2001-09-12', '2001-09-13', '2001-09-14')), false) AS holiday FROM e5 LEFT JOIN o ON o.date = e5.date""")


def order_days(m):
    lo = m.table("orders").agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    return lo.select(F.explode(F.sequence("lo", "hi")).alias("date"))


@query("trading_calendar", "2.9.17 2.9.3", """
SELECT @D(date) AS date, @I(holiday) AS holiday, @I(early) AS early_close, @I(dow BETWEEN 1 AND 5 AND NOT holiday) AS session, CASE WHEN early THEN 780 ELSE 960 END AS close_minute,
 CASE WHEN early THEN 775 ELSE 955 END AS flat_minute FROM (SELECT *, NOT holiday AND ((mo = 11 AND dow = 5 AND dd BETWEEN 23 AND 29) OR (dow BETWEEN 1 AND 4 AND ((mo = 7 AND dd = 3) OR (mo = 12 AND dd = 24)))) AS early FROM holidays)""")
def _(m):
    early = F.col("early_close")
    return K.with_holidays(order_days(m)).select(
        "date", "holiday", "early_close", "session", clock.regular_close_minute(early).alias("close_minute"), clock.flat_minute(early).alias("flat_minute"))


@query("dst_transitions", "2.9.17", """
WITH o AS (SELECT date, CAST(date_diff('hour', CAST(date AS TIMESTAMP) + INTERVAL 12 HOUR, ((CAST(date AS TIMESTAMP) + INTERVAL 12 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS BIGINT) AS "offset" FROM all_days)
SELECT @D(date) AS date, "offset" FROM o QUALIFY "offset" <> lag("offset") OVER (ORDER BY date)""")
def _(m):
    return K.dst_transitions(order_days(m))


@query("weekly_event_calendar", "2.1.16", """
SELECT @D(wk + 2 + late) AS date, late AS delayed FROM (SELECT CAST(date_trunc('week', date) AS DATE) AS wk, max(CASE WHEN dow BETWEEN 1 AND 3 AND holiday THEN 1 ELSE 0 END) AS late FROM holidays GROUP BY 1)""")
def _(m):
    return K.weekly_events(order_days(m), 4)


@query("exchange_open", "2.9.18", """
SELECT @I(CASE WHEN dow = 6 THEN false WHEN dow = 0 THEN mi >= 1080 WHEN dow = 5 THEN mi < 1020 ELSE mi < 1020 OR mi >= 1080 END) AS is_open, @I(mi // 60 = 17) AS maintenance, count(*) AS n
FROM (SELECT dayofweek((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS dow, minute AS mi FROM ticks) GROUP BY 1, 2""")
def _(m):
    return m.ticks().groupBy(clock.exchange_open("ts").alias("is_open"), clock.in_maintenance("ts").alias("maintenance")).agg(F.count(F.lit(1)).alias("n"))


@query("tick_rounding", "2.9.4", """
SELECT @I(seq) AS seq, @R(floor(round(px / 0.25, 9) + 0.5) * 0.25) AS nearest, @R(ceil(round(px / 0.25, 9)) * 0.25) AS up, @R(floor(round(px / 0.25, 9)) * 0.25) AS down,
 @I(sign(px - 50) * floor(abs(px - 50) + 0.5)) AS half_away FROM ticks""")
def _(m):
    p = F.col("px")
    return m.ticks().select("seq", P.round_tick(p, 0.25).alias("nearest"), P.round_tick(p, 0.25, "up").alias("up"),
                            P.round_tick(p, 0.25, "down").alias("down"), P.round_half_away(p - 50).alias("half_away"))


@query("price_grid_profile", "2.9.5 2.20.55", """
SELECT @I(d) AS distance, count(*) AS fills, count(*) FILTER (p = d) AS placebo_same FROM (SELECT least(c % 50, 50 - c % 50) AS d, least((c + 25) % 50, 50 - (c + 25) % 50) AS p
 FROM (SELECT CAST(floor(price * 100 + 0.5) AS BIGINT) AS c FROM fills)) GROUP BY d""")
def _(m):
    c = m.fills().withColumn("c", P.to_cents(F.col("price")))
    d = c.select(P.grid_distance(F.col("c"), 50).alias("distance"), P.grid_distance(F.col("c"), 50, 25).alias("placebo"))
    return d.groupBy("distance").agg(F.count(F.lit(1)).alias("fills"), F.count(F.when(F.col("placebo") == F.col("distance"), 1)).alias("placebo_same"))


REG = "(0.000003 * qty + CASE WHEN side = 'SELL' THEN 0.0000206 * qty * price + 0.000195 * qty ELSE 0 END)"
TIER = "least(greatest(0.0035::DOUBLE * qty, 0.35), 0.01 * qty * price)"


@query("commission_schedules", "2.9.6 2.19.6", f"""
SELECT @I(seq) AS seq, @R(least(greatest(0.005::DOUBLE * qty, 1.0), 0.01 * qty * price) + {REG}) AS fixed,
 @R({TIER} * (1 + 0.000175::DOUBLE + 0.000563) + CASE WHEN price >= 1 THEN 0.003 * qty ELSE 0.003 * qty * price END + 0.0002 * qty + {REG}) AS tiered,
 @R({TIER} * (1 + 0.000175::DOUBLE + 0.000563) + CASE WHEN price >= 1 THEN -0.0013 * qty ELSE 0 END + 0.0002 * qty + {REG}) AS tiered_adding,
 @R(CASE WHEN price >= 1 AND minute >= 420 AND minute < 1200 THEN 0 WHEN price < 1 THEN least(greatest(0.005::DOUBLE * qty, 0.99), 7.95) ELSE 0.005 * qty END - 0.0032 * qty
   + CASE WHEN side = 'SELL' THEN 0.000166 * qty ELSE 0 END) AS zero_passive FROM fills""")
def _(m):
    q, p, s = F.col("qty"), F.col("price"), F.col("side") == "SELL"
    return m.fills().select("seq", C.order_cost(q, p, s, "fixed").alias("fixed"), C.order_cost(q, p, s, "tiered").alias("tiered"),
                            C.order_cost(q, p, s, "tiered", False).alias("tiered_adding"),
                            C.order_cost(q, p, s, "zero", False, F.col("minute")).alias("zero_passive"))


@query("plan_crossover", "2.9.7", """
WITH p AS (SELECT DISTINCT CAST(floor(price) AS DOUBLE) AS price FROM fills), g AS (SELECT price, unnest(range(1, 2001)) AS qty FROM p),
c AS (SELECT *, least(greatest(0.005::DOUBLE * qty, 1.0), 0.01 * qty * price) AS f, least(greatest(0.0035::DOUBLE * qty, 0.35), 0.01 * qty * price) * (1 + 0.000175::DOUBLE + 0.000563) + 0.003 * qty + 0.0002 * qty AS t FROM g),
s AS (SELECT *, f <= t AS cheaper, lag(f <= t) OVER (PARTITION BY price ORDER BY qty) AS prev FROM c)
SELECT @R(price) AS price, @I(min(qty) FILTER (cheaper AND NOT prev)) AS crossover FROM s GROUP BY price""")
def _(m):
    prices = m.fills().select(F.floor("price").cast("double").alias("price")).distinct()
    grid = prices.withColumn("qty", F.explode(F.sequence(F.lit(1), F.lit(2000))))
    q, p = F.col("qty"), F.col("price")
    cheaper = C.round_trip_cost(q, p, "fixed") <= C.round_trip_cost(q, p, "tiered")
    w = Window.partitionBy("price").orderBy("qty")
    g = grid.withColumn("cheaper", cheaper).withColumn("prev", F.lag("cheaper").over(w))
    return g.groupBy("price").agg(F.min(F.when(F.expr("cheaper and not prev"), F.col("qty"))).alias("crossover"))  # NULL: none within 2,000 shares


@query("futures_costs", "2.9.8 2.20.152", """
SELECT @I(trade_id) AS trade_id, @R((exit_px - entry_px) * 5 * 2) AS gross_usd, @R((exit_px - entry_px) * 5 * 2 - 2 * 2 * (0.62 + 1 * 1.25)) AS net_usd FROM ledger""")
def _(m):
    side = C.futures_side_cost(F.lit(0.62), F.lit(1), F.lit(1.25))
    gross = C.futures_pnl(F.lit(1), F.col("entry_px"), F.col("exit_px"), F.lit(5.0), F.lit(2))
    return m.ledger().select("trade_id", gross.alias("gross_usd"), (gross - 2 * 2 * side).alias("net_usd"))


@query("friction_and_financing", "2.9.9", """
SELECT @I(trade_id) AS trade_id, @R((entry_px * qty * 4 + exit_px * qty * 6 * CASE WHEN net < 0 THEN 1.5 ELSE 1 END) / 10000) AS friction,
 @R(entry_px * qty * 0.5 * 0.0713 / 365 * (exit_date - session_date)) AS financing FROM ledger""")
def _(m):
    a, b = F.col("entry_px") * F.col("qty"), F.col("exit_px") * F.col("qty")
    return m.ledger().select("trade_id", C.bps_friction(a, b, F.lit(4.0), F.lit(6.0), F.col("net") < 0).alias("friction"),
                             C.financing(a, F.datediff("exit_date", "session_date")).alias("financing"))


@query("position_size", "2.9.10", """
SELECT @I(trade_id) AS trade_id, @I(floor(least(1000, 25000 * 0.25 / entry_px))) AS shares, @I(greatest(1, least(1000, floor(100 / abs(entry_px - entry_px * 0.95::DOUBLE))))) AS equal_risk FROM ledger""")
def _(m):
    e = F.col("entry_px")
    return m.ledger().select("trade_id", C.size_for(e, F.lit(25000.0)).alias("shares"), C.equal_risk_size(e, e * 0.95).alias("equal_risk"))


HEADS = """CASE doc_id % 8 WHEN 0 THEN 'Acme announces 1‑For‑12 reverse split' WHEN 1 THEN 'Acme prices $5M registered direct offering priced at-the-market under Nasdaq rules'
 WHEN 2 THEN 'Acme launches proposed public offering' WHEN 3 THEN 'Acme enters ATM program' WHEN 4 THEN 'Acme regained compliance with Nasdaq minimum bid' WHEN 5 THEN 'Nasdaq notice: minimum bid deficiency'
 WHEN 6 THEN 'Acme warrant inducement &amp; exercise' ELSE '' END || ' ' || text"""


@query("headline_labels", "2.9.11", f"""
WITH h AS (SELECT doc_id, regexp_replace(replace(replace({HEADS}, '&amp;', '&'), '&#39;', ''''), '[‐‑‒–—−]', '-', 'g') AS t FROM documents),
m AS (SELECT doc_id, replace(replace(t, 'priced at-the-market', '@'), 'at-the-market under', '@') AS u, t FROM h)
SELECT doc_id, CASE WHEN regexp_matches(t, '\\bbundle offering\\b|regained compliance', 'i') THEN NULL
 WHEN regexp_matches(t, 'reverse (stock |share )?split|\\b1[- ]for[- ]\\d{{1,3}}\\b|share consolidation', 'i') THEN 'REVERSE_SPLIT'
 WHEN regexp_matches(u, 'at[- ]the[- ]market|\\bATM (offering|program|facility)', 'i') THEN 'ATM'
 WHEN regexp_matches(t, '(proposed|intends? to offer|launch(es)?).{{0,60}}(offering|private placement)', 'i') THEN 'OFFERING_PROPOSED'
 WHEN regexp_matches(t, '(announces?|prices?|priced|pricing of|closes?|closing of).{{0,80}}(offering|registered direct|private placement|PIPE\\b)', 'i') THEN 'OFFERING_PRICED'
 WHEN regexp_matches(t, 'warrant (inducement|exercise|amendment|repricing)|inducement (letter|agreement)', 'i') THEN 'WARRANT'
 WHEN regexp_matches(t, '(nasdaq|nyse).{{0,60}}(deficiency|non-?compliance|delist|minimum bid)', 'i') THEN 'DELIST_NOTICE' END AS label FROM m""")
def _(m):
    k = F.col("doc_id") % 8
    heads = ["Acme announces 1‑For‑12 reverse split", "Acme prices $5M registered direct offering priced at-the-market under Nasdaq rules",
             "Acme launches proposed public offering", "Acme enters ATM program", "Acme regained compliance with Nasdaq minimum bid",
             "Nasdaq notice: minimum bid deficiency", "Acme warrant inducement &amp; exercise", ""]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (k + 1).cast("int"))
    return m.table("documents").select("doc_id", X.headline_label(F.concat(head, F.lit(" "), F.col("text"))).alias("label"))


@query("filing_labels", "2.9.12", """
WITH f AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '8-K' WHEN 1 THEN '424B3' WHEN 2 THEN 'S-3' WHEN 3 THEN 'DEF 14A' WHEN 4 THEN '8-K/A' ELSE '10-Q' END AS form,
  CASE o_orderkey % 7 WHEN 0 THEN '1.01,3.02,5.03' WHEN 1 THEN '3.01' WHEN 2 THEN '5.03 ' WHEN 3 THEN ' 3.02' END AS items FROM orders),
p AS (SELECT *, list_transform(string_split(coalesce(items, ''), ','), lambda x: trim(x)) AS parts FROM f)
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN form = '424B3' THEN 'ACTIVE_SHELF_CANDIDATE' END, CASE WHEN form = 'DEF 14A' THEN 'PROPOSED_RS_CANDIDATE' END,
 CASE WHEN form = 'S-3' OR (starts_with(form, '8-K') AND list_has_any(parts, ['1.01', '3.02'])) THEN 'TRIGGER_A' END,
 CASE WHEN starts_with(form, '8-K') AND list_contains(parts, '5.03') THEN 'TRIGGER_B' END], lambda x: x IS NOT NULL), ',') AS labels FROM p""")
def _(m):
    o = m.table("orders")
    a, b = F.col("o_orderkey") % 6, F.col("o_orderkey") % 7
    form = F.when(a == 0, "8-K").when(a == 1, "424B3").when(a == 2, "S-3").when(a == 3, "DEF 14A").when(a == 4, "8-K/A").otherwise("10-Q")
    items = F.when(b == 0, "1.01,3.02,5.03").when(b == 1, "3.01").when(b == 2, "5.03 ").when(b == 3, " 3.02")
    return o.select("o_orderkey", F.array_join(X.filing_labels(form, items), ",").alias("labels"))


@query("mixed_stamps", "2.9.13", """
SELECT @I(seq) AS seq, strftime(timezone('UTC', timezone('America/New_York', date_trunc('second', ts))), '%Y-%m-%d %H:%M:%S') AS edgar, @T(ts) AS utc, @T(ts) AS report, @T(ts) AS chart FROM ticks""")
def _(m):
    t = m.ticks()
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    rep = F.when(F.col("seq") % 2 == 0, F.date_format("ts", "yyyyMMdd;HHmmss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    chart = F.when(F.col("seq") % 3 == 0, F.unix_timestamp("ts").cast("string")).otherwise(F.concat(iso, F.lit("Z")))
    return t.select("seq", X.edgar_stamp(F.concat(iso, F.lit(".000Z"))).alias("edgar"), X.utc_stamp(F.concat(iso, F.lit("Z"))).alias("utc"),
                    X.report_stamp(rep).alias("report"), X.chart_stamp(chart).alias("chart"))


@query("report_zone_resolution", "2.9.14", """
WITH z AS (SELECT unnest(['America/New_York', 'America/Chicago', 'Australia/Sydney', 'UTC']) AS zone), s AS (
 SELECT zone, count(*) AS n, count(*) FILTER (hour((wall AT TIME ZONE zone) AT TIME ZONE 'America/New_York') BETWEEN 4 AND 19 AND CAST((wall AT TIME ZONE zone) AT TIME ZONE 'America/New_York' AS DATE) = session_date) AS fits
 FROM (SELECT session_date, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Sydney' AS wall FROM ticks), z GROUP BY 1)
SELECT zone, n, fits, CAST(row_number() OVER (ORDER BY fits DESC, zone) = 1 AS BIGINT) AS chosen FROM s""")
def _(m):
    from tidemark.operators.quality import zone_scores
    execs = m.ticks().select("session_date", F.from_utc_timestamp("ts", "Australia/Sydney").alias("wall"))
    return zone_scores(execs, ["America/New_York", "America/Chicago", "Australia/Sydney", "UTC"])


@query("symbol_spelling", "2.9.15", """
SELECT p_partkey, regexp_replace(upper(trim(p_name)), '[-/ ]', '.', 'g') AS spelled, len(list_distinct(list_filter(string_split(upper(regexp_replace(p_name, '[^A-Za-z.]+', ' ', 'g')), ' '), lambda w: regexp_full_match(w, '[A-Z]{1,5}(\\.[A-Z])?')))) AS symbols FROM part""")
def _(m):
    return m.table("part").select("p_partkey", X.vendor_symbol(F.col("p_name")).alias("spelled"), F.size(X.watchlist_symbols(F.col("p_name"))).alias("symbols"))


@query("delay_modes", "2.9.16", """
SELECT market, @R(CASE WHEN market = 'view' THEN 900 WHEN market = 'click' THEN 0 END) AS delay, count(*) AS n FROM ticks GROUP BY 1, 2""")
def _(m):
    mode = F.when(F.col("market") == "view", "delayed_streaming_900").when(F.col("market") == "click", "streaming").otherwise("unknown")
    return m.ticks().groupBy("market", X.delay_seconds(mode).cast("double").alias("delay")).agg(F.count(F.lit(1)).alias("n"))


@query("nearest_session", "2.9.19", """
SELECT @I(o_orderkey) AS o_orderkey, @D(CAST(o_orderdate AS DATE)) AS date, @D((SELECT max(date) FROM holidays h WHERE dow BETWEEN 1 AND 5 AND NOT holiday AND h.date <= CAST(o_orderdate AS DATE) AND h.date >= CAST(o_orderdate AS DATE) - 5)) AS session FROM orders""")
def _(m):
    sessions = K.with_holidays(order_days(m)).filter("session").select("date")
    o = m.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return K.nearest_session(o, sessions).select("o_orderkey", "date", "session")
