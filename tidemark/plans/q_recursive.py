"""Recursive indicators (2.6), checked against recursive SQL."""

from pyspark.sql import functions as F

from tidemark.operators import recursive as R
from tidemark.operators import windows as W
from tidemark.plans.registry import query, view

D = "PARTITION BY symbol ORDER BY date"

view("numbered", f"""SELECT *, row_number() OVER ({D}) AS i, lag(close) OVER ({D}) AS pc FROM daily""")
view("steps", """SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
  greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss FROM numbered""")
view("fold", """SELECT symbol, date, i, close, close AS e9, close AS e12, close AS e21, close AS e26, close AS rma, tr AS atr,
   0::DOUBLE AS macd, 0::DOUBLE AS sig, NULL::DOUBLE AS up, NULL::DOUBLE AS dn FROM steps WHERE i = 1
 UNION ALL
 SELECT s.symbol, s.date, s.i, s.close, s.close * 0.2 + f.e9 * 0.8, s.close * (2/13.0::DOUBLE) + f.e12 * (11/13.0::DOUBLE),
   s.close * (2/22.0::DOUBLE) + f.e21 * (20/22.0::DOUBLE),
   s.close * (2/27.0::DOUBLE) + f.e26 * (25/27.0::DOUBLE), s.close / 14 + f.rma * 13 / 14, s.tr / 14 + f.atr * 13 / 14,
   (s.close * (2/13.0::DOUBLE) + f.e12 * (11/13.0::DOUBLE)) - (s.close * (2/27.0::DOUBLE) + f.e26 * (25/27.0::DOUBLE)),
   ((s.close * (2/13.0::DOUBLE) + f.e12 * (11/13.0::DOUBLE)) - (s.close * (2/27.0::DOUBLE) + f.e26 * (25/27.0::DOUBLE))) * 0.2 + f.sig * 0.8,
   coalesce(s.gain / 14 + f.up * 13 / 14, s.gain), coalesce(s.loss / 14 + f.dn * 13 / 14, s.loss)
 FROM fold f JOIN steps s ON s.symbol = f.symbol AND s.i = f.i + 1""")
view("seeds", """SELECT symbol, max(CASE WHEN n20 = 20 THEN a20 END) AS s20, max(CASE WHEN n14 = 14 THEN a14 END) AS s14, max(CASE WHEN n14 = 14 THEN t14 END) AS t14 FROM (
  SELECT symbol, i, count(*) FILTER (i <= 20) OVER w AS n20, avg(close) FILTER (i <= 20) OVER w AS a20,
   count(*) FILTER (i <= 14) OVER w AS n14, avg(close) FILTER (i <= 14) OVER w AS a14, avg(tr) FILTER (i <= 14) OVER w AS t14
  FROM steps WINDOW w AS (PARTITION BY symbol)) GROUP BY 1""")
view("seed_fold", """SELECT symbol, i, NULL::DOUBLE AS e20, NULL::DOUBLE AS r14, NULL::DOUBLE AS t14 FROM steps WHERE i = 1
 UNION ALL
 SELECT s.symbol, s.i, CASE WHEN s.i = 20 THEN d.s20 WHEN s.i > 20 THEN s.close * (2/21.0::DOUBLE) + f.e20 * (19/21.0::DOUBLE) END,
  CASE WHEN s.i = 14 THEN d.s14 WHEN s.i > 14 THEN s.close / 14 + f.r14 * 13 / 14 END,
  CASE WHEN s.i = 14 THEN d.t14 WHEN s.i > 14 THEN s.tr / 14 + f.t14 * 13 / 14 END
 FROM seed_fold f JOIN steps s ON s.symbol = f.symbol AND s.i = f.i + 1 JOIN seeds d ON d.symbol = s.symbol""")


@query("ema_and_rma", "2.6.1 2.6.3", """
SELECT symbol, @D(date) AS date, @R(e9) AS ema9, @R(e21) AS ema21, @R(rma) AS rma14 FROM fold""", digits=4)
def _(m):
    return R.with_indicators(m.daily(), ["ema9", "ema21", "rma14"]).select("symbol", "date", "ema9", "ema21", "rma14")


@query("seeded_averages", "2.6.2 2.6.3", """
SELECT symbol, @I(i) AS i, @R(e20) AS ema20_seeded, @R(r14) AS rma14_seeded, @R(t14) AS atr14_seeded FROM seed_fold""", digits=4)
def _(m):
    df = R.with_indicators(m.daily(), ["ema20_seeded", "rma14_seeded", "atr14_seeded"])
    i = F.row_number().over(W.Window.partitionBy("symbol").orderBy("date"))
    return df.select("symbol", i.alias("i"), "ema20_seeded", "rma14_seeded", "atr14_seeded")


@query("average_true_range", "2.6.4", "SELECT symbol, @D(date) AS date, @R(atr) AS atr14 FROM fold")
def _(m):
    return R.with_indicators(m.daily(), ["atr14"]).select("symbol", "date", "atr14")


@query("macd_lines", "2.6.5", "SELECT symbol, @D(date) AS date, @R(macd) AS macd, @R(sig) AS macd_signal, @R(macd - sig) AS histogram FROM fold")
def _(m):
    return R.with_indicators(m.daily(), ["macd", "macd_signal"]).select(
        "symbol", "date", "macd", "macd_signal", (F.col("macd") - F.col("macd_signal")).alias("histogram"))


@query("rsi", "2.6.6", """SELECT symbol, @D(date) AS date,
 @R(CASE WHEN dn IS NULL OR dn = 0 THEN 100 ELSE 100 - 100 / (1 + up / dn) END) AS rsi14 FROM fold""")
def _(m):
    return R.with_indicators(m.daily(), ["rsi14"]).select("symbol", "date", "rsi14")


@query("macd_crosses", "2.6.8", f"""
WITH x AS (SELECT *, lag(round(macd, 9)) OVER ({D}) AS m1, lag(round(sig, 9)) OVER ({D}) AS s1 FROM fold),
c AS (SELECT *, coalesce(m1 <= s1 AND round(macd, 9) > round(sig, 9), false) AS cu, coalesce(m1 >= s1 AND round(macd, 9) < round(sig, 9), false) AS cd,
  coalesce(round(e9, 9) > round(e21, 9), false) AS conf FROM x)
SELECT symbol, @D(date) AS date, @I(cu) AS crossed_up, @I(cd) AS crossed_down,
 strftime(min(CASE WHEN conf THEN date END) OVER ({D} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), '%Y-%m-%d') AS confirmed_at FROM c""")
def _(m):
    df = R.with_indicators(m.daily(), ["macd", "macd_signal", "ema9", "ema21"])
    for c in ("macd", "macd_signal", "ema9", "ema21"):
        df = df.withColumn(c, F.round(c, 9))
    df = df.withColumn("crossed_up", R.cross_up("macd", "macd_signal")).withColumn(
        "crossed_down", R.cross_down("macd", "macd_signal")).withColumn("conf", F.col("ema9") > F.col("ema21"))
    return R.confirmation_bar(df, "conf", 5).select("symbol", "date", "crossed_up", "crossed_down", "confirmed_at")


view("session_numbered", """SELECT *, row_number() OVER w AS i, lag(close) OVER w AS pc,
  sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w AS vwap, sum(close * volume) OVER w AS dollars
  FROM bars5 WINDOW w AS (PARTITION BY symbol, session_date ORDER BY ts)""")
view("session_fold", """SELECT symbol, session_date, ts, i, close, vwap, dollars, close AS e9, high - low AS atr FROM session_numbered WHERE i = 1
 UNION ALL SELECT s.symbol, s.session_date, s.ts, s.i, s.close, s.vwap, s.dollars, s.close * 0.2 + f.e9 * 0.8,
  greatest(s.high - s.low, abs(s.high - s.pc), abs(s.low - s.pc)) / 14 + f.atr * 13 / 14
 FROM session_fold f JOIN session_numbered s ON s.symbol = f.symbol AND s.session_date = f.session_date AND s.i = f.i + 1""")


@query("session_indicators", "2.6.9 2.2.22", """
SELECT symbol, @T(ts) AS ts, @R(e9) AS ema9, @R(atr) AS atr14, @R(vwap) AS vwap, @I(i >= 5 AND dollars >= 10000) AS mature,
 CASE WHEN NOT (i >= 5 AND dollars >= 10000) THEN NULL WHEN close <= vwap THEN 'BEARISH' WHEN close > e9 THEN 'STRONG' ELSE 'WEAK_BULL' END AS regime
FROM session_fold""")
def _(m):
    return R.session_indicators(m.bars()).select("symbol", "ts", "ema9", "atr14", "vwap", "mature", "regime")


@query("ew_variance", "2.5.30", f"""
WITH n AS (SELECT *, row_number() OVER ({D}) - 1 AS k FROM (SELECT *, close / lag(close) OVER ({D}) - 1 AS r FROM daily)),
l AS (SELECT symbol, date, k, list(struct_pack(k := k, r := r)) OVER ({D} ROWS UNBOUNDED PRECEDING) AS h FROM n),
v AS (SELECT symbol, date, k, list_filter(h, lambda x: x.k >= 1) AS h FROM l WHERE k >= 1),
s AS (SELECT symbol, date, k, list_sum(list_transform(h, lambda x: pow(60/61.0::DOUBLE, k - x.k))) AS w,
  list_sum(list_transform(h, lambda x: pow(60/61.0::DOUBLE, k - x.k) * x.r)) AS wr,
  list_sum(list_transform(h, lambda x: pow(60/61.0::DOUBLE, k - x.k) * x.r * x.r)) AS wrr FROM v),
f AS (SELECT n.symbol, n.date, CASE WHEN s.k >= 61 THEN (wrr / w - (wr / w) * (wr / w)) * 261 END AS var FROM n LEFT JOIN s USING (symbol, date))
SELECT symbol, @D(date) AS date, @R(lag(var) OVER ({D})) AS ew_var, @R(sqrt(lag(var) OVER ({D}))) AS ex_ante_vol FROM f""", digits=2)
def _(m):
    return R.ew_variance(m.daily(), need=61).select("symbol", "date", "ew_var", "ex_ante_vol")
