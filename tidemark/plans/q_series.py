"""Sessions, splits and futures series (2.10), the scaled book (2.14.8) and data quality (2.17)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import bars, calendar as K, quality as Q, rollups as G, screen as S, series as Y, signals as X, windows as W
from tidemark.plans.q_bars import order_days
from tidemark.plans.q_screen import calendar, screen_list, session_closes
from tidemark.plans.registry import query, view
from tidemark.session import staged

D = "PARTITION BY symbol ORDER BY date"


@query("session_validity", "2.10.1", """
WITH g AS (SELECT *, CASE WHEN minute <= 630 THEN minute - lag(minute) OVER (PARTITION BY symbol, session_date ORDER BY ts) END AS g FROM bars5 WHERE minute >= 570 AND minute < 960)
SELECT symbol, @D(session_date) AS session_date, @I(min(minute)) AS first_minute, @I(coalesce(max(g), 0)) AS widest_gap, @I(min(minute) = 570 AND coalesce(max(g), 0) <= 60) AS valid FROM g GROUP BY 1, session_date""")
def _(m):
    return Y.session_validity(m.bars(), max_gap=60)


@query("session_windows", "2.10.2", """
WITH h AS (SELECT session_date, dayofweek(session_date) = 3 AS early FROM (SELECT DISTINCT session_date FROM bars5)) SELECT symbol, @D(session_date) AS session_date, count(*) AS bars FROM bars5 JOIN h USING (session_date)
WHERE minute >= 540 AND minute < CASE WHEN early THEN 780 ELSE 960 END + 30 GROUP BY 1, session_date""")
def _(m):
    b = m.bars()
    cal = b.select(F.col("session_date").alias("date")).distinct().withColumn("early_close", F.dayofweek("date") == 4)
    return Y.session_window(b, cal, 30).groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("bars"))


READ = ["last_before", "first_after", "largest_near", "last_of_day", "mean_half_hour"]
view("readings", """SELECT market AS symbol, session_date, last(px ORDER BY ts, seq) FILTER (minute < 960) AS last_before, first(px ORDER BY ts, seq) FILTER (minute >= 960) AS first_after,
 last(px ORDER BY size, ts, seq) FILTER (minute BETWEEN 930 AND 990) AS largest_near, last(px ORDER BY ts, seq) AS last_of_day, avg(px) FILTER (minute BETWEEN 930 AND 959) AS mean_half_hour FROM ticks GROUP BY 1, 2""")


@query("regular_close_readings", "2.10.4 2.20.66 2.20.110", """
SELECT symbol, @D(session_date) AS session_date, @R(last_before) AS last_before, @R(first_after) AS first_after, @R(largest_near) AS largest_near, @R(last_of_day) AS last_of_day, @R(mean_half_hour) AS mean_half_hour FROM readings""")
def _(m):
    return Y.regular_close_readings(m.market_ticks())


@query("regular_close_scores", "2.10.4", """
WITH j AS (SELECT r.*, c AS truth FROM readings r JOIN (SELECT symbol, session_date, last(close ORDER BY ts) AS c FROM bars5 WHERE minute < 960 GROUP BY 1, 2) USING (symbol, session_date)),
d AS (SELECT * FROM j WHERE greatest(last_before, first_after, largest_near, last_of_day, mean_half_hour) - least(last_before, first_after, largest_near, last_of_day, mean_half_hour) > 0.005),
u AS (SELECT unnest(['last_before', 'first_after', 'largest_near', 'last_of_day', 'mean_half_hour']) AS reading, unnest([last_before, first_after, largest_near, last_of_day, mean_half_hour]) AS v, truth FROM d)
SELECT reading, count(v) AS n, @R(avg(CAST(abs(v - truth) <= 0.005 AS INT))) AS hit_rate FROM u GROUP BY 1""")
def _(m):
    truth = m.bars().filter("minute < 960").groupBy("symbol", "session_date").agg(F.max_by("close", "ts").alias("truth"))
    return Y.score_readings(Y.regular_close_readings(m.market_ticks()), truth, READ)


view("planted", f"""SELECT symbol, date, CASE WHEN k < n // 2 THEN 100 * 4 ELSE 100 END + k % 7 / 10.0::DOUBLE AS close, CASE WHEN k < n // 2 THEN 1000 ELSE 4000 END + k % 5 AS volume FROM (SELECT *, row_number() OVER ({D}) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM daily)""")


def planted(m):
    k = F.row_number().over(Window.partitionBy("symbol").orderBy("date"))
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    d = m.daily().withColumn("k", k).withColumn("n", n)
    early = F.col("k") < F.floor(F.col("n") / 2)
    return d.select("symbol", "date", (F.when(early, 400).otherwise(100) + F.col("k") % 7 / 10).alias("close"), (F.when(early, 1000).otherwise(4000) + F.col("k") % 5).alias("volume"))


@query("split_back_adjustment", "2.10.5", f"""
WITH r AS (SELECT *, lag(close) OVER ({D}) / close AS p, volume / lag(volume) OVER ({D}) AS v FROM planted), f AS (SELECT unnest([0.1, 0.125, 1/6.0, 0.2, 0.25, 1/3.0, 0.5, 2, 3, 4, 5, 6, 8, 10]::DOUBLE[]) AS f),
h AS (SELECT symbol, date, arg_min(f, abs(p / f - 1)) AS factor FROM r, f WHERE abs(p / f - 1) * 100 <= 3 AND abs(v / f - 1) * 100 <= 25 GROUP BY 1, 2),
s AS (SELECT r.*, factor, exp(coalesce(sum(ln(factor)) OVER ({D} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS scale FROM r LEFT JOIN h USING (symbol, date))
SELECT symbol, @D(date) AS date, @R(factor) AS factor, @R(close / scale) AS adj_close, @R(volume * scale) AS adj_volume FROM s""")
def _(m):
    return Y.adjust_splits(Y.detect_splits(planted(m))).select("symbol", "date", "factor", "adj_close", "adj_volume")


@query("cross_source_ratio_steps", "2.10.6", f"""
WITH r AS (SELECT a.symbol, a.date, round(a.close / CASE WHEN a.date >= DATE '1999-01-01' THEN a.close * 2 WHEN a.volume % 40 = 0 THEN a.close * 1.5 ELSE a.close END, 9) AS ratio FROM daily a),
s AS (SELECT *, round(ratio / lag(ratio) OVER ({D}), 9) AS mv FROM r), t AS (SELECT *, coalesce(abs(ln(mv)) > 0.2, false) AS step, CASE WHEN coalesce(abs(ln(mv)) > 0.2, false) THEN sign(ln(mv)) END AS sg FROM s),
u AS (SELECT *, CASE WHEN NOT step THEN 'none' WHEN coalesce(sg * min(sg) OVER fw < 0, false) OR coalesce(sg * max(sg) OVER fw < 0, false) OR coalesce(sg * min(sg) OVER bw < 0, false) OR coalesce(sg * max(sg) OVER bw < 0, false) THEN 'reversed' ELSE 'split' END AS kind FROM t
  WINDOW fw AS ({D} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), bw AS ({D} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)), v AS (SELECT *, sum(CAST(kind = 'split' AS INT)) OVER ({D}) AS seg FROM u)
SELECT symbol, @D(date) AS date, @R(ratio) AS ratio, kind, @I(seg) AS segment, @I(abs(ratio / quantile_cont(ratio, 0.5) OVER (PARTITION BY symbol, seg) - 1) > 0.05) AS bad_session FROM v""")
def _(m):
    d = m.daily()
    other = d.withColumn("close", F.when(F.col("date") >= F.lit("1999-01-01").cast("date"), F.col("close") * 2).when(F.col("volume") % 40 == 0, F.col("close") * 1.5).otherwise(F.col("close")))
    return Y.ratio_steps(d, other).select("symbol", "date", "ratio", "kind", "segment", "bad_session")


view("contracts", """SELECT DISTINCT symbol AS root, symbol || '-' || CAST(year(date) * 10 + quarter(date) AS VARCHAR) AS contract, CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH AS DATE) AS expiry FROM daily""")
view("rolls", """WITH a AS (SELECT root, contract, expiry, min(ordinal) AS k FROM contracts JOIN calendar_days ON date >= expiry GROUP BY 1, 2, 3) SELECT root, contract, expiry, date AS roll FROM a JOIN calendar_days c ON c.ordinal = a.k - 5""")


def root_days(m):
    """(root, date, close, volume), computed once for all that is read from it."""
    return staged(m.daily().select(F.col("symbol").alias("root"), "date", "close", "volume"))


def contracts(d):
    q = F.year("date") * 10 + F.quarter("date")
    return d.select("root", F.concat_ws("-", "root", q.cast("string")).alias("contract"), F.add_months(F.trunc("date", "quarter"), 3).alias("expiry")).distinct()


@query("contract_definitions", "2.1.5 2.10.7", "SELECT root, contract, @D(expiry) AS expiry, @D(roll) AS roll FROM rolls")
def _(m):
    return Y.roll_schedule(contracts(m.daily().select(F.col("symbol").alias("root"), "date")), calendar(m))


view("held", """SELECT d.symbol AS root, d.date, r.contract FROM (SELECT DISTINCT symbol, date FROM daily) d ASOF JOIN rolls r ON d.symbol = r.root AND d.date < r.roll""")


def held(m, d):
    return Y.held_contract(Y.roll_schedule(contracts(d), calendar(m)), d.select("root", "date")).filter("contract is not null").drop("until")


@query("held_contract", "2.10.8", "SELECT root, @D(date) AS date, contract FROM held")
def _(m):
    return held(m, root_days(m).select("root", "date"))


# The next quarter's contract trades one percent above the front one per quarter of distance.
view("contract_px", """SELECT d.symbol AS root, c.contract, d.date, d.close * (1 + 0.01::DOUBLE * (year(c.expiry) * 4 + quarter(c.expiry) - year(d.date) * 4 - quarter(d.date))) AS close, d.volume // (1 + year(c.expiry) * 4 + quarter(c.expiry) - year(d.date) * 4 - quarter(d.date)) AS volume
 FROM daily d JOIN contracts c ON c.root = d.symbol AND d.date < c.expiry AND year(c.expiry) * 4 + quarter(c.expiry) - year(d.date) * 4 - quarter(d.date) <= 2 WHERE d.volume % 17 <> 0""")


def contract_px(d):
    quarter = lambda d: F.year(d) * 4 + F.quarter(d)
    # The contract of a quarter expires as the next one begins, so a day has prices of its own quarter's
    # contract and, if its root trades in the next quarter too, of that one's; both by one pass a root.
    q = quarter("date")
    next_one = F.count(F.lit(1)).over(Window.partitionBy("root").orderBy("__q").rangeBetween(1, 1)) > 0
    d = d.withColumn("__q", q).withColumn("ahead", F.when(next_one, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    d = d.filter("volume % 17 <> 0").withColumn("ahead", F.explode("ahead"))
    of = F.add_months("date", 3 * (F.col("ahead") - 1))
    name = F.concat_ws("-", "root", (F.year(of) * 10 + F.quarter(of)).cast("string"))
    return d.select("root", name.alias("contract"), "date", (F.col("close") * (1 + 0.01 * F.col("ahead"))).alias("close"), F.floor(F.col("volume") / (1 + F.col("ahead"))).alias("volume"))


view("held_series", """WITH h AS (SELECT h.*, p.close AS px FROM held h LEFT JOIN contract_px p USING (root, contract, date)), r AS (SELECT *, last_value(px IGNORE NULLS) OVER (PARTITION BY root, contract ORDER BY date ROWS UNBOUNDED PRECEDING) AS raw FROM h),
 l AS (SELECT *, lag(contract) OVER w AS pc, lag(raw) OVER w AS pr, lag(date) OVER w AS pd FROM r WINDOW w AS (PARTITION BY root ORDER BY date)), e AS (SELECT l.*, p.close AS eve FROM l LEFT JOIN contract_px p ON p.root = l.root AND p.contract = l.contract AND p.date = l.pd),
 b AS (SELECT *, coalesce(contract <> pc, false) AS rolled, CASE WHEN coalesce(contract <> pc, false) THEN coalesce(eve, raw) ELSE pr END AS base FROM e),
 g AS (SELECT *, coalesce(raw - base, 0) AS change, CASE WHEN rolled THEN coalesce(base - pr, 0) ELSE 0 END AS gap FROM b)
 SELECT root, date, contract, raw, px IS NULL AS stale, rolled, base, change, gap, raw + coalesce(sum(gap) OVER (PARTITION BY root ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS cont, change / nullif(base, 0) AS ret FROM g""")


def held_rows(m):
    d = root_days(m)
    return Y.held_series(held(m, d), contract_px(d))


@query("held_series", "2.10.9 2.20.96", """
SELECT root, @D(date) AS date, contract, @R(raw) AS raw, @I(stale) AS stale, @I(rolled) AS rolled, @R(base) AS base, @R(change) AS change, @R(gap) AS gap, @R(cont) AS cont, @R(ret) AS ret FROM held_series""", digits=4)
def _(m):
    return held_rows(m).select("root", "date", "contract", "raw", "stale", "rolled", "base", "change", "gap", "cont", "ret")


@query("roll_cross_check", "2.10.10", """
WITH b AS (SELECT root, contract, min(k.ordinal) AS kb FROM (SELECT root, contract, expiry - 7 AS e FROM contracts) c JOIN calendar_days k ON k.date >= c.e GROUP BY 1, 2), a AS (SELECT root, contract, ordinal AS ka FROM rolls JOIN calendar_days ON date = roll)
SELECT root, count(*) AS rolls, count(*) FILTER (abs(ka - kb) > 1) AS off, @R(avg(CAST(abs(ka - kb) > 1 AS INT))) AS share_off FROM a JOIN b USING (root, contract) GROUP BY 1""")
def _(m):
    cal = calendar(m)
    c = contracts(m.daily().select(F.col("symbol").alias("root"), "date"))
    other = Y.roll_schedule(c.withColumn("expiry", F.date_sub("expiry", 7)), cal, 0)
    return Y.roll_check(Y.roll_schedule(c, cal), other, cal)


@query("roll_volume_share", "2.10.11", """
WITH v AS (SELECT root, date, sum(volume) AS rv FROM contract_px GROUP BY 1, 2) SELECT s.root, @D(s.date) AS date, s.contract, @R(coalesce(p.volume, 0) / nullif(rv, 0)) AS share FROM held_series s JOIN v ON v.root = s.root AND v.date = s.date LEFT JOIN contract_px p ON p.root = s.root AND p.date = s.date AND p.contract = s.contract WHERE s.rolled""")
def _(m):
    d = root_days(m)
    return Y.roll_volume_share(Y.with_rolls(held(m, d)), contract_px(d).drop("close"))


@query("roll_legs", "2.10.12", """
WITH c AS (SELECT root, date, sum(CAST(rolled AS INT)) OVER (PARTITION BY root ORDER BY date) AS n FROM held_series), x AS (SELECT root, date, lead(date, 40) OVER w AS exit_date, lead(n, 40) OVER w - n AS legs FROM c WINDOW w AS (PARTITION BY root ORDER BY date))
SELECT root, @D(date) AS entry_date, @D(exit_date) AS exit_date, @I(legs) AS roll_legs FROM x WHERE exit_date IS NOT NULL""")
def _(m):
    return Y.roll_legs(Y.with_rolls(held(m, root_days(m).select("root", "date"))), 40)


view("trend_inputs", """WITH s AS (SELECT *, sign(cont - lag(cont, 60) OVER (PARTITION BY root ORDER BY date)) AS sg, CASE WHEN count(ret) OVER w = 30 THEN stddev_pop(ret) OVER w * sqrt(252) END AS vol FROM held_series WINDOW w AS (PARTITION BY root ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) SELECT * FROM s""")


@query("tranche_book", "2.14.8", """
WITH n AS (SELECT date, count(*) FILTER (sg IS NOT NULL AND vol IS NOT NULL) AS live FROM trend_inputs GROUP BY 1), z AS (SELECT s.*, ordinal, CASE WHEN vol > 0 THEN round(1e6::DOUBLE * 0.1 * sg / nullif(live * raw * vol, 0), 9) END AS x FROM trend_inputs s JOIN n USING (date) JOIN calendar_days USING (date)),
t AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS tr FROM z), u AS (SELECT *, CASE WHEN ordinal % 5 = tr THEN coalesce(sign(x) * floor(abs(x) + 0.5), 0) END AS st FROM t), v AS (SELECT *, coalesce(last_value(st IGNORE NULLS) OVER (PARTITION BY root, tr ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS sz FROM u),
y AS (SELECT *, coalesce(lag(sz) OVER (PARTITION BY root, tr ORDER BY date), 0) AS hs FROM v)
SELECT root, @D(date) AS date, @R(sum(hs * change) / 5) AS pnl, @R(sum(abs(sz - hs) + CASE WHEN rolled THEN 2 * abs(hs) ELSE 0 END) / 5) AS sides, @R(sum(sz) / 5) AS size FROM y GROUP BY root, date""", digits=3)
def _(m):
    w = Window.partitionBy("root").orderBy("date")
    f = w.rowsBetween(-30, -1)
    vol = F.when(F.count("ret").over(f) == 30, F.stddev_pop("ret").over(f) * F.sqrt(F.lit(252.0)))
    s = held_rows(m).withColumn("sg", F.signum(F.col("cont") - F.lag("cont", 60).over(w))).withColumn("vol", vol)
    return Y.tranche_book(s, "sg", "vol", 1e6, sessions=calendar(m))


# ---- quality

@query("outside_membership", "2.17.1", """
SELECT symbol, @D(date) AS date FROM daily d WHERE NOT EXISTS (SELECT 1 FROM spells s WHERE s.symbol = d.symbol AND d.date >= s.start AND (s."end" IS NULL OR d.date < s."end"))""")
def _(m):
    return Q.outside_membership(m.daily().select("symbol", "date"), m.spells(), "date")


@query("prefix_rerun_differences", "2.17.1", "SELECT 0 AS differing, count(*) FILTER (date < DATE '1999-01-01') AS compared FROM daily")
def _(m):
    d = m.daily()
    cut = F.col("date") < F.lit("1999-01-01").cast("date")
    rule = lambda df: W.screen_features(df).select("symbol", "date", "prior_close", "rvol", "gap_pct")
    bad = Q.prefix_differences(rule, d, cut, cut).agg(F.count(F.lit(1)).alias("differing"))
    return bad.join(F.broadcast(d.filter(cut).agg(F.count(F.lit(1)).alias("compared"))), how="cross")


@query("fill_at_printed_price", "2.17.1", "SELECT @I(seq) AS seq FROM (SELECT seq, symbol, session_date, CASE WHEN seq % 50 = 0 THEN price + 0.005 ELSE price END AS p FROM fills) f WHERE NOT EXISTS (SELECT 1 FROM ticks t WHERE t.symbol = f.symbol AND t.session_date = f.session_date AND t.px = f.p)")
def _(m):
    f = m.fills().withColumn("price", F.when(F.col("seq") % 50 == 0, F.col("price") + 0.005).otherwise(F.col("price")))
    return Q.unprinted_fills(f, m.ticks()).select("seq")


@query("leak_control", "2.17.2 2.20.42", """
WITH k AS (SELECT symbol, session_date, CASE WHEN max(size) > 66 THEN 'survivor' ELSE 'reject' END AS population FROM ticks GROUP BY 1, 2), t AS (SELECT symbol, session_date, count(*) AS n, sum(net) AS net FROM ledger GROUP BY 1, 2),
p AS (SELECT population, coalesce(sum(n), 0) / count(*) AS e, sum(net) / sum(n) AS nt FROM k LEFT JOIN t USING (symbol, session_date) GROUP BY 1), g AS (SELECT max(e) FILTER (population = 'survivor') AS s, max(e) FILTER (population = 'reject') AS r, max(nt) FILTER (population = 'survivor') AS sn, max(nt) FILTER (population = 'reject') AS rn FROM p)
SELECT @R(s) AS s, @R(r) AS r, @R(sn) AS sn, @R(rn) AS rn, CASE WHEN s IS NULL OR r IS NULL THEN 'UNKNOWN' WHEN s > 2 * r THEN 'LEAK_RATE' WHEN sn > 0 AND rn <= 0 THEN 'LEAK_QUALITY' ELSE 'CLEAN' END AS verdict FROM g""")
def _(m):
    keys = m.ticks().groupBy("symbol", "session_date").agg(F.when(F.max("size") > 66, "survivor").otherwise("reject").alias("population"))
    return Q.leak_verdict(G.population_measure(m.ledger(), keys))


@query("daily_read_back", "2.17.4", """
WITH a AS (SELECT symbol, session_date AS date, last(close ORDER BY ts) AS a FROM sbars1 GROUP BY 1, 2), b AS (SELECT symbol, date, CASE WHEN CAST(close * 100 AS BIGINT) % 9 = 0 THEN close + 1 ELSE close END AS b FROM session_closes WHERE CAST(close * 100 AS BIGINT) % 11 <> 0)
SELECT symbol, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS "both", count(*) FILTER (a IS NULL) AS missing, @R(avg(CAST(abs(a - b) <= 0.01 + 1e-9 AS INT))) AS agree, @I(avg(CAST(abs(a - b) <= 0.01 + 1e-9 AS INT)) >= 0.9) AS passes FROM a FULL JOIN b USING (symbol, date) GROUP BY 1""")
def _(m):
    rebuilt = m.symbol_bars(1).groupBy("symbol", F.col("session_date").alias("date")).agg(F.max_by("close", "ts").alias("close"))
    cents = F.round(F.col("close") * 100).cast("bigint")
    owned = session_closes(m).filter(cents % 11 != 0).withColumn("close", F.when(cents % 9 == 0, F.col("close") + 1).otherwise(F.col("close")))
    return Q.daily_agreement(rebuilt, owned, 0.01, 0.9)


@query("session_assertions", "2.17.5", """
WITH g AS (SELECT symbol, session_date, count(*) AS bars, count(*) FILTER (high < greatest(open, close) OR low > least(open, close)) AS bad, count(*) FILTER (volume <= 0) AS nov, count(DISTINCT minute) AS mins FROM bars5 GROUP BY 1, 2)
SELECT symbol, @D(session_date) AS session_date, bars, array_to_string(list_filter([CASE WHEN bars < 55 THEN 'short' END, CASE WHEN bad > 0 THEN 'ohlc' END, CASE WHEN nov > 0 THEN 'volume' END, CASE WHEN mins < bars THEN 'duplicate' END], lambda x: x IS NOT NULL), ',') AS failures FROM g WHERE bars < 55 OR bad > 0 OR nov > 0 OR mins < bars""")
def _(m):
    return Q.session_assertions(m.bars(), 55).select("symbol", "session_date", "bars", "failures")


@query("spell_coverage", "2.17.6 2.20.150", """
WITH sp AS (SELECT symbol, min(start) AS start, CASE WHEN CAST(symbol AS BIGINT) % 3 = 0 THEN NULL ELSE max(start) END AS "end" FROM spells GROUP BY 1), v AS (SELECT symbol, min(date) AS f, max(date) AS l, count(*) AS n FROM daily GROUP BY 1)
SELECT symbol, CASE WHEN n IS NULL THEN 'none' WHEN l < start OR f > coalesce("end", l) THEN 'outside' WHEN n < 0.25 * (l - f + 1) * 5 / 7 THEN 'suspect_reuse' WHEN f - start <= 7 AND coalesce("end", l) - l <= 7 THEN 'full' ELSE 'partial' END AS coverage FROM sp LEFT JOIN v USING (symbol)""")
def _(m):
    sp = m.spells().groupBy("symbol").agg(F.min("start").alias("start"), F.max("start").alias("end")).withColumn("end", F.when(F.col("symbol").cast("bigint") % 3 == 0, None).otherwise(F.col("end")))
    spans = m.daily().groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("rows"))
    return Q.spell_coverage(sp, spans, density=0.25).select("symbol", "coverage")


@query("rename_candidates", "2.17.6", """
WITH k AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g'), '\\b(inc|corp|ltd|co|plc|llc|holdings)\\b', '', 'g')) AS k FROM part) SELECT k AS name_key, count(*) AS n, min(p_partkey) AS first_key FROM k GROUP BY 1 HAVING count(*) > 1""")
def _(m):
    return m.table("part").groupBy(Q.name_key(F.col("p_name")).alias("name_key")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key")).filter("n > 1")


@query("screen_found_by_lag", "2.17.7 2.20.73", """
WITH s AS (SELECT DISTINCT symbol, ordinal FROM screen_list JOIN tick_days ON date = session_date), l AS (SELECT DISTINCT symbol, ordinal FROM ledger JOIN tick_days ON date = session_date), g AS (SELECT lag, count(*) AS live, count(s.symbol) AS found FROM (SELECT *, unnest([-1, 0, 1]) AS lag FROM l) l LEFT JOIN s ON s.symbol = l.symbol AND s.ordinal = l.ordinal + lag GROUP BY 1)
SELECT @I(lag) AS lag, live, found, @R(found / live) AS rate, @I(row_number() OVER (ORDER BY found DESC, abs(lag), lag) = 1) AS best FROM g""")
def _(m):
    from tidemark.plans.q_ledger import tick_days
    d = F.broadcast(tick_days(m).withColumnRenamed("date", "session_date"))
    return Q.screen_found(m.ledger().join(d, "session_date"), screen_list(m).join(d, "session_date"), [-1, 0, 1])


@query("frozen_reproduction", "2.17.8", """
WITH a AS (SELECT trade_id, round(net, 6) AS net FROM ledger), b AS (SELECT trade_id, CASE WHEN trade_id > 5000 AND trade_id % 7 = 0 THEN 0 ELSE round(net, 6) END AS net FROM ledger WHERE trade_id % 501 <> 3)
SELECT count(*) AS rows_seen, count(*) FILTER (b.trade_id IS NULL OR a.net <> b.net) AS differing, @I(min(coalesce(a.trade_id, b.trade_id)) FILTER (b.trade_id IS NULL OR a.net <> b.net)) AS first_bad FROM a FULL JOIN b USING (trade_id)""")
def _(m):
    a = m.ledger().select("trade_id", F.round("net", 6).alias("net"))
    b = a.filter("trade_id % 501 <> 3").withColumn("net", F.when((F.col("trade_id") > 5000) & (F.col("trade_id") % 7 == 0), 0.0).otherwise(F.col("net")))
    return Q.first_difference(a, b, "trade_id", ["net"])


@query("clock_bucket_prices", "2.17.9 2.20.148", """
WITH d AS (SELECT DISTINCT symbol, session_date FROM ticks), g AS (SELECT d.symbol, d.session_date, b.b, max((ts, seq, minute, px)) AS t FROM d JOIN (SELECT unnest([600, 780, 950]) AS b) b ON true LEFT JOIN ticks t ON t.symbol = d.symbol AND t.session_date = d.session_date AND t.minute <= b.b GROUP BY 1, 2, 3)
SELECT symbol, @D(session_date) AS session_date, @I(b) AS bucket, @R(t[4]) AS px, CASE WHEN t[4] IS NULL THEN 'MISSING' WHEN b - t[3] <= 30 THEN 'HIT' ELSE 'BACKFILL' END AS status FROM g""")
def _(m):
    t = m.ticks()
    return Q.bucket_prices(t.select("symbol", "session_date").distinct(), t, [600, 780, 950], 30)


@query("count_only_preflight", "2.17.10 2.20.118", """
SELECT @I(year(session_date)) AS year, count(*) FILTER (market = 'purchase') AS purchase, count(*) FILTER (market = 'signup') AS signup, count(*) FILTER (market = 'error') AS error FROM ticks GROUP BY 1""")
def _(m):
    return Q.counts_by_year(m.ticks(), "session_date", "market", ["purchase", "signup", "error"])


@query("marks_near_entries", "2.17.11 2.20.135", """
WITH f AS (SELECT f.seq, e.seq AS es, abs(date_diff('microsecond', e.ts, f.ts)) AS d, e.ts AS ets FROM fills f JOIN quotes e ON e.symbol = f.symbol AND e.ts >= f.ts - INTERVAL 2 HOUR AND e.ts <= f.ts + INTERVAL 2 HOUR)
SELECT @I(f.seq) AS seq, @R(g.m) AS matched, @I(g.m IS NOT NULL) AS found FROM fills f LEFT JOIN (SELECT seq, arg_min(es, (d, ets)) AS m FROM f GROUP BY 1) g USING (seq)""")
def _(m):
    return Q.marks_found(m.fills(), m.quotes(), 7200).select("seq", F.col("matched").cast("double").alias("matched"), "found")


@query("rebuilt_minutes", "2.17.12 2.20.120", """
WITH a AS (SELECT symbol, ts, close, volume FROM sbars1 WHERE CAST(epoch(ts) AS BIGINT) // 60 % 13 <> 0), b AS (SELECT symbol, ts, close, volume FROM sbars1 WHERE CAST(epoch(ts) AS BIGINT) // 60 % 17 <> 0)
SELECT CASE WHEN a.ts IS NULL THEN 'missing' WHEN b.ts IS NULL THEN 'extra' WHEN a.close <> b.close OR a.volume <> b.volume THEN 'differs' ELSE 'same' END AS state, count(*) AS n FROM a FULL JOIN b USING (symbol, ts) GROUP BY 1""")
def _(m):
    minute = F.floor(F.unix_seconds("ts") / 60)
    b = m.symbol_bars(1)
    return Q.rebuilt_minutes(b.filter(minute % 13 != 0), b.filter(minute % 17 != 0)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("statistic_type_census", "2.17.13 2.20.109", """
SELECT market AS stat_type, count(*) AS n_rows, count(DISTINCT symbol) AS symbols, @D(min(session_date)) AS first_day, @D(max(session_date)) AS last_day FROM ticks GROUP BY 1""")
def _(m):
    return m.ticks().groupBy(F.col("market").alias("stat_type")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("symbol").alias("symbols"), F.min("session_date").alias("first_day"), F.max("session_date").alias("last_day"))


@query("pairs_from_reports", "2.17.14", """
SELECT DISTINCT symbol, @D(CAST(((ts AT TIME ZONE 'Australia/Sydney') AT TIME ZONE 'America/New_York') AS DATE)) AS session_date FROM fills""")
def _(m):
    et = F.from_utc_timestamp(F.to_utc_timestamp("ts", "Australia/Sydney"), "America/New_York")
    return m.fills().select("symbol", F.to_date(et).alias("session_date")).distinct()


@query("content_hash", "2.17.15", """
WITH d AS (SELECT CAST('0x' || substr(md5(concat_ws('|', CAST(CAST(round(close * 10000) AS BIGINT) AS VARCHAR), CAST(date AS VARCHAR), CAST(CAST(round(high * 10000) AS BIGINT) AS VARCHAR), CAST(CAST(round(low * 10000) AS BIGINT) AS VARCHAR), CAST(CAST(round(open * 10000) AS BIGINT) AS VARCHAR), symbol, CAST(volume AS VARCHAR))), 1, 12) AS BIGINT) AS h FROM daily)
SELECT count(*) AS n_rows, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS digest FROM d""")
def _(m):
    return Q.content_hash(m.daily().select("close", "date", "high", "low", "open", "symbol", "volume"))


@query("fill_statuses", "2.17.16", """
SELECT @D(session_date) AS session_date, count(*) FILTER (seq % 5 < 3) AS filled, count(*) FILTER (seq % 5 = 3) AS skipped, count(*) FILTER (seq % 5 = 4) AS rejected FROM fills GROUP BY session_date""")
def _(m):
    k = F.col("seq") % 5
    return Q.statuses(m.fills().withColumn("status", F.when(k < 3, "FILLED").when(k == 3, "SKIPPED_SPREAD").otherwise("REJECTED")), ["session_date"])
