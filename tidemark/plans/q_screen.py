"""Screens, predicates, top-k and populations (2.2, 2.7, 2.8)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import clock, predicates as P
from tidemark.operators import bars, populations as O, recursive as R, rollups, screen as S, windows as W
from tidemark.plans.registry import query, view

D = "PARTITION BY symbol ORDER BY date"
CFG = S.Screen(change_min=20.0, price_range=(2.0, 250.0), volume_min=60, cadence_minutes=15,
               ladder=((240, 1.0), (420, 0.8), (480, 0.552)), top=10)

view("session_closes", """SELECT symbol, session_date AS date, last(px ORDER BY ts, seq) AS close FROM ticks GROUP BY 1, 2""")
view("prior_px", """SELECT symbol, date, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prior_close FROM session_closes""")
view("screen_state", """SELECT session_date, symbol, tick, close, cum_volume, (close / prior_close - 1) * 100 AS change FROM (
  SELECT b.session_date, b.symbol, g.tick, last(b.close ORDER BY b.ts) AS close, sum(b.volume) AS cum_volume, max(p.prior_close) AS prior_close
  FROM sbars1 b JOIN (SELECT unnest(range(255, 571, 15)) AS tick) g ON b.minute + 1 <= g.tick AND b.minute >= 240
  JOIN prior_px p ON p.symbol = b.symbol AND p.date = b.session_date WHERE p.prior_close > 0 GROUP BY 1, 2, 3)""")
view("screen_list", """SELECT *, row_number() OVER (PARTITION BY session_date, tick ORDER BY change DESC, symbol) AS position FROM screen_state
  WHERE change >= 20 - 1e-9 AND close BETWEEN 2 AND 250
   AND cum_volume >= round_even(60 * CASE WHEN tick >= 480 THEN 0.552::DOUBLE WHEN tick >= 420 THEN 0.8::DOUBLE ELSE 1.0 END, 0)
  QUALIFY position <= 10""")


def session_closes(m):
    return m.ticks().groupBy("symbol", F.col("session_date").alias("date")).agg(bars.last_by("px", "ts", "seq").alias("close"))


def screen_list(m):
    return S.running_screen(m.symbol_bars(1), S.prior_closes(session_closes(m)), CFG)


@query("running_screen", "2.2.5 2.2.7 2.18.2 2.7.1", """
SELECT @D(session_date) AS session_date, @I(tick) AS tick, symbol, @R(close) AS close, @I(cum_volume) AS cum_volume, @R(change) AS change, position FROM screen_list""")
def _(m):
    return screen_list(m)


@query("first_seen_universe", "2.18.3", """
SELECT @D(session_date) AS session_date, symbol, @I(min(tick)) AS first_seen, arg_min(position, tick) AS first_rank, min(position) AS best_rank,
 count(*) AS ticks_on FROM screen_list GROUP BY 1, 2""")
def _(m):
    return S.first_seen(screen_list(m))


@query("screen_at_minute", "2.2.5 2.2.6", """
SELECT @D(session_date) AS session_date, symbol, @R(close) AS close, @I(cum_volume) AS cum_volume, @R(change) AS change, position FROM screen_list WHERE tick = 480""")
def _(m):
    return S.screen_at(m.symbol_bars(1), S.prior_closes(session_closes(m)), 480, CFG).select(
        "session_date", "symbol", "close", "cum_volume", "change", "position")


@query("screen_paths_agree", "2.17.3", """
SELECT 2 * count(*) AS compared, 0 AS differing FROM screen_list WHERE tick = 420""")
def _(m):
    b, p = m.symbol_bars(1), S.prior_closes(session_closes(m))
    cols = ["session_date", "symbol", "position"]
    fast = S.running_screen(b, p, CFG).filter("tick = 420").select(*cols)
    slow = S.screen_at(b, p, 420, CFG).select(*cols)
    tagged = fast.withColumn("w", F.lit(1)).unionAll(slow.withColumn("w", F.lit(-1)))
    return tagged.groupBy(*cols).agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("compared"), F.count(F.when(F.col("w") != 0, 1)).alias("differing"))


@query("visible_bars", "2.2.6", """
SELECT symbol, count(*) FILTER (minute >= 240 AND minute + 1 <= 480) AS visible, count(*) AS n FROM sbars1 GROUP BY 1""")
def _(m):
    at = F.to_utc_timestamp(F.col("session_date").cast("timestamp") + F.expr("INTERVAL 480 MINUTES"), clock.NEW_YORK)
    seen = clock.visible_at(F.col("ts"), at)
    return m.symbol_bars(1).groupBy("symbol").agg(F.count(F.when(seen, 1)).alias("visible"), F.count(F.lit(1)).alias("n"))


@query("stage_filters", "2.2.2 2.2.3", """
SELECT symbol, @D(date) AS date, @I(coalesce(prior_close BETWEEN 0.5 AND 2000 AND prior_avg_dollar_vol >= 25000, false)) AS knowable,
 @I(coalesce(rvol >= 1.5 AND range_pct >= 10, false)) AS hindsight FROM screen_features""")
def _(m):
    f = W.screen_features(m.daily())
    return f.select("symbol", "date", S.stage1(f, (0.5, 2000.0)).alias("knowable"), S.stage2(1.5).alias("hindsight"))


@query("top_per_day", "2.7.2", """
SELECT symbol, @D(date) AS date, @R(rvol) AS rvol, row_number() OVER (PARTITION BY date ORDER BY rvol DESC, symbol) AS day_rank FROM screen_features
WHERE prior_close BETWEEN 0.5 AND 2000 AND prior_avg_dollar_vol >= 25000 AND rvol >= 1.5 AND range_pct >= 10 QUALIFY day_rank <= 5""")
def _(m):
    f = W.screen_features(m.daily())
    return S.select_candidates(f, S.stage1(f, (0.5, 2000.0)) & S.stage2(1.5), 5).select("symbol", "date", "rvol", "day_rank")


@query("test_symbol_exclusion", "2.2.4", """
SELECT p_partkey, sym, @I(regexp_full_match(sym, '(Z[A-Z]ZZ[TC]|[A-Z]?TEST[A-Z]?|.*\\.TEST)') OR sym IN ('ZZZ', 'ZVV', 'ZTST')) AS is_test
FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'ZVZZT' WHEN p_size % 5 = 1 THEN upper(split_part(p_name, ' ', 1)) || '.TEST'
 WHEN p_size % 5 = 2 THEN 'ZZZ' ELSE upper(split_part(p_name, ' ', 1)) END AS sym FROM part)""")
def _(m):
    word = F.upper(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)))
    k = F.col("p_size") % 5
    sym = F.when(k == 0, "ZVZZT").when(k == 1, F.concat(word, F.lit(".TEST"))).when(k == 2, "ZZZ").otherwise(word)
    return m.table("part").select("p_partkey", sym.alias("sym")).withColumn("is_test", P.is_test_symbol(F.col("sym")))


CLAUSES = [{"column": "rvol", "op": "egreater", "right": 1.2}, {"column": "range_pct", "op": "greater", "right": 10.0},
           {"column": "prior_close", "op": "in_range", "right": (100.0, 2000.0)}, {"column": "gap_pct", "op": "less", "right": 50.0},
           {"column": "volume", "op": "eless", "right": 60}, {"column": "volume", "op": "unheard", "right": 1}]


@query("failing_clauses", "2.2.8", """
SELECT symbol, @D(date) AS date, array_to_string(list_filter([CASE WHEN coalesce(rvol >= 1.2, false) THEN NULL ELSE 'rvol' END,
 CASE WHEN coalesce(range_pct > 10, false) THEN NULL ELSE 'range_pct' END, CASE WHEN coalesce(prior_close BETWEEN 100 AND 2000, false) THEN NULL ELSE 'prior_close' END,
 CASE WHEN coalesce(gap_pct < 50, false) THEN NULL ELSE 'gap_pct' END, CASE WHEN coalesce(volume <= 60, false) THEN NULL ELSE 'volume' END], lambda x: x IS NOT NULL), ',') AS failing FROM screen_features""")
def _(m):
    return W.screen_features(m.daily()).select("symbol", "date", F.array_join(P.failing_clauses(CLAUSES), ",").alias("failing"))


@query("failed_condition_list", "2.2.9", f"""
SELECT symbol, @D(date) AS date, array_to_string(list_filter([CASE WHEN coalesce(close > lag(close, 3) OVER ({D}), false) THEN NULL ELSE 'c_rising' END,
 CASE WHEN coalesce(volume >= lag(volume) OVER ({D}), false) THEN NULL ELSE 'c_volume' END, CASE WHEN close > open THEN NULL ELSE 'c_body' END], lambda x: x IS NOT NULL), ',') AS failed FROM daily""")
def _(m):
    df = m.daily().withColumn("c_rising", W.rising("close")).withColumn("c_volume", F.col("volume") >= W.lag("volume", W.DAY, "date")).withColumn(
        "c_body", F.col("close") > F.col("open"))
    return df.select("symbol", "date", F.array_join(P.failed_conditions(["c_rising", "c_volume", "c_body"]), ",").alias("failed"))


@query("clause_margins", "2.2.10", """
WITH a AS (SELECT *, (rvol - 1.2) / 1.2::DOUBLE AS m1, (range_pct - 10) / 10 AS m2, (2000 - close) / 2000 AS m3 FROM screen_features WHERE rvol IS NOT NULL AND range_pct IS NOT NULL)
SELECT symbol, @D(date) AS date, @R(m1) AS rvol_margin, @R(m2) AS range_pct_margin, @R(m3) AS close_margin, @R(least(m1, m2, m3)) AS slack,
 CASE WHEN m1 <= m2 AND m1 <= m3 THEN 'rvol' WHEN m2 <= m3 THEN 'range_pct' ELSE 'close' END AS binding,
 @R(percent_rank() OVER (PARTITION BY date ORDER BY round(least(m1, m2, m3), 9))) AS slack_rank FROM a""")
def _(m):
    f = W.screen_features(m.daily()).filter("rvol is not null and range_pct is not null")
    df = S.clause_margins(f, [("rvol", "min", 1.2), ("range_pct", "min", 10.0), ("close", "max", 2000.0)])
    rank = F.percent_rank().over(Window.partitionBy("date").orderBy(F.round("slack", 9)))
    return df.select("symbol", "date", "rvol_margin", "range_pct_margin", "close_margin", "slack", "binding", rank.alias("slack_rank"))


@query("in_session_mask", "2.2.11", """
SELECT symbol, @I(minute >= 570 AND minute < 960) AS inside, count(*) AS n FROM bars5 GROUP BY 1, 2""")
def _(m):
    inside = clock.in_session(F.col("ts"), F.col("session_date"), 570, 960)
    return m.bars().groupBy("symbol", inside.alias("inside")).agg(F.count(F.lit(1)).alias("n"))


@query("quote_predicates", "2.2.12 2.2.13 2.2.14", """
WITH q AS (SELECT *, CASE WHEN seq % 7 = 0 THEN ask WHEN seq % 11 = 0 THEN 0 WHEN seq % 13 = 0 THEN NULL ELSE bid END AS b,
  CASE WHEN seq % 17 = 0 THEN NULL ELSE (bid + ask) / 2 * (1 + (seq % 10) / 100.0::DOUBLE) END AS ref FROM quotes)
SELECT seq, @I(coalesce(b > 0 AND ask > 0 AND ask >= b, false)) AS usable, @I(coalesce(b > 0 AND ask > b, false)) AS strict_usable,
 @I(coalesce(ref > 0 AND b > 0 AND ask >= b AND abs(ref / ((b + ask) / 2) - 1) <= 0.05, false)) AS believed,
 @I(coalesce(CASE WHEN b > 0 AND ask >= b THEN (ask - b) / ((ask + b) / 2) * 100 END < 1.9, true)) AS spread_ok,
 @I(coalesce(abs(ask / nullif(ref, 0) - 1) <= 0.03, true)) AS drift_ok FROM q""")
def _(m):
    k = F.col("seq")
    q = m.quotes().withColumn("b", F.when(k % 7 == 0, F.col("ask")).when(k % 11 == 0, 0.0).when(k % 13 == 0, None).otherwise(F.col("bid")))
    q = q.withColumn("ref", F.when(k % 17 == 0, None).otherwise((F.col("bid") + F.col("ask")) / 2 * (1 + (k % 10) / 100)))
    b, a, ref = F.col("b"), F.col("ask"), F.col("ref")
    return q.select("seq", P.usable_quote(b, a).alias("usable"), P.usable_quote(b, a, False).alias("strict_usable"),
                    P.usable_reference(ref, b, a).alias("believed"), P.spread_guard_ok(b, a, 1.9).alias("spread_ok"),
                    P.drift_guard_ok(a, ref, 0.03).alias("drift_ok"))


@query("rule_flags", "2.2.15", """
SELECT symbol, @D(date) AS date, @I(coalesce(rvol >= 1.5, false)) AS f_rvol, @I(coalesce(range_pct >= 10, false)) AS f_range,
 @I(close BETWEEN 2 AND 2000) AS f_price, @I(coalesce(prior_avg_dollar_vol >= 25000, false)) AS f_liquid FROM screen_features""")
def _(m):
    no = F.lit(False)
    return W.screen_features(m.daily()).select(
        "symbol", "date", F.coalesce(F.col("rvol") >= 1.5, no).alias("f_rvol"), F.coalesce(F.col("range_pct") >= 10, no).alias("f_range"),
        F.col("close").between(2, 2000).alias("f_price"), F.coalesce(F.col("prior_avg_dollar_vol") >= 25000, no).alias("f_liquid"))


@query("run_up_gates", "2.2.16 2.2.17", """
WITH b AS (SELECT *, close / lag(close, 5) OVER w - 1 AS r5, close / max(high) OVER (PARTITION BY symbol, session_date ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS d
 FROM bars1 WINDOW w AS (PARTITION BY symbol, session_date ORDER BY ts)),
g AS (SELECT symbol, ts, coalesce(r5 <= 0.5, false) AS g1, coalesce(d >= -0.6, false) AS g2 FROM b)
SELECT b5.symbol, @T(b5.ts) AS ts, @I(coalesce(g1, false)) AS chase_ok, @I(coalesce(g1 AND g2, false)) AS cell_ok
FROM bars5 b5 LEFT JOIN g ON g.symbol = b5.symbol AND g.ts = b5.ts + INTERVAL 4 MINUTE""")
def _(m):
    one = W.running_extremes(m.bars(1))
    r5 = F.try_divide(F.col("close"), W.lag("close", W.SESSION, "ts", 5)) - 1
    one = one.withColumn("r5", r5)
    gates = one.select("symbol", (F.col("ts") - F.expr("INTERVAL 4 MINUTES")).alias("ts"),
                       P.ceiling_gate(F.col("r5"), 0.5).alias("chase_ok"),
                       P.ceiling_gate(F.col("r5"), 0.5, F.col("dist_from_high"), -0.6).alias("cell_ok"))
    return m.bars(5).select("symbol", "ts").join(gates, ["symbol", "ts"], "left").na.fill(False)


@query("cold_session_gate", "2.2.18", """
WITH n AS (SELECT session_date, count(*) AS n FROM bars5 GROUP BY 1), d AS (SELECT session_date, coalesce(lag(n) OVER (ORDER BY session_date) < avg(n) OVER (ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS cold FROM n)
SELECT b.symbol, @I(minute < 420 OR NOT cold) AS gate, count(*) AS n FROM bars5 b JOIN d USING (session_date) GROUP BY 1, 2""")
def _(m):
    b = m.bars()
    days = b.groupBy("session_date").agg(F.count(F.lit(1)).alias("n"))
    cold = days.select("session_date", rollups.below_earlier_mean("n", "session_date").alias("cold"))
    gated = b.join(F.broadcast(cold), "session_date").withColumn("gate", P.cold_gate(F.col("minute"), F.col("cold")))
    return gated.groupBy("symbol", "gate").agg(F.count(F.lit(1)).alias("n"))


@query("keep_set_mask", "2.2.20 2.3.20", """
WITH f AS (SELECT symbol, session_date, max(high) / nullif(min(low), 0) - 1 AS peak FROM sbars1 GROUP BY 1, 2)
SELECT @I(trade_id) AS trade_id, symbol, @I(coalesce(peak >= 1.0, false)) AS kept FROM ledger JOIN f USING (symbol, session_date)""")
def _(m):
    peak = m.ticks().groupBy("symbol", "session_date").agg((F.try_divide(F.max("px"), F.min("px")) - 1).alias("peak"))
    keep = peak.filter("peak >= 1.0")
    led = m.ledger()
    on = ["symbol", "session_date"]
    kept = led.join(keep, on, "left_semi").select("trade_id", "symbol", F.lit(True).alias("kept"))
    return kept.unionByName(led.join(keep, on, "left_anti").select("trade_id", "symbol", F.lit(False).alias("kept")))


@query("first_failing_gate", "2.2.23", """
SELECT symbol, @D(date) AS date, CASE WHEN NOT coalesce(dollar_vol >= 50000, false) THEN 'trigger_dollars' WHEN NOT coalesce(abs(gap_pct) <= 60, false) THEN 'extension'
 WHEN NOT coalesce(prior_close <= 2500, false) THEN 'overhead' END AS reason FROM screen_features""")
def _(m):
    rules = [("trigger_dollars", F.col("dollar_vol") >= 50000), ("extension", F.abs(F.col("gap_pct")) <= 60), ("overhead", F.col("prior_close") <= 2500)]
    return W.screen_features(m.daily()).select("symbol", "date", P.first_failure(rules).alias("reason"))


@query("decision_validation", "2.2.24", """
WITH d AS (SELECT trade_id, CASE WHEN trade_id % 3 = 0 THEN 'SHORT' WHEN trade_id % 50 = 1 THEN 'X' ELSE 'LONG' END AS side, entry_px AS entry,
  entry_px * 0.9 AS stop, exit_px AS target, qty / 2 AS size, exit_minute - entry_minute AS horizon FROM ledger)
SELECT @I(trade_id) AS trade_id, array_to_string(list_filter([CASE WHEN side IN ('LONG', 'SHORT') THEN NULL ELSE 'side' END, CASE WHEN entry > 0 THEN NULL ELSE 'entry' END,
 CASE WHEN CASE WHEN side = 'LONG' THEN stop < entry ELSE stop > entry END THEN NULL ELSE 'stop' END,
 CASE WHEN CASE WHEN side = 'LONG' THEN target > entry ELSE target < entry END THEN NULL ELSE 'target' END,
 CASE WHEN size > 0 AND size = floor(size) THEN NULL ELSE 'size' END, CASE WHEN horizon BETWEEN 1 AND 365 THEN NULL ELSE 'horizon' END], lambda x: x IS NOT NULL), ',') AS errors FROM d""")
def _(m):
    t = F.col("trade_id")
    d = m.ledger().select(
        "trade_id", F.when(t % 3 == 0, "SHORT").when(t % 50 == 1, "X").otherwise("LONG").alias("side"), F.col("entry_px").alias("entry"),
        (F.col("entry_px") * 0.9).alias("stop"), F.col("exit_px").alias("target"), (F.col("qty") / 2).alias("size"),
        (F.col("exit_minute") - F.col("entry_minute")).alias("horizon"))
    return d.select("trade_id", F.array_join(P.decision_errors(), ",").alias("errors"))


@query("active_names", "2.2.25", """
WITH last AS (SELECT symbol, arg_max(side, (ts, seq)) AS side, arg_max(qty, (ts, seq)) AS qty FROM fills GROUP BY 1)
SELECT symbol, side, @I(qty) AS qty FROM last WHERE side = 'BUY' OR qty > 80""")
def _(m):
    last = m.fills().groupBy("symbol").agg(F.max_by(F.struct("side", "qty"), F.struct("ts", "seq")).alias("s"))
    return last.select("symbol", "s.side", "s.qty").filter("side = 'BUY' or qty > 80")


@query("bottom_decile", "2.7.3 2.12.26", f"""
WITH r AS (SELECT symbol, date, close / lag(close, 5) OVER ({D}) - 1 AS r FROM daily), n AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM r WHERE r IS NOT NULL)
SELECT symbol, @D(date) AS date, @R(round(r, 9)) AS ret, @I(greatest(1, round_even(n / 10, 0))) AS picks, row_number() OVER (PARTITION BY date ORDER BY round(r, 9), symbol) AS place
FROM n QUALIFY place <= picks""")
def _(m):
    r = F.round(F.col("close") / W.lag("close", W.DAY, "date", 5) - 1, 9)
    return S.bottom_decile(m.daily().withColumn("ret", r), ["date"], "ret").select("symbol", "date", "ret", "picks", "place")


@query("decision_ranking", "2.7.4", """
SELECT @I(trade_id) AS trade_id, @D(session_date) AS session_date, row_number() OVER w AS place, CASE WHEN row_number() OVER w <= 3 THEN 'TAKE' ELSE 'PASS' END AS call
FROM ledger WINDOW w AS (PARTITION BY session_date ORDER BY qty DESC, round(exit_px / nullif(entry_px, 0), 9) DESC NULLS LAST, symbol, trade_id)""")
def _(m):
    w = Window.partitionBy("session_date").orderBy(F.desc("qty"), F.desc(F.round(F.try_divide("exit_px", "entry_px"), 9)), "symbol", "trade_id")
    k = F.row_number().over(w)
    return m.ledger().select("trade_id", "session_date", k.alias("place"), F.when(k <= 3, "TAKE").otherwise("PASS").alias("call"))


@query("rank_and_slice", "2.7.5", """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY rvol DESC, symbol) AS rk, CAST(close > open AS INT) AS hit FROM screen_features WHERE rvol IS NOT NULL),
t AS (SELECT unnest([1, 5, 10]) AS top)
SELECT @I(top) AS top, @R(avg(hit) FILTER (rk <= top)) AS rate, @R(avg(hit)) AS pool_rate, @R(avg(hit) FILTER (rk <= top) / avg(hit)) AS lift FROM a, t GROUP BY top""")
def _(m):
    f = W.screen_features(m.daily()).filter("rvol is not null")
    return S.rank_and_slice(f, ["date"], "rvol", F.col("close") > F.col("open"), [1, 5, 10])


@query("watchlist_tiers", "2.7.6", """
WITH s AS (SELECT session_date, symbol, max(tick) AS last_seen, max(tick) = 570 AS current, arg_max(close, tick) <= 60 AS in_band FROM screen_list GROUP BY 1, 2)
SELECT @D(session_date) AS session_date, symbol, @I(CASE WHEN current AND in_band THEN 0 WHEN current THEN 1 ELSE 2 END) AS tier,
 row_number() OVER (PARTITION BY session_date ORDER BY CASE WHEN current AND in_band THEN 0 WHEN current THEN 1 ELSE 2 END, last_seen DESC, symbol) AS position FROM s QUALIFY position <= 40""")
def _(m):
    s = screen_list(m).groupBy("session_date", "symbol").agg(
        F.max("tick").alias("last_seen"), (F.max("tick") == 570).alias("current"), (F.max_by("close", "tick") <= 60).alias("in_band"))
    return S.tiers(s).select("session_date", "symbol", "tier", "position")


@query("stratified_order", "2.7.7", """
WITH a AS (SELECT trade_id, session_date, net > 0 AS won, md5(CAST(trade_id AS VARCHAR)) AS h FROM ledger),
b AS (SELECT *, row_number() OVER (PARTITION BY session_date, won ORDER BY h) AS k, count(*) OVER (PARTITION BY session_date, won) AS n FROM a)
SELECT @I(trade_id) AS trade_id, k AS in_stratum, n AS stratum_size, @R((k - 0.5) / n) AS place FROM b""")
def _(m):
    led = m.ledger().withColumn("won", F.col("net") > 0)
    return O.presentation_order(led, ["session_date", "won"], F.col("trade_id")).select("trade_id", "in_stratum", "stratum_size", "place")


@query("winner_selection", "2.7.8", """
SELECT symbol, trades, @R(score) AS score, @I(trades >= 15 AND row_number() OVER (ORDER BY (trades >= 15) DESC, score DESC, symbol) = 1) AS chosen, @I(trades < 15) AS dropped
FROM (SELECT symbol, count(*) AS trades, round(avg(net), 6) AS score FROM ledger GROUP BY 1)""")
def _(m):
    cells = m.ledger().groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.round(F.avg("net"), 6).alias("score"))
    best = cells.filter("trades >= 15").orderBy(F.desc("score"), "symbol").limit(1).select(F.col("symbol").alias("__best"))
    return cells.join(F.broadcast(best), F.col("symbol") == F.col("__best"), "left").select(
        "symbol", "trades", "score", F.col("__best").isNotNull().alias("chosen"), (F.col("trades") < 15).alias("dropped"))


@query("biggest_bars", "2.7.9 2.20.151", """
SELECT symbol, @T(ts) AS ts, @R(high - low) AS bar_range FROM (SELECT symbol, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, max(high) AS high, min(low) AS low FROM bars5 GROUP BY 1, 2)
ORDER BY round(high - low, 6) DESC, symbol, ts LIMIT 15""")
def _(m):
    b = bars.resample_bars(m.bars(), 30).withColumn("bar_range", F.round(F.col("high") - F.col("low"), 6))
    return b.orderBy(F.desc("bar_range"), "symbol", "ts").limit(15).select("symbol", "ts", "bar_range")


@query("every_kth_trade", "2.7.10", """
SELECT @I(trade_id) AS trade_id, position FROM (SELECT trade_id, row_number() OVER (ORDER BY entry_ts, trade_id) AS position FROM ledger) WHERE (position - 1) % 7 = 0""")
def _(m):
    return O.every_kth(m.ledger(), ["entry_ts", "trade_id"], 7).select("trade_id", "position")


view("crc_bits", "SELECT i, 0 AS k, i AS c FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE k < 8")


@query("crc_subset", "2.7.11", """
WITH t AS (SELECT list(c ORDER BY i) AS tab FROM crc_bits WHERE k = 8),
c AS (SELECT trade_id, xor(list_reduce(list_transform(string_split(CAST(trade_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM ledger, t)
SELECT @I(trade_id) AS trade_id, @I(crc) AS crc FROM c ORDER BY crc, CAST(trade_id AS VARCHAR) LIMIT 100""")
def _(m):
    return O.crc_subset(m.ledger(), F.col("trade_id").cast("string"), 100).select("trade_id", "crc")


@query("universe_overlap", "2.8.1", """
WITH a AS (SELECT DISTINCT symbol, session_date FROM ticks WHERE market = 'purchase'), b AS (SELECT DISTINCT symbol, session_date FROM ticks WHERE market = 'signup')
SELECT count(*) FILTER (a.symbol IS NOT NULL AND b.symbol IS NOT NULL) AS "both", count(*) FILTER (b.symbol IS NULL) AS only_left,
 count(*) FILTER (a.symbol IS NULL) AS only_right, @R(count(*) FILTER (a.symbol IS NOT NULL AND b.symbol IS NOT NULL) / count(*)) AS jaccard
FROM a FULL JOIN b ON a.symbol = b.symbol AND a.session_date = b.session_date""")
def _(m):
    t = m.ticks()
    return O.overlap(t.filter("market = 'purchase'"), t.filter("market = 'signup'"))


@query("restrict_to_dates", "2.8.2", """
SELECT @I(trade_id) AS trade_id FROM ledger WHERE session_date IN (SELECT session_date FROM ticks WHERE market = 'error' GROUP BY 1 HAVING count(*) >= 65)""")
def _(m):
    busy = m.ticks().filter("market = 'error'").groupBy("session_date").count().filter("count >= 65")
    return O.restrict(m.ledger(), busy).select("trade_id")


@query("first_file_wins", "2.8.3", """
WITH u AS (SELECT 1 AS file_no, symbol, session_date, seq FROM fills WHERE side = 'BUY' UNION ALL SELECT 2, symbol, session_date, seq FROM quotes)
SELECT @I(file_no) AS file_no, symbol, @D(session_date) AS session_date, @I(seq) AS seq FROM u QUALIFY file_no = min(file_no) OVER (PARTITION BY session_date)""")
def _(m):
    cols = ["symbol", "session_date", "seq"]
    a = m.fills().filter("side = 'BUY'").select(F.lit(1).alias("file_no"), *cols)
    return O.first_file_wins(a.unionByName(m.quotes().select(F.lit(2).alias("file_no"), *cols)))


@query("reject_control_sample", "2.8.4", """
WITH f AS (SELECT symbol, date, coalesce(prior_close BETWEEN 0.5 AND 2000 AND prior_avg_dollar_vol >= 25000, false) AS a, coalesce(rvol >= 1.5 AND range_pct >= 10, false) AS b FROM screen_features),
c AS (SELECT date, round_even(count(*) / sum(count(*)) OVER () * 2000, 0) AS want FROM f WHERE a AND b GROUP BY 1),
r AS (SELECT symbol, date, row_number() OVER (PARTITION BY date ORDER BY md5('0|' || symbol || '|' || CAST(date AS VARCHAR))) AS k FROM f WHERE a AND NOT b)
SELECT symbol, @D(date) AS date, k AS draw_order FROM r JOIN c USING (date) WHERE k <= want""")
def _(m):
    f = W.screen_features(m.daily())
    a, b = S.stage1(f, (0.5, 2000.0)), S.stage2(1.5)
    return O.reject_sample(f.filter(a & ~b), f.filter(a & b), 2000).select("symbol", "date", "draw_order")


@query("holdout_split", "2.8.5", """
WITH d AS (SELECT session_date, row_number() OVER (ORDER BY session_date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT session_date FROM ledger)),
p AS (SELECT session_date, CASE WHEN k > n - floor(n * 0.3) THEN 'locked' WHEN k <= floor((n - floor(n * 0.3)) / 2) THEN 'early' ELSE 'late' END AS part FROM d)
SELECT part, count(*) AS trades, @R(sum(net)) AS net FROM ledger JOIN p USING (session_date) GROUP BY 1""")
def _(m):
    return O.session_split(m.ledger()).groupBy("part").agg(F.count(F.lit(1)).alias("trades"), F.sum("net").alias("net"))


@query("universe_fingerprint", "2.8.5 2.17.15", """
SELECT count(*) AS n_keys, CAST(sum(CAST('0x' || substr(md5(symbol || '|' || CAST(session_date AS VARCHAR)), 1, 12) AS BIGINT)) AS DOUBLE) AS digest_sum
FROM (SELECT DISTINCT symbol, session_date FROM ticks)""", digits=0)
def _(m):
    return O.fingerprint(m.ticks())


@query("training_cut", "2.8.6", """
SELECT symbol, count(*) AS n, @R(sum(volume)) AS volume FROM daily WHERE date < DATE '1999-01-01' GROUP BY 1""")
def _(m):
    lines = m.daily().filter(F.col("date") < F.lit("1999-01-01").cast("date"))
    return lines.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").cast("double").alias("volume"))


@query("three_way_split", "2.8.7", """
SELECT CASE WHEN date >= DATE '2001-01-01' THEN 'seen' WHEN date >= DATE '2000-01-01' THEN 'holdout' ELSE 'training' END AS part, count(*) AS n
FROM daily WHERE NOT date BETWEEN DATE '1997-03-01' AND DATE '1997-04-15' GROUP BY 1""")
def _(m):
    return O.three_way(m.daily(), F.col("date"), "2000-01-01", "2001-01-01", [("1997-03-01", "1997-04-15")]).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


view("calendar_days", """SELECT date, row_number() OVER (ORDER BY date) AS ordinal FROM (SELECT DISTINCT date FROM daily)""")


def calendar(m):
    days = m.table("lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return days.withColumn("ordinal", F.row_number().over(Window.partitionBy().orderBy("date")))


@query("series_segments", "2.8.8", """
WITH a AS (SELECT symbol, ordinal, lag(ordinal) OVER (PARTITION BY symbol ORDER BY ordinal) AS p FROM daily JOIN calendar_days USING (date))
SELECT symbol, @I(ordinal) AS ordinal, @I(sum(CASE WHEN p IS NULL OR ordinal - p > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ordinal)) AS segment FROM a""")
def _(m):
    return O.segments(m.daily().join(F.broadcast(calendar(m)), "date")).select("symbol", "ordinal", "segment")


@query("missing_sessions", "2.8.9", """
WITH s AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM daily GROUP BY 1)
SELECT symbol, @I(year(c.date)) AS year, count(*) AS sessions, count(*) FILTER (d.date IS NULL) AS missing, @R(count(*) FILTER (d.date IS NULL) / count(*)) AS missing_share
FROM s JOIN calendar_days c ON c.date BETWEEN lo AND hi LEFT JOIN daily d USING (symbol, date) GROUP BY 1, 2""")
def _(m):
    return O.missing_sessions(calendar(m), m.daily())


@query("pick_turnover", "2.4.22", f"""
WITH r AS (SELECT symbol, date, round(close / lag(close, 5) OVER ({D}) - 1, 9) AS r FROM daily), n AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM r WHERE r IS NOT NULL),
p AS (SELECT symbol, date FROM n QUALIFY row_number() OVER (PARTITION BY date ORDER BY r, symbol) <= greatest(1, round_even(n / 10, 0))),
d AS (SELECT date, count(*) AS n, lag(date) OVER (ORDER BY date) AS pd, lag(count(*)) OVER (ORDER BY date) AS pn FROM p GROUP BY 1),
c AS (SELECT d.date, count(q.symbol) AS common FROM d JOIN p USING (date) LEFT JOIN p q ON q.date = d.pd AND q.symbol = p.symbol GROUP BY 1)
SELECT @D(date) AS date, n + pn - 2 * common AS changed, n + pn - common AS union_size, @R((n + pn - 2 * common) / (n + pn - common)) AS turnover FROM d JOIN c USING (date) WHERE pd IS NOT NULL""")
def _(m):
    r = F.round(F.col("close") / W.lag("close", W.DAY, "date", 5) - 1, 9)
    picks = S.bottom_decile(m.daily().withColumn("ret", r), ["date"], "ret").select("symbol", "date")
    return O.turnover(picks, "date")
