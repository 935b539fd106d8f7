"""Joins (2.3) and microstructure (2.11)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.operators import joins as J, micro as M, scale, screen as S, series as Y, windows as W
from tidemark.plans.registry import query, view

TOL = 6 * 3600

# predicates.usable_quote: two-sided and not crossed.
view("usable_quotes", "SELECT * FROM quotes WHERE bid > 0 AND ask > 0 AND ask >= bid")


@query("asof_quote_per_fill", "2.3.1 2.11.1 2.20.35", """
WITH j AS (SELECT f.*, q.bid, q.ask, q.ts AS qts FROM fills f ASOF LEFT JOIN usable_quotes q ON f.symbol = q.symbol AND f.ts >= q.ts)
SELECT @I(seq) AS seq, side, @R((bid + ask) / 2) AS mid, @R(CASE WHEN side = 'BUY' THEN price - ask ELSE bid - price END) AS slip_touch,
 @R(CASE WHEN side = 'BUY' THEN price - (bid + ask) / 2 ELSE (bid + ask) / 2 - price END) AS slip_mid FROM j WHERE qts >= ts - INTERVAL 6 HOUR""")
def _(m):
    return M.slippage(M.fill_quotes(m.fills(), m.quotes(), TOL)).select("seq", "side", "mid", "slip_touch", "slip_mid")


@query("asof_without_tolerance", "2.3.1", """
SELECT @I(f.seq) AS seq, @R(q.bid) AS bid, @R(q.seq) AS quote_seq FROM fills f ASOF LEFT JOIN quotes q ON f.symbol = q.symbol AND f.ts >= q.ts""")
def _(m):
    q = m.quotes().withColumn("quote_seq", F.col("seq").cast("double"))
    return J.asof_join(m.fills(), q, ["symbol"], ["bid", "quote_seq"]).select("seq", "bid", "quote_seq")


@query("asof_at_horizons", "2.3.2", """
WITH h AS (SELECT *, unnest([0, 300, 3600, 86400]) AS horizon FROM fills)
SELECT @I(h.seq) AS seq, @I(h.horizon) AS horizon, @R((q.bid + q.ask) / 2) AS mid, @R(q.seq) AS quote_seq FROM
 (SELECT *, ts + to_seconds(horizon) AS at FROM h) h ASOF LEFT JOIN quotes q ON h.symbol = q.symbol AND h.at >= q.ts""")
def _(m):
    out = M.horizon_quotes(m.fills(), m.quotes(), (300, 3600, 86400))
    return out.select("seq", "horizon", "mid", F.col("quote_seq").cast("double").alias("quote_seq"))


@query("strict_asof", "2.3.3", """
SELECT @I(t.seq) AS seq, @R(q.px) AS prev_px FROM ticks t ASOF LEFT JOIN ticks q ON t.symbol = q.symbol AND t.ts > q.ts""")
def _(m):
    t = m.ticks()
    prev = t.select("symbol", "ts", "seq", F.col("px").alias("prev_px"))
    return J.asof_join(t, prev, ["symbol"], ["prev_px"], strict=True).select("seq", "prev_px")


@query("trailing_window_sums", "2.3.4", """
SELECT @I(f.seq) AS seq, @R(sum(q.bid_sz)) AS bid_sum, @R(count(q.seq)) AS n FROM fills f LEFT JOIN quotes q ON f.symbol = q.symbol AND q.ts >= f.ts - INTERVAL 12 HOUR AND q.ts < f.ts GROUP BY f.seq""")
def _(m):
    q = m.quotes().withColumn("one", F.lit(1))
    out = J.trailing_sums(m.fills(), q, ["symbol"], {"bid_sum": "bid_sz", "n": "one"}, 12 * 3600, bucket_s=86400)
    return out.select("seq", F.col("bid_sum").cast("double").alias("bid_sum"), F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("n"))


@query("range_join_pairs", "2.3.4", """
SELECT @I(f.seq) AS seq, count(*) AS n, @R(max(q.bid)) AS best FROM fills f JOIN quotes q ON f.symbol = q.symbol AND q.ts >= f.ts AND q.ts < f.ts + INTERVAL 4 HOUR GROUP BY f.seq""")
def _(m):
    near = J.ahead_aggregates(m.fills(), m.quotes(), ["symbol"], {"n": ("bid", F.count), "best": ("bid", F.max)}, 4 * 3600, bucket_s=86400)
    return near.filter("n > 0").select("seq", "n", "best")


@query("point_in_time_facts", "2.3.5 2.20.26", """
WITH d AS (SELECT DISTINCT symbol, date FROM daily), f AS (SELECT symbol, filed, last(val ORDER BY row_id) AS val FROM facts GROUP BY 1, 2), k AS (SELECT DISTINCT symbol FROM facts),
j AS (SELECT d.symbol, d.date, f.val, f.filed, k.symbol IS NOT NULL AS listed FROM d ASOF LEFT JOIN f ON d.symbol = f.symbol AND d.date >= f.filed LEFT JOIN k ON k.symbol = d.symbol)
SELECT symbol, @D(date) AS date, @R(val) AS val, @D(filed) AS filed_on, CASE WHEN NOT listed THEN 'no_facts' WHEN val IS NULL THEN 'before_first_filing' WHEN date - filed > 200 THEN 'stale' ELSE 'known' END AS status FROM j""")
def _(m):
    return Y.facts_known(m.daily().select("symbol", "date"), m.facts(), 200).select("symbol", "date", "val", "filed_on", "status")


@query("latest_filed_per_period", "2.3.6 2.20.106", """
SELECT symbol, @D(date_trunc('month', period_end)) AS period, @R(arg_max(val, (filed, row_id))) AS val, @D(max(filed)) AS filed FROM facts WHERE filed <= DATE '2000-06-30' GROUP BY 1, date_trunc('month', period_end)""")
def _(m):
    f = m.facts().filter(F.col("filed") <= F.lit("2000-06-30").cast("date")).withColumn("period", F.trunc("period_end", "month"))
    return f.groupBy("symbol", "period").agg(F.max_by("val", F.struct("filed", "row_id")).alias("val"), F.max("filed").alias("filed"))


@query("membership_join", "2.3.7 2.1.15", """
SELECT d.symbol, @D(d.date) AS date, @D(s.start) AS start, @D(s."end") AS "end" FROM daily d JOIN spells s ON d.symbol = s.symbol AND d.date >= s.start AND (s."end" IS NULL OR d.date < s."end")""")
def _(m):
    return J.interval_join(m.daily().select("symbol", "date"), m.spells(), ["symbol"], "date")


view("labelled_events", """SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 3 = 0 THEN 'A' WHEN o_orderkey % 3 = 1 THEN 'B' ELSE 'SHELF' END AS kind FROM orders""")


def labelled_events(m):
    k = F.col("o_orderkey") % 3
    return m.table("orders").select(F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").alias("day"),
                                    F.when(k == 0, "A").when(k == 1, "B").otherwise("SHELF").alias("kind"))


@query("trailing_event_labels", "2.3.8", """
WITH p AS (SELECT DISTINCT symbol, date FROM daily)
SELECT p.symbol, @D(p.date) AS date, @I(coalesce(bool_or(kind = 'A' AND day > date - 2), false)) AS trigger_a, @I(coalesce(bool_or(kind = 'B' AND day > date - 30), false)) AS trigger_b,
 @I(count(*) FILTER (kind = 'SHELF' AND day > date - 90) >= 2) AS shelf, CASE WHEN max(day) FILTER (kind = 'A') IS NULL THEN 'none' WHEN date - max(day) FILTER (kind = 'A') < 2 THEN 'fresh' WHEN date - max(day) FILTER (kind = 'A') < 30 THEN 'month' ELSE 'quarter' END AS recency
FROM p LEFT JOIN labelled_events e ON CAST(e.o_custkey AS VARCHAR) = p.symbol AND day <= date AND day > date - 90 GROUP BY p.symbol, p.date""")
def _(m):
    return Y.trailing_event_labels(m.daily().select("symbol", "date").distinct(), labelled_events(m))


@query("event_in_window", "2.3.9", """
SELECT @I(trade_id) AS trade_id, CASE WHEN count(t.seq) > 0 THEN 'NEWS' ELSE 'NONE' END AS tag, @R(min(t.seq)) AS first_event FROM ledger l
LEFT JOIN ticks t ON t.symbol = l.symbol AND t.market = 'error' AND t.ts >= l.entry_ts - INTERVAL 2 DAY AND t.ts < l.entry_ts GROUP BY 1""")
def _(m):
    ev = m.ticks().filter("market = 'error'").select("symbol", F.col("ts").alias("e_ts"), F.col("seq").alias("event_seq"))
    lo = F.timestamp_micros(clock.micros("entry_ts") - 2 * 86400 * 1_000_000)
    led = m.ledger().select("trade_id", "symbol", "entry_ts")
    hit = J.range_join(led, ev, ["symbol"], lo, F.col("entry_ts"), "e_ts", bin_s=86400, how="left")
    return hit.groupBy("trade_id").agg(F.when(F.count("event_seq") > 0, "NEWS").otherwise("NONE").alias("tag"), F.min("event_seq").cast("double").alias("first_event"))


@query("mid_hold_events", "2.3.10", """
SELECT @I(trade_id) AS trade_id, @I(bool_or(t.seq IS NOT NULL AND t.ts <= l.entry_ts)) AS before, @I(bool_or(t.seq IS NOT NULL AND t.ts > l.entry_ts) AND NOT bool_or(t.seq IS NOT NULL AND t.ts <= l.entry_ts)) AS mid_hold FROM ledger l
LEFT JOIN ticks t ON t.symbol = l.symbol AND t.market = 'error' AND t.ts >= l.entry_ts - INTERVAL 1 DAY AND t.ts <= l.exit_ts GROUP BY 1""")
def _(m):
    ev = m.ticks().filter("market = 'error'").select("symbol", "ts", "seq", F.col("ts").alias("e_ts"))
    led = m.ledger().withColumn("seq", F.col("trade_id")).withColumn("ts", F.col("entry_ts"))
    a = J.asof_join(led, ev, ["symbol"], ["e_ts"], bucket_s=86400).withColumnRenamed("e_ts", "at_entry").withColumn("ts", F.col("exit_ts"))
    b = J.asof_join(a, ev, ["symbol"], ["e_ts"], bucket_s=86400)
    day = 86400 * 1_000_000
    before = F.coalesce(clock.micros("at_entry") >= clock.micros("entry_ts") - day, F.lit(False))
    inside = F.coalesce(F.col("e_ts") > F.col("entry_ts"), F.lit(False))
    return b.select("trade_id", before.alias("before"), (inside & ~before).alias("mid_hold"))


@query("event_day_windows", "2.3.11", """
WITH d AS (SELECT session_date, row_number() OVER (ORDER BY session_date) AS k FROM (SELECT DISTINCT session_date FROM ticks)), e AS (SELECT k FROM d WHERE dayofweek(session_date) = 3)
SELECT part, count(*) AS trades, @R(sum(net)) AS net FROM (SELECT CASE d.k - e.k WHEN -1 THEN 'W0' WHEN 0 THEN 'W1' ELSE 'W2' END AS part, net FROM ledger JOIN d USING (session_date) JOIN e ON d.k - e.k IN (-1, 0, 1)) GROUP BY 1""")
def _(m):
    days = m.ticks().select(F.col("session_date").alias("date")).distinct().withColumn("ordinal", F.row_number().over(Window.partitionBy().orderBy("date")))
    events = days.filter(F.dayofweek("date") == 4).select(F.col("ordinal").alias("event_ordinal"))
    return Y.event_windows(m.ledger(), days, events).groupBy("part").agg(F.count(F.lit(1)).alias("trades"), F.sum("net").alias("net"))


view("halts", """WITH s AS (SELECT *, market = 'error' AS h FROM ticks), a AS (SELECT *, CASE WHEN h AND NOT coalesce(lag(h) OVER w, false) THEN 1 ELSE 0 END AS turn FROM s WINDOW w AS (PARTITION BY symbol, session_date ORDER BY ts, seq)),
 b AS (SELECT *, sum(turn) OVER (PARTITION BY symbol, session_date ORDER BY ts, seq) AS run FROM a)
 SELECT symbol, session_date, min(minute) FILTER (h) AS start_minute, coalesce(min(minute) FILTER (NOT h), 1200) AS end_minute, min(ts) FILTER (h) AS halted_at FROM b WHERE run > 0 GROUP BY symbol, session_date, run""")


@query("halt_intervals", "2.11.14", """SELECT symbol, @D(session_date) AS session_date, @I(start_minute) AS start_minute, @I(end_minute) AS end_minute, @T(halted_at) AS halted_at FROM halts""")
def _(m):
    return M.halts(m.status()).select("symbol", "session_date", "start_minute", "end_minute", "halted_at")


@query("trades_through_halts", "2.3.12 2.20.36", """
SELECT @I(trade_id) AS trade_id, @I(coalesce(bool_or(start_minute BETWEEN entry_minute AND exit_minute), false)) AS halted_inside, @I(coalesce(bool_or(end_minute = exit_minute), false)) AS exit_on_resume
FROM ledger LEFT JOIN halts USING (symbol, session_date) GROUP BY 1""")
def _(m):
    return M.trades_in_halts(m.ledger(), M.halts(m.status()))


@query("match_preceding_alert", "2.3.13", """
WITH RECURSIVE e AS (SELECT symbol, side AS action, session_date, ts, 1 AS o, seq FROM fills UNION ALL SELECT symbol, CASE WHEN seq % 2 = 0 THEN 'BUY' ELSE 'SELL' END, session_date, ts, 0, seq FROM quotes),
k AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY symbol, action, session_date ORDER BY ts, o, seq) AS k FROM e),
r AS (
 SELECT symbol, action, session_date, k, o, seq, CASE WHEN o = 0 THEN [{'s': seq, 't': us}] ELSE [] END AS waiting, CAST(NULL AS BIGINT) AS rid, CAST(NULL AS BIGINT) AS dt_us FROM k WHERE k = 1
 UNION ALL
 SELECT k.symbol, k.action, k.session_date, k.k, k.o, k.seq,
  CASE WHEN k.o = 0 THEN list_append(r.waiting, {'s': k.seq, 't': k.us}) WHEN len(r.waiting) > 0 AND k.us - r.waiting[-1].t <= 21600000000 THEN r.waiting[1:len(r.waiting) - 1] ELSE r.waiting END,
  CASE WHEN k.o = 1 AND len(r.waiting) > 0 AND k.us - r.waiting[-1].t <= 21600000000 THEN r.waiting[-1].s END, CASE WHEN k.o = 1 AND len(r.waiting) > 0 AND k.us - r.waiting[-1].t <= 21600000000 THEN k.us - r.waiting[-1].t END
 FROM r JOIN k ON k.symbol = r.symbol AND k.action = r.action AND k.session_date = r.session_date AND k.k = r.k + 1)
SELECT symbol, action, @I(seq) AS lid, @I(rid) AS rid, dt_us FROM r WHERE o = 1
UNION ALL SELECT symbol, action, NULL, @I(seq), NULL FROM k WHERE o = 0 AND seq NOT IN (SELECT rid FROM r WHERE rid IS NOT NULL)""")
def _(m):
    f = m.fills().withColumn("left_id", F.col("seq")).withColumn("action", F.col("side"))
    a = m.quotes().withColumn("right_id", F.col("seq")).withColumn("action", F.when(F.col("seq") % 2 == 0, "BUY").otherwise("SELL"))
    return J.pair_up(f, a, ["symbol", "action", "session_date"], TOL, mode="preceding").select("symbol", "action", "lid", "rid", "dt_us")


@query("match_nearest_pairs", "2.3.14", """
WITH RECURSIVE c AS (
 SELECT l.symbol, l.session_date, l.seq AS lid, s.seq AS rid, epoch_us(s.ts) - epoch_us(l.ts) AS dt, row_number() OVER (PARTITION BY l.symbol, l.session_date ORDER BY abs(epoch_us(s.ts) - epoch_us(l.ts)), l.ts, l.seq, s.ts, s.seq) AS k
 FROM fills l JOIN fills s ON l.symbol = s.symbol AND l.session_date = s.session_date AND l.side = 'BUY' AND s.side = 'SELL' AND abs(epoch_us(s.ts) - epoch_us(l.ts)) <= 21600000000),
r AS (
 SELECT symbol, session_date, k, lid, rid, dt, TRUE AS took, [lid] AS ls, [rid] AS rs FROM c WHERE k = 1
 UNION ALL
 SELECT c.symbol, c.session_date, c.k, c.lid, c.rid, c.dt, NOT list_contains(r.ls, c.lid) AND NOT list_contains(r.rs, c.rid),
  CASE WHEN NOT list_contains(r.ls, c.lid) AND NOT list_contains(r.rs, c.rid) THEN list_append(r.ls, c.lid) ELSE r.ls END, CASE WHEN NOT list_contains(r.ls, c.lid) AND NOT list_contains(r.rs, c.rid) THEN list_append(r.rs, c.rid) ELSE r.rs END
 FROM r JOIN c ON c.symbol = r.symbol AND c.session_date = r.session_date AND c.k = r.k + 1),
p AS (SELECT * FROM r WHERE took)
SELECT symbol, @I(lid) AS lid, @I(rid) AS rid, @I(dt) AS dt_us FROM p
UNION ALL SELECT symbol, @I(seq), NULL, NULL FROM fills WHERE side = 'BUY' AND seq NOT IN (SELECT lid FROM p)
UNION ALL SELECT symbol, NULL, @I(seq), NULL FROM fills WHERE side = 'SELL' AND seq NOT IN (SELECT rid FROM p)""")
def _(m):
    f = m.fills()
    live = f.filter("side = 'BUY'").withColumn("left_id", F.col("seq"))
    sim = f.filter("side = 'SELL'").withColumn("right_id", F.col("seq"))
    return J.pair_up(live, sim, ["symbol", "session_date"], TOL).select("symbol", "lid", "rid", "dt_us")


@query("bar_diff_two_tapes", "2.3.15 2.20.38 2.20.78", """
WITH a AS (SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, last(px ORDER BY ts, seq) AS close, sum(size) AS v FROM (SELECT market AS symbol, ts, seq, px, size FROM ticks WHERE seq % 3 <> 0) GROUP BY 1, 2),
b AS (SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, last(px ORDER BY ts, seq) AS close, sum(size) AS v FROM (SELECT market AS symbol, ts, seq, px, size FROM ticks WHERE seq % 4 <> 0) GROUP BY 1, 2)
SELECT symbol, count(*) FILTER (a.ts IS NOT NULL AND b.ts IS NOT NULL) AS "both", count(*) FILTER (b.ts IS NULL) AS only_a, count(*) FILTER (a.ts IS NULL) AS only_b,
 @R(avg(abs(a.close - b.close))) AS mean_abs, @R(sum(a.v) / sum(b.v)) AS volume_ratio FROM a FULL JOIN b USING (symbol, ts) GROUP BY 1""")
def _(m):
    from tidemark.operators.bars import resample_ticks
    t = m.market_ticks()
    return Y.bar_diff(resample_ticks(t.filter("seq % 3 <> 0"), 300), resample_ticks(t.filter("seq % 4 <> 0"), 300))


@query("minute_day_conflicts", "2.3.16 2.20.79", """
WITH d AS (SELECT symbol, session_date, max(px) AS hi, min(px) AS lo FROM ticks WHERE seq % 5 <> 0 GROUP BY 1, 2), b AS (SELECT symbol, session_date, max(high) AS bh, min(low) AS bl FROM sbars1 GROUP BY 1, 2)
SELECT symbol, @D(session_date) AS session_date, @R(greatest(bh - hi, 0)) AS above, @R(greatest(lo - bl, 0)) AS below FROM b JOIN d USING (symbol, session_date)
WHERE bh - hi > greatest(0.01, 0.005 * (hi - lo)) OR lo - bl > greatest(0.01, 0.005 * (hi - lo))""")
def _(m):
    d = m.ticks().filter("seq % 5 <> 0").groupBy("symbol", "session_date").agg(F.max("px").alias("hi"), F.min("px").alias("lo"))
    return Y.tape_conflicts(m.symbol_bars(1), d)


@query("prior_close_with_source", "2.3.17", """
WITH r AS (SELECT symbol, date, CASE WHEN volume % 4 = 0 THEN open ELSE close END AS c, CASE WHEN volume % 4 = 0 THEN 'repaired' ELSE 'daily' END AS src FROM daily)
SELECT symbol, @D(date) AS date, @R(lag(c) OVER w) AS prior_close, lag(src) OVER w AS prior_source FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def _(m):
    d = m.daily()
    fixed = d.filter("volume % 4 = 0").select("symbol", "date", F.col("open").alias("close"))
    return S.prior_closes(d, fixed)


@query("strict_cover_join", "2.3.18", """
WITH v AS (SELECT trade_id FROM ledger WHERE trade_id % 10 <> 0 UNION ALL SELECT trade_id FROM ledger WHERE trade_id % 25 = 1)
SELECT count(*) FILTER (n = 0) AS missing, count(*) FILTER (n > 1) AS duplicated, count(*) FILTER (n = 1) AS matched FROM (SELECT l.trade_id, count(v.trade_id) AS n FROM ledger l LEFT JOIN v USING (trade_id) GROUP BY 1)""")
def _(m):
    led = m.ledger().select("trade_id")
    v = led.filter("trade_id % 10 <> 0").unionByName(led.filter("trade_id % 25 = 1"))
    return Y.cover_check(led, v, "trade_id").select("missing", "duplicated", "matched")


@query("completed_higher_timeframe", "2.3.19", """
WITH w AS (SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS wk, last(close ORDER BY date) AS wclose FROM daily GROUP BY 1, 2)
SELECT d.symbol, @D(d.date) AS date, @R(w.wclose) AS weekly_close FROM daily d ASOF LEFT JOIN w ON d.symbol = w.symbol AND CAST(date_trunc('week', d.date) AS DATE) > w.wk""")
def _(m):
    from tidemark.operators import bars as B
    d = m.daily()
    wk = d.withColumn("wk", F.date_trunc("week", "date").cast("date"))
    weekly = B.coarsen(wk, ["symbol", "wk"], "date").select("symbol", F.date_add("wk", 7).alias("available_at"), F.col("close").alias("weekly_close"))
    return Y.asof_daily(d.select("symbol", "date"), weekly, "available_at", ["weekly_close"])


@query("semi_anti_membership", "2.3.20", """
WITH a AS (SELECT DISTINCT symbol, session_date FROM fills WHERE side = 'BUY'), b AS (SELECT DISTINCT symbol, session_date FROM fills WHERE side = 'SELL')
SELECT symbol, @D(session_date) AS session_date FROM a ANTI JOIN b USING (symbol, session_date)""")
def _(m):
    f = m.fills().select("symbol", "session_date", "side")
    return f.filter("side = 'BUY'").drop("side").distinct().join(f.filter("side = 'SELL'"), ["symbol", "session_date"], "left_anti")


@query("paired_trades", "2.3.21 2.20.18", """
WITH o AS (SELECT trade_id, net * 0.5 + 3 AS net FROM ledger WHERE trade_id % 6 <> 0)
SELECT @I(l.trade_id) AS trade_id, @R(o.net - l.net) AS delta FROM ledger l JOIN o USING (trade_id)""")
def _(m):
    a = m.ledger().select("trade_id", "net")
    b = a.filter("trade_id % 6 <> 0").select("trade_id", (F.col("net") * 0.5 + 3).alias("other"))
    return a.join(b, "trade_id").select("trade_id", (F.col("other") - F.col("net")).alias("delta"))


@query("cost_model_lookup", "2.3.22", """
WITH c AS (SELECT entry_minute // 30 AS slot, avg((ask - bid) / nullif(bid, 0)) * 1e4 / 2 AS half_bps FROM (SELECT q.bid, q.ask, t.minute AS entry_minute FROM quotes q JOIN ticks t USING (seq)) GROUP BY 1)
SELECT @I(trade_id) AS trade_id, @R(entry_px * qty * half_bps / 1e4) AS entry_cost FROM ledger l JOIN c ON l.entry_minute // 30 = c.slot""")
def _(m):
    slot = F.floor(F.col("entry_minute") / 30).alias("slot")
    q = m.quotes().withColumn("entry_minute", clock.minute_of_day("ts"))
    c = q.groupBy(slot).agg((F.avg(F.try_divide(F.col("ask") - F.col("bid"), F.col("bid"))) * 1e4 / 2).alias("half_bps"))
    led = m.ledger().withColumn("slot", F.floor(F.col("entry_minute") / 30))
    return led.join(F.broadcast(c), "slot").select("trade_id", (F.col("entry_px") * F.col("qty") * F.col("half_bps") / 1e4).alias("entry_cost"))


@query("interval_mapping", "2.1.4", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start) AS k FROM spells)
SELECT d.symbol, @D(d.date) AS date, d.symbol || '-' || CAST(k AS VARCHAR) AS ticker FROM daily d JOIN n ON d.symbol = n.symbol AND d.date >= n.start AND (n."end" IS NULL OR d.date < n."end")""")
def _(m):
    k = F.row_number().over(Window.partitionBy("symbol").orderBy("start"))
    names = m.spells().withColumn("ticker", F.concat_ws("-", "symbol", k.cast("string")))
    return J.interval_join(m.daily().select("symbol", "date"), names, ["symbol"], "date").select("symbol", "date", "ticker")


# ---- microstructure

view("positions", """WITH a AS (SELECT *, CASE WHEN side = 'BUY' THEN qty ELSE -qty END AS signed_qty FROM fills), b AS (SELECT *, sum(signed_qty) OVER (PARTITION BY symbol ORDER BY ts, seq) AS pos_after FROM a),
 c AS (SELECT *, pos_after - signed_qty AS pos_before FROM b)
 SELECT *, sum(CASE WHEN pos_before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, seq) AS position, CASE WHEN abs(pos_after) > abs(pos_before) THEN 'entry' ELSE 'exit' END AS role FROM c""")


@query("fill_positions", "2.11.3", "SELECT @I(seq) AS seq, @I(pos_after) AS pos_after, @I(position) AS position, role FROM positions")
def _(m):
    return M.assign_positions(m.fills()).select("seq", "pos_after", "position", "role")


# Fills whose sizes are one share, so that positions close often.
view("unit_positions", """WITH a AS (SELECT *, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS signed_qty FROM fills), b AS (SELECT *, sum(signed_qty) OVER (PARTITION BY symbol ORDER BY ts, seq) AS pos_after FROM a),
 c AS (SELECT *, pos_after - signed_qty AS pos_before FROM b)
 SELECT *, sum(CASE WHEN pos_before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, seq) AS position, CASE WHEN abs(pos_after) > abs(pos_before) THEN 'entry' ELSE 'exit' END AS role FROM c""")


def unit_positions(m):
    return M.assign_positions(m.fills().withColumn("qty", F.lit(1).cast("bigint")))


@query("flat_to_flat_round_trips", "2.11.3 2.4.8", """
SELECT symbol, @I(position) AS position, @T(min(ts)) AS opened, @T(max(ts)) AS last_fill, count(*) AS fills, @I(max(abs(pos_after))) AS max_position,
 @R(avg(price) FILTER (role = 'entry')) AS avg_entry, @R(avg(price) FILTER (role = 'exit')) AS avg_exit, @R(sum(-signed_qty * price)) AS cash, @I(sum(signed_qty) <> 0) AS open_at_end FROM unit_positions GROUP BY symbol, position""")
def _(m):
    return M.round_trips(unit_positions(m)).drop("shares")


# Fills of one to three shares: a position is entered, added to, reduced and reversed by parts.
view("sized_positions", """WITH a AS (SELECT *, CASE WHEN side = 'BUY' THEN seq % 3 + 1 ELSE -(seq % 3 + 1) END AS signed_qty FROM fills), b AS (SELECT *, sum(signed_qty) OVER (PARTITION BY symbol ORDER BY ts, seq) AS pos_after FROM a),
 c AS (SELECT *, pos_after - signed_qty AS pos_before FROM b)
 SELECT *, sum(CASE WHEN pos_before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, seq) AS position, CASE WHEN abs(pos_after) > abs(pos_before) THEN 'entry' ELSE 'exit' END AS role FROM c""")


@query("markout_identity", "2.11.4 2.20.32", """
WITH a AS (SELECT p.*, (q.bid + q.ask) / 2 AS m0 FROM sized_positions p ASOF LEFT JOIN quotes q ON p.symbol = q.symbol AND p.ts >= q.ts),
b AS (SELECT a.*, (q.bid + q.ask) / 2 AS mh FROM (SELECT *, ts + INTERVAL 1 HOUR AS at FROM a) a ASOF LEFT JOIN quotes q ON a.symbol = q.symbol AND a.at >= q.ts),
g AS (SELECT symbol, position, count(*) AS fills, count(m0) AS priced, sum(signed_qty) AS open_qty, sum(-signed_qty * price) AS gross, sum(signed_qty * (m0 - price)) AS spread,
 sum(CASE WHEN role = 'entry' THEN signed_qty * (mh - m0) ELSE 0 END) AS drift_in, sum(CASE WHEN role = 'exit' THEN signed_qty * (mh - m0) ELSE 0 END) AS drift_out FROM b GROUP BY 1, 2)
SELECT symbol, @I(position) AS position, fills, @R(gross) AS gross, @R(spread) AS spread, @R(drift_in) AS drift_in, @R(drift_out) AS drift_out, @R(gross - spread - drift_in - drift_out) AS rest FROM g WHERE fills = priced AND open_qty = 0""")
def _(m):
    priced = M.horizon_quotes(M.assign_positions(m.fills().withColumn("qty", F.col("seq") % 3 + 1)), m.quotes(), (3600,))
    keys = ["symbol", "position", "seq", "role", "signed_qty", "price"]
    wide = priced.groupBy(*keys).agg(F.max(F.when(F.col("horizon") == 0, F.col("mid"))).alias("mid_0"), F.max(F.when(F.col("horizon") == 3600, F.col("mid"))).alias("mid_h"))
    return M.markout_identity(wide)


@query("leg_costs", "2.11.2 2.20.29", """
WITH l AS (SELECT CASE WHEN side = 'BUY' THEN 'ENTRY' WHEN seq % 5 < 2 THEN 'TRAIL' WHEN seq % 5 < 4 THEN 'WCLOSE' ELSE 'OTHER' END AS leg, abs(price - round(price, 0)) AS cost FROM fills), p AS (SELECT leg, count(*) AS n, avg(cost) AS own, sum(cost) AS s FROM l GROUP BY 1)
SELECT leg, n, @R(CASE WHEN n >= 500 THEN own ELSE (SELECT sum(s) / sum(n) FROM p) END) AS cost, @I(n < 500) AS fallback FROM p""")
def _(m):
    reason = F.when(F.col("seq") % 5 < 2, "stop").when(F.col("seq") % 5 < 4, "time").otherwise("x")
    legs = m.fills().select(M.leg_class(reason, F.col("side")).alias("leg"), F.abs(F.col("price") - F.round("price", 0)).alias("cost"))
    return M.leg_costs(legs, 500)


@query("sell_paired_with_buy", "2.11.5 2.20.10", """
SELECT @I(s.seq) AS seq, @R(b.price) AS buy_px, @R((s.price - b.price) * b.qty) AS pnl FROM (SELECT * FROM fills WHERE side = 'SELL') s ASOF LEFT JOIN (SELECT * FROM fills WHERE side = 'BUY') b ON s.symbol = b.symbol AND s.ts > b.ts""")
def _(m):
    return M.pair_sells(m.fills()).select("seq", "buy_px", ((F.col("price") - F.col("buy_px")) * F.col("buy_qty")).alias("pnl"))


@query("decision_to_fill_split", "2.11.6", """
WITH j AS (SELECT f.seq, f.side, f.price, t.px AS alert_px, t.ts AS ats, f.symbol FROM fills f ASOF JOIN ticks t ON f.symbol = t.symbol AND f.ts > t.ts), k AS (SELECT j.*, q.bid AS ref_px, b.px AS bar_close FROM j ASOF JOIN quotes q ON j.symbol = q.symbol AND j.ats >= q.ts ASOF JOIN ticks b ON j.symbol = b.symbol AND j.ats > b.ts)
SELECT @I(seq) AS seq, @R(s * (alert_px - bar_close)) AS bar_gap, @R(s * (ref_px - alert_px)) AS drift, @R(s * (price - ref_px)) AS execution, @R(s * (price - bar_close)) AS total FROM (SELECT *, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS s FROM k)""")
def _(m):
    t = m.ticks().select("symbol", "ts", "seq", F.col("px").alias("alert_px"), F.col("ts").alias("alert_ts"))
    j = J.asof_join(m.fills(), t, ["symbol"], ["alert_px", "alert_ts"], strict=True, bucket_s=86400).filter("alert_ts is not null").withColumn("ts", F.col("alert_ts"))
    j = J.asof_join(j, m.quotes().withColumn("ref_px", F.col("bid")), ["symbol"], ["ref_px"], bucket_s=86400)
    j = J.asof_join(j, t.withColumnRenamed("alert_px", "bar_close"), ["symbol"], ["bar_close"], strict=True, bucket_s=86400)
    return M.decision_to_fill(j.filter("ref_px is not null and bar_close is not null")).select("seq", "bar_gap", "drift", "execution", "total")


@query("time_weighted_imbalance", "2.11.7", """
WITH q AS (SELECT symbol, ts, (bid_sz - ask_sz) / (bid_sz + ask_sz)::DOUBLE AS w, CASE WHEN bid > 0 AND ask > bid THEN w END AS v, lead(ts) OVER (PARTITION BY symbol ORDER BY ts, seq) AS nx FROM quotes),
j AS (SELECT f.seq, q.v, date_diff('microsecond', greatest(q.ts, f.ts - INTERVAL 6 HOUR), least(coalesce(q.nx, f.ts), f.ts)) / 1e6 AS d FROM fills f JOIN q ON q.symbol = f.symbol AND q.ts < f.ts AND coalesce(q.nx, f.ts) > f.ts - INTERVAL 6 HOUR)
SELECT @I(f.seq) AS seq, @R(sum(v * d) / nullif(sum(d) FILTER (v IS NOT NULL), 0)) AS imbalance FROM fills f LEFT JOIN j USING (seq) GROUP BY f.seq""", digits=4)
def _(m):
    return M.quote_imbalance(m.fills(), m.quotes(), 6 * 3600, bucket_s=86400).select("seq", "imbalance")


view("flows", """SELECT *, CASE WHEN pb IS NULL THEN 0 ELSE CASE WHEN bid >= pb THEN bid_sz ELSE 0 END - CASE WHEN bid <= pb THEN pbs ELSE 0 END - CASE WHEN ask <= pa THEN ask_sz ELSE 0 END + CASE WHEN ask >= pa THEN pas ELSE 0 END END AS flow FROM
 (SELECT *, lag(bid) OVER w AS pb, lag(ask) OVER w AS pa, lag(bid_sz) OVER w AS pbs, lag(ask_sz) OVER w AS pas FROM quotes WHERE bid > 0 AND ask > bid WINDOW w AS (PARTITION BY symbol, session_date ORDER BY ts, seq))""")


@query("order_flow_imbalance", "2.11.8", """
SELECT @I(f.seq) AS seq, @R(sum(flow)) AS flow FROM fills f LEFT JOIN flows q ON q.symbol = f.symbol AND q.ts >= f.ts - INTERVAL 6 HOUR AND q.ts < f.ts GROUP BY f.seq""")
def _(m):
    e = M.flow_events(m.quotes())
    return J.trailing_sums(m.fills(), e, ["symbol"], {"flow": "flow"}, 6 * 3600, bucket_s=86400).select("seq", F.col("flow").cast("double").alias("flow"))


@query("quote_rule_sides", "2.11.9", """
SELECT symbol, rule_side, count(*) AS n, @I(sum(size)) AS volume FROM (SELECT t.symbol, t.size, CASE WHEN t.px >= q.ask THEN 'B' WHEN t.px <= q.bid THEN 'A' ELSE 'N' END AS rule_side
 FROM (SELECT * FROM ticks WHERE market IN ('purchase', 'signup')) t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts > q.ts) GROUP BY 1, 2""")
def _(m):
    t = m.ticks().filter("market in ('purchase', 'signup')")
    return M.quote_rule(t, m.quotes(), bucket_s=86400).groupBy("symbol", "rule_side").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"))


view("books", """SELECT symbol, ts, seq, bid, ask, ask_sz + 3 * (seq % 7) AS ask_depth, (bid_sz + 2 * (seq % 5) - (ask_sz + 3 * (seq % 7))) / (bid_sz + 2 * (seq % 5) + ask_sz + 3 * (seq % 7))::DOUBLE AS imbalance FROM quotes""")


def books(m):
    k = F.col("seq")
    lv = F.array(F.struct(F.col("bid_sz").cast("double").alias("bid_sz"), F.col("ask_sz").cast("double").alias("ask_sz")),
                 F.struct((2 * (k % 5)).cast("double").alias("bid_sz"), (3 * (k % 7)).cast("double").alias("ask_sz")))
    b = m.quotes().withColumn("levels", lv)
    return b.withColumn("ask_depth", F.aggregate("levels", F.lit(0.0), lambda a, x: a + x["ask_sz"])).withColumn("imbalance", M.depth_imbalance())


@query("depth_features", "2.11.10", """
WITH a AS (SELECT f.seq, f.symbol, f.ts, b.ask_depth AS dn, b.imbalance, (b.ask - b.bid) / ((b.ask + b.bid) / 2) * 100 AS sp FROM fills f ASOF LEFT JOIN books b ON f.symbol = b.symbol AND f.ts > b.ts)
SELECT @I(a.seq) AS seq, @R(dn) AS depth_now, @R(sp) AS spread_pct, @R(dn / nullif(b.ask_depth, 0)) AS depth_ratio FROM (SELECT *, ts - INTERVAL 6 HOUR AS back FROM a) a ASOF LEFT JOIN books b ON a.symbol = b.symbol AND a.back >= b.ts""")
def _(m):
    return M.depth_change(m.fills(), books(m), 6 * 3600, bucket_s=86400).select("seq", F.col("depth_now").cast("double").alias("depth_now"), "spread_pct", "depth_ratio")


@query("depth_imbalance", "2.11.10", "SELECT @I(seq) AS seq, @R(imbalance) AS imbalance FROM books")
def _(m):
    return books(m).select("seq", "imbalance")


@query("book_repriced_trades", "2.11.11 2.20.60", """
WITH a AS (SELECT l.*, q.ask AS ask_in, q.ts AS q_in FROM ledger l ASOF JOIN quotes q ON l.symbol = q.symbol AND l.entry_ts >= q.ts)
SELECT @I(trade_id) AS trade_id, @R((b.bid - ask_in) * qty) AS book_pnl, @R(a.gross - (b.bid - ask_in) * qty) AS shortfall, @R(date_diff('microsecond', b.ts, exit_ts) / 1e6) AS exit_age FROM a ASOF JOIN quotes b ON a.symbol = b.symbol AND a.exit_ts >= b.ts""")
def _(m):
    led = m.ledger().withColumn("seq", F.col("trade_id")).withColumn("ts", F.col("entry_ts"))
    q = m.quotes().withColumn("q_ts", F.col("ts"))
    a = J.asof_join(led, q, ["symbol"], ["ask"], bucket_s=86400).withColumnRenamed("ask", "ask_in").filter("ask_in is not null").withColumn("ts", F.col("exit_ts"))
    b = J.asof_join(a, q, ["symbol"], ["bid", "q_ts"], bucket_s=86400).filter("bid is not null")
    pnl = (F.col("bid") - F.col("ask_in")) * F.col("qty")
    return b.select("trade_id", pnl.alias("book_pnl"), (F.col("gross") - pnl).alias("shortfall"), clock.clock_seconds_between("exit_ts", "q_ts").alias("exit_age"))


@query("first_fill_at_limit", "2.11.12 2.20.30 2.20.21", """
WITH e AS (SELECT seq, symbol, ts, price * unnest([0.5, 0.9, 1.0]::DOUBLE[]) AS lim FROM fills WHERE side = 'SELL')
SELECT @I(e.seq) AS seq, @R(lim) AS limit_px, @T(min(q.ts)) AS filled_at, @R(arg_min(q.bid, q.ts)) AS fill_bid FROM e JOIN quotes q ON q.symbol = e.symbol AND q.ts >= e.ts AND q.ts < e.ts + INTERVAL 1 DAY AND q.bid >= lim AND q.bid_sz >= 10 GROUP BY e.seq, lim""")
def _(m):
    e = m.fills().filter("side = 'SELL'").withColumn("step", F.explode(F.array(F.lit(0.5), F.lit(0.9), F.lit(1.0))))
    return M.first_fill_at(e, m.quotes(), F.col("price") * F.col("step"), 86400, 10)


@query("fill_place_in_bar", "2.11.13 2.20.5 2.20.23", """
SELECT @I(f.seq) AS seq, @R((price - low) / nullif(high - low, 0)) AS place, @R(qty / volume) AS participation FROM (SELECT f.*, t.market FROM fills f JOIN ticks t USING (seq)) f JOIN bars5 b ON b.symbol = f.market AND b.ts = time_bucket(INTERVAL 5 MINUTE, f.ts)""")
def _(m):
    f = m.fills().join(m.ticks().select("seq", "market"), "seq").drop("symbol").withColumnRenamed("market", "symbol").withColumn("bar_ts", clock.floor_to("ts", 300))
    b = m.bars(5).select("symbol", F.col("ts").alias("bar_ts"), "high", "low", "volume")
    return f.join(b, ["symbol", "bar_ts"]).select("seq", F.try_divide(F.col("price") - F.col("low"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0))).alias("place"), (F.col("qty") / F.col("volume")).alias("participation"))


@query("tape_capture", "2.11.15 2.20.6 2.20.39", """
WITH c AS (SELECT unnest([480, 570, 720, 960]) AS cutoff), w AS (SELECT market, session_date, cutoff, sum(CASE WHEN minute < cutoff THEN size ELSE 0 END) AS whole, sum(CASE WHEN minute < cutoff AND seq % 3 <> 0 THEN size ELSE 0 END) AS own FROM ticks, c GROUP BY 1, 2, 3)
SELECT market AS symbol, @D(session_date) AS session_date, @I(cutoff) AS cutoff, @I(own) AS own, @I(whole) AS whole, @R(own / nullif(whole, 0)) AS ratio FROM w""")
def _(m):
    t = m.market_ticks().withColumnRenamed("size", "volume")
    return M.capture_ratio(t.filter("seq % 3 <> 0"), t, [480, 570, 720, 960])


@query("spike_bars", "2.11.16 2.20.80", """
SELECT symbol, count(*) FILTER (high > greatest(open, close) * 1.25 OR low * 1.25 < least(open, close)) AS spikes, count(*) AS bars,
 @R(quantile_cont(volume, 0.5) FILTER (minute BETWEEN 420 AND 479)) AS median_07, @I(max(volume) FILTER (minute BETWEEN 480 AND 484)) AS volume_0800 FROM bars5 GROUP BY 1""")
def _(m):
    b = m.bars()
    ok = b.groupBy("symbol").agg(F.count(F.when(M.spike_bars(), 1)).alias("spikes"), F.count(F.lit(1)).alias("bars"), F.max(F.when(F.col("minute").between(480, 484), F.col("volume"))).alias("volume_0800"))
    med = scale.exact_quantiles(b.filter("minute between 420 and 479"), ["symbol"], "volume", {"median_07": 0.5}).drop("n")
    return ok.join(med, "symbol", "left")


@query("isolated_bad_ticks", "2.11.17", """
WITH a AS (SELECT *, lag(px) OVER w AS p0, lead(px) OVER w AS p1, lead(ts) OVER w AS t1, avg(size) OVER (PARTITION BY symbol, session_date ORDER BY ts, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM ticks WINDOW w AS (PARTITION BY symbol, session_date ORDER BY ts, seq))
SELECT @I(seq) AS seq FROM a WHERE abs(px / nullif(p0, 0) - 1) > 0.5 AND abs(px / nullif(p1, 0) - 1) > 0.5 AND t1 <= ts + INTERVAL 1 HOUR AND size < near * 1.2""")
def _(m):
    return M.isolated_ticks(m.ticks()).filter("bad_tick").select("seq")


@query("slippage_quantiles", "2.11.1 2.20.34", """
WITH j AS (SELECT f.side, CASE WHEN side = 'BUY' THEN price - (bid + ask) / 2 ELSE (bid + ask) / 2 - price END AS slip FROM fills f ASOF JOIN usable_quotes q ON f.symbol = q.symbol AND f.ts >= q.ts WHERE q.ts >= f.ts - INTERVAL 6 HOUR)
SELECT side, count(*) AS n, @R(quantile_cont(slip, 0.25)) AS p25, @R(quantile_cont(slip, 0.5)) AS p50, @R(quantile_cont(slip, 0.75)) AS p75 FROM j GROUP BY 1""")
def _(m):
    return M.cost_quantiles(M.slippage(M.fill_quotes(m.fills(), m.quotes(), TOL)), ["side"], "slip_mid")


@query("quoted_spread_gate", "2.2.19 2.20.22", """
WITH b AS (SELECT symbol, ts, 0 AS seq FROM sbars1), j AS (SELECT b.symbol, b.ts, q.bid, q.ask, q.ts AS qt FROM b ASOF LEFT JOIN quotes q ON b.symbol = q.symbol AND b.ts >= q.ts), g AS (SELECT *, CASE WHEN qt >= ts - INTERVAL 1 HOUR THEN (ask - bid) / ((ask + bid) / 2) * 100 END AS sp FROM j)
SELECT symbol, @T(ts) AS ts, @R(sp) AS spread_pct, @I(coalesce(sp < 2.5, false)) AS allowed FROM g""")
def _(m):
    b = m.symbol_bars(1).select("symbol", "ts", F.lit(0).alias("seq"))
    q = J.asof_join(b, m.quotes(), ["symbol"], ["bid", "ask"], tolerance_s=3600)
    spread = F.try_divide(F.col("ask") - F.col("bid"), (F.col("ask") + F.col("bid")) / 2) * 100
    return q.select("symbol", "ts", spread.alias("spread_pct"), F.coalesce(spread < 2.5, F.lit(False)).alias("allowed"))
