"""Outcome labels (2.13) and ledger transforms (2.14)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import labels as L, ledger as B, recursive as R, windows as W
from tidemark.plans.registry import query, view

S = "PARTITION BY symbol, session_date ORDER BY ts"

view("nbars", f"SELECT *, row_number() OVER ({S}) AS i FROM bars5")
# Every eighth bar of a session is an entry at its close, with a stop and a target around it.
view("entries", """SELECT symbol, session_date, i, symbol || '|' || CAST(session_date AS VARCHAR) || '|' || CAST(i AS VARCHAR) AS entry_id, close AS entry_px, close * 0.6::DOUBLE AS stop_px, close * 1.8::DOUBLE AS target_px FROM nbars WHERE i % 8 = 1""")
view("touches", """SELECT e.symbol, e.session_date, e.entry_id, e.entry_px, e.i, b.i AS j, b.open AS bo, b.high AS bh, b.low AS bl, b.close AS bc, stop_px, target_px FROM entries e JOIN nbars b ON b.symbol = e.symbol AND b.session_date = e.session_date AND b.i > e.i""")
view("outcomes", """WITH c AS (SELECT *, CASE WHEN bl <= stop_px THEN 1 WHEN bh >= target_px THEN 2 WHEN j - i >= 30 THEN 3 END AS code FROM touches),
 p AS (SELECT *, CASE code WHEN 1 THEN least(stop_px, bo) WHEN 2 THEN greatest(target_px, bo) ELSE bc END AS px FROM c)
 SELECT symbol, session_date, entry_id, entry_px, any_value(i) AS i, coalesce(arg_min(px, j) FILTER (code IS NOT NULL), arg_max(bc, j)) AS exit_px,
  coalesce(CASE arg_min(code, j) FILTER (code IS NOT NULL) WHEN 1 THEN 'stop' WHEN 2 THEN 'target' WHEN 3 THEN 'time' END, 'end') AS reason, coalesce(min(j) FILTER (code IS NOT NULL), max(j)) - any_value(i) AS bars_held FROM p GROUP BY 1, 2, 3, 4""")


def nbars(m):
    return L.numbered(m.bars())


def entries(m):
    key = F.concat_ws("|", "symbol", F.col("session_date").cast("string"), F.col("i").cast("string"))
    return nbars(m).filter("i % 8 = 1").select("symbol", "session_date", "i", key.alias("entry_id"), F.col("close").alias("entry_px"),
                                               (F.col("close") * 0.6).alias("stop_px"), (F.col("close") * 1.8).alias("target_px"))


def outcomes(m):
    return L.first_touch(L.later_bars(entries(m), nbars(m), horizon=30), max_bars=30)


@query("first_touch_exit", "2.13.1 2.20.3 2.20.37", "SELECT entry_id, @R(exit_px) AS exit_px, reason, @I(bars_held) AS bars_held FROM outcomes")
def _(m):
    return outcomes(m).select("entry_id", "exit_px", "reason", "bars_held")


@query("trailing_stop_exit", "2.13.2 2.20.84 2.20.77", """
WITH t AS (SELECT *, greatest(entry_px, coalesce(max(bh) OVER (PARTITION BY entry_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), entry_px)) AS top FROM touches),
l AS (SELECT *, greatest(top * 0.5::DOUBLE, CASE WHEN top >= entry_px * 1.5 THEN entry_px * 1.1::DOUBLE ELSE top * 0.5::DOUBLE END) AS lev FROM t)
SELECT entry_id, @R(coalesce(arg_min(least(lev, bo), j) FILTER (bl <= lev), arg_max(bc, j))) AS exit_px, CASE WHEN count(*) FILTER (bl <= lev) > 0 THEN 'stop' ELSE 'end' END AS reason FROM l GROUP BY 1""")
def _(m):
    return L.trailing_exit(L.later_bars(entries(m), nbars(m)), 0.5, ratchet=(0.5, 0.1)).select("entry_id", "exit_px", "reason")


@query("bar_flag_exits", "2.13.3 2.20.46", f"""
WITH f AS (SELECT *, sum(CAST(close < open AS INT)) OVER ({S} ROWS 2 PRECEDING) = 3 AS rr FROM nbars), j AS (SELECT e.entry_id, b.i AS j, b.close AS bc, b.rr FROM entries e JOIN f b ON b.symbol = e.symbol AND b.session_date = e.session_date AND b.i > e.i)
SELECT entry_id, @R(coalesce(arg_min(bc, j) FILTER (rr), arg_max(bc, j))) AS exit_px, CASE WHEN count(*) FILTER (rr) > 0 THEN 'signal' ELSE 'end' END AS reason FROM j GROUP BY 1""")
def _(m):
    b = L.exit_flags(L.numbered(R.with_indicators(m.bars(), ["ema9"], W.SESSION, "ts")))
    return L.flag_exit(L.later_bars(entries(m), b, cols=("open", "high", "low", "close", "red_run")), "red_run").select("entry_id", "exit_px", "reason")


view("excursion", f"""SELECT *, coalesce((max(high) OVER w - close) / close, 0) AS mfe, coalesce((close - min(low) OVER w) / close, 0) AS mae FROM nbars WINDOW w AS ({S} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""")


@query("excursions_to_session_end", "2.13.4 2.20.19 2.20.48", f"""
SELECT symbol, @T(ts) AS ts, @R(coalesce((max(high) OVER w - close) / nullif(close, 0), 0)) AS mfe, @R(coalesce((close - min(low) OVER w) / nullif(close, 0), 0)) AS mae FROM nbars WINDOW w AS ({S} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""")
def _(m):
    return L.excursions(m.bars()).select("symbol", "ts", "mfe", "mae")


@query("excursions_fixed_horizon", "2.13.4", f"""
WITH w AS (SELECT *, max(high) OVER w AS hh, min(low) OVER w AS ll, list(struct_pack(i := i, h := high, l := low)) OVER w AS f FROM nbars WINDOW w AS ({S} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
SELECT symbol, @T(ts) AS ts, @R(coalesce((hh - close) / nullif(close, 0), 0)) AS mfe, @R(coalesce((close - ll) / nullif(close, 0), 0)) AS mae,
 @R(CASE WHEN len(f) > 0 THEN CAST(list_min(list_transform(list_filter(f, lambda x: x.h = hh), lambda x: x.i)) < list_min(list_transform(list_filter(f, lambda x: x.l = ll), lambda x: x.i)) AS INT) END) AS high_first FROM w""")
def _(m):
    return L.excursions(m.bars(), horizon=10).select("symbol", "ts", "mfe", "mae", F.col("high_first").cast("int").cast("double").alias("high_first"))


@query("rebound_census", "2.13.5 2.20.62", """
WITH g AS (SELECT entry_id, any_value(entry_px) AS e, min(j) FILTER (bl < entry_px) AS u, min(j) FILTER (bl <= entry_px * 0.95::DOUBLE) AS w FROM touches GROUP BY 1),
k AS (SELECT t.entry_id, min(j) AS b FROM touches t JOIN g USING (entry_id) WHERE bh >= entry_px AND j > u GROUP BY 1)
SELECT entry_id, @I(u IS NOT NULL) AS went_under, @R(b - u) AS bars_under, CASE WHEN u IS NULL THEN NULL WHEN b IS NULL AND w IS NULL THEN 'neither' WHEN w IS NULL OR b < w THEN 'back' ELSE 'worse' END AS first FROM g LEFT JOIN k USING (entry_id)""")
def _(m):
    out = L.rebounds(L.later_bars(entries(m), nbars(m)))
    return out.select("entry_id", "went_under", F.col("bars_under").cast("double").alias("bars_under"), "first")


def scored(m):
    x = L.excursions(m.bars()).select("symbol", "session_date", "i", "mfe", "mae")
    e = entries(m).select("symbol", "session_date", "i", "entry_id").join(x, ["symbol", "session_date", "i"])
    return outcomes(m).join(e.select("entry_id", "mfe", "mae"), "entry_id")


view("scored", "SELECT o.*, x.mfe, x.mae FROM outcomes o JOIN excursion x USING (symbol, session_date, i)")


@query("rung_survival", "2.13.6 2.20.41", """
WITH b AS (SELECT unnest([0.0, 0.9, 0.95, 1.0, 1.05, 1.1, 1.21]::DOUBLE[]) AS a, unnest([0.9, 0.95, 1.0, 1.05, 1.1, 1.21, 1e300]::DOUBLE[]) AS z)
SELECT @R(a) AS from_ratio, @R(avg(CAST(exit_px / entry_px >= a AND exit_px / entry_px < z AS INT))) AS share, @R(avg(CAST(1 + mfe >= a AS INT))) AS reached FROM scored, b GROUP BY a""")
def _(m):
    return L.rung_survival(scored(m))


@query("perfect_exit_bound", "2.13.6", "SELECT count(*) AS trades, @R(sum(mfe * entry_px - 1)) AS ceiling, @R(avg(CAST(mfe * entry_px < 1 AS INT))) AS never_covered FROM scored")
def _(m):
    return L.perfect_exit(scored(m), 1.0)


@query("hard_stop_scan", "2.13.7 2.20.7", """
WITH s AS (SELECT unnest([0.02, 0.05, 0.1, 0.2, 0.4]::DOUBLE[]) AS s) SELECT @R(s) AS stop_level, @R(sum(CASE WHEN mae >= s THEN -s ELSE exit_px / entry_px - 1 END)) AS total, @R(avg(CAST(mae >= s AS INT))) AS stopped FROM scored, s GROUP BY s""")
def _(m):
    return L.stop_scan(scored(m), [0.02, 0.05, 0.1, 0.2, 0.4])


@query("n_day_exit", "2.13.8 2.20.149", """
WITH p AS (SELECT d.symbol, c.date, c.ordinal AS k FROM daily d JOIN calendar_days c USING (date) WHERE volume > 80), x AS (SELECT symbol, ordinal, close FROM daily JOIN calendar_days USING (date)), mx AS (SELECT max(ordinal) AS mo FROM calendar_days)
SELECT p.symbol, @D(p.date) AS date, @R(e.close) AS entry_px, @R(o.close) AS exit_px, CASE WHEN k + 6 > mo THEN 'past_end' WHEN e.close IS NULL THEN 'no_entry' WHEN o.close IS NULL THEN 'no_exit' ELSE 'filled' END AS status,
 @R(CASE WHEN k + 6 <= mo AND e.close IS NOT NULL AND o.close IS NOT NULL THEN o.close / e.close - 1 END) AS ret
FROM p LEFT JOIN x e ON e.symbol = p.symbol AND e.ordinal = k + 1 LEFT JOIN x o ON o.symbol = p.symbol AND o.ordinal = k + 6, mx""")
def _(m):
    from tidemark.plans.q_screen import calendar
    d = m.daily()
    return L.n_day_exit(d.filter("volume > 80").select("symbol", "date"), calendar(m), d.select("symbol", "date", F.col("close").alias("px")), 5)


@query("entry_minute_order", "2.13.9 2.20.126", """
WITH e AS (SELECT market, session_date, minute, first(px ORDER BY ts, seq) AS p FROM ticks GROUP BY 1, 2, 3), j AS (SELECT e.market || CAST(e.session_date AS VARCHAR) || CAST(e.minute AS VARCHAR) AS entry_id, t.px >= p AS trig, t.px <= p * 0.8::DOUBLE AS st, t.ts, t.seq FROM e JOIN ticks t USING (market, session_date, minute)),
g AS (SELECT entry_id, min((ts, seq)) FILTER (trig) AS a, max((ts, seq)) FILTER (st) AS z FROM j GROUP BY 1)
SELECT entry_id, CASE WHEN a IS NULL THEN 'no_trigger' WHEN z IS NULL THEN 'clean' WHEN z > a THEN 'stop_after' ELSE 'stop_before' END AS order_in_minute FROM g""")
def _(m):
    t = m.market_ticks()
    by = ["symbol", "session_date", "minute"]
    e = t.groupBy(*by).agg(F.min_by("px", F.struct("ts", "seq")).alias("p"))
    e = e.select(*by, F.concat("symbol", F.col("session_date").cast("string"), F.col("minute").cast("string")).alias("entry_id"), F.col("p").alias("trigger_px"), (F.col("p") * 0.8).alias("stop_px"))
    return L.entry_minute_order(e, t)


@query("post_stop_rally", "2.13.10", """
SELECT o.entry_id, @R(max(b.high) / nullif(max(o.exit_px), 0) - 1) AS rally FROM outcomes o JOIN nbars b ON b.symbol = o.symbol AND b.session_date = o.session_date AND b.i > o.i + o.bars_held AND b.i <= o.i + o.bars_held + 10 WHERE reason = 'stop' GROUP BY 1""")
def _(m):
    e = entries(m).select("entry_id", F.col("i").alias("i0"))
    return L.post_stop_rally(outcomes(m).join(e, "entry_id"), nbars(m), 10)


# ---- ledger

def book(m):
    return m.numbered_ledger().withColumn("book", F.when(F.col("trade_id") % 2 == 0, "even").otherwise("odd"))


view("book", """SELECT *, CASE WHEN trade_id % 2 = 0 THEN 'even' ELSE 'odd' END AS book, row_number() OVER (PARTITION BY symbol, session_date ORDER BY entry_ts, trade_id) AS ordinal FROM ledger""")
view("equity", """SELECT *, greatest(0, max(equity) OVER (PARTITION BY book ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING)) AS peak FROM (SELECT *, sum(net) OVER (PARTITION BY book ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING) AS equity FROM book)""")


@query("equity_and_drawdown", "2.5.33", "SELECT @I(trade_id) AS trade_id, book, @R(equity) AS equity, @R(peak - equity) AS drawdown FROM equity")
def _(m):
    return B.equity_curve(book(m)).select("trade_id", "book", "equity", "drawdown")


@query("drawdown_summary", "2.5.33", """SELECT book, @R(max(peak - equity)) AS max_drawdown, @R(arg_max(equity, (exit_ts, trade_id))) AS final, strftime(min(exit_ts) FILTER (equity <= -5000), '%Y-%m-%d %H:%M:%S') AS ruined_at FROM equity GROUP BY 1""")
def _(m):
    return B.drawdown_summary(B.equity_curve(book(m)), -5000.0)


@query("concurrency", "2.5.34 2.20.1", """
WITH e AS (SELECT book, trade_id, entry_ts AS t, 1 AS o, 1 AS s, entry_px * qty AS c FROM book UNION ALL SELECT book, trade_id, exit_ts, 0, -1, -entry_px * qty FROM book), r AS (SELECT *, sum(s) OVER w AS n, sum(c) OVER w AS k FROM e WINDOW w AS (PARTITION BY book ORDER BY t, o, trade_id ROWS UNBOUNDED PRECEDING))
SELECT book, @I(max(n)) AS max_open, @R(max(k)) AS peak_capital, @R(avg(CAST(n > 1 AS INT)) FILTER (s = 1)) AS overlap_share FROM r GROUP BY 1""")
def _(m):
    return B.concurrency(book(m))


@query("entry_ordinals", "2.5.31 2.14.5 2.20.33 2.20.17", """
SELECT ordinal, count(*) AS trades, @R(sum(net)) AS net, @I(count(*) FILTER (ordinal <= 2)) AS kept_by_cap, @I(count(*) FILTER (ordinal > 1)) AS kept_by_skip FROM book GROUP BY 1""")
def _(m):
    n = book(m)
    a = n.groupBy("ordinal").agg(F.count(F.lit(1)).alias("trades"), F.sum("net").alias("net"))
    c = B.entry_cap(n, 2).groupBy("ordinal").agg(F.count(F.lit(1)).alias("kept_by_cap"))
    s = B.skip_first(n).groupBy("ordinal").agg(F.count(F.lit(1)).alias("kept_by_skip"))
    return a.join(c, "ordinal", "left").join(s, "ordinal", "left").na.fill(0)


view("picks", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_ts, trade_id) AS r FROM ledger) SELECT symbol, r, trade_id, exit_ts FROM r WHERE r = 1
 UNION ALL SELECT n.symbol, n.r, n.trade_id, n.exit_ts FROM picks p JOIN LATERAL (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_ts, trade_id) AS r FROM ledger) o WHERE o.symbol = p.symbol AND o.entry_ts > p.exit_ts ORDER BY o.r LIMIT 1) n ON true""")


@query("non_overlapping_trades", "2.14.1", "SELECT @I(trade_id) AS trade_id FROM picks")
def _(m):
    from tidemark.operators.intervals import non_overlapping
    t = m.ledger().select("symbol", "trade_id", F.unix_micros("entry_ts").alias("a"), F.unix_micros("exit_ts").alias("b"))
    return non_overlapping(t, "a", "b", ["symbol"]).select("trade_id")


@query("concurrency_cap_replay", "2.14.2 2.20.54", """
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY m, symbol, trade_id) AS k FROM (SELECT session_date, symbol, trade_id, CAST(floor(epoch(entry_ts) / 60) AS BIGINT) AS m, CAST(floor(epoch(exit_ts) / 60) AS BIGINT) AS x FROM ledger)),
r AS (
 SELECT session_date, k, trade_id, TRUE AS took, [x] AS held FROM o WHERE k = 1
 UNION ALL
 SELECT o.session_date, o.k, o.trade_id, len(list_filter(r.held, lambda e: e > o.m)) < 2, CASE WHEN len(list_filter(r.held, lambda e: e > o.m)) < 2 THEN list_append(list_filter(r.held, lambda e: e > o.m), o.x) ELSE list_filter(r.held, lambda e: e > o.m) END
 FROM r JOIN o ON o.session_date = r.session_date AND o.k = r.k + 1)
SELECT @D(session_date) AS session_date, @I(trade_id) AS trade_id FROM r WHERE took""")
def _(m):
    minute = lambda c: F.floor(F.unix_micros(c) / 60_000_000).cast("bigint")
    return B.replay_cap(m.ledger().withColumn("entry_minute", minute("entry_ts")).withColumn("exit_minute", minute("exit_ts")), 2)


view("landed", """SELECT *, greatest(0, max(realised) OVER (PARTITION BY session_date ORDER BY exit_ts, entry_ts, trade_id ROWS UNBOUNDED PRECEDING)) AS peak FROM (SELECT *, sum(net - 1) OVER (PARTITION BY session_date ORDER BY exit_ts, entry_ts, trade_id ROWS UNBOUNDED PRECEDING) AS realised FROM ledger)""")


@query("session_give_back", "2.14.3 2.20.74", """
WITH t AS (SELECT session_date, min(exit_ts) FILTER (peak >= 500 AND realised <= 0.5 * peak) AS t FROM landed GROUP BY 1)
SELECT @I(trade_id) AS trade_id, @I(coalesce(entry_ts >= t, false)) AS removed FROM ledger JOIN t USING (session_date)""")
def _(m):
    return B.session_stop(m.ledger(), ["session_date"], B.give_back(0.5, 500.0), 1.0).select("trade_id", "removed")


@query("flat_session_stop", "2.14.3 2.20.76", """
WITH t AS (SELECT session_date, min(exit_ts) FILTER (peak - realised >= 2000) AS t FROM landed GROUP BY 1)
SELECT @I(trade_id) AS trade_id, @I(coalesce(entry_ts >= t, false)) AS removed FROM ledger JOIN t USING (session_date)""")
def _(m):
    return B.session_stop(m.ledger(), ["session_date"], B.flat_loss(2000.0), 1.0).select("trade_id", "removed")


@query("solved_flat_stop", "2.14.4", """
WITH l AS (SELECT unnest([500.0, 1000.0, 2000.0, 4000.0]) AS level), t AS (SELECT session_date, level, min(exit_ts) FILTER (peak - realised >= level) AS t FROM landed, l GROUP BY 1, 2), c AS (SELECT level, count(*) FILTER (entry_ts >= t) AS removed FROM ledger JOIN t USING (session_date) GROUP BY 1)
SELECT @R(level) AS level, removed, @I(level = max(CASE WHEN removed >= 20 THEN level END) OVER ()) AS chosen FROM c""")
def _(m):
    return B.solve_flat_stop(m.ledger(), ["session_date"], 20, [500.0, 1000.0, 2000.0, 4000.0], 1.0)


@query("compounding_account", "2.14.6")
def _(m):
    day = m.ticks().groupBy("symbol", "session_date").agg(F.sum(F.col("px") * F.col("size")).alias("dollar_volume"))
    return B.compounding(book(m).join(day, ["symbol", "session_date"], "left"), [(0.05, 0.2), (0.1, 0.5), (0.6, 1.0)], 25000.0, volume_share=0.5)


view("tick_days", "SELECT session_date AS date, row_number() OVER (ORDER BY session_date) AS ordinal FROM (SELECT DISTINCT session_date FROM ticks)")


def tick_days(m):
    d = m.ticks().select(F.col("session_date").alias("date")).distinct()
    return d.withColumn("ordinal", F.row_number().over(Window.partitionBy().orderBy("date")))


@query("nights_and_margin", "2.14.7", """
WITH n AS (SELECT b.*, y.ordinal - x.ordinal AS nights FROM book b JOIN tick_days x ON x.date = b.session_date JOIN tick_days y ON y.date = b.exit_date), q AS (SELECT book, exit_ts, arg_max(equity, trade_id) AS equity FROM equity GROUP BY 1, 2)
SELECT @I(n.trade_id) AS trade_id, @I(nights) AS nights, @I(nights > 0 AND 50 * qty > 2000 + coalesce(q.equity, 0)) AS breach FROM n ASOF LEFT JOIN q ON n.book = q.book AND n.entry_ts >= q.exit_ts""")
def _(m):
    n = B.nights_held(book(m), tick_days(m))
    return B.margin_breaches(n, B.equity_curve(book(m)), 50.0, 2000.0).select("trade_id", "nights", "breach")


@query("largest_position", "2.14.7", """
WITH d AS (SELECT book, max(peak - equity) AS dd FROM equity GROUP BY 1) SELECT book, @R(dd) AS max_drawdown, @I(CASE WHEN dd <= 0 THEN 10 ELSE greatest(0, least(10, ceil(40000 / dd) - 1)) END) AS size FROM d""")
def _(m):
    return B.largest_size(B.equity_curve(book(m)), 40000.0, 10, ["book"])


@query("void_split_spans", "2.14.9", """
SELECT @I(trade_id) AS trade_id FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM ticks t WHERE t.symbol = l.symbol AND t.market = 'error' AND t.session_date > l.session_date AND t.session_date <= l.exit_date)""")
def _(m):
    bad = m.ticks().filter("market = 'error'").select("symbol", F.col("session_date").alias("date")).distinct()
    return B.void_spans(m.ledger(), bad).select("trade_id")


@query("daily_marks", "2.14.10", """
WITH s AS (SELECT l.gross, y.ordinal - x.ordinal + 1 AS n, unnest(range(x.ordinal, y.ordinal + 1)) AS ordinal FROM ledger l JOIN tick_days x ON x.date = l.session_date JOIN tick_days y ON y.date = l.exit_date),
d AS (SELECT date, sum(gross / n) AS gross, sum(1 / n) AS trades FROM s JOIN tick_days USING (ordinal) GROUP BY 1)
SELECT @D(date) AS date, @R(gross) AS gross, @R(trades) AS trades, @R(sum(gross) OVER w) AS cum_0, @R(sum(gross - trades) OVER w) AS cum_1, @R(sum(gross - 2 * trades) OVER w) AS cum_2 FROM d WINDOW w AS (ORDER BY date)""")
def _(m):
    return B.daily_marks(m.ledger(), tick_days(m))
