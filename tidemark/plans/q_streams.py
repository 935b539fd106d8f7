"""Streaming jobs drained over the events table (2.18), the scan rows (2.1) and the rule surface (2.19)."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.operators import rules
from tidemark.operators import screen as S
from tidemark.plans.q_screen import CFG, screen_list, session_closes
from tidemark.plans.registry import TABLES, query, view
from tidemark.session import staged
from tidemark.sources import readers
from tidemark.sources.schemas import EXECUTION_REPORT
from tidemark.sources.store import Store, report_refusals, write_report
from tidemark.streaming import forward, jobs as J, screens


SKEW, LATE = "2 seconds", "10 minutes"
# What the last watermark of a drained stream has passed.
PASSED = "(SELECT date_trunc('milliseconds', max(ts)) FROM ticks) - INTERVAL 10 MINUTE"


def stream_ticks(m):
    return J.ticks(J.read_events(m.spark, m.folder))


@query("stream_closed_bars", "2.18.1", """
SELECT symbol, @T(ts) AS ts, @R(open) AS open, @R(high) AS high, @R(low) AS low, @R(close) AS close, @I(volume) AS volume FROM bars5 WHERE ts + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM ticks) - INTERVAL 2 SECOND""")
def _(m):
    t = stream_ticks(m).drop("symbol").withColumnRenamed("market", "symbol")
    return J.drain(J.closed_bars(t, SKEW))


@query("stream_arrivals", "2.18.6", f"SELECT symbol, @D(session_date) AS session_date, @I(first(seq ORDER BY ts, seq)) AS seq FROM ticks GROUP BY 1, session_date HAVING min(ts) <= {PASSED}")
def _(m):
    return J.drain(J.arrivals(stream_ticks(m), LATE)).select("symbol", "session_date", "seq")


@query("stream_one_signal_per_bar", "2.18.8", f"SELECT symbol, @T(time_bucket(INTERVAL 1 HOUR, ts)) AS bar_ts, @I(first(seq ORDER BY ts, seq)) AS seq FROM ticks WHERE market = 'purchase' GROUP BY symbol, time_bucket(INTERVAL 1 HOUR, ts) HAVING min(ts) <= (SELECT date_trunc('milliseconds', max(ts)) FROM ticks WHERE market = 'purchase') - INTERVAL 10 MINUTE")
def _(m):
    s = stream_ticks(m).filter("market = 'purchase'").withColumn("strategy", F.lit("s")).withColumn("bar_ts", clock.floor_to("ts", 3600))
    return J.drain(J.one_signal_per_bar(s, LATE)).select("symbol", "bar_ts", "seq")


@query("stream_signal_after_exit", "2.18.8", """
WITH e AS (SELECT *, market = 'signup' AS leaves, time_bucket(INTERVAL 4 HOUR, ts) AS bar_ts FROM ticks WHERE market IN ('purchase', 'click', 'signup')),
x AS (SELECT *, max(CASE WHEN leaves THEN ts END) OVER (PARTITION BY symbol ORDER BY ts, seq) AS left_ts FROM e)
SELECT symbol, @T(bar_ts) AS bar_ts, @I(first(seq ORDER BY ts, seq)) AS seq FROM x WHERE NOT leaves AND (left_ts IS NULL OR bar_ts >= left_ts) AND ts <= (SELECT date_trunc('milliseconds', max(ts)) FROM e) - INTERVAL 10 MINUTE GROUP BY symbol, bar_ts""")
def _(m):
    t = stream_ticks(m).filter("market in ('purchase', 'click', 'signup')").withColumn("strategy", F.lit("s")).withColumn("bar_ts", clock.floor_to("ts", 14400))
    events = t.withColumn("kind", F.when(F.col("market") == "signup", "exit").otherwise("signal"))
    return J.drain(J.one_signal_per_bar(events, LATE, keep_s=400 * 86_400)).select("symbol", "bar_ts", "seq")


@query("stream_feed_delay", "2.18.7", """
WITH h AS (SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS hour_ts, count(*) AS n, avg(size % 30) AS mean_delay, max(size % 30) AS worst_delay FROM ticks GROUP BY 1)
SELECT @T(hour_ts) AS ts, n, @R(mean_delay) AS mean_delay, @I(worst_delay) AS worst_delay FROM h WHERE hour_ts + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM ticks) - INTERVAL 10 MINUTE""")
def _(m):
    return J.drain(J.feed_delay(stream_ticks(m).withColumn("delay_s", F.col("size") % 30)))


view("spans", """WITH g AS (SELECT market AS symbol, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM ticks WINDOW w AS (PARTITION BY market ORDER BY ts)), r AS (SELECT *, sum(f) OVER (PARTITION BY symbol ORDER BY ts) AS r FROM g)
 SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS samples FROM r GROUP BY symbol, r""")


@query("stream_sampled_spans", "2.18.13", """
SELECT symbol, @T(first_ts) AS first_ts, @T(last_ts) AS last_ts, samples FROM spans WHERE last_ts + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM ticks) - INTERVAL 10 MINUTE""")
def _(m):
    t = stream_ticks(m).drop("symbol").withColumnRenamed("market", "symbol")
    return J.drain(J.sampled_spans(t, "30 minutes"))


@query("quote_outages", "2.18.13", """
SELECT symbol, @T(last_ts) AS outage_from, @T(lead(first_ts) OVER (PARTITION BY symbol ORDER BY first_ts)) AS outage_to FROM spans QUALIFY lead(first_ts) OVER (PARTITION BY symbol ORDER BY first_ts) IS NOT NULL""")
def _(m):
    t = m.market_ticks().groupBy("symbol", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("a"), F.max("ts").alias("outage_from"))
    w = Window.partitionBy("symbol").orderBy("a")
    return t.withColumn("outage_to", F.lead("a").over(w)).filter("outage_to is not null").select("symbol", "outage_from", "outage_to")


view("fresh", """WITH a AS (SELECT *, first(size) OVER w <> size AS moved FROM ticks WINDOW w AS (PARTITION BY symbol, session_date ORDER BY ts, seq)) SELECT * FROM (SELECT *, bool_or(moved) OVER (PARTITION BY symbol, session_date ORDER BY ts, seq) AS ok FROM a) WHERE ok""")


@query("stream_freshness_gate", "2.18.4", f"SELECT symbol, @D(session_date) AS session_date, @I(seq) AS seq FROM fresh WHERE ts <= {PASSED}")
def _(m):
    return J.drain(J.fresh_rows(stream_ticks(m), LATE)).select("symbol", "session_date", "seq")


@query("freshness_gate", "2.18.4", "SELECT symbol, @D(session_date) AS session_date, @I(seq) AS seq FROM fresh")
def _(m):
    on, at = ["symbol", "session_date"], F.struct("ts", "seq")
    t = m.ticks()
    first = t.groupBy(*on).agg(F.min_by("size", at).alias("__first"))
    opened = t.join(first, on).filter("size <> __first").groupBy(*on).agg(F.min(at).alias("__from"))
    return t.join(opened, on).filter(at >= F.col("__from")).select("symbol", "session_date", "seq")


@query("stream_round_trips", "2.18.9", "SELECT @I(s.seq) AS seq, @R((s.price - b.price) * b.qty) AS pnl FROM (SELECT * FROM fills WHERE side = 'SELL') s ASOF JOIN (SELECT * FROM fills WHERE side = 'BUY') b ON s.symbol = b.symbol AND s.ts > b.ts WHERE s.ts <= (SELECT date_trunc('milliseconds', max(ts)) FROM fills) - INTERVAL 10 MINUTE")
def _(m):
    t = stream_ticks(m).filter("market in ('purchase', 'signup')").select(
        "symbol", "ts", "seq", F.when(F.col("market") == "purchase", "BUY").otherwise("SELL").alias("side"), F.col("px").alias("price"), F.col("size").alias("qty"))
    return J.drain(J.sell_round_trips(t, LATE)).select("seq", "pnl")


@query("session_summary", "2.18.9", """
WITH r AS (SELECT s.session_date, s.symbol, (s.price - b.price) * b.qty AS pnl FROM (SELECT * FROM fills WHERE side = 'SELL') s ASOF JOIN (SELECT * FROM fills WHERE side = 'BUY') b ON s.symbol = b.symbol AND s.ts > b.ts)
SELECT @D(session_date) AS session_date, symbol, count(*) AS round_trips, @R(sum(pnl)) AS pnl FROM r GROUP BY ROLLUP (session_date, symbol)""")
def _(m):
    from tidemark.operators.micro import pair_sells
    r = pair_sells(m.fills()).filter("buy_px is not null").withColumn("pnl", (F.col("price") - F.col("buy_px")) * F.col("buy_qty"))
    return r.rollup("session_date", "symbol").agg(F.count(F.lit(1)).alias("round_trips"), F.sum("pnl").alias("pnl"))


# Ticks of the screen the last watermark of its trades has passed.
TICK_TS = "((session_date::TIMESTAMP + {} * INTERVAL 1 MINUTE) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' <= (SELECT date_trunc('milliseconds', max(ts)) FROM ticks WHERE minute BETWEEN 240 AND 569) - INTERVAL 10 MINUTE"
view("stream_list", f"SELECT * FROM screen_list WHERE {TICK_TS.format('tick')}")


def stream_lists(m):
    prior = S.prior_closes(session_closes(m))
    return screens.tick_lists(screens.states(stream_ticks(m), prior, CFG, LATE), CFG)


@query("stream_running_screen", "2.18.2", "SELECT @D(session_date) AS session_date, @I(tick) AS tick, symbol, @R(close) AS close, @I(cum_volume) AS cum_volume, @R(change) AS change, position FROM stream_list")
def _(m):
    return J.drain(screens.listed(stream_lists(m)).drop("window"))


@query("stream_first_seen", "2.18.3", """
SELECT @D(session_date) AS session_date, symbol, @I(min(tick)) AS first_seen, arg_min(position, tick) AS first_rank, min(position) AS best_rank, count(*) AS ticks_on FROM screen_list
WHERE session_date::TIMESTAMP + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) FROM ticks WHERE minute BETWEEN 240 AND 569) - INTERVAL 10 MINUTE GROUP BY session_date, symbol""")
def _(m):
    return J.drain(screens.first_seen(screens.listed(stream_lists(m))))


@query("stream_ranking_memory", "2.18.5", f"""
WITH t AS (SELECT DISTINCT session_date, tick FROM stream_list UNION SELECT DISTINCT session_date, tick + 15 FROM stream_list WHERE tick + 15 <= 570 AND {TICK_TS.format('(tick + 15)')}),
s AS (SELECT t.session_date, t.tick, l.symbol, max(l.tick) AS seen, arg_max(l.close, l.tick) AS px, arg_max(l.position, l.tick) AS place FROM t JOIN stream_list l ON l.session_date = t.session_date AND l.tick <= t.tick GROUP BY 1, 2, 3),
k AS (SELECT *, CASE WHEN seen < tick THEN 2 WHEN px <= 60 THEN 0 ELSE 1 END AS tier FROM s)
SELECT @D(session_date) AS session_date, @I(tick) AS tick, count(*) FILTER (tier = 0) AS hot, count(*) FILTER (tier = 1) AS warm, count(*) FILTER (tier = 2) AS cold,
 array_to_string(list(symbol ORDER BY tier, CASE WHEN tier < 2 THEN place END, seen DESC, symbol)[1:10], ',') AS names FROM k GROUP BY session_date, tick""")
def _(m):
    return J.drain(screens.ranking(stream_lists(m), CFG, (0.0, 60.0))).select("session_date", "tick", "hot", "warm", "cold", "names")


@query("stream_watchlist_changes", "2.18.10", f"""
WITH gone AS (SELECT session_date, tick + 15 AS tick, symbol FROM stream_list WHERE tick + 15 <= 570 AND {TICK_TS.format('(tick + 15)')} AND (session_date, tick + 15, symbol) NOT IN (SELECT (session_date, tick, symbol) FROM stream_list)),
need AS (SELECT unnest(range(255, 571, 15)) AS tick, round_even(60 * CASE WHEN unnest(range(255, 571, 15)) >= 480 THEN 0.552::DOUBLE WHEN unnest(range(255, 571, 15)) >= 420 THEN 0.8::DOUBLE ELSE 1.0 END, 0)::BIGINT AS need)
SELECT @D(session_date) AS session_date, @I(tick) AS tick, symbol, 'added' AS change, NULL::VARCHAR AS reason FROM stream_list WHERE (session_date, tick - 15, symbol) NOT IN (SELECT (session_date, tick, symbol) FROM stream_list)
UNION ALL
SELECT @D(g.session_date), @I(g.tick), g.symbol, 'removed', CASE WHEN s.change < 20 - 1e-9 THEN printf('change %.2f < 20.00', s.change) WHEN NOT s.close BETWEEN 2 AND 250 THEN printf('price %.2f outside 2.00-250.00', s.close)
 WHEN s.cum_volume < need THEN 'volume ' || s.cum_volume::BIGINT || ' < ' || need ELSE 'outranked' END
FROM gone g JOIN screen_state s USING (session_date, tick, symbol) JOIN need USING (tick)""")
def _(m):
    return screens.changes(J.drain(screens.ranking(stream_lists(m), CFG, (0.0, 60.0))))


view("list_changes", """WITH a AS (SELECT session_date, symbol, tick, lag(tick) OVER w AS p, lead(tick) OVER w AS n, max(tick) OVER (PARTITION BY session_date) AS last FROM screen_list WINDOW w AS (PARTITION BY session_date, symbol ORDER BY tick))
 SELECT session_date, tick, symbol, 'added' AS change FROM a WHERE p IS NULL OR tick - p > 15 UNION ALL SELECT session_date, tick + 15, symbol, 'removed' FROM a WHERE (n IS NULL OR n - tick > 15) AND tick < last""")


@query("watchlist_changes", "2.18.10", "SELECT @D(session_date) AS session_date, @I(tick) AS tick, symbol, change FROM list_changes")
def _(m):
    w = Window.partitionBy("session_date", "symbol").orderBy("tick")
    s = screen_list(m).select("session_date", "symbol", "tick").withColumn("p", F.lag("tick").over(w)).withColumn("n", F.lead("tick").over(w))
    last = s.groupBy("session_date").agg(F.max("tick").alias("last"))
    added = s.filter("p is null or tick - p > 15").select("session_date", "tick", "symbol", F.lit("added").alias("change"))
    gone = s.join(F.broadcast(last), "session_date").filter("(n is null or n - tick > 15) and tick < last").select(
        "session_date", (F.col("tick") + 15).alias("tick"), "symbol", F.lit("removed").alias("change"))
    return added.unionByName(gone)


@query("ranking_memory", "2.18.5", """
WITH t AS (SELECT DISTINCT session_date, tick FROM screen_list), s AS (SELECT t.session_date, t.tick, l.symbol, max(l.tick) AS seen, arg_max(l.close, l.tick) AS px FROM t JOIN screen_list l ON l.session_date = t.session_date AND l.tick <= t.tick GROUP BY 1, 2, 3)
SELECT @D(session_date) AS session_date, @I(tick) AS tick, count(*) FILTER (seen = tick AND px <= 60) AS hot, count(*) FILTER (seen = tick AND px > 60) AS warm, count(*) FILTER (seen < tick) AS cold FROM s GROUP BY session_date, tick""")
def _(m):
    s = screen_list(m)
    now = s.groupBy("session_date", "tick").agg(F.count(F.when(F.col("close") <= 60, 1)).alias("hot"), F.count(F.when(F.col("close") > 60, 1)).alias("warm"))
    first = s.groupBy("session_date", "symbol").agg(F.min("tick").alias("tick")).groupBy("session_date", "tick").agg(F.count(F.lit(1)).alias("fresh"))
    w = Window.partitionBy("session_date").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    j = now.join(first, ["session_date", "tick"], "left").withColumn("ever", F.sum(F.coalesce("fresh", F.lit(0))).over(w))
    return j.select("session_date", "tick", "hot", "warm", (F.col("ever") - F.col("hot") - F.col("warm")).alias("cold"))


@query("delayed_feed_floor", "2.18.12 2.20.31", """
WITH f AS (SELECT session_date, symbol, min(tick) + 15 AS first_seen FROM screen_list GROUP BY 1, 2) SELECT @I(trade_id) AS trade_id, @I(entry_minute >= first_seen) AS allowed FROM ledger JOIN f USING (symbol, session_date)""")
def _(m):
    f = screen_list(m).groupBy("session_date", "symbol").agg(F.min("tick").alias("first_seen"))
    return m.ledger().join(J.delayed_floor(f, 15), ["symbol", "session_date"]).select("trade_id", (F.col("entry_minute") >= F.col("first_seen")).alias("allowed"))


def session_net(rows):
    return rows.groupBy("session_date").agg(F.count(F.lit(1)).alias("trades"), F.sum("net").alias("net"))


def two_runs(m):
    """The ledger scored twice: first up to the middle of its sessions, then whole."""
    root, ledger = J.shared_folder(m.spark), m.ledger().select("session_date", "trade_id", "symbol", "net")
    ledger.write.parquet(f"{root}/ledger")
    ledger = m.spark.read.parquet(f"{root}/ledger")
    days = ledger.select("session_date").distinct()
    half = days.agg(F.expr("date_from_unix_date(int(percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_date(session_date))))").alias("d")).first().d
    forward.score_new(ledger.filter(F.col("session_date") <= F.lit(half)), session_net, root)
    forward.score_new(ledger, session_net, root)
    return m.spark.read.parquet(f"{root}/scores"), m.spark.read.parquet(f"{root}/log")


@query("forward_scores", "2.18.11 2.20.143 2.20.144", """
SELECT count(DISTINCT session_date) AS sessions, @R(sum(net)) AS net, @I(count(DISTINCT session_date) >= 10 AND sum(net) <= -1000) AS stopped FROM ledger WHERE session_date < (SELECT max(session_date) FROM ledger)""")
def _(m):
    return forward.early_stop(two_runs(m)[0], 1000.0, 10)


@query("forward_sessions", "2.18.11", """
WITH d AS (SELECT session_date, count(*) AS trades, sum(net) AS net FROM ledger GROUP BY 1), h AS (SELECT quantile_disc(session_date, 0.5) AS half FROM d)
SELECT @D(session_date) AS session_date, CASE WHEN session_date < half THEN 1 ELSE 2 END::BIGINT AS run, trades, @R(net) AS net FROM d, h WHERE session_date < (SELECT max(session_date) FROM d)""")
def _(m):
    scores, log = two_runs(m)
    return scores.join(log, "session_date").select("session_date", "run", "trades", "net")


# ---- scans (2.1)

@query("bar_scan_guarded", "2.1.1 2.1.2", "SELECT market AS symbol, count(*) AS n FROM ticks GROUP BY 1")
def _(m):
    raw = readers.bars(m.spark, [f"{m.folder}/events.parquet"], "event_type")
    return raw.groupBy(F.col("event_type").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


@query("first_row_per_symbol_day", "2.1.3 2.1.19", """
SELECT symbol, @D(date) AS date, @I(first(l_orderkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS l_orderkey, count(*) AS copies FROM (SELECT *, CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date FROM lineitem) GROUP BY 1, date""")
def _(m):
    d = m.table("lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return readers.first_per_key(d, ["symbol", "date"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]).select("symbol", "date", "l_orderkey", "copies")


@query("latest_snapshot_per_contract", "2.1.5", """
SELECT @I(o_custkey) AS o_custkey, @R(arg_max(o_totalprice, (o_orderdate, o_orderkey))) AS o_totalprice FROM orders GROUP BY o_custkey""")
def _(m):
    return readers.latest_per_key(m.table("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_totalprice")


@query("complete_slices", "2.1.6", """
SELECT symbol, @D(session_date) AS session_date, @I(count(DISTINCT minute // 360)) AS windows FROM ticks GROUP BY symbol, session_date HAVING count(DISTINCT minute // 360) >= 3""")
def _(m):
    t = m.ticks().withColumn("k", F.struct("symbol", "session_date")).withColumn("w", F.floor(F.col("minute") / 360))
    return readers.complete_dates(t, "k", "w", 3).select("k.symbol", "k.session_date", "windows")


@query("pair_union", "2.1.7", """
SELECT DISTINCT translate(symbol, '0123456789', 'ABCDEFGHIJ') AS symbol, @D(session_date) AS session_date FROM (SELECT symbol, session_date FROM fills UNION ALL SELECT symbol, session_date FROM quotes)""")
def _(m):
    both = m.fills().select("symbol", "session_date").unionByName(m.quotes().select("symbol", "session_date"))
    lines = both.select(F.to_json(F.struct(F.translate("symbol", "0123456789", "ABCDEFGHIJ").alias("symbol"), F.col("session_date").cast("string").alias("date"))).alias("line"))
    return readers.pair_rows(lines.select(F.from_json("line", readers.PAIR_JSON).alias("r")).select("r.*"))


@query("warmup_windows", "2.1.8", """
WITH p AS (SELECT DISTINCT symbol, session_date FROM ledger) SELECT p.symbol, @D(p.session_date) AS target_date, count(*) AS bars, count(DISTINCT b.session_date) AS sessions FROM p JOIN tick_days t ON t.date = p.session_date JOIN tick_days u ON u.ordinal BETWEEN t.ordinal - 2 AND t.ordinal
JOIN sbars1 b ON b.symbol = p.symbol AND b.session_date = u.date GROUP BY p.symbol, p.session_date""")
def _(m):
    from tidemark.plans.q_ledger import tick_days
    w = m.ledger().select("symbol", "session_date").distinct()
    out = readers.warmup_windows(m.symbol_bars(1), w, tick_days(m))
    return out.groupBy("symbol", "target_date").agg(F.count(F.lit(1)).alias("bars"), F.count_distinct("session_date").alias("sessions"))


@query("single_source_check", "2.1.9", "SELECT l_returnflag, count(DISTINCT l_linestatus) AS sources, @I(count(DISTINCT l_linestatus) <= 1) AS accepted FROM lineitem GROUP BY 1")
def _(m):
    return readers.one_source(m.table("lineitem"), ["l_returnflag"], "l_linestatus")


def report_lines(m):
    """Fills as the lines of two overlapping broker reports, with order lines among them."""
    f = m.fills()
    qty = F.when(F.col("side") == "SELL", -F.col("qty")).otherwise(F.col("qty"))
    line = lambda level: F.concat_ws(",", F.col("seq").cast("string"), F.translate("symbol", "0123456789", "ABCDEFGHIJ"), F.date_format("session_date", "yyyyMMdd"), F.date_format("ts", "yyyyMMdd;HHmmss"),
                                     qty.cast("string"), F.col("price").cast("string"), F.lit("-1"), F.lit("0"), F.col("side"), F.lit(level), F.lit("STK"))
    parts = [f.select(line("EXECUTION").alias("line")), f.filter("seq % 2 = 0").select(line("EXECUTION").alias("line")), f.filter("seq % 3 = 0").select(line("ORDER").alias("line"))]
    return reduce(DataFrame.unionByName, parts)


@query("executions_by_id", "2.1.10 2.1.11", """
SELECT CAST(seq AS VARCHAR) AS trade_id, translate(symbol, '0123456789', 'ABCDEFGHIJ') AS symbol, @D(session_date) AS trade_date, @R(qty) AS qty, @R(price) AS price, @R(-1) AS commission, side, 1 AS time_known FROM fills""")
def _(m):
    raw = report_lines(m).select(F.from_csv("line", EXECUTION_REPORT).alias("r")).select("r.*")
    return readers.execution_rows(raw).select("trade_id", "symbol", "trade_date", "qty", "price", "commission", "side", "time_known")


@query("fill_log_generations", "2.1.12", """
SELECT @I(seq) AS seq, @R(price) AS price, @I(CASE WHEN seq % 2 = 0 THEN qty END) AS qty, @D(session_date) AS session_date FROM fills""")
def _(m):
    f = m.fills()
    name = F.concat(F.lit("/logs/fills_"), F.col("session_date").cast("string"), F.lit(".csv"))
    old = f.filter("seq % 2 = 1").select(F.concat_ws(",", F.col("seq").cast("string"), F.col("price").cast("string")).alias("line"), name.alias("source_file"))
    new = f.filter("seq % 2 = 0").select(F.concat_ws(",", F.col("seq").cast("string"), F.col("price").cast("string"), F.col("qty").cast("string")).alias("line"), name.alias("source_file"))
    read = lambda d, header: d.select(F.from_csv("line", header).alias("r"), "source_file").select("r.*", "source_file")
    return readers.log_rows([read(old, "seq bigint, price double"), read(new, "seq bigint, price double, qty bigint")]).select("seq", "price", "qty", "session_date")


@query("json_facts", "2.1.13", """
SELECT @I(o_custkey) AS cik, 'T' || o_orderpriority[1:1] AS tag, 'USD' AS unit, @D(CAST(o_orderdate AS DATE) - 45) AS "end", @D(CAST(o_orderdate AS DATE)) AS filed, o_orderstatus AS form, @R(o_totalprice) AS val FROM orders""")
def _(m):
    day = F.to_date("o_orderdate")
    row = F.struct(F.date_sub(day, 135).cast("string").alias("start"), F.date_sub(day, 45).cast("string").alias("end"), day.cast("string").alias("filed"), F.col("o_orderstatus").alias("form"), F.col("o_totalprice").cast("double").alias("val"))
    body = F.to_json(F.struct(F.lit("gaap").alias("taxonomy"), F.concat(F.lit("T"), F.substring("o_orderpriority", 1, 1)).alias("tag"), F.col("o_custkey").alias("cik"), F.create_map(F.lit("USD"), F.array(row)).alias("units")))
    return readers.concept_facts(m.table("orders").select(body.alias("body"))).select("cik", "tag", "unit", "end", "filed", "form", "val")


@query("json_members", "2.1.15", """
SELECT 'ix' AS index, 'S' || CAST(s_suppkey AS VARCHAR) AS code, @D(DATE '2000-01-01' + CAST(s_suppkey AS INT)) AS start, @D(CASE WHEN s_suppkey % 3 = 0 THEN DATE '2010-01-01' + CAST(s_suppkey AS INT) END) AS "end", @I(s_suppkey % 3 <> 0) AS active FROM supplier""")
def _(m):
    k = F.col("s_suppkey").cast("int")
    spell = F.struct(F.concat(F.lit("S"), k.cast("string")).alias("Code"), F.date_add(F.lit("2000-01-01").cast("date"), k).cast("string").alias("StartDate"),
                     F.when(k % 3 == 0, F.date_add(F.lit("2010-01-01").cast("date"), k).cast("string")).alias("EndDate"))
    return readers.constituents(m.table("supplier").select(F.to_json(F.create_map(k.cast("string"), spell)).alias("body")), "ix")


@query("headline_scan", "2.1.14", """
WITH h AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Acme announces 1-for-12 reverse split' WHEN 1 THEN 'Acme enters ATM program' WHEN 2 THEN 'Acme regained compliance, reverse split' WHEN 3 THEN 'Nasdaq notice: minimum bid deficiency' ELSE 'Acme opens a store' END AS head FROM documents)
SELECT 'S' || doc_id % 50 AS symbol, head AS headline, @T(TIMESTAMP '2024-01-02 09:00:00' + doc_id * INTERVAL 1 MINUTE) AS created_at, @I(1 + doc_id % 4) AS symbol_count,
 CASE doc_id % 5 WHEN 0 THEN 'REVERSE_SPLIT' WHEN 1 THEN 'ATM' WHEN 3 THEN 'DELIST_NOTICE' END AS label FROM h""")
def _(m):
    k = F.col("doc_id")
    heads = ["Acme announces 1-for-12 reverse split", "Acme enters ATM program", "Acme regained compliance, reverse split", "Nasdaq notice: minimum bid deficiency", "Acme opens a store"]
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704186000) + k * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.concat_ws(",", F.concat(F.lit("S"), (k % 50).cast("string")), F.concat(F.lit('"'), F.element_at(F.array(*map(F.lit, heads)), (k % 5 + 1).cast("int")), F.lit('"')), stamp, (1 + k % 4).cast("string"))
    return readers.headline_rows(m.table("documents").select(F.from_csv(line, readers.HEADLINE_CSV).alias("r")).select("r.*"))


@query("filing_scan", "2.1.14", """
WITH f AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '8-K' WHEN 1 THEN '424B3' ELSE '10-Q' END AS form, CASE o_orderkey % 4 WHEN 0 THEN '1.01,3.02' WHEN 1 THEN '5.03' WHEN 2 THEN '9.01' END AS items FROM orders)
SELECT 'S' || o_orderkey % 50 AS symbol, form, items, array_to_string(list_filter([CASE WHEN form = '424B3' THEN 'ACTIVE_SHELF_CANDIDATE' END, CASE WHEN form = '8-K' AND o_orderkey % 4 = 0 THEN 'TRIGGER_A' END, CASE WHEN form = '8-K' AND o_orderkey % 4 = 1 THEN 'TRIGGER_B' END], lambda x: x IS NOT NULL), ',') AS labels FROM f""")
def _(m):
    k = F.col("o_orderkey")
    form = F.when(k % 3 == 0, "8-K").when(k % 3 == 1, "424B3").otherwise("10-Q")
    items = F.when(k % 4 == 0, '"1.01,3.02"').when(k % 4 == 1, "5.03").when(k % 4 == 2, "9.01").otherwise("")
    line = F.concat_ws(",", F.concat(F.lit("S"), (k % 50).cast("string")), form, items, F.lit("2024-01-02T16:05:00.000Z"))
    rows = readers.filing_rows(m.table("orders").select(F.from_csv(line, readers.FILING_CSV).alias("r")).select("r.*"))
    return rows.select("symbol", "form", "items", F.array_join("labels", ",").alias("labels"))


@query("unmixed_rows", "2.1.9", "SELECT symbol, @D(session_date) AS session_date, count(*) AS n FROM fills GROUP BY 1, session_date HAVING count(DISTINCT side) = 1")
def _(m):
    """Sessions whose fills come from one side, read as from one source."""
    on = ["symbol", "session_date"]
    fit = readers.one_source(m.fills(), on, "side").filter("accepted").select(*on)
    return readers.unmixed(m.fills().join(fit, on, "left_semi"), on, "side").groupBy(*on).agg(F.count(F.lit(1)).alias("n"))


@query("schema_drift", "2.1.20", """
SELECT d.*, n AS stored FROM (VALUES ('bar_daily', 'dataset', 'blocked'), ('bar_daily', 'open', 'addable'), ('bar_daily', 'high', 'addable'), ('bar_daily', 'low', 'addable'), ('bar_daily', 'dollar_volume', 'addable')) d("table", "column", kind), (SELECT count(*) AS n FROM daily)""")
def _(m):
    from tidemark.sources.store import drift_rows

    store = Store(m.spark, J.shared_folder(m.spark))
    m.daily().select("symbol", F.col("date").alias("session_date"), "close", "volume").write.parquet(store.path("bar_daily"))
    stored = m.spark.read.parquet(store.path("bar_daily")).agg(F.count(F.lit(1)).alias("stored"))
    return drift_rows(store, ["bar_daily"]).crossJoin(F.broadcast(stored))


@query("table_counts", "2.1.22", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in TABLES))
def _(m):
    parts = [m.table(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), "n") for t in TABLES]
    return reduce(DataFrame.unionByName, parts)


# ---- rule surface (2.19)

@query("named_rules", "2.19.1 2.19.4", f"""
SELECT symbol, @D(date) AS date, @I(coalesce(close > CASE WHEN count(*) OVER p = 20 THEN max(high) OVER p END, false)) AS channel, @I(coalesce(close > lag(close, 3) OVER (PARTITION BY symbol ORDER BY date), false)) AS rising FROM daily WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def _(m):
    return rules.apply_rules(m.daily(), ["channel", "rising"]).select("symbol", "date", "channel", "rising")


@query("gate_as_series", "2.19.2", """
WITH g AS (SELECT symbol, ts, close >= open AS ok FROM bars5) SELECT t.symbol, count(*) AS n, count(*) FILTER (ok) AS allowed FROM (SELECT market AS symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS ts FROM ticks WHERE market = 'purchase') t JOIN g USING (symbol, ts) GROUP BY 1""")
def _(m):
    b = m.bars()
    e = m.market_ticks().filter("symbol = 'purchase'").select("symbol", clock.floor_to("ts", 300).alias("ts"))
    return rules.gated(e, b.select("symbol", "ts", (F.col("close") >= F.col("open")).alias("ok")), ["symbol", "ts"]).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ok"), 1)).alias("allowed"))


@query("per_session_map", "2.19.3", """
SELECT symbol, @D(session_date) AS session_date, count(*) AS bars, @R(last(close ORDER BY ts) / first(open ORDER BY ts) - 1) AS day_return FROM bars5 GROUP BY 1, session_date""")
def _(m):
    import pandas as pd

    def day(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts")
        return pd.DataFrame([(*key, len(g), g["close"].iloc[-1] / g["open"].iloc[0] - 1)], columns=["symbol", "session_date", "bars", "day_return"])

    return rules.map_sessions(m.bars(), day, "symbol string, session_date date, bars bigint, day_return double")


@query("store_as_views", "2.19.5", "SELECT symbol, count(*) AS n FROM daily GROUP BY 1")
def _(m):
    m.daily().createOrReplaceTempView("bars_daily")
    return m.spark.sql("SELECT symbol, count(*) AS n FROM bars_daily GROUP BY symbol")


@query("row_generators", "2.19.7", """
SELECT @D(session_date) AS session_date, count(*) AS ticks, @I(min(tick)) AS first_tick, @I(max(tick)) AS last_tick FROM (SELECT DISTINCT session_date FROM bars5), (SELECT unnest(range(255, 571, 15)) AS tick) GROUP BY session_date""")
def _(m):
    from tidemark.operators import screen as S
    from tidemark.plans.q_screen import CFG
    return S.tick_grid(m.bars(), CFG).groupBy("session_date").agg(F.count(F.lit(1)).alias("ticks"), F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"))


# ---- the store (2.1)

@query("store_load", "2.1.17 2.1.18", """
SELECT 'A' AS dataset, count(*) AS n, count(DISTINCT date) AS days, @R(sum(CASE WHEN volume % 2 = 0 THEN close + 1 ELSE close END)) AS closes FROM daily
UNION ALL SELECT 'B', count(*), count(DISTINCT date), @R(sum(close)) FROM daily WHERE volume % 3 = 0""", digits=3)
def _(m):
    store = Store(m.spark, J.shared_folder(m.spark))
    # Each load reads its rows several times.
    d = staged(m.daily().select("symbol", F.col("date").alias("session_date"), "open", "high", "low", "close", "volume"))
    store.load("bar_daily", d.withColumn("dataset", F.lit("A")), "bars", "/x/a.csv", "2024-01-02 00:00:00")
    store.load("bar_daily", d.filter("volume % 3 = 0").withColumn("dataset", F.lit("B")), "bars", "/x/b.csv", "2024-01-02 00:00:00")
    # A second load of half the keys replaces those rows and leaves the others and the other dataset.
    store.load("bar_daily", d.filter("volume % 2 = 0").withColumn("dataset", F.lit("A")).withColumn("close", F.col("close") + 1), "bars", "/x/a.csv", "2024-01-03 00:00:00")
    return store.read("bar_daily").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_date").alias("days"), F.sum("close").alias("closes"))


@query("report_with_its_run", "2.1.23", "SELECT count(*) AS trades, @R(sum(net)) AS net, 1 AS refusals FROM ledger", digits=3)
def _(m):
    path = J.shared_folder(m.spark)
    write_report(m.ledger().select("trade_id", "symbol", "net"), path, {"friction": "1.0", "days": "all"})
    refused = report_refusals(m.spark, path, {"friction": "1.0", "days": "ten"}).agg(F.count(F.lit(1)).alias("refusals"))
    rows = m.spark.read.schema("trade_id bigint, symbol string, net double").option("header", True).csv(f"{path}/rows")
    return rows.agg(F.count(F.lit(1)).alias("trades"), F.sum("net").alias("net")).join(F.broadcast(refused), how="cross")


@query("archive_inventory", "2.1.21")
def _(m):
    return readers.inventory(m.spark, m.folder)
