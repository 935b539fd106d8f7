"""Study reports (2.20) over the driver's tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import labels as L, ledger as B, recursive as R, stats as T, windows as W
from tidemark.plans import studies as S
from tidemark.plans.q_ledger import entries, nbars, scored
from tidemark.plans.q_screen import screen_list
from tidemark.plans.registry import query

F0 = 4.26
NET = "net - 4.26"
CELL = f"count(*) AS trades, @R(sum({NET})) AS net, @R(avg({NET})) AS per_trade, @R(avg(CAST({NET} > 0 AS INT))) AS win_rate"


@query("study_time_of_day", "2.20.83 2.20.47", f"""SELECT printf('%02d:%02d', entry_minute // 30 * 30 // 60, entry_minute // 30 * 30 % 60) AS block, {CELL} FROM ledger GROUP BY 1""")
def _(m):
    from tidemark.functions import clock
    return S.book_table(m.ledger().withColumn("block", clock.half_hour_block(F.col("entry_minute"))), ["block"], F0)


@query("study_day_compare", "2.20.13 2.20.45", """
WITH f AS (SELECT session_date, count(*) AS fills, sum(CASE WHEN side = 'SELL' THEN qty * price ELSE -qty * price END) AS cash FROM fills GROUP BY 1), t AS (SELECT session_date, count(*) AS trades, sum(net) AS net FROM ledger GROUP BY 1)
SELECT @D(session_date) AS session_date, coalesce(fills, 0) AS fills, @R(coalesce(cash, 0)) AS cash, coalesce(trades, 0) AS trades, @R(coalesce(net, 0)) AS net FROM f FULL JOIN t USING (session_date)""")
def _(m):
    signed = F.when(F.col("side") == "SELL", F.col("qty") * F.col("price")).otherwise(-F.col("qty") * F.col("price"))
    a = m.fills().groupBy("session_date").agg(F.count(F.lit(1)).alias("fills"), F.sum(signed).alias("cash"))
    b = m.ledger().groupBy("session_date").agg(F.count(F.lit(1)).alias("trades"), F.sum("net").alias("net"))
    return a.join(b, "session_date", "full_outer").na.fill(0)


@query("study_regime", "2.20.44 2.20.64 2.20.11", f"""
WITH d AS (SELECT session_date, count(*) AS n FROM bars5 GROUP BY 1), q AS (SELECT *, lag(n) OVER (ORDER BY session_date) AS y, avg(n) OVER (ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM d)
SELECT CASE WHEN y IS NULL THEN 'unrated' WHEN y > a THEN 'hot' ELSE 'cold' END AS regime, {CELL} FROM ledger JOIN q USING (session_date) GROUP BY 1""")
def _(m):
    d = m.bars().groupBy("session_date").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy().orderBy("session_date")
    d = d.withColumn("y", F.lag("n").over(w)).withColumn("a", F.avg("n").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    label = F.when(F.col("y").isNull(), "unrated").when(F.col("y") > F.col("a"), "hot").otherwise("cold")
    return S.book_table(m.ledger().join(F.broadcast(d.select("session_date", label.alias("regime"))), "session_date"), ["regime"], F0)


@query("study_news", "2.20.49 2.20.50", f"""
WITH n AS (SELECT DISTINCT symbol, session_date FROM ticks WHERE market = 'error') SELECT CASE WHEN n.symbol IS NULL THEN 'NONE' ELSE 'NEWS' END AS tag, {CELL} FROM ledger l LEFT JOIN n USING (symbol, session_date) GROUP BY 1""")
def _(m):
    n = m.ticks().filter("market = 'error'").select("symbol", "session_date").distinct().withColumn("k", F.lit(1))
    t = m.ledger().join(n, ["symbol", "session_date"], "left").withColumn("tag", F.when(F.col("k").isNull(), "NONE").otherwise("NEWS"))
    return S.book_table(t, ["tag"], F0)


@query("study_price_bands", "2.20.55 2.20.86", f"""SELECT CASE WHEN entry_px < 10 THEN 'a:<10' WHEN entry_px < 50 THEN 'b:<50' ELSE 'c:50+' END AS band, {CELL} FROM ledger GROUP BY 1""")
def _(m):
    p = F.col("entry_px")
    return S.book_table(m.ledger().withColumn("band", F.when(p < 10, "a:<10").when(p < 50, "b:<50").otherwise("c:50+")), ["band"], F0)


GATES = [("cheap", "entry_px <= 60"), ("early", "entry_minute < 720"), ("large", "qty >= 50"), ("cheap_and_early", "entry_px <= 60 AND entry_minute < 720")]


@query("study_gates", "2.20.22 2.20.24 2.20.63", " UNION ALL ".join(f"""SELECT '{n}' AS gate, count(*) FILTER ({c}) AS kept, @R(sum({NET}) FILTER ({c})) AS kept_net, @R(avg({NET}) FILTER ({c})) AS kept_per_trade, count(*) FILTER (NOT ({c})) AS removed,
 @R(sum({NET}) FILTER (NOT ({c}))) AS removed_net FROM ledger""" for n, c in GATES))
def _(m):
    return S.gate_report(m.ledger(), [(n, F.expr(c)) for n, c in GATES], F0)


@query("study_halves_by_block", "2.20.27 2.20.98", f"""
WITH h AS (SELECT entry_minute // 240 AS block, half, avg({NET}) AS p FROM halved GROUP BY 1, 2), g AS (SELECT block, max(p) FILTER (half = 'early') AS early, max(p) FILTER (half = 'late') AS late FROM h GROUP BY 1)
SELECT @I(block) AS block, @R(early) AS early, @R(late) AS late, @I(coalesce(sign(early) = sign(late), false)) AS agree FROM g""")
def _(m):
    return S.halves_report(m.ledger().withColumn("block", F.floor(F.col("entry_minute") / 240)), ["block"], F0)


@query("study_exit_rules_paired", "2.20.100 2.20.127 2.20.82", """
WITH a AS (SELECT entry_id, any_value(symbol) AS symbol, arg_max(bc, j) / any_value(entry_px) - 1 AS ra FROM touches GROUP BY 1), d AS (SELECT a.symbol, o.exit_px / o.entry_px - 1 - ra AS d FROM outcomes o JOIN a USING (entry_id)),
c AS (SELECT symbol AS k, sum(d) AS total, row_number() OVER (ORDER BY md5(symbol)) AS slot, count(*) OVER () AS kk FROM d GROUP BY 1), p AS (SELECT draw, CAST('0x' || substr(md5('1|' || CAST(draw AS VARCHAR) || '|' || CAST(slot AS VARCHAR)), 1, 8) AS BIGINT) % kk + 1 AS slot FROM c, draws),
b AS (SELECT draw, sum(total) AS t FROM p JOIN c USING (slot) GROUP BY 1) SELECT count(*) AS pairs, @R(sum(d)) AS delta, @R(avg(CAST(d > 0 AS INT))) AS better, @R((SELECT avg(CAST(t > 0 AS INT)) FROM b)) AS share_positive FROM d""")
def _(m):
    last = nbars(m).groupBy(*W.SESSION).agg(F.max("i").alias("__end"), F.max_by("close", "i").alias("__close"))
    hold = entries(m).join(last, list(W.SESSION)).filter("__end > i").select(*W.SESSION, "entry_id", (F.try_divide("__close", "entry_px") - 1).alias("ret"))
    rule = L.first_touch(L.later_bars(entries(m), nbars(m), horizon=30), max_bars=30).withColumn("ret", F.try_divide("exit_px", "entry_px") - 1)
    return S.paired_report(hold, rule, "entry_id", 40)


@query("study_concentration", "2.20.90", """
WITH s AS (SELECT symbol, sum(net) AS t, row_number() OVER (ORDER BY round(sum(net), 6) DESC, symbol) AS k FROM ledger GROUP BY 1), n AS (SELECT unnest([1, 5, 20]) AS top) SELECT @I(top) AS top, @R(sum(t) FILTER (k <= top)) AS best, @R(sum(t)) AS total, @R(sum(t) FILTER (k <= top) / sum(t)) AS share FROM s, n GROUP BY top""")
def _(m):
    return S.concentration(m.ledger(), "symbol", [1, 5, 20])


@query("study_live_vs_sim", "2.20.43", """
WITH l AS (SELECT trade_id, net, entry_px FROM ledger WHERE trade_id % 3 <> 0), s AS (SELECT trade_id, net * 0.9::DOUBLE AS sn FROM ledger WHERE trade_id % 4 <> 1)
SELECT CASE WHEN l.net IS NULL THEN 'sim_only' WHEN sn IS NULL THEN 'live_only' ELSE 'matched' END AS part, CASE WHEN l.net IS NOT NULL AND sn IS NULL THEN 'no_signal' ELSE '' END AS why, count(*) AS trades, @R(sum(l.net)) AS live_net, @R(sum(sn)) AS sim_net FROM l FULL JOIN s USING (trade_id) GROUP BY 1, 2""")
def _(m):
    led = m.ledger()
    return S.live_against_sim(led.filter("trade_id % 3 <> 0"), led.filter("trade_id % 4 <> 1").withColumn("net", F.col("net") * 0.9), ["trade_id"], F.lit("no_signal"))


@query("study_clause_lockout", "2.20.86", """
SELECT a.first, a.second, count(*) FILTER (x AND y) AS together, count(*) FILTER (x AND NOT y) AS first_only, count(*) FILTER (NOT x AND y) AS second_only FROM (
 SELECT unnest(['rvol', 'rvol', 'range']) AS first, unnest(['range', 'gap', 'gap']) AS second, unnest([r, r, g]) AS x, unnest([g, p, p]) AS y FROM (SELECT coalesce(rvol >= 1.5, false) AS r, coalesce(range_pct >= 30, false) AS g, coalesce(gap_pct >= 20, false) AS p FROM screen_features)) a GROUP BY 1, 2""")
def _(m):
    f = W.screen_features(m.daily())
    return S.clause_lockout(f, [("rvol", F.col("rvol") >= 1.5), ("range", F.col("range_pct") >= 30), ("gap", F.col("gap_pct") >= 20)])


@query("study_point_in_time_floor", "2.20.51 2.20.52 2.20.53", f"""
WITH f AS (SELECT session_date, symbol, min(tick) AS first_seen FROM screen_list GROUP BY 1, 2) SELECT CASE WHEN f.symbol IS NULL THEN 'never_listed' WHEN entry_minute >= first_seen THEN 'after_floor' ELSE 'before_floor' END AS part, {CELL} FROM ledger l LEFT JOIN f USING (symbol, session_date) GROUP BY 1""")
def _(m):
    f = screen_list(m).groupBy("session_date", "symbol").agg(F.min("tick").alias("first_seen"))
    t = m.ledger().join(f, ["symbol", "session_date"], "left")
    part = F.when(F.col("first_seen").isNull(), "never_listed").when(F.col("entry_minute") >= F.col("first_seen"), "after_floor").otherwise("before_floor")
    return S.book_table(t.withColumn("part", part), ["part"], F0)


@query("study_rules_vs_pnl", "2.20.67", f"""SELECT CAST(entry_px <= 60 AS BIGINT) + CAST(entry_minute < 720 AS BIGINT) + CAST(qty >= 50 AS BIGINT) AS rules_met, {CELL} FROM ledger GROUP BY 1""")
def _(m):
    k = sum(((F.expr(c)).cast("int") for c in ("entry_px <= 60", "entry_minute < 720", "qty >= 50")), F.lit(0))
    return S.book_table(m.ledger().withColumn("rules_met", k), ["rules_met"], F0)


@query("study_bandwidth_buckets", "2.20.12", """
WITH b AS (SELECT symbol, date, close, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS mid, CASE WHEN count(*) OVER w = 20 THEN stddev_pop(close) OVER w END AS sd, lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) AS x FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
r AS (SELECT x / close - 1 AS o, row_number() OVER (ORDER BY v) - 1 AS r, count(*) OVER () AS nn, v FROM (SELECT *, round(4 * sd / mid, 9) AS v FROM b WHERE mid IS NOT NULL AND x IS NOT NULL))
SELECT @I(floor(((r + 1) * 4 - 1) / nn)) AS bucket, count(*) AS n, @R(avg(o)) AS mean FROM r GROUP BY floor(((r + 1) * 4 - 1) / nn)""", digits=4)
def _(m):
    b = W.bollinger(m.daily()).withColumn("x", W.lead("close", W.DAY, "date", 5)).withColumn("v", F.round("bb_width", 9))
    b = b.filter("v is not null and x is not null").withColumn("o", F.try_divide("x", "close") - 1)
    return T.quantile_buckets(b, "v", 4, "o").select("bucket", "n", "mean")


@query("study_event_day_removal", "2.20.88 2.20.146", f"""
SELECT CASE WHEN dayofweek(session_date) = 3 THEN 'event' ELSE 'other' END AS part, {CELL}, count(DISTINCT session_date) AS sessions FROM ledger GROUP BY 1""")
def _(m):
    t = m.ledger().withColumn("part", F.when(F.dayofweek("session_date") == 4, "event").otherwise("other"))
    return S.book_table(t, ["part"], F0).join(t.groupBy("part").agg(F.count_distinct("session_date").alias("sessions")), "part")


@query("study_index_direction", "2.20.91", f"""
WITH i AS (SELECT session_date, avg(CASE WHEN c > o THEN 1 WHEN c < o THEN -1 ELSE 0 END) AS d FROM ranges GROUP BY 1) SELECT CASE WHEN d > 0 THEN 'with' WHEN d < 0 THEN 'against' ELSE 'flat' END AS index_side, {CELL} FROM ledger JOIN i USING (session_date) GROUP BY 1""")
def _(m):
    from tidemark.operators.signals import opening_range
    i = opening_range(m.bars(), 30).groupBy("session_date").agg(F.avg("side").alias("d"))
    t = m.ledger().join(F.broadcast(i), "session_date").withColumn("index_side", F.when(F.col("d") > 0, "with").when(F.col("d") < 0, "against").otherwise("flat"))
    return S.book_table(t, ["index_side"], F0)


@query("study_break_volume", "2.20.92", """
WITH j AS (SELECT b.*, h, avg(volume) OVER (PARTITION BY b.symbol, b.session_date ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS av FROM bars5 b JOIN ranges r USING (symbol, session_date) WHERE minute < 960 AND minute >= 570), k AS (SELECT symbol, session_date, arg_min(volume / av, ts) AS vr FROM j WHERE minute >= 600 AND high >= h GROUP BY 1, 2)
SELECT CASE WHEN vr >= 1.5 THEN 'loud' WHEN vr IS NULL THEN 'none' ELSE 'quiet' END AS volume_side, count(*) AS breaks, @R(avg(vr)) AS mean_ratio FROM k GROUP BY 1""")
def _(m):
    from tidemark.operators.signals import opening_range
    b = m.bars().filter("minute >= 570 and minute < 960")
    av = F.avg("volume").over(W.frame(W.SESSION, "ts", Window.unboundedPreceding, -1))
    j = b.withColumn("vr", F.try_divide("volume", av)).join(opening_range(m.bars(), 30).select(*W.SESSION, "or_high"), list(W.SESSION))
    k = j.filter("minute >= 600 and high >= or_high").groupBy(*W.SESSION).agg(F.min_by("vr", "ts").alias("vr"))
    side = F.when(F.col("vr") >= 1.5, "loud").when(F.col("vr").isNull(), "none").otherwise("quiet")
    return k.groupBy(side.alias("volume_side")).agg(F.count(F.lit(1)).alias("breaks"), F.avg("vr").alias("mean_ratio"))


@query("study_reversal_picks", "2.20.94", """
WITH r AS (SELECT symbol, date, round(close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY date) - 1, 9) AS r, lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS fwd FROM daily), n AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM r WHERE r IS NOT NULL),
p AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY date ORDER BY r, symbol) <= greatest(1, round_even(n / 10, 0))), a AS (SELECT date, avg(fwd) AS base FROM r GROUP BY 1)
SELECT @I(year(date)) AS year, count(*) AS picks, @R(avg(fwd)) AS mean, @R(avg(fwd - base)) AS excess FROM p JOIN a USING (date) WHERE fwd IS NOT NULL GROUP BY year(date)""")
def _(m):
    from tidemark.operators.screen import bottom_decile
    d = m.daily().withColumn("ret", F.round(F.try_divide(F.col("close"), W.lag("close", W.DAY, "date", 5)) - 1, 9)).withColumn("fwd", F.try_divide(W.lead("close", W.DAY, "date", 5), F.col("close")) - 1)
    base = d.groupBy("date").agg(F.avg("fwd").alias("base"))
    p = bottom_decile(d, ["date"], "ret").join(F.broadcast(base), "date").filter("fwd is not null")
    return p.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("picks"), F.avg("fwd").alias("mean"), F.avg(F.col("fwd") - F.col("base")).alias("excess"))


@query("study_indicator_snapshot", "2.20.105", """
SELECT symbol, @D(max(date)) AS date, @R(arg_max(ema9, date)) AS ema9, @R(arg_max(atr14, date)) AS atr14, @R(arg_max(rsi14, date)) AS rsi14, @R(arg_max(macd, date)) AS macd FROM ind GROUP BY 1""", digits=4)
def _(m):
    names = ["ema9", "atr14", "rsi14", "macd"]
    df = R.with_indicators(m.daily(), names)
    return df.groupBy("symbol").agg(F.max("date").alias("date"), *[F.max_by(n, "date").alias(n) for n in names])


@query("study_macro_changes", "2.20.107", """
WITH d AS (SELECT date, avg(close) AS c FROM daily GROUP BY 1) SELECT @D(date) AS date, @R(c) AS close, @R(c / lag(c) OVER (ORDER BY date) - 1) AS change_1, @R(c / lag(c, 5) OVER (ORDER BY date) - 1) AS change_5 FROM d""")
def _(m):
    d = m.daily().groupBy("date").agg(F.avg("close").alias("close"))
    w = Window.partitionBy().orderBy("date")
    return d.select("date", "close", (F.col("close") / F.lag("close").over(w) - 1).alias("change_1"), (F.col("close") / F.lag("close", 5).over(w) - 1).alias("change_5"))


@query("study_own_entries_mechanical_exits", "2.20.104 2.20.57", """
SELECT reason, count(*) AS n, @R(avg(exit_px / entry_px - 1)) AS mean, @R(avg(mfe)) AS mfe, @R(avg(mae)) AS mae FROM scored GROUP BY 1""")
def _(m):
    return scored(m).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.avg(F.try_divide("exit_px", "entry_px") - 1).alias("mean"), F.avg("mfe").alias("mfe"), F.avg("mae").alias("mae"))


@query("study_session_rules", "2.20.74", f"""
WITH g AS (SELECT session_date, min(exit_ts) FILTER (peak >= 500 AND realised <= 0.5 * peak) AS t FROM landed GROUP BY 1), b AS (SELECT *, row_number() OVER (PARTITION BY symbol, session_date ORDER BY entry_ts, trade_id) AS o FROM ledger),
r AS (SELECT 'base' AS rule, net FROM b UNION ALL SELECT 'cap_1', net FROM b WHERE o <= 1 UNION ALL SELECT 'skip_first', net FROM b WHERE o > 1 UNION ALL SELECT 'give_back', net FROM b JOIN g USING (session_date) WHERE NOT coalesce(entry_ts >= t, false))
SELECT rule, {CELL} FROM r GROUP BY 1""")
def _(m):
    n = m.numbered_ledger()
    kept = B.session_stop(n, ["session_date"], B.give_back(0.5, 500.0), 1.0).filter("not removed")
    parts = [("base", n), ("cap_1", B.entry_cap(n, 1)), ("skip_first", B.skip_first(n)), ("give_back", kept)]
    u = None
    for name, df in parts:
        p = df.select(F.lit(name).alias("rule"), "net")
        u = p if u is None else u.unionByName(p)
    return S.book_table(u, ["rule"], F0)


@query("study_capacity", "2.20.5", """
WITH b AS (SELECT f.qty, v.volume FROM (SELECT f.*, t.market FROM fills f JOIN ticks t USING (seq)) f JOIN bars5 v ON v.symbol = f.market AND v.ts = time_bucket(INTERVAL 5 MINUTE, f.ts)), p AS (SELECT unnest([0.05, 0.1, 0.25]::DOUBLE[]) AS share)
SELECT @R(share) AS share, count(*) AS fills, count(*) FILTER (qty <= volume * share) AS fits, @R(avg(floor(volume * share))) AS mean_size FROM b, p GROUP BY share""")
def _(m):
    from tidemark.functions import clock
    f = m.fills().join(m.ticks().select("seq", "market"), "seq").select(F.col("market").alias("symbol"), clock.floor_to("ts", 300).alias("ts"), "qty")
    b = f.join(m.bars(5).select("symbol", "ts", "volume"), ["symbol", "ts"]).withColumn("share", F.explode(F.array(*[F.lit(x) for x in (0.05, 0.1, 0.25)])))
    room = F.col("volume") * F.col("share")
    return b.groupBy("share").agg(F.count(F.lit(1)).alias("fills"), F.count(F.when(F.col("qty") <= room, 1)).alias("fits"), F.avg(F.floor(room)).alias("mean_size"))


@query("study_volume_deciles", "2.20.81", """
WITH v AS (SELECT l.trade_id, l.net, sum(t.size) + l.trade_id * 1e-7::DOUBLE AS v FROM ledger l JOIN ticks t USING (symbol, session_date) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY v) - 1 AS r, count(*) OVER () AS nn FROM v)
SELECT @I(floor(((r + 1) * 10 - 1) / nn)) AS bucket, count(*) AS n, @R(avg(net)) AS mean, @R(avg(CAST(net > 0 AS INT))) AS win FROM r GROUP BY floor(((r + 1) * 10 - 1) / nn)""")
def _(m):
    day = m.ticks().groupBy("symbol", "session_date").agg(F.sum("size").alias("day_volume"))
    t = m.ledger().join(day, ["symbol", "session_date"]).withColumn("v", F.col("day_volume") + F.col("trade_id") * 1e-7)
    return T.quantile_buckets(t, "v", 10, "net").select("bucket", "n", "mean", "win")


FILTERS = [("all", "true"), ("cheap", "close < 1200"), ("gap_up", "gap >= 0.02"), ("wide", "width >= 0.2"), ("busy", "volume >= 60")]


@query("study_universe_lift", "2.20.85", f"""
WITH d AS (SELECT *, open / nullif(lag(close) OVER w, 0) - 1 AS gap, high / nullif(low, 0) - 1 AS width, lead(close) OVER w / nullif(close, 0) - 1 AS later FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY date)), k AS (SELECT * FROM d WHERE later IS NOT NULL)
""" + " UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) FILTER ({c}) AS kept, @R(avg(CAST(later >= 0.05 AS INT)) FILTER ({c})) AS hit_rate, @R((avg(CAST(later >= 0.05 AS INT)) FILTER ({c})) / avg(CAST(later >= 0.05 AS INT))) AS lift FROM k" for n, c in FILTERS))
def _(m):
    w = Window.partitionBy("symbol").orderBy("date")
    d = m.daily().withColumn("gap", F.try_divide("open", F.lag("close").over(w)) - 1).withColumn("width", F.try_divide("high", "low") - 1)
    d = d.withColumn("later", F.try_divide(F.lead("close").over(w), "close") - 1).filter("later is not null")
    return S.lift_report(d, [(n, F.expr(c)) for n, c in FILTERS], F.col("later") >= 0.05)


@query("study_range_rank", "2.20.61", """
WITH d AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY date) / nullif(close, 0) - 1 AS later, row_number() OVER (PARTITION BY date ORDER BY round(high / nullif(low, 0), 9) DESC NULLS LAST, symbol) AS k FROM daily)
SELECT CAST(CASE WHEN k <= 5 THEN 5 WHEN k <= 10 THEN 10 ELSE 99 END AS BIGINT) AS top, count(later) AS names, @R(avg(later)) AS mean, @R(avg(CAST(later > 0 AS INT))) AS share_up FROM d WHERE later IS NOT NULL GROUP BY 1""")
def _(m):
    w = Window.partitionBy("symbol").orderBy("date")
    d = m.daily().withColumn("later", F.try_divide(F.lead("close").over(w), "close") - 1)
    k = F.row_number().over(Window.partitionBy("date").orderBy(F.desc_nulls_last(F.round(F.try_divide("high", "low"), 9)), "symbol"))
    d = d.withColumn("top", F.when(k <= 5, 5).when(k <= 10, 10).otherwise(99)).filter("later is not null")
    return d.groupBy("top").agg(F.count("later").alias("names"), F.avg("later").alias("mean"), F.avg((F.col("later") > 0).cast("int")).alias("share_up"))
