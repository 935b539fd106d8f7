"""Statistics, verdicts and grids (2.15, 2.16)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import grids as G, opening_grid as OG, populations as O, stats as T, windows as W
from tidemark.plans.q_ledger import entries, nbars, scored
from tidemark.plans.registry import query, view

N = 40
F0 = 1.0

view("cut", "SELECT session_date AS cut FROM (SELECT session_date, row_number() OVER (ORDER BY session_date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT session_date FROM ledger)) WHERE k = n // 2 + 1")
view("halved", "SELECT l.*, CASE WHEN session_date < cut THEN 'early' ELSE 'late' END AS half FROM ledger l, cut")
view("draws", f"SELECT unnest(range(0, {N})) AS draw")


def hexd(text, digits=8):
    return f"CAST('0x' || substr(md5({text}), 1, {digits}) AS BIGINT)"


def halved(m):
    return O.with_half(m.ledger())


@query("net_and_halves", "2.15.1 2.15.2", "SELECT half, count(*) AS trades, @R(sum(net - 1)) AS net, @R(avg(net - 1)) AS per_trade FROM halved GROUP BY 1")
def _(m):
    return T.book_totals(halved(m), ["half"], F0)


@query("drop_top_levels", "2.15.3", """
SELECT @R(sum(net) - (SELECT sum(net) FROM (SELECT net FROM ledger ORDER BY net DESC, trade_id LIMIT 10))) AS trades_without,
 @R(sum(net) - (SELECT sum(t) FROM (SELECT sum(net) AS t FROM ledger GROUP BY symbol ORDER BY round(sum(net), 6) DESC, symbol LIMIT 5))) AS symbols_without FROM ledger""")
def _(m):
    led = m.ledger()
    s = led.groupBy("symbol").agg(F.round(F.sum("net"), 6).alias("t"))
    a = T.drop_top(led, "net", 10, ["trade_id"]).withColumnRenamed("without", "trades_without")
    return a.join(F.broadcast(T.drop_top(s, "t", 5, ["symbol"]).withColumnRenamed("without", "symbols_without")), how="cross")


@query("paired_delta_by_symbol_day", "2.15.4", """
WITH a AS (SELECT symbol, session_date, sum(net - 1) AS a FROM ledger GROUP BY 1, 2), b AS (SELECT symbol, session_date, sum(net - 1) AS b FROM ledger WHERE qty > 30 GROUP BY 1, 2)
SELECT symbol, @D(session_date) AS session_date, @R(coalesce(b, 0) - coalesce(a, 0)) AS delta FROM a FULL JOIN b USING (symbol, session_date)""")
def _(m):
    led = m.ledger()
    return T.paired_deltas(led, led.filter("qty > 30"), ["symbol", "session_date"], F0)


def boot_view(name, source, key, net):
    """Views of a cluster bootstrap whose cluster key is the SQL text `key`."""
    view(f"{name}_c", f"SELECT k, total, n, row_number() OVER (ORDER BY md5(k)) AS slot, count(*) OVER () AS kk FROM (SELECT {key} AS k, sum({net}) AS total, count(*) AS n FROM {source} GROUP BY 1)")
    view(f"{name}_d", f"SELECT p.draw, sum(c.total) AS total, sum(c.n) AS n FROM (SELECT draw, {hexd(chr(39) + '1|' + chr(39) + ' || CAST(draw AS VARCHAR) || ' + chr(39) + '|' + chr(39) + ' || CAST(slot AS VARCHAR)')} % kk + 1 AS slot FROM {name}_c, draws) p JOIN {name}_c c USING (slot) GROUP BY 1")


boot_view("boot_sym", "ledger", "symbol", "net")
boot_view("boot_day", "ledger", "symbol || '|' || CAST(session_date AS VARCHAR)", "net")


@query("cluster_bootstrap_symbol", "2.15.5 2.20.2", "SELECT @I(draw) AS draw, @R(total) AS total, @I(n) AS n FROM boot_sym_d")
def _(m):
    return T.cluster_bootstrap(m.ledger(), ["symbol"], N)


@query("cluster_bootstrap_symbol_day", "2.15.5", "SELECT @I(draw) AS draw, @R(total) AS total, @I(n) AS n FROM boot_day_d")
def _(m):
    return T.cluster_bootstrap(m.ledger(), ["symbol", "session_date"], N)


SUMMARY = """WITH r AS (SELECT *, row_number() OVER (ORDER BY total) - 1 AS r, count(*) OVER () AS nn FROM {0})
SELECT count(*) AS draws, @R(avg(CAST(total > 0 AS INT))) AS share_positive, @R(max(CASE WHEN r = floor(0.025::DOUBLE * (nn - 1)) THEN total END)) AS low, @R(max(CASE WHEN r = floor(0.5::DOUBLE * (nn - 1)) THEN total END)) AS mid,
 @R(max(CASE WHEN r = floor(0.975::DOUBLE * (nn - 1)) THEN total END)) AS high, @R(avg(total / n)) AS mean_per_trade FROM r"""


@query("bootstrap_interval", "2.15.5", SUMMARY.format("boot_sym_d"))
def _(m):
    return T.bootstrap_summary(T.cluster_bootstrap(m.ledger(), ["symbol"], N))


view("removal_rank", f"SELECT draw, trade_id, net, session_date, symbol, row_number() OVER (PARTITION BY draw ORDER BY md5('1|' || CAST(draw AS VARCHAR) || '|' || CAST(trade_id AS VARCHAR))) AS o FROM ledger, draws")


@query("random_removal", "2.15.6", """
WITH d AS (SELECT draw, sum(net - 1) AS removed FROM removal_rank WHERE o <= 100 GROUP BY 1), b AS (SELECT sum(net - 1) AS total, count(*) AS n FROM ledger), x AS (SELECT (total - removed) / (n - 100) - total / n AS pt, -removed / 500 AS pd FROM d, b)
SELECT @R(quantile_cont(pt, 0.05)) AS pt05, @R(quantile_cont(pt, 0.5)) AS pt50, @R(quantile_cont(pt, 0.95)) AS pt95, @R(quantile_cont(pd, 0.05)) AS pd05, @R(quantile_cont(pd, 0.5)) AS pd50, @R(quantile_cont(pd, 0.95)) AS pd95 FROM x""")
def _(m):
    return T.abstention(m.ledger(), 100, 500, N, friction=F0)


@query("random_removal_per_cell", "2.15.7", """
WITH k AS (SELECT session_date, count(*) // 4 AS k FROM ledger GROUP BY 1), r AS (SELECT draw, session_date, net, row_number() OVER (PARTITION BY draw, session_date ORDER BY md5('1|' || CAST(draw AS VARCHAR) || '|' || CAST(trade_id AS VARCHAR))) AS o FROM ledger, draws)
SELECT @I(draw) AS draw, @R(sum(net)) AS removed, count(*) AS removed_n FROM r JOIN k USING (session_date) WHERE o <= k GROUP BY draw""")
def _(m):
    led = m.ledger()
    k = led.groupBy("session_date").agg(F.floor(F.count(F.lit(1)) / 4).alias("k"))
    return T.removal_draws(led, k, ["session_date"], N)


@query("random_entry_control", "2.15.8", """
WITH e AS (SELECT session_date, entry_id, exit_px / entry_px - 1 AS ret, i % 16 = 1 AS took FROM scored), k AS (SELECT session_date, count(*) AS k FROM e WHERE took GROUP BY 1),
r AS (SELECT draw, session_date, ret, k, row_number() OVER (PARTITION BY draw, session_date ORDER BY md5('1|' || CAST(draw AS VARCHAR) || '|' || entry_id)) AS o FROM e JOIN k USING (session_date), draws), d AS (SELECT draw, avg(ret) AS mean FROM r WHERE o <= k GROUP BY 1), ob AS (SELECT avg(ret) AS observed FROM e WHERE took)
SELECT @R(max(observed)) AS observed, @R(avg(mean)) AS control_mean, @R((count(*) FILTER (mean >= observed) + 1) / (count(*) + 1)) AS p_value FROM d, ob""")
def _(m):
    e = scored(m).withColumn("ret", F.try_divide("exit_px", "entry_px") - 1)
    e = e.join(entries(m).select("entry_id", "i"), "entry_id")
    took = e.filter("i % 16 = 1")
    k = took.groupBy("session_date").agg(F.count(F.lit(1)).alias("k"))
    return T.control_p(took.agg(F.avg("ret").alias("observed")), T.random_entries(e, k, ["session_date"], N))


@query("coin_flip_sides", "2.15.9", f"""
SELECT @I(draw) AS draw, @R(sum(CASE WHEN {hexd("'1|' || CAST(draw AS VARCHAR) || '|' || CAST(trade_id AS VARCHAR)")} % 2 = 0 THEN gross ELSE -gross END)) AS total FROM ledger, draws GROUP BY draw""")
def _(m):
    return T.coin_flip(m.ledger(), N)


@query("label_permutation", "2.15.10 2.20.65", """
WITH d AS (SELECT session_date, sum(net) AS net, dayofweek(session_date) IN (1, 2) AS lab FROM ledger GROUP BY 1), l AS (SELECT lab, row_number() OVER (ORDER BY md5('label|' || CAST(session_date AS VARCHAR))) AS o FROM d),
u AS (SELECT draw, net, row_number() OVER (PARTITION BY draw ORDER BY md5('1|' || CAST(draw AS VARCHAR) || '|' || CAST(session_date AS VARCHAR))) AS o FROM d, draws), s AS (SELECT draw, avg(net) FILTER (lab) AS mean FROM u JOIN l USING (o) GROUP BY 1), ob AS (SELECT avg(net) FILTER (lab) AS observed FROM d)
SELECT @R(max(observed)) AS observed, @R(avg(mean)) AS control_mean, @R((count(*) FILTER (mean >= observed) + 1) / (count(*) + 1)) AS p_value FROM s, ob""")
def _(m):
    d = m.ledger().groupBy("session_date").agg(F.sum("net").alias("net")).withColumn("lab", F.dayofweek("session_date").isin(2, 3))
    p = T.permuted_labels(d, "lab", ["session_date"], N).groupBy("draw").agg(F.avg(F.when(F.col("permuted"), F.col("net"))).alias("mean"))
    return T.control_p(d.agg(F.avg(F.when(F.col("lab"), F.col("net"))).alias("observed")), p)


@query("matched_day_permutation", "2.15.11 2.20.87", f"""
WITH d AS (SELECT date, avg(close / open - 1) AS v, dayofweek(date) AS wd, day(date) <= 3 AS ev FROM daily GROUP BY 1), q AS (SELECT date, v, wd, row_number() OVER (PARTITION BY wd ORDER BY md5(CAST(date AS VARCHAR))) AS slot, count(*) OVER (PARTITION BY wd) AS k FROM d WHERE NOT ev),
p AS (SELECT draw, e.wd, {hexd("'1|' || CAST(draw AS VARCHAR) || '|' || CAST(e.date AS VARCHAR)")} % k.k + 1 AS slot FROM d e JOIN (SELECT wd, count(*) AS k FROM q GROUP BY 1) k USING (wd), draws WHERE ev), s AS (SELECT draw, quantile_cont(v, 0.5) AS mean FROM p JOIN q USING (wd, slot) GROUP BY 1),
ob AS (SELECT quantile_cont(v, 0.5) AS observed FROM d WHERE ev AND wd IN (SELECT wd FROM q)) SELECT @R(max(observed)) AS observed, @R(avg(mean)) AS control_mean, @R((count(*) FILTER (mean >= observed) + 1) / (count(*) + 1)) AS p_value FROM s, ob""")
def _(m):
    d = m.daily().groupBy("date").agg(F.avg(F.col("close") / F.col("open") - 1).alias("v")).withColumn("wd", F.dayofweek("date")).withColumn("ev", F.dayofmonth("date") <= 3)
    from tidemark.operators.scale import hash_ordinal
    q = hash_ordinal(d.filter("not ev"), ["wd"], F.col("date").cast("string"), "slot")
    k = q.groupBy("wd").agg(F.count(F.lit(1)).alias("k"))
    e = d.filter("ev").select("wd", F.col("date").alias("event")).join(F.broadcast(k), "wd")
    p = T.with_draws(e, N).withColumn("slot", T.draw_value("1", F.col("draw"), F.col("event")) % F.col("k") + 1)
    s = p.join(q.select("wd", "slot", "v"), ["wd", "slot"]).groupBy("draw").agg(F.percentile("v", F.lit(0.5)).alias("mean"))
    return T.control_p(d.filter("ev").join(F.broadcast(k), "wd", "left_semi").agg(F.percentile("v", F.lit(0.5)).alias("observed")), s)


@query("holm_adjustment", "2.15.12", """
WITH t AS (SELECT symbol AS test, round(count(*) FILTER (close <= open) / count(*), 9) / 10 AS p FROM daily GROUP BY 1), r AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1) * p) AS a FROM t)
SELECT test, @R(p) AS p, @R(max(a) OVER (ORDER BY p, test)) AS adjusted FROM r""")
def _(m):
    t = m.daily().groupBy(F.col("symbol").alias("test")).agg((F.round(F.count(F.when(F.col("close") <= F.col("open"), 1)) / F.count(F.lit(1)), 9) / 10).alias("p"))
    return T.holm(t)


@query("wilson_interval", "2.15.13", """
WITH k AS (SELECT symbol, count(*) FILTER (net > 0) AS k, count(*) AS n FROM ledger GROUP BY 1), p AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM k)
SELECT symbol, k, n, @R((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)) AS low, @R((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)) AS high FROM p""")
def _(m):
    g = m.ledger().groupBy("symbol").agg(F.count(F.when(F.col("net") > 0, 1)).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = T.wilson(F.col("k"), F.col("n"))
    return g.select("symbol", "k", "n", lo.alias("low"), hi.alias("high"))


@query("binomial_tail", "2.15.14", """
WITH k AS (SELECT symbol AS "case", count(*) FILTER (net > 0) AS k, count(*) AS n FROM ledger GROUP BY 1), x AS (SELECT *, unnest(range(k, n + 1)) AS x FROM k)
SELECT "case", k, n, @R(least(1, sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) - n * ln(2))))) AS tail FROM x GROUP BY 1, 2, 3""")
def _(m):
    g = m.ledger().groupBy(F.col("symbol").alias("case")).agg(F.count(F.when(F.col("net") > 0, 1)).alias("k"), F.count(F.lit(1)).alias("n"))
    return T.binomial_tail(g)


@query("rank_auc", "2.15.15 2.20.81", """
WITH r AS (SELECT half, net > 0 AS p, rank() OVER (PARTITION BY half ORDER BY entry_px) + (count(*) OVER (PARTITION BY half, entry_px) - 1) / 2 AS r FROM halved)
SELECT half, count(*) FILTER (p) AS n_pos, count(*) FILTER (NOT p) AS n_neg, @R((sum(r) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2) / (count(*) FILTER (p) * count(*) FILTER (NOT p))) AS auc FROM r GROUP BY 1""")
def _(m):
    return T.rank_auc(halved(m), "entry_px", F.col("net") > 0, ["half"])


@query("spearman", "2.15.16", """
WITH r AS (SELECT rank() OVER (ORDER BY entry_px) + (count(*) OVER (PARTITION BY entry_px) - 1) / 2 AS a, rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2 AS b FROM ledger) SELECT count(*) AS n, @R(corr(a, b)) AS rho FROM r""")
def _(m):
    return T.spearman(m.ledger(), "entry_px", "qty")


view("feature_rows", "SELECT half, 'entry_px' AS feature, entry_px + trade_id * 1e-7::DOUBLE AS v, net FROM halved UNION ALL SELECT half, 'minute', entry_minute + trade_id * 1e-7::DOUBLE, net FROM halved UNION ALL SELECT half, 'qty', CAST(qty AS DOUBLE), net FROM halved")
view("buckets", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY half, feature ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY half, feature) AS nn FROM feature_rows), b AS (SELECT *, CAST(floor(((r + 1) * 4 - 1) / nn) AS BIGINT) AS bucket FROM r),
 s AS (SELECT half, feature, v FROM b GROUP BY 1, 2, 3 HAVING count(DISTINCT bucket) > 1) SELECT half, feature, bucket, min(v) AS lo, max(v) AS hi, count(*) AS n, avg(net) AS mean, avg(CAST(net > 0 AS INT)) AS win FROM b WHERE (half, feature) NOT IN (SELECT half, feature FROM s) AND nn >= 20 GROUP BY 1, 2, 3""")


def feature_rows(m):
    h = halved(m)
    jit = F.col("trade_id") * 1e-7
    cols = F.array(F.struct(F.lit("entry_px").alias("feature"), (F.col("entry_px") + jit).alias("v")), F.struct(F.lit("minute").alias("feature"), (F.col("entry_minute") + jit).alias("v")),
                   F.struct(F.lit("qty").alias("feature"), F.col("qty").cast("double").alias("v")))
    return h.select("half", "net", F.explode(cols).alias("c")).select("half", "net", "c.*")


@query("quantile_buckets", "2.15.17", "SELECT half, feature, bucket, @R(lo) AS lo, @R(hi) AS hi, n, @R(mean) AS mean, @R(win) AS win FROM buckets")
def _(m):
    return T.quantile_buckets(feature_rows(m), "v", 4, "net", ["half", "feature"])


@query("feature_tiers", "2.15.18 2.20.20", """
WITH d AS (SELECT *, mean - lag(mean) OVER (PARTITION BY half, feature ORDER BY bucket) AS d FROM buckets), g AS (SELECT half, feature, CASE WHEN count(d) < 2 THEN 0 WHEN min(d) > 0 THEN 1 WHEN max(d) < 0 THEN -1 ELSE 0 END AS mono, arg_max(mean, bucket) - arg_min(mean, bucket) AS gap FROM d GROUP BY 1, 2),
t AS (SELECT feature, count(*) AS h, max(mono) FILTER (half = 'early') AS ma, max(mono) FILTER (half = 'late') AS mb, max(gap) FILTER (half = 'early') AS ga, max(gap) FILTER (half = 'late') AS gb FROM g GROUP BY 1)
SELECT feature, @R(ga) AS ga, @R(gb) AS gb, CASE WHEN h < 2 THEN 'NOTHING' WHEN ma <> 0 AND ma = mb AND (ga > 0) = (gb > 0) AND least(abs(ga), abs(gb)) > 4.26 THEN 'CANDIDATE' WHEN (ga > 0) = (gb > 0) AND least(abs(ga), abs(gb)) > 4.26 THEN 'WEAK' ELSE 'NOTHING' END AS tier FROM t""")
def _(m):
    b = T.quantile_buckets(feature_rows(m), "v", 4, "net", ["half", "feature"])
    return T.feature_tiers(T.direction(b, ["half", "feature"]), 4.26)


@query("bind_table", "2.15.19", """
SELECT half, @R(cut) AS cut, @R(avg(CAST(entry_px >= cut AS INT))) AS kept FROM halved, (SELECT unnest([10.0, 50.0, 100.0]::DOUBLE[]) AS cut) GROUP BY half, cut""")
def _(m):
    return T.bind_table(halved(m), "entry_px", "half", [10.0, 50.0, 100.0])


@query("case_control_sample", "2.15.20 2.20.69", f"""
SELECT @I(is_case) AS is_case, count(*) AS n, @R(sum(w)) AS weight FROM (SELECT seq, px > 150 AS is_case, CASE WHEN px > 150 THEN 1 ELSE 10 END AS w, {hexd("'1|' || CAST(seq AS VARCHAR)")} / 4294967296.0 AS u FROM ticks) WHERE is_case OR u < 0.1 GROUP BY is_case""")
def _(m):
    return T.case_control(m.ticks(), F.col("px") > 150, F.col("seq"), 0.1).groupBy("is_case").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


@query("solve_matched_threshold", "2.15.21 2.20.9 2.20.15", """
WITH c AS (SELECT entry_px, sum(count(*)) OVER (ORDER BY entry_px) - count(*) AS refused FROM ledger GROUP BY 1) SELECT @R(entry_px) AS entry_px, @I(refused) AS refused FROM c ORDER BY abs(refused - 400), entry_px LIMIT 1""")
def _(m):
    return T.solve_threshold(m.ledger(), "entry_px", 400)


@query("selection_decomposition", "2.15.22 2.20.8", """
WITH v AS (SELECT * FROM ledger WHERE entry_minute >= 300 AND trade_id % 5 <> 0), k AS (SELECT DISTINCT symbol, session_date FROM v)
SELECT CASE WHEN k.symbol IS NULL THEN 'selection' WHEN l.entry_minute < 300 THEN 'clock' WHEN v.trade_id IS NULL THEN 'dropped' ELSE 'common' END AS part, count(*) AS trades, @R(sum(l.net)) AS net
FROM ledger l LEFT JOIN k USING (symbol, session_date) LEFT JOIN v ON v.trade_id = l.trade_id GROUP BY 1""")
def _(m):
    led = m.ledger()
    v = led.filter("entry_minute >= 300 and trade_id % 5 <> 0")
    k = v.select("symbol", "session_date").distinct().withColumn("k", F.lit(1))
    j = led.join(k, ["symbol", "session_date"], "left").join(v.select("trade_id", F.lit(1).alias("v")), "trade_id", "left")
    part = F.when(F.col("k").isNull(), "selection").when(F.col("entry_minute") < 300, "clock").when(F.col("v").isNull(), "dropped").otherwise("common")
    return j.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("trades"), F.sum("net").alias("net"))


view("gated", "SELECT * FROM halved WHERE entry_px <= 60")
view("vdelta", "SELECT symbol, session_date, coalesce(b, 0) - coalesce(a, 0) AS delta FROM (SELECT symbol, session_date, sum(net - 1) AS a FROM halved GROUP BY 1, 2) FULL JOIN (SELECT symbol, session_date, sum(net - 1) AS b FROM gated GROUP BY 1, 2) USING (symbol, session_date)")
boot_view("boot_v", "vdelta", "symbol", "delta")
view("vnum", """WITH b AS (SELECT count(*) AS n, sum(net - 1) AS t, sum(net - 1) FILTER (half = 'early') AS te, sum(net - 1) FILTER (half = 'late') AS tl, count(*) FILTER (half = 'early') AS ne, count(*) FILTER (half = 'late') AS nl FROM halved),
 g AS (SELECT count(*) AS n, sum(net - 1) AS t, sum(net - 1) FILTER (half = 'early') AS te, sum(net - 1) FILTER (half = 'late') AS tl, count(*) FILTER (half = 'early') AS ne, count(*) FILTER (half = 'late') AS nl FROM gated)
 SELECT g.t / g.n - b.t / b.n AS pt, (g.t - b.t) / 500 AS pd, g.te / g.ne - b.te / b.ne AS et, g.tl / g.nl - b.tl / b.nl AS lt, (g.te - b.te) / 500 AS ed, (g.tl - b.tl) / 500 AS ld,
  (SELECT sum(delta) FROM vdelta) - (SELECT sum(delta) FROM (SELECT delta FROM vdelta ORDER BY delta DESC, symbol, session_date LIMIT 5)) AS dd, b.t - (SELECT sum(v) FROM (SELECT net - 1 AS v FROM halved ORDER BY 1 DESC, trade_id LIMIT 5)) AS db,
  g.t - (SELECT sum(v) FROM (SELECT net - 1 AS v FROM gated ORDER BY 1 DESC, trade_id LIMIT 5)) AS dg, (SELECT avg(CAST(total > 0 AS INT)) FROM boot_v_d) AS sp,
  (SELECT quantile_cont((b.t - removed) / (b.n - removed_n) - b.t / b.n, 0.95) FROM (SELECT draw, sum(net - 1) AS removed, count(*) AS removed_n FROM removal_rank, b, g WHERE o <= b.n - g.n GROUP BY draw), b WHERE removed_n < b.n) AS rp FROM b, g""")


@query("gate_verdict", "2.15.23 2.20.59 2.20.71", """
WITH f AS (SELECT *, list_filter([CASE WHEN pt >= 1 AND pd > 0 THEN NULL ELSE 'margin' END, CASE WHEN et > 0 AND lt > 0 AND ed > 0 AND ld > 0 THEN NULL ELSE 'halves' END, CASE WHEN dg > db AND dd > 0 THEN NULL ELSE 'drop_top' END, CASE WHEN sp >= 0.9 THEN NULL ELSE 'bootstrap' END, CASE WHEN pt > rp THEN NULL ELSE 'abstention' END], lambda x: x IS NOT NULL) AS f FROM vnum)
SELECT @R(pt) AS d_per_trade, @R(pd) AS d_per_day, @R(et) AS early_trade, @R(lt) AS late_trade, @R(dd) AS drop_delta, @R(sp) AS share_positive, @R(rp) AS random_p95, CASE WHEN (pt > 0) <> (pd > 0) THEN 'REFUSED' WHEN len(f) > 0 THEN 'NOTHING' ELSE 'PASSES' END AS verdict, array_to_string(f, ',') AS failed FROM f""")
def _(m):
    h = halved(m)
    return T.verdict(h, h.filter("entry_px <= 60"), 500, F0, draws=N)


@query("positive_control", "2.15.24", f"""
SELECT @I(flag) AS flag, count(*) AS n, @R(avg(r + CASE WHEN flag THEN 0.05 ELSE 0 END)) AS mean FROM (SELECT symbol, date, close / open - 1 AS r, {hexd("'1|' || symbol || '|' || CAST(date AS VARCHAR)")} / 4294967296.0 < 0.2 AS flag FROM daily) GROUP BY flag""")
def _(m):
    d = m.daily().withColumn("flag", T.draw_uniform("1", F.col("symbol"), F.col("date")) < 0.2)
    r = F.col("close") / F.col("open") - 1 + F.when(F.col("flag"), 0.05).otherwise(0.0)
    return d.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean"))


view("scores", "SELECT l.doc_id, quality, n_chars AS score FROM labels l JOIN documents USING (doc_id)")


def scores(m):
    return m.table("labels").join(m.table("documents"), "doc_id").select("doc_id", "quality", F.col("n_chars").alias("score"))


@query("classification_metrics", "2.15.25 2.20.101", """
WITH c AS (SELECT count(*) FILTER (quality = 1 AND score > 800) AS tp, count(*) FILTER (quality <> 1 AND score > 800) AS fp, count(*) FILTER (quality = 1 AND score <= 800) AS fn, count(*) FILTER (quality <> 1 AND score <= 800) AS tn FROM scores)
SELECT tp, fp, fn, tn, @R(tp / (tp + fp)) AS precision, @R(tp / (tp + fn)) AS recall, @R(5 * tp / (5 * tp + 4 * fn + fp)) AS f2 FROM c""")
def _(m):
    return T.metrics(scores(m).withColumn("pred", (F.col("score") > 800).cast("int")), "quality", "pred")


@query("threshold_scan_f2_youden", "2.15.25 2.15.26", """
WITH g AS (SELECT score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS n FROM scores GROUP BY 1), c AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS tot_p, sum(n) OVER () AS tot_n FROM g WINDOW w AS (ORDER BY score DESC))
SELECT score, @I(tp) AS tp, @I(fp) AS fp, @R(5 * tp / (5 * tp + 4 * (tot_p - tp) + fp)) AS f2, @R(tp / tot_p - fp / tot_n) AS youden FROM c""")
def _(m):
    return T.threshold_scan(scores(m), "score", "quality")


@query("fitted_classifiers", "2.15.26")
def _(m):
    """Quality labels from character shares of the texts."""
    text = F.coalesce("text", F.lit(""))
    size = F.greatest(F.char_length(text), F.lit(1))
    share = lambda keep: F.char_length(F.regexp_replace(text, keep, "")) / size
    d = m.table("documents").select("doc_id", share("[^%&#$*]+").alias("marks"), share("[^A-Z]+").alias("upper"), share("[^|!]+").alias("bars"), F.log1p(size.cast("double")).alias("size"))
    rows = m.table("labels").select("doc_id", "quality").join(d, "doc_id")
    return T.classifier_report(rows, ["marks", "upper", "bars", "size"], "quality", "doc_id")


@query("label_consistency", "2.15.25", """
WITH r AS (SELECT md5(lower(text)) AS item, quality FROM labels JOIN documents USING (doc_id)), g AS (SELECT item, count(*) AS n, greatest(sum(quality), count(*) - sum(quality)) AS most FROM r GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS items, @I(sum(n)) AS labels, @R(avg(CAST(most = n AS INT))) AS unanimous, @R(sum(most * (most - 1) / 2 + (n - most) * (n - most - 1) / 2) / sum(n * (n - 1) / 2)) AS pair_agreement FROM g""")
def _(m):
    """Texts that were labelled more than once."""
    rows = m.table("labels").join(m.table("documents").select("doc_id", F.md5(F.lower("text")).alias("item")), "doc_id")
    return T.consistency(rows, ["item"], "quality")


@query("rule_stump", "2.15.26", """
WITH f AS (SELECT quality, unnest(['n_chars', 'n_lines']) AS feature, unnest([n_chars, len(text) - len(replace(text, chr(10), ''))]) AS score FROM labels JOIN documents USING (doc_id)),
g AS (SELECT feature, score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS n FROM f GROUP BY 1, 2),
c AS (SELECT feature, score, sum(p) OVER w / sum(p) OVER a - sum(n) OVER w / sum(n) OVER a AS j FROM g WINDOW w AS (PARTITION BY feature ORDER BY score DESC), a AS (PARTITION BY feature)),
d AS (SELECT feature, score, CASE WHEN j >= 0 THEN 'at_least' ELSE 'below' END AS side, abs(j) AS youden FROM c)
SELECT feature, @R(score) AS threshold, side, @R(youden) AS youden FROM d ORDER BY round(youden, 9) DESC, feature, score LIMIT 1""")
def _(m):
    d = m.table("labels").join(m.table("documents").select("doc_id", "n_chars", (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))).alias("n_lines")), "doc_id")
    return T.stump(d, ["n_chars", "n_lines"], "quality")


@query("drawdown_monte_carlo", "2.15.27", f"""
WITH d AS (SELECT session_date, sum(net) AS net FROM ledger GROUP BY 1), s AS (SELECT net, row_number() OVER (ORDER BY md5(CAST(session_date AS VARCHAR))) AS slot, count(*) OVER () AS k FROM d),
p AS (SELECT draw, slot AS place, {hexd("'1|' || CAST(draw AS VARCHAR) || '|' || CAST(slot AS VARCHAR)")} % k + 1 AS slot FROM s, draws), e AS (SELECT draw, place, sum(net) OVER (PARTITION BY draw ORDER BY place) AS eq FROM p JOIN s USING (slot)), q AS (SELECT draw, greatest(0, max(eq) OVER (PARTITION BY draw ORDER BY place)) - eq AS dd FROM e)
SELECT @I(draw) AS draw, @R(max(dd)) AS max_drawdown FROM q GROUP BY draw""")
def _(m):
    return T.drawdown_paths(m.ledger(), N)


@query("random_gate_by_half", "2.15.28 2.20.145", f"""
WITH r AS (SELECT half, avg(CAST(entry_px <= 60 AS INT)) AS rate FROM halved GROUP BY 1)
SELECT @I(draw) AS draw, count(*) AS taken, @R(sum(net)) AS net FROM halved JOIN r USING (half), draws WHERE {hexd("'1|' || CAST(draw AS VARCHAR) || '|' || CAST(trade_id AS VARCHAR)")} / 4294967296.0 < rate GROUP BY draw""")
def _(m):
    h = halved(m)
    r = h.groupBy("half").agg(F.avg((F.col("entry_px") <= 60).cast("int")).alias("rate"))
    d = T.with_draws(h.join(F.broadcast(r), "half"), N)
    return d.filter(T.draw_uniform("1", F.col("draw"), F.col("trade_id")) < F.col("rate")).groupBy("draw").agg(F.count(F.lit(1)).alias("taken"), F.sum("net").alias("net"))


@query("leg_cost_state", "2.15.29 2.20.108", f"""
WITH s AS (SELECT side AS leg, session_date, sum(abs(price - round(price, 0))) AS total, count(*) AS n FROM fills GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY leg ORDER BY md5(CAST(session_date AS VARCHAR))) AS slot, count(*) OVER (PARTITION BY leg) AS k FROM s),
p AS (SELECT leg, draw, {hexd("'1|' || CAST(draw AS VARCHAR) || '|' || leg || '|' || CAST(slot AS VARCHAR)")} % k + 1 AS slot FROM o, draws), d AS (SELECT leg, draw, sum(total) / sum(n) AS v FROM p JOIN o USING (leg, slot) GROUP BY 1, 2)
SELECT d.leg, @R(max(c.cost)) AS cost, max(c.n) AS n, @R(quantile_cont(v, 0.025)) AS low, @R(quantile_cont(v, 0.975)) AS high FROM d JOIN (SELECT side AS leg, avg(abs(price - round(price, 0))) AS cost, count(*) AS n FROM fills GROUP BY 1) c USING (leg) GROUP BY d.leg""")
def _(m):
    legs = m.fills().select(F.col("side").alias("leg"), "session_date", F.abs(F.col("price") - F.round("price", 0)).alias("cost"))
    return T.cost_state(legs, N)


@query("risk_ratios", "2.15.30", """
WITH d AS (SELECT session_date, sum(net) AS net FROM ledger GROUP BY 1) SELECT count(*) AS days, @R(avg(net) / stddev_samp(net)) AS net_per_vol, @R(avg(net) / stddev_samp(net) * sqrt(252)) AS annualised,
 @R((SELECT sum(net) FROM (SELECT net, row_number() OVER (ORDER BY net DESC, session_date) AS r, count(*) OVER () AS n FROM d) WHERE r <= ceil(n / 10)) / sum(net)) AS concentration FROM d""")
def _(m):
    return T.risk_ratios(m.ledger().groupBy("session_date").agg(F.sum("net").alias("net")))


@query("net_quantiles_by_half", "2.4.12 2.15.2", "SELECT half, count(*) AS n, @R(quantile_cont(net, 0.25)) AS p25, @R(quantile_cont(net, 0.5)) AS p50, @R(quantile_cont(net, 0.75)) AS p75 FROM halved GROUP BY 1")
def _(m):
    return T.net_quantiles(halved(m), ["half"])


view("cells", "SELECT unnest([0.1, 0.2, 0.4]::DOUBLE[]) AS stop, t AS target FROM (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS t)")
view("grid_results", """WITH j AS (SELECT t.*, c.stop, c.target, CASE WHEN bl <= entry_px * (1 - c.stop) THEN least(entry_px * (1 - c.stop), bo) WHEN bh >= entry_px * (1 + c.target) THEN greatest(entry_px * (1 + c.target), bo) END AS px FROM touches t, cells c)
 SELECT entry_id, session_date, stop, target, coalesce(arg_min(px, j) FILTER (px IS NOT NULL), arg_max(bc, j)) / any_value(entry_px) - 1 AS ret FROM j GROUP BY 1, 2, 3, 4""")
GRID = G.cells(stop=[0.1, 0.2, 0.4], target=[0.5, 1.0, 2.0])


@query("exit_grid", "2.16.2 2.20.111", """
SELECT @R(stop) AS stop, @R(target) AS target, count(*) AS trades, @R(sum(ret)) AS total, @R(avg(ret)) AS mean, @I(count(*) < 10) AS refused, @R(avg(CAST(sum(ret) > 0 AS INT)) OVER ()) AS share_positive FROM grid_results GROUP BY stop, target""")
def _(m):
    return G.grid_report(G.exit_grid(entries(m), nbars(m), GRID), ["stop", "target"], 10)


view("orb_bars", "SELECT symbol, session_date, minute, open, high, low, close, row_number() OVER w AS i, lag(low) OVER w AS anchor FROM bars5 WHERE minute BETWEEN 570 AND 955 WINDOW w AS (PARTITION BY symbol, session_date ORDER BY ts)")
view("orb_setups", """WITH g AS (SELECT symbol, session_date, m AS minutes, max(high) FILTER (minute < 570 + m) AS hi, min(low) FILTER (minute < 570 + m) AS lo FROM orb_bars, (SELECT unnest([5, 15, 30]) AS m) GROUP BY 1, 2, 3),
r AS (SELECT *, hi - lo AS width, CASE WHEN hi IS NULL THEN 'no_range' WHEN (hi - lo) / lo * 100 < 0.5 THEN 'too_narrow' WHEN (hi - lo) / lo * 100 > 1500 THEN 'too_wide' END AS no FROM g),
l AS (SELECT b.*, r.minutes, r.hi, r.lo, r.width FROM orb_bars b JOIN r USING (symbol, session_date) WHERE no IS NULL AND b.minute >= 570 + minutes),
t AS (SELECT symbol, session_date, minutes, min(i) AS trig FROM l WHERE close > hi GROUP BY 1, 2, 3),
b AS (SELECT l.*, close < lo AS dead, bool_or(low <= hi) OVER w AND close > hi AS bl, bool_or(low <= lo + 0.62::DOUBLE * width) OVER w AND close > hi AS bz FROM l JOIN t USING (symbol, session_date, minutes) WHERE i > trig AND i < trig + 6 WINDOW w AS (PARTITION BY symbol, session_date, minutes ORDER BY i)),
q AS (SELECT symbol, session_date, minutes, min(i) FILTER (dead) AS dead, min(i) FILTER (bl) AS bl, min(i) FILTER (bz) AS bz FROM b GROUP BY 1, 2, 3),
e AS (SELECT r.*, retest, trig, CASE retest WHEN 'none' THEN trig WHEN 'level' THEN CASE WHEN dead IS NULL OR bl < dead THEN bl END ELSE CASE WHEN dead IS NULL OR bz < dead THEN bz END END + 1 AS entry_i FROM r LEFT JOIN t USING (symbol, session_date, minutes) LEFT JOIN q USING (symbol, session_date, minutes), (SELECT unnest(['none', 'level', 'zone']) AS retest)),
p AS (SELECT e.*, stop, o.open AS entry, o.minute AS em, CASE stop WHEN 'structure' THEN o.anchor - o.open * 0.001::DOUBLE ELSE o.open - 0.5::DOUBLE * width END AS stop_px FROM e LEFT JOIN orb_bars o ON o.symbol = e.symbol AND o.session_date = e.session_date AND o.i = e.entry_i, (SELECT unnest(['structure', 'range_share']) AS stop))
SELECT *, entry - stop_px AS risk, coalesce(no, CASE WHEN trig IS NULL THEN 'no_trigger' WHEN entry_i IS NULL THEN 'retest_failed' WHEN entry IS NULL THEN 'no_entry_bar' WHEN em >= 950 THEN 'too_late' WHEN entry - stop_px <= 0 THEN 'risk_not_positive' WHEN (entry - stop_px) / entry * 100 > 90 THEN 'risk_too_wide' END) AS refused FROM p""")
view("orb_results", """WITH w AS (SELECT s.symbol, s.session_date, s.minutes, s.retest, s.stop, s.entry, s.risk, s.width, s.stop_px, b.i, b.open AS o, b.high AS h, b.low AS l, b.close AS c,
  greatest(s.entry, max(b.high) OVER k) AS peak, coalesce(bool_or(b.high >= s.entry + 0.5::DOUBLE * s.width) OVER k, FALSE) AS armed
  FROM orb_setups s JOIN orb_bars b ON b.symbol = s.symbol AND b.session_date = s.session_date AND b.i >= s.entry_i WHERE refused IS NULL
  WINDOW k AS (PARTITION BY s.symbol, s.session_date, s.minutes, s.retest, s.stop ORDER BY b.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CASE WHEN armed THEN greatest(stop_px, entry) ELSE stop_px END AS be, greatest(stop_px, peak * (1 - 0.05::DOUBLE)) AS tr, min(CASE WHEN h >= entry + 2 * risk THEN i END) OVER (PARTITION BY symbol, session_date, minutes, retest, stop) AS half FROM w),
x AS (SELECT symbol, session_date, minutes, retest, stop, any_value(entry) AS entry, any_value(risk) AS risk, any_value(width) AS width, arg_max(c, i) AS last,
  min(i) FILTER (l <= stop_px) AS si, arg_min(least(o, stop_px), i) FILTER (l <= stop_px) AS sp, min(i) FILTER (l <= be) AS bi, arg_min(least(o, be), i) FILTER (l <= be) AS bp, arg_min(least(o, tr), i) FILTER (l <= tr) AS tp,
  min(i) FILTER (h >= entry + 1.5 * risk) AS t15, any_value(half) AS t2, min(i) FILTER (h >= entry + width) AS tw, min(i) FILTER (h >= entry + 3 * risk AND i > half) AS t3 FROM v GROUP BY 1, 2, 3, 4, 5),
y AS (SELECT *, coalesce(sp, last) - entry AS sg, coalesce(bp, last) - entry AS bg, coalesce(tp, last) - entry AS tg FROM x),
z AS (SELECT symbol, session_date, minutes, retest, stop, e AS exit, CASE e WHEN 'r_2' THEN CASE WHEN t2 IS NOT NULL AND (si IS NULL OR t2 < si) THEN 2 * risk ELSE sg END WHEN 'r_1_5' THEN CASE WHEN t15 IS NOT NULL AND (si IS NULL OR t15 < si) THEN 1.5 * risk ELSE sg END
  WHEN 'r_3_trim' THEN CASE WHEN t2 IS NOT NULL AND (si IS NULL OR t2 < si) THEN 0.5 * (2 * risk) + 0.5 * CASE WHEN t3 IS NOT NULL AND (si IS NULL OR t3 < si) THEN 3 * risk ELSE sg END ELSE sg END
  WHEN 'range_1x' THEN CASE WHEN tw IS NOT NULL AND (bi IS NULL OR tw < bi) THEN width ELSE bg END ELSE tg END / entry AS ret FROM y, (SELECT unnest(['r_2', 'r_1_5', 'r_3_trim', 'range_1x', 'trail']) AS e))
SELECT s.symbol, s.session_date, s.minutes, s.retest, s.stop, f.e AS exit, s.refused, z.ret FROM orb_setups s CROSS JOIN (SELECT unnest(['r_2', 'r_1_5', 'r_3_trim', 'range_1x', 'trail']) AS e) f LEFT JOIN z ON z.symbol = s.symbol AND z.session_date = s.session_date AND z.minutes = s.minutes AND z.retest = s.retest AND z.stop = s.stop AND z.exit = f.e""")
ORB = OG.OpeningGrid(range_pct=(0.5, 1500.0), risk_pct=90.0)
ORB_COUNTS = ", ".join(f"count(*) FILTER (refused = '{c}') AS {c}" for c in OG.REASONS)


@query("opening_range_grid", "2.16.1 2.20.111", f"""
SELECT @I(minutes) AS minutes, stop, retest, exit, count(*) AS sessions, count(*) FILTER (refused IS NULL) AS trades, @R(coalesce(sum(ret) FILTER (refused IS NULL), 0)) AS net, count(*) FILTER (refused IS NULL AND ret > 0) AS wins, {ORB_COUNTS} FROM orb_results GROUP BY minutes, stop, retest, exit""")
def _(m):
    t = OG.opening_report(OG.opening_results(m.bars(), ORB), ORB)
    return t.select(*OG.AXES, "sessions", "trades", "net", "wins", *OG.REASONS)


@query("opening_grid_neighbours", "2.16.2", f"""
WITH c AS (SELECT minutes, stop, retest, exit, coalesce(sum(ret) FILTER (refused IS NULL), 0) AS net, count(*) FILTER (refused IS NULL) AS trades FROM orb_results GROUP BY 1, 2, 3, 4),
p AS (SELECT *, list_position([5, 15, 30], minutes) AS x, list_position(['structure', 'range_share'], stop) AS s, list_position(['none', 'level', 'zone'], retest) AS r, list_position(['r_2', 'r_1_5', 'r_3_trim', 'range_1x', 'trail'], exit) AS e FROM c)
SELECT @I(a.minutes) AS minutes, a.stop, a.retest, a.exit, @R(any_value(a.net)) AS net, count(*) AS neighbours, @R(avg(CAST(b.net > 0 AS INT))) AS neighbours_positive, @I(any_value(a.trades) < 10) AS thin
FROM p a JOIN p b ON abs(a.x - b.x) + abs(a.s - b.s) + abs(a.r - b.r) + abs(a.e - b.e) = 1 GROUP BY a.minutes, a.stop, a.retest, a.exit""")
def _(m):
    t = OG.opening_report(OG.opening_results(m.bars(), ORB), ORB, least=10)
    return t.select(*OG.AXES, "net", "neighbours", "neighbours_positive", "thin")


@query("parameter_sweep", "2.16.3", """
WITH c AS (SELECT unnest([20, 50, 80]) AS size_cap, a AS min_px FROM (SELECT unnest([5.0, 20.0]::DOUBLE[]) AS a)) SELECT @I(size_cap) AS size_cap, @R(min_px) AS min_px, count(*) AS trades, @R(sum(gross / qty * least(qty, size_cap))) AS net FROM ledger, c WHERE entry_px >= min_px GROUP BY size_cap, min_px""")
def _(m):
    t = G.with_cells(m.ledger(), G.cells(size_cap=[20, 50, 80], min_px=[5.0, 20.0]))
    return t.filter("entry_px >= min_px").groupBy("size_cap", "min_px").agg(F.count(F.lit(1)).alias("trades"), F.sum(F.col("gross") / F.col("qty") * F.least("qty", "size_cap")).alias("net"))


@query("weighted_sleeves", "2.16.4", """
WITH d AS (SELECT date, avg(close / open - 1) AS a, avg(high / low - 1) AS b FROM daily GROUP BY 1) SELECT @D(date) AS date, @R(0.25 * a + 0.75 * b) AS value, 2 AS sleeves FROM d""")
def _(m):
    d = m.daily()
    a = d.groupBy("date").agg(F.avg(F.col("close") / F.col("open") - 1).alias("value"))
    b = d.groupBy("date").agg(F.avg(F.col("high") / F.col("low") - 1).alias("value"))
    return G.sleeves([("body", 0.25, a), ("range", 0.75, b)])


@query("coverage_check", "2.16.5", """
WITH f AS (SELECT DISTINCT symbol, session_date FROM fills), w AS (SELECT DISTINCT symbol, session_date FROM ticks), s AS (SELECT CASE WHEN f.symbol IS NOT NULL THEN 'found' WHEN dayofweek(session_date) IN (0, 6) THEN 'weekend' ELSE 'missing' END AS status FROM w LEFT JOIN f USING (symbol, session_date))
SELECT status, count(*) AS n, @R(sum(CASE WHEN status <> 'found' THEN count(*) ELSE 0 END) OVER () / sum(count(*)) OVER ()) AS missing_share, @I(sum(CASE WHEN status <> 'found' THEN count(*) ELSE 0 END) OVER () / sum(count(*)) OVER () > 0.5) AS refused FROM s GROUP BY 1""")
def _(m):
    w = m.ticks().select("symbol", "session_date").distinct()
    reason = F.when(F.dayofweek("session_date").isin(1, 7), "weekend").otherwise("missing")
    return G.coverage(w, m.fills(), ["symbol", "session_date"], 0.5, reason)
