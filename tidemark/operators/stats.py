"""Statistics and verdicts on ledgers.

Draws are rows. Every random choice is a digest of (seed, draw, key), so any engine repeats it. A
ledger is folded to its clusters before it meets the draws, and choosing k of n inside a draw adds up
parts of the digests before it ranks one of them, so neither a draw nor a hot cluster is held in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import staged
from tidemark.operators.scale import cumulative_counts, exact_quantiles, hash_ordinal

HEX = 8
SPAN = float(16**HEX)
CROWDED = 4096


def draw_value(*parts) -> Column:
    """Integer in [0, 2^32) from the digest of the parts."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HEX), 16, 10).cast("bigint")


def draw_uniform(*parts) -> Column:
    return draw_value(*parts) / SPAN


def clusters(trades: DataFrame, by: Sequence[str], net: str = "net") -> DataFrame:
    return trades.groupBy(*by).agg(F.sum(net).alias("total"), F.count(F.lit(1)).alias("n"))


def with_draws(df: DataFrame, draws: int) -> DataFrame:
    """Every row once per draw: a generator over the row, not a join."""
    return df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))


def cluster_bootstrap(trades: DataFrame, by: Sequence[str], draws: int = 200, seed: str = "1", net: str = "net") -> DataFrame:
    """(draw, total, n): clusters drawn with replacement; their trade counts travel with them.

    Clusters are numbered in digest order. For each cluster slot and draw the picked number is a
    digest, so picks are made on the cluster rows themselves and counted before they meet the
    cluster totals: what is joined is (draw, picked, times).
    """
    c = clusters(trades, by, net).withColumn("__key", F.concat_ws("|", *[F.col(k).cast("string") for k in by]))
    c = hash_ordinal(c, [], F.col("__key"), "slot")
    k = c.agg(F.count(F.lit(1)).alias("__k"))
    slots = with_draws(c.select("slot").join(F.broadcast(k), how="cross"), draws)
    picks = slots.select("draw", (draw_value(seed, F.col("draw"), F.col("slot")) % F.col("__k") + 1).alias("slot"))
    times = picks.groupBy("draw", "slot").agg(F.count(F.lit(1)).alias("times"))
    return times.join(c.select("slot", "total", "n"), "slot").groupBy("draw").agg(
        F.sum(F.col("times") * F.col("total")).alias("total"), F.sum(F.col("times") * F.col("n")).alias("n"))


def bootstrap_summary(draws: DataFrame) -> DataFrame:
    """Share above zero and the 2.5/97.5 lower-index quantiles of the draws. One row per draw comes
    in, so plain percentiles are enough."""
    d = draws.withColumn("per_trade", F.col("total") / F.col("n"))
    w = Window.partitionBy().orderBy("total")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    d = d.withColumn("__r", F.row_number().over(w) - 1).withColumn("__n", n)
    at = lambda q: F.max(F.when(F.col("__r") == F.floor(F.lit(q) * (F.col("__n") - 1)), F.col("total")))
    return d.agg(F.count(F.lit(1)).alias("draws"), F.avg((F.col("total") > 0).cast("int")).alias("share_positive"),
                 at(0.025).alias("low"), at(0.5).alias("mid"), at(0.975).alias("high"), F.avg("per_trade").alias("mean_per_trade"))


def _digest(seed: str, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), key))


def lowest_draws(rows: DataFrame, counts: DataFrame, by: Sequence[str], draws: int, seed: str, key: str, value: str, crowded: int = CROWDED) -> DataFrame:
    """(draw, total, n, known): the k rows of each stratum with the lowest digests of (seed, draw, key), added up.

    counts has one row per stratum with k. Rows are shuffled once, not once a draw. A stratum of at most
    `crowded` rows is one array and every draw is made on it. Of a larger one, a draw first adds up the
    256 parts its digests fall into (a row a task, draw and part); parts that k covers are taken whole,
    and only the part in which k runs out is ranked.
    """
    base = staged(rows.select(*by, F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value")))
    wanted = counts.select(*by, F.col("k").cast("bigint").alias("k"))
    sized = base.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    strata = staged((sized.join(wanted, list(by)) if by else sized.crossJoin(wanted)).filter("k > 0"))
    on = lambda d, frame: d.join(frame, list(by)) if by else d.crossJoin(frame)
    least, most = strata.agg(F.min("size"), F.max("size")).first()  # a table without crowded strata, or with them only, goes one way
    few = on(base, strata.filter(F.col("size") <= crowded)).groupBy(*by, "k").agg(F.collect_list(F.struct("key", "value")).alias("items"))
    few = with_draws(few, draws).withColumn("low", F.slice(F.array_sort(F.transform("items", lambda x: F.struct(_digest(seed, x["key"]).alias("h"), x["value"].alias("value")))), F.lit(1), F.col("k").cast("int")))
    taken = F.filter(F.transform("low", lambda x: x["value"]), lambda v: v.isNotNull())
    small = few.select("draw", F.aggregate(taken, F.lit(0.0), lambda a, v: a + v).alias("total"), F.size("low").cast("bigint").alias("n"), F.size(taken).cast("bigint").alias("known"))
    if (most or 0) <= crowded:
        return _added(small)
    many = on(base, strata.filter(F.col("size") > crowded))
    dealt = with_draws(many, draws).withColumn("part", F.substring(_digest(seed, F.col("key")), 1, 2))
    parts = dealt.groupBy("draw", *by, "part").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"), F.count("value").alias("known"), F.max("k").alias("k"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("draw", *by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("left", F.col("k") - before)
    whole = parts.filter("left >= n").select("draw", "total", "n", "known")
    edge = parts.filter("left > 0 AND left < n").groupBy(*by).agg(F.collect_list(F.struct("draw", "part", "left")).alias("edges"))
    asked = on(many, edge)
    mine = F.filter("edges", lambda e: F.substring(F.md5(F.concat_ws("|", F.lit(seed), e["draw"].cast("string"), F.col("key"))), 1, 2) == e["part"])
    met = asked.select(*by, "key", "value", F.explode(mine).alias("e")).select(*by, "key", "value", "e.draw", "e.left")
    ranked = met.withColumn("__o", F.row_number().over(Window.partitionBy("draw", *by).orderBy(_digest(seed, F.col("key")))))
    rest = ranked.filter(F.col("__o") <= F.col("left")).groupBy("draw").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"), F.count("value").alias("known"))
    large = whole.unionByName(rest)
    return _added(large if least > crowded else small.unionByName(large))


def _added(parts: DataFrame) -> DataFrame:
    return parts.groupBy("draw").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("known").alias("known"))


def removal_draws(trades: DataFrame, counts: DataFrame, by: Sequence[str], draws: int, seed: str = "1", key: str = "trade_id", net: str = "net") -> DataFrame:
    """(draw, removed total, removed n) when `k` rows per stratum are removed at random; counts has k per stratum."""
    return lowest_draws(trades, counts, by, draws, seed, key, net).select("draw", F.col("total").alias("removed"), F.col("n").alias("removed_n"))


def abstention(trades: DataFrame, k: int | DataFrame, symbol_days: int, draws: int = 100, seed: str = "1", friction: float = 0.0) -> DataFrame:
    """Quantiles of the per-trade and per-symbol-day change when k random trades are left out.

    k may be a frame of one row and column `k`. Nothing or everything left out gives NULLs.
    """
    t = trades.withColumn("__n", F.col("net") - friction)
    base = t.agg(F.sum("__n").alias("total"), F.count(F.lit(1)).alias("n"))
    counts = trades.sparkSession.range(1).select(F.lit(k).cast("bigint").alias("k")) if isinstance(k, int) else k
    d = removal_draws(t, counts, [], draws, seed, net="__n").join(F.broadcast(base), how="cross")
    d = d.filter(F.col("removed_n") < F.col("n"))
    d = d.select(((F.col("total") - F.col("removed")) / (F.col("n") - F.col("removed_n")) - F.col("total") / F.col("n")).alias("per_trade"), (-F.col("removed") / symbol_days).alias("per_day"))
    p = lambda c, q: F.percentile(c, F.lit(q))
    return d.agg(p("per_trade", 0.05).alias("pt05"), p("per_trade", 0.5).alias("pt50"), p("per_trade", 0.95).alias("pt95"),
                 p("per_day", 0.05).alias("pd05"), p("per_day", 0.5).alias("pd50"), p("per_day", 0.95).alias("pd95"))


def coin_flip(trades: DataFrame, draws: int, seed: str = "1", key: str = "trade_id") -> DataFrame:
    """Total per draw when every trade takes a random side."""
    rows = with_draws(trades.select(key, "gross"), draws)
    side = F.when(draw_value(seed, F.col("draw"), F.col(key)) % 2 == 0, 1).otherwise(-1)
    return rows.groupBy("draw").agg(F.sum(side * F.col("gross")).alias("total"))


def random_entries(candidates: DataFrame, wanted: DataFrame, by: Sequence[str], draws: int, seed: str = "1", key: str = "entry_id", value: str = "ret") -> DataFrame:
    """Mean outcome per draw of as many random candidates per stratum as the rule took there."""
    d = lowest_draws(candidates, wanted, by, draws, seed, key, value)
    return d.select("draw", F.try_divide("total", "known").alias("mean"), "n")


def control_p(observed: DataFrame, draws: DataFrame, value: str = "mean") -> DataFrame:
    """(1 + draws at or above observed) / (1 + draws)."""
    j = draws.join(F.broadcast(observed), how="cross")
    return j.agg(F.max("observed").alias("observed"), F.avg(value).alias("control_mean"),
                 ((F.count(F.when(F.col(value) >= F.col("observed"), 1)) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def permuted_labels(units: DataFrame, label: str, unit: Sequence[str], draws: int, seed: str = "1") -> DataFrame:
    """Each unit's label swapped for another unit's, counts kept, per draw.

    Units and labels are numbered independently: labels once in digest order, units anew per draw;
    equal numbers meet in an equi-join.
    """
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in unit])
    labels = hash_ordinal(units.select(label, *unit), [], F.concat_ws("|", F.lit("label"), key), "__o").select(F.col(label).alias("permuted"), "__o")
    rows = with_draws(units.drop(label), draws)
    rows = hash_ordinal(rows, ["draw"], F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), key), "__o")
    return rows.join(labels, "__o").drop("__o")


def holm(tests: DataFrame, p: str = "p", m: int | None = None) -> DataFrame:
    """Step-down adjusted p-values: monotone, capped at 1. A handful of tests come in."""
    w = Window.partitionBy().orderBy(p, "test")
    size = F.lit(m) if m is not None else F.count(F.lit(1)).over(Window.partitionBy())
    raw = F.least(F.lit(1.0), (size - F.row_number().over(w) + 1) * F.col(p))
    return tests.withColumn("__r", raw).withColumn("adjusted", F.max("__r").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__r")


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def binomial_tail(cases: DataFrame) -> DataFrame:
    """P(X >= k) for X ~ Binomial(n, 1/2) per case row (case, k, n), from log factorials.

    n is a count of sessions or symbols; the factorial table has n rows.
    """
    top = cases.agg(F.max("n").alias("m"))
    nums = top.select(F.explode(F.sequence(F.lit(0), F.col("m").cast("int"))).alias("v"))
    w = Window.partitionBy().orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    logs = nums.select("v", F.sum(F.when(F.col("v") > 0, F.log("v")).otherwise(0.0)).over(w).alias("lf"))
    x = cases.withColumn("x", F.explode(F.sequence(F.col("k").cast("int"), F.col("n").cast("int"))))
    lf = lambda name: logs.select(F.col("v").alias(f"v_{name}"), F.col("lf").alias(f"lf_{name}"))
    j = x.join(lf("n"), F.col("n") == F.col("v_n")).join(lf("x"), F.col("x") == F.col("v_x")).join(lf("r"), F.col("n") - F.col("x") == F.col("v_r"))
    term = F.exp(F.col("lf_n") - F.col("lf_x") - F.col("lf_r") - F.col("n") * F.log(F.lit(2.0)))
    return j.groupBy("case", "k", "n").agg(F.least(F.sum(term), F.lit(1.0)).alias("tail"))


def rank_auc(df: DataFrame, value: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """P(positive > negative) + ties/2, from counts per distinct value; nothing is ranked row by row."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.when(positive, 1)).alias("pos"), F.count(F.when(~positive, 1)).alias("neg"))
    r = cumulative_counts(c, by, value, ["neg"])
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return r.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.try_divide(won, F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Average rank per distinct value: one row per value, whatever the row count."""
    c = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return cumulative_counts(c, by, value, ["n"]).select(*by, value, (F.col("n_below") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of average ranks over distinct (a, b) pairs weighted by their count."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("w"))
    ra = average_ranks(rows, a).withColumnRenamed("rank", "ra")
    rb = average_ranks(rows, b).withColumnRenamed("rank", "rb")
    j = pairs.join(ra, a).join(rb, b)
    w, x, y = F.col("w"), F.col("ra"), F.col("rb")
    s = j.agg(F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"))
    num = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    den = F.sqrt((F.col("sxx") - F.col("sx") ** 2 / F.col("n")) * (F.col("syy") - F.col("sy") ** 2 / F.col("n")))
    return s.select("n", F.try_divide(num, den).alias("rho"))


def quantile_buckets(df: DataFrame, value: str, q: int, outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """Buckets at ranks n*k//q with the outcome's mean and win rate; no rows when an edge would
    split equal values or there are fewer than 5q rows.

    Works on (value, count, sum, wins): equal values are one row, so an edge inside a run shows as a
    value whose ranks meet two buckets.
    """
    c = staged(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("s"), F.count(F.when(F.col(outcome) > 0, 1)).alias("w")))
    r = cumulative_counts(c, by, value, ["n"])
    size = c.groupBy(*by).agg(F.sum("n").alias("__size"))
    r = r.join(size, list(by)) if by else r.join(F.broadcast(size), how="cross")
    bucket = lambda rank: F.floor(((rank + 1) * q - 1) / F.col("__size")).cast("int")
    r = r.withColumn("bucket", bucket(F.col("n_below"))).withColumn("__last", bucket(F.col("n_below") + F.col("n") - 1))
    out = r.groupBy(*by, "bucket").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), (F.sum("w") / F.sum("n")).alias("win"),
                                       F.max(F.col("__last") - F.col("bucket")).alias("__split"), F.max("__size").alias("__size"))
    # A group has at most q buckets, so what holds of its ranks is read from them.
    out = out.withColumn("__split", F.max("__split").over(Window.partitionBy(*by)))
    return out.filter((F.col("__split") == 0) & (F.col("__size") >= 5 * q)).drop("__split", "__size")


def direction(buckets: DataFrame, by: Sequence[str]) -> DataFrame:
    """+1, -1 or 0 for the bucket means, and the gap between the ends. q rows per group come in."""
    w = Window.partitionBy(*by).orderBy("bucket")
    d = buckets.withColumn("__d", F.col("mean") - F.lag("mean").over(w))
    g = d.groupBy(*by).agg(F.count("__d").alias("k"), F.min("__d").alias("lo"), F.max("__d").alias("hi"), (F.max_by("mean", "bucket") - F.min_by("mean", "bucket")).alias("gap"))
    mono = F.when(F.col("k") < 2, 0).when(F.col("lo") > 0, 1).when(F.col("hi") < 0, -1).otherwise(0)
    return g.select(*by, mono.alias("monotone"), "gap")


def feature_tiers(directions: DataFrame, friction: float) -> DataFrame:
    """CANDIDATE / WEAK / NOTHING per feature from its two halves."""
    g = directions.groupBy("feature").agg(
        F.count(F.lit(1)).alias("halves"), F.max(F.when(F.col("half") == "early", F.col("monotone"))).alias("ma"), F.max(F.when(F.col("half") == "late", F.col("monotone"))).alias("mb"),
        F.max(F.when(F.col("half") == "early", F.col("gap"))).alias("ga"), F.max(F.when(F.col("half") == "late", F.col("gap"))).alias("gb"))
    same = (F.col("ga") > 0) == (F.col("gb") > 0)
    big = F.least(F.abs("ga"), F.abs("gb")) > friction
    tier = F.when(F.col("halves") < 2, "NOTHING").when((F.col("ma") != 0) & (F.col("ma") == F.col("mb")) & same & big, "CANDIDATE").when(same & big, "WEAK").otherwise("NOTHING")
    return g.select("feature", "ga", "gb", tier.alias("tier"))


def bind_table(df: DataFrame, value: str, group: str, cuts: Sequence[float]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.avg((F.col(value) >= c).cast("int")).alias("kept")) for c in cuts])
    return df.filter(F.col(value).isNotNull()).groupBy(group).agg(rows.alias("r")).select(group, F.explode("r").alias("r")).select(group, "r.*")


def case_control(df: DataFrame, case: Column, key: Column, rate: float, seed: str = "1") -> DataFrame:
    """All cases with weight 1 and a digest-chosen share of the controls with weight 1/rate."""
    keep = case | (draw_uniform(seed, key) < rate)
    return df.withColumn("is_case", case).filter(keep).withColumn("weight", F.when(F.col("is_case"), 1.0).otherwise(1.0 / rate))


def solve_threshold(df: DataFrame, value: str, target: int) -> DataFrame:
    """Value whose refusal count (rows below it) is nearest to the target, smaller value on a tie."""
    c = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    r = cumulative_counts(c, [], value, ["n"])
    return r.select(value, F.col("n_below").alias("refused")).orderBy(F.abs(F.col("refused") - target), value).limit(1)


def book_totals(trades: DataFrame, by: Sequence[str], friction: float) -> DataFrame:
    return trades.groupBy(*by).agg(F.count(F.lit(1)).alias("trades"), F.sum(F.col("net") - friction).alias("net"), F.avg(F.col("net") - friction).alias("per_trade"))


def paired_deltas(base: DataFrame, other: DataFrame, on: Sequence[str], friction: float = 0.0) -> DataFrame:
    """other - base per key over the union of keys, missing = 0."""
    a = base.groupBy(*on).agg(F.sum(F.col("net") - friction).alias("a"))
    b = other.groupBy(*on).agg(F.sum(F.col("net") - friction).alias("b"))
    return a.join(b, list(on), "full_outer").select(*on, (F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))).alias("delta"))


def drop_top(df: DataFrame, value: str, n: int, tie: Sequence[str]) -> DataFrame:
    """Total without the n largest rows."""
    best = df.orderBy(F.desc(value), *tie).limit(n).agg(F.sum(value).alias("__b"))
    return df.agg(F.sum(value).alias("__t")).join(F.broadcast(best), how="cross").select((F.col("__t") - F.col("__b")).alias("without"))


def verdict(base: DataFrame, gated: DataFrame, symbol_days: int, friction: float, margin: float = 1.0, draws: int = 100, min_p: float = 0.9, drop: int = 5) -> DataFrame:
    """PASSES / NOTHING / REFUSED with the failing criteria, as one row.

    Both books carry `half`. REFUSED when the two denominators disagree in sign. The fifth criterion
    is to beat the 95th percentile of leaving out as many trades at random; it fails when the gate
    leaves out nothing or everything.
    """
    def sums(df, tag):
        e, l = F.col("half") == "early", F.col("half") == "late"
        v = F.col("net") - friction
        return df.agg(F.count(F.lit(1)).alias(f"{tag}_n"), F.sum(v).alias(f"{tag}_t"),
                      F.count(F.when(e, 1)).alias(f"{tag}_ne"), F.sum(F.when(e, v)).alias(f"{tag}_te"),
                      F.count(F.when(l, 1)).alias(f"{tag}_nl"), F.sum(F.when(l, v)).alias(f"{tag}_tl"))

    delta = paired_deltas(base, gated, ["symbol", "session_date"], friction)
    boot = bootstrap_summary(cluster_bootstrap(delta, ["symbol"], draws, net="delta")).select("share_positive")
    dd = drop_top(delta, "delta", drop, ["symbol", "session_date"]).withColumnRenamed("without", "drop_delta")
    db = drop_top(base.withColumn("v", F.col("net") - friction), "v", drop, ["trade_id"]).withColumnRenamed("without", "drop_base")
    dg = drop_top(gated.withColumn("v", F.col("net") - friction), "v", drop, ["trade_id"]).withColumnRenamed("without", "drop_gated")
    sums_b, sums_g = sums(base, "b"), sums(gated, "g")
    left_out = sums_b.join(F.broadcast(sums_g), how="cross").select(F.greatest(F.col("b_n") - F.col("g_n"), F.lit(0)).alias("k"))
    chance = abstention(base, left_out, symbol_days, draws, friction=friction).select(F.col("pt95").alias("random_p95"))
    one = sums_b
    for part in (sums_g, boot, dd, db, dg, chance):
        one = one.join(F.broadcast(part), how="cross")
    ratio = lambda t, n: F.try_divide(F.col(t), F.col(n))
    one = (
        one.withColumn("d_per_trade", ratio("g_t", "g_n") - ratio("b_t", "b_n")).withColumn("d_per_day", (F.col("g_t") - F.col("b_t")) / symbol_days)
        .withColumn("early_trade", ratio("g_te", "g_ne") - ratio("b_te", "b_ne")).withColumn("late_trade", ratio("g_tl", "g_nl") - ratio("b_tl", "b_nl"))
        .withColumn("early_day", (F.col("g_te") - F.col("b_te")) / symbol_days).withColumn("late_day", (F.col("g_tl") - F.col("b_tl")) / symbol_days)
    )
    empty = (F.col("b_ne") == 0) | (F.col("b_nl") == 0) | (F.col("g_ne") == 0) | (F.col("g_nl") == 0)
    checks = [
        ("margin", (F.col("d_per_trade") >= margin) & (F.col("d_per_day") > 0)),
        ("halves", (F.col("early_trade") > 0) & (F.col("late_trade") > 0) & (F.col("early_day") > 0) & (F.col("late_day") > 0)),
        ("drop_top", (F.col("drop_gated") > F.col("drop_base")) & (F.col("drop_delta") > 0)),
        ("bootstrap", F.col("share_positive") >= min_p),
        ("abstention", F.col("d_per_trade") > F.col("random_p95")),
    ]
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks]))
    word = F.when(empty, "NOTHING").when((F.col("d_per_trade") > 0) != (F.col("d_per_day") > 0), "REFUSED").when(F.size(failed) > 0, "NOTHING").otherwise("PASSES")
    return one.select("d_per_trade", "d_per_day", "early_trade", "late_trade", "drop_delta", "share_positive", "random_p95", word.alias("verdict"), F.array_join(failed, ",").alias("failed"))


def drawdown_paths(trades: DataFrame, draws: int, seed: str = "1") -> DataFrame:
    """Maximum drawdown per draw of a bootstrap of daily totals in random order.

    Days, not trades, are resampled into the path's slots, so a path has one row per day.
    """
    days = trades.groupBy("session_date").agg(F.sum("net").alias("net"))
    days = hash_ordinal(days, [], F.col("session_date").cast("string"), "slot")
    k = days.agg(F.count(F.lit(1)).alias("__k"))
    slots = with_draws(days.select(F.col("slot").alias("place")).join(F.broadcast(k), how="cross"), draws)
    picks = slots.select("draw", "place", (draw_value(seed, F.col("draw"), F.col("place")) % F.col("__k") + 1).alias("slot"))
    rows = picks.join(days.select("slot", "net"), "slot")
    w = Window.partitionBy("draw").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    path = rows.withColumn("equity", F.sum("net").over(w)).withColumn("peak", F.greatest(F.lit(0.0), F.max("equity").over(w)))
    return path.groupBy("draw").agg(F.max(F.col("peak") - F.col("equity")).alias("max_drawdown"))


def metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(pred) == 1
    g = df.agg(F.count(F.when(t & p, 1)).alias("tp"), F.count(F.when(~t & p, 1)).alias("fp"), F.count(F.when(t & ~p, 1)).alias("fn"), F.count(F.when(~t & ~p, 1)).alias("tn"))
    return g.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn"))).withColumn(
        "f2", F.try_divide(5 * F.col("tp"), 5 * F.col("tp") + 4 * F.col("fn") + F.col("fp")))


def threshold_scan(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Counts at or above each distinct score, with F2 and Youden J."""
    c = df.groupBy(score).agg(F.count(F.when(F.col(truth) == 1, 1)).alias("pos"), F.count(F.when(F.col(truth) != 1, 1)).alias("neg"))
    r = cumulative_counts(c, [], score, ["pos", "neg"])
    tot = c.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    r = r.join(F.broadcast(tot), how="cross")
    tp, fp = F.col("P") - F.col("pos_below"), F.col("N") - F.col("neg_below")
    return r.select(score, tp.alias("tp"), fp.alias("fp"), F.try_divide(5 * tp, 5 * tp + 4 * (F.col("P") - tp) + fp).alias("f2"), (F.try_divide(tp, F.col("P")) - F.try_divide(fp, F.col("N"))).alias("youden"))


def stump(df: DataFrame, features: Sequence[str], truth: str) -> DataFrame:
    """The one rule on one feature with the largest Youden index: feature, threshold, side, youden. Ties by name, then threshold.

    All features are scanned as one table of (feature, value) counts.
    """
    long = df.select(truth, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("score")) for f in features])).alias("x")).select(truth, "x.*")
    c = long.filter("score IS NOT NULL").groupBy("feature", "score").agg(F.count(F.when(F.col(truth) == 1, 1)).alias("pos"), F.count(F.when(F.col(truth) != 1, 1)).alias("neg"))
    r = cumulative_counts(c, ["feature"], "score", ["pos", "neg"])
    tot = c.groupBy("feature").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = F.try_divide(F.col("P") - F.col("pos_below"), F.col("P")) - F.try_divide(F.col("N") - F.col("neg_below"), F.col("N"))
    rows = r.join(tot, "feature").select("feature", F.col("score").alias("threshold"), F.when(j >= 0, "at_least").otherwise("below").alias("side"), F.abs(j).alias("youden"))
    return rows.orderBy(F.desc(F.round("youden", 9)), "feature", "threshold").limit(1)


def consistency(labels: DataFrame, item: Sequence[str], label: str) -> DataFrame:
    """Items labelled more than once: how many, the share with one label only, and the share of equal pairs of labels of one item."""
    kinds = labels.groupBy(*item, label).agg(F.count(F.lit(1)).alias("__k"))
    g = kinds.groupBy(*item).agg(F.sum("__k").alias("n"), F.max("__k").alias("most"), F.sum(F.col("__k") * (F.col("__k") - 1) / 2).alias("equal")).filter("n > 1")
    return g.agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("labels"), F.avg((F.col("most") == F.col("n")).cast("int")).alias("unanimous"),
                 F.try_divide(F.sum("equal"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).alias("pair_agreement"))


def risk_ratios(daily: DataFrame, net: str = "net", per_year: int = 252) -> DataFrame:
    """Mean over deviation, annualised, and the share of the total made by the best tenth of days."""
    n = daily.agg(F.count(F.lit(1)).alias("days"), F.avg(net).alias("mean"), F.stddev_samp(net).alias("sd"), F.sum(net).alias("total"))
    w = Window.partitionBy().orderBy(F.desc(net), "session_date")
    top = daily.withColumn("__r", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy())).filter(
        F.col("__r") <= F.ceil(F.col("__n") / 10)).agg(F.sum(net).alias("best"))
    return n.join(F.broadcast(top), how="cross").select("days", (F.col("mean") / F.col("sd")).alias("net_per_vol"), (F.col("mean") / F.col("sd") * F.sqrt(F.lit(float(per_year)))).alias("annualised"),
                                                       F.try_divide("best", "total").alias("concentration"))


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = 32) -> dict[str, list[float]]:
    """Per feature the values that cut its rows, and its distinct values, into `bins` parts of like size; exact, from all rows."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select("x.*").filter("v IS NOT NULL AND NOT isnan(v)")
    cuts = {f"q{k}": k / bins for k in range(1, bins + 1)}
    found = [exact_quantiles(d, ["feature"], "v", cuts, "lower") for d in (long, long.distinct())]
    edges: dict[str, set[float]] = {f: set() for f in features}
    for r in found[0].unionByName(found[1]).collect():
        edges[r.feature] |= {r[c] for c in cuts if math.isfinite(r[c])}
    return {f: sorted(e) or [0.0] for f, e in edges.items()}


def fit_classifier(df: DataFrame, features: Sequence[str], label: str, folds: int = 3, kind: str = "logit", fold: str = ""):
    """Logistic or boosted-tree model chosen by cross-validation with pyspark.ml; `fold` names a column with each row's fold.

    The trees' thresholds are `bin_edges`. Left to itself the library takes them from 10,000 rows or the square of
    maxBins, if that is more, so maxBins is at least the root of the row count.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    if kind == "logit":
        stages = [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")]
        model = LogisticRegression(labelCol=label, maxIter=20)
        grid = ParamGridBuilder().addGrid(model.regParam, [0.0, 0.1]).build()
    else:
        edges, binned, ordered = bin_edges(df, features), [f"__bin_{f}" for f in features], [f"__ord_{f}" for f in features]
        splits = [[-math.inf, *edges[f], math.inf] for f in features]
        # The sum drops the mark by which the trees would take a bin for a category without order.
        number = SQLTransformer(statement=f"SELECT *, {', '.join(f'`{b}` + 0D AS `{o}`' for b, o in zip(binned, ordered))} FROM __THIS__")
        stages = [Bucketizer(inputCols=list(features), outputCols=binned, splitsArray=splits, handleInvalid="skip"), number, VectorAssembler(inputCols=ordered, outputCol="features")]
        model = GBTClassifier(labelCol=label, maxIter=10, maxBins=max(*map(len, splits), math.isqrt(df.count()) + 1))
        grid = ParamGridBuilder().addGrid(model.maxDepth, [2, 3]).build()
    score = BinaryClassificationEvaluator(labelCol=label, numBins=0)
    cv = CrossValidator(estimator=Pipeline(stages=[*stages, model]), estimatorParamMaps=grid, evaluator=score, numFolds=folds, seed=7, foldCol=fold)
    return cv.fit(df)


def classifier_report(rows: DataFrame, features: Sequence[str], label: str, key: str, limit: int | None = None, folds: int = 2) -> DataFrame:
    """Held-out AUC of the fitted models: fitted on every row not held out, and scored on every held-out row
    (a third, by the key's digest). With `limit`, on those whose digests are lowest."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    digest = F.md5(F.col(key).cast("string"))
    part = lambda at: F.conv(F.substring("__d", at, 4), 16, 10).cast("int")
    # Written once: the fits and the scores read the features many times.
    marked = staged(rows.select(key, label, *features).withColumn("__d", digest).withColumn("__out", part(1) % 3 == 0).withColumn("__fold", part(5) % folds))
    train = marked.filter("NOT __out")
    if limit is not None:
        train = train.orderBy("__d", key).limit(limit)
    train, held = train.select(*features, label, "__fold"), marked.filter("__out").select(*features, label)
    score = BinaryClassificationEvaluator(labelCol=label, numBins=0)
    found = [(kind, float(score.evaluate(fit_classifier(train, features, label, folds, kind, "__fold").transform(held)))) for kind in ("logit", "boosted")]
    out = held.agg(F.count(F.lit(1)).alias("held_out")).join(F.broadcast(train.agg(F.count(F.lit(1)).alias("fitted"))), how="cross")
    return out.withColumn("m", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("auc")) for k, a in found]))).select("m.kind", "fitted", "held_out", F.round("m.auc", 2).alias("auc"))


def cost_state(legs: DataFrame, draws: int = 100, seed: str = "1") -> DataFrame:
    """Current cost per leg with a session-bootstrap interval."""
    s = legs.groupBy("leg", "session_date").agg(F.sum("cost").alias("total"), F.count(F.lit(1)).alias("n"))
    s = hash_ordinal(s, ["leg"], F.col("session_date").cast("string"), "slot")
    k = s.groupBy("leg").agg(F.count(F.lit(1)).alias("__k"))
    slots = with_draws(s.select("leg", "slot").join(F.broadcast(k), "leg"), draws)
    picks = slots.select("leg", "draw", (draw_value(seed, F.col("draw"), F.col("leg"), F.col("slot")) % F.col("__k") + 1).alias("slot"))
    d = picks.join(s.select("leg", "slot", "total", "n"), ["leg", "slot"]).groupBy("leg", "draw").agg((F.sum("total") / F.sum("n")).alias("v"))
    ci = d.groupBy("leg").agg(F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"))
    now = legs.groupBy("leg").agg(F.avg("cost").alias("cost"), F.count(F.lit(1)).alias("n"))
    return now.join(ci, "leg")


def net_quantiles(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    return exact_quantiles(trades, by, "net", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
