"""Study jobs: tables in, a report table out, composed of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import populations as O
from tidemark.operators import stats as T


def book_table(trades: DataFrame, by: Sequence[str], friction: float) -> DataFrame:
    """Trades, net, per trade and win rate per cell at one friction level."""
    v = F.col("net") - friction
    return trades.groupBy(*by).agg(F.count(F.lit(1)).alias("trades"), F.sum(v).alias("net"), F.avg(v).alias("per_trade"), F.avg((v > 0).cast("int")).alias("win_rate"))


def gate_report(trades: DataFrame, gates: Sequence[tuple[str, Column]], friction: float) -> DataFrame:
    """Kept and removed trades of several gates from one pass over the ledger."""
    v = F.col("net") - friction
    rows = []
    for name, keep in gates:
        k = F.coalesce(keep, F.lit(False))
        rows.append(F.struct(F.lit(name).alias("gate"), F.count(F.when(k, 1)).alias("kept"), F.sum(F.when(k, v)).alias("kept_net"), F.avg(F.when(k, v)).alias("kept_per_trade"),
                             F.count(F.when(~k, 1)).alias("removed"), F.sum(F.when(~k, v)).alias("removed_net")))
    return trades.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def lift_report(rows: DataFrame, filters: Sequence[tuple[str, Column]], hit: Column) -> DataFrame:
    """How often each filter's rows hit, and that over how often all rows do, in one pass."""
    hits = hit.cast("int")
    every = F.avg(hits)
    cells = [F.struct(F.lit(n).alias("filter"), F.count(F.when(keep, 1)).alias("kept"), F.avg(F.when(keep, hits)).alias("hit_rate"), F.try_divide(F.avg(F.when(keep, hits)), every).alias("lift")) for n, keep in filters]
    return rows.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def halves_report(trades: DataFrame, by: Sequence[str], friction: float, date: str = "session_date") -> DataFrame:
    """A cell's result in both halves and whether they agree in sign."""
    h = book_table(O.with_half(trades, date), [*by, "half"], friction)
    g = h.groupBy(*by).agg(F.max(F.when(F.col("half") == "early", F.col("per_trade"))).alias("early"), F.max(F.when(F.col("half") == "late", F.col("per_trade"))).alias("late"))
    return g.withColumn("agree", F.coalesce(F.signum("early") == F.signum("late"), F.lit(False)))


def paired_report(a: DataFrame, b: DataFrame, key: str, draws: int, cluster: str = "symbol") -> DataFrame:
    """Paired difference of two exit rules with a cluster-bootstrap share above zero."""
    d = a.select(key, cluster, F.col("ret").alias("ra")).join(b.select(key, F.col("ret").alias("rb")), key).withColumn("delta", F.col("rb") - F.col("ra"))
    total = d.agg(F.count(F.lit(1)).alias("pairs"), F.sum("delta").alias("delta"), F.avg((F.col("delta") > 0).cast("int")).alias("better"))
    boot = T.bootstrap_summary(T.cluster_bootstrap(d, [cluster], draws, net="delta")).select("share_positive")
    return total.join(F.broadcast(boot), how="cross")


def concentration(trades: DataFrame, by: str, tops: Sequence[int]) -> DataFrame:
    """Share of the total made by the best n keys. Keys are pre-aggregated; the ordered step runs over
    one row per key of the catalogue."""
    s = trades.groupBy(by).agg(F.sum("net").alias("t"))
    w = Window.partitionBy().orderBy(F.desc(F.round("t", 6)), by)
    r = s.withColumn("k", F.row_number().over(w))
    rows = F.array(*[F.struct(F.lit(n).alias("top"), F.sum(F.when(F.col("k") <= n, F.col("t"))).alias("best"), F.sum("t").alias("total")) for n in tops])
    return r.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*").withColumn("share", F.try_divide("best", "total"))


def live_against_sim(live: DataFrame, sim: DataFrame, on: Sequence[str], reason: Column) -> DataFrame:
    """matched / live-only / sim-only with trades and net on each side."""
    l = live.select(*on, F.col("net").alias("live_net"))
    s = sim.select(*on, F.col("net").alias("sim_net"))
    j = l.join(s, list(on), "full_outer")
    part = F.when(F.col("live_net").isNull(), "sim_only").when(F.col("sim_net").isNull(), "live_only").otherwise("matched")
    return j.withColumn("part", part).withColumn("why", F.when(part == "live_only", reason).otherwise("")).groupBy("part", "why").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("live_net").alias("live_net"), F.sum("sim_net").alias("sim_net"))


def clause_lockout(df: DataFrame, clauses: Sequence[tuple[str, Column]]) -> DataFrame:
    """How often each pair of clauses is true together, alone, and never."""
    rows = []
    for i, (a, x) in enumerate(clauses):
        for b, y in clauses[i + 1:]:
            p, q = F.coalesce(x, F.lit(False)), F.coalesce(y, F.lit(False))
            rows.append(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.count(F.when(p & q, 1)).alias("together"), F.count(F.when(p & ~q, 1)).alias("first_only"), F.count(F.when(~p & q, 1)).alias("second_only")))
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
