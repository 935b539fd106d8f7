"""Ledger transforms that depend on the order of trades."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import micros


def global_position(rows: DataFrame, order: Sequence[str], out: str = "position", day: str = "session_date") -> DataFrame:
    """1-based position in a dated list, numbered day by day.

    Days are counted with a combining aggregate and summed over the day list; rows are numbered
    inside their day and shifted by the days before it. The first order column must not cross
    session dates.
    """
    days = rows.groupBy(day).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy().orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    offset = days.select(day, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__p"))
    inner = Window.partitionBy(day).orderBy(*order)
    return (
        rows.join(F.broadcast(offset), day)
        .withColumn(out, F.row_number().over(inner) + F.col("__p"))
        .drop("__p")
    )


def two_level_extreme(rows: DataFrame, by: Sequence[str], order: Sequence[str], col: str, bucket: Column, out: str) -> DataFrame:
    """Running maximum per key in order, the key split by an order-preserving bucket."""
    r = rows.withColumn("__b", bucket)
    tops = r.groupBy(*by, "__b").agg(F.max(col).alias("__m"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*by, "__b", F.max("__m").over(before).alias("__p"))
    inner = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    j = r.join(tops, [*by, "__b"])
    return j.withColumn(out, F.greatest(F.max(col).over(inner), F.coalesce("__p", col))).drop("__b", "__p")


def equity_curve(trades: DataFrame, by: Sequence[str] = ("book",), net: str = "net") -> DataFrame:
    """Running total and its drawdown in exit order, split by exit day."""
    from tidemark.operators.scale import running_sums, time_bucket

    day = time_bucket("exit_ts", 86400)
    order = ["exit_ts", "trade_id"]
    df = running_sums(trades, by, order, {"equity": net}, day)
    df = two_level_extreme(df, by, order, "equity", day, "peak")
    df = df.withColumn("peak", F.greatest("peak", F.lit(0.0)))
    return df.withColumn("drawdown", F.col("peak") - F.col("equity"))


def drawdown_summary(curve: DataFrame, ruin: float, by: Sequence[str] = ("book",)) -> DataFrame:
    return curve.groupBy(*by).agg(
        F.max("drawdown").alias("max_drawdown"), F.max_by("equity", F.struct("exit_ts", "trade_id")).alias("final"),
        F.min(F.when(F.col("equity") <= ruin, F.col("exit_ts"))).alias("ruined_at"))


def concurrency(trades: DataFrame, by: Sequence[str] = ("book",)) -> DataFrame:
    """Open positions and capital after each entry or exit; exits come first at a tie."""
    from tidemark.operators.scale import running_sums, time_bucket

    cost = F.col("entry_px") * F.col("qty")
    ev = F.array(
        F.struct(F.col("entry_ts").alias("at"), F.lit(1).alias("step"), cost.alias("capital"), F.lit(1).alias("o")),
        F.struct(F.col("exit_ts").alias("at"), F.lit(-1).alias("step"), (-cost).alias("capital"), F.lit(0).alias("o")))
    rows = trades.select(*by, "trade_id", F.explode(ev).alias("e")).select(*by, "trade_id", "e.*")
    df = running_sums(rows, by, ["at", "o", "trade_id"], {"open_now": "step", "capital_now": "capital"}, time_bucket("at", 86400))
    return df.groupBy(*by).agg(F.max("open_now").alias("max_open"), F.max("capital_now").alias("peak_capital"),
                               F.avg(F.when(F.col("step") == 1, (F.col("open_now") > 1).cast("int"))).alias("overlap_share"))


def replay_cap(trades: DataFrame, cap: int, by: Sequence[str] = ("session_date",), tie: Sequence[str] = ("symbol", "trade_id")) -> DataFrame:
    """Trades an account with `cap` slots would have taken. A slot is held from the entry minute up to
    the exit minute, so exits free it before entries of the same minute and a trade that ends in its
    entry minute holds none.

    `by` is the scope of the slots (the session, or session and strategy); `tie` orders the entries of
    a minute (a strategy's rank first, if it has one). Only how many slots are held when a minute
    begins has to be replayed, and at most `cap` entries of a minute can change that, so what reaches
    a task is bounded by minutes x (cap + 1). Needs entry_minute and exit_minute.
    """
    w = Window.partitionBy(*by, "entry_minute").orderBy(*tie)
    ranked = trades.withColumn("__held", (F.col("exit_minute") > F.col("entry_minute")).cast("int"))
    ranked = ranked.withColumn("__before", F.coalesce(F.sum("__held").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    able = ranked.filter((F.col("__held") == 1) & (F.col("__before") < cap)).select(*by, F.col("entry_minute").alias("__in"), F.col("exit_minute").alias("__out"), F.col("__before").alias("__turn"))
    clock = ranked.select(*by, F.col("entry_minute").alias("__in"), F.col("entry_minute").alias("__out"), F.lit(-1).cast("bigint").alias("__turn")).distinct()
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in able.select(*by).schema.fields)

    def replay(key, g: pd.DataFrame) -> pd.DataFrame:
        import heapq

        held: list[int] = []
        rows = []
        for m, ends in g.sort_values(["__in", "__turn"]).groupby("__in")["__out"]:
            while held and held[0] <= m:
                heapq.heappop(held)
            rows.append((*key, m, len(held)))
            for end in [e for e in ends if e > m][: cap - len(held)]:
                heapq.heappush(held, end)
        return pd.DataFrame(rows, columns=[*by, "entry_minute", "__open"])

    kind = dict(trades.dtypes)["entry_minute"]
    state = able.unionByName(clock).groupBy(*by).applyInPandas(replay, f"{keys}, entry_minute {kind}, __open bigint")
    taken = ranked.join(state, [*by, "entry_minute"]).filter(F.col("__open") + F.col("__before") < cap)
    return taken.select(*by, "trade_id")


def _landed(trades: DataFrame, scope: Sequence[str], friction: float) -> DataFrame:
    """Realised total and its peak after each exit, per scope, in exit order."""
    from tidemark.operators.scale import running_sums, time_bucket

    hour = time_bucket("exit_ts", 3600)
    order = ["exit_ts", "entry_ts", "trade_id"]
    t = trades.withColumn("__n", F.col("net") - friction)
    t = running_sums(t, scope, order, {"realised": "__n"}, hour)
    t = two_level_extreme(t, scope, order, "realised", hour, "peak")
    return t.withColumn("peak", F.greatest("peak", F.lit(0.0))).drop("__n")


def session_stop(trades: DataFrame, scope: Sequence[str], rule: Column, friction: float = 0.0) -> DataFrame:
    """Marks the trades a session rule removes: once `rule` (over realised and peak) holds after an
    exit, entries at or after that exit are removed; open trades ride on."""
    trip = _landed(trades, scope, friction).groupBy(*scope).agg(F.min(F.when(rule, F.col("exit_ts"))).alias("tripped_at"))
    j = trades.join(trip, list(scope))
    return j.withColumn("removed", F.coalesce(F.col("entry_ts") >= F.col("tripped_at"), F.lit(False)))


def give_back(fraction: float, arm: float) -> Column:
    return (F.col("peak") >= arm) & (F.col("realised") <= fraction * F.col("peak"))


def flat_loss(limit: float) -> Column:
    return F.col("peak") - F.col("realised") >= limit


def solve_flat_stop(trades: DataFrame, scope: Sequence[str], target: int, levels: Sequence[float], friction: float = 0.0) -> DataFrame:
    """Largest flat stop whose removal count reaches `target`; every level is read from one landing
    pass through conditional minima."""
    landed = _landed(trades, scope, friction)
    trips = landed.groupBy(*scope).agg(*[F.min(F.when(flat_loss(s), F.col("exit_ts"))).alias(f"t{k}") for k, s in enumerate(levels)])
    j = trades.join(trips, list(scope))
    counts = j.agg(*[F.count(F.when(F.col("entry_ts") >= F.col(f"t{k}"), 1)).alias(f"n{k}") for k in range(len(levels))])
    rows = F.array(*[F.struct(F.lit(float(s)).alias("level"), F.col(f"n{k}").alias("removed")) for k, s in enumerate(levels)])
    out = counts.select(F.explode(rows).alias("r")).select("r.*")
    best = Window.partitionBy()
    return out.withColumn("chosen", F.col("level") == F.max(F.when(F.col("removed") >= target, F.col("level"))).over(best))


def entry_cap(numbered: DataFrame, k: int) -> DataFrame:
    return numbered.filter(F.col("ordinal") <= k)


def skip_first(numbered: DataFrame) -> DataFrame:
    return numbered.filter(F.col("ordinal") > 1)


def nights_held(trades: DataFrame, sessions: DataFrame) -> DataFrame:
    """Session transitions across each hold, by ordinals of the entry and exit dates."""
    s = sessions.select("date", "ordinal")
    a = trades.join(F.broadcast(s.withColumnRenamed("ordinal", "__a")), F.col("session_date") == F.col("date")).drop("date")
    b = a.join(F.broadcast(s.withColumnRenamed("ordinal", "__b")), F.col("exit_date") == F.col("date")).drop("date")
    return b.withColumn("nights", F.col("__b") - F.col("__a")).drop("__a", "__b")


def margin_breaches(trades: DataFrame, curve: DataFrame, margin: float, start: float) -> DataFrame:
    """Held nights whose margin exceeded the equity realised by the trade's entry."""
    from tidemark.operators.joins import asof_join

    c = curve.select("book", F.col("exit_ts").alias("ts"), F.col("trade_id").alias("seq"), "equity")
    t = trades.withColumn("ts", F.col("entry_ts")).withColumn("seq", F.col("trade_id"))
    j = asof_join(t, c, ["book"], ["equity"], bucket_s=86400)
    return j.withColumn("breach", (F.col("nights") > 0) & (margin * F.col("qty") > start + F.coalesce("equity", F.lit(0.0))))


def largest_size(curve: DataFrame, limit: float, cap: int, by: Sequence[str] = ()) -> DataFrame:
    """Largest n <= cap whose n-fold drawdown stays under the limit, 0 if none."""
    dd = curve.groupBy(*by).agg(F.max("drawdown").alias("max_drawdown"))
    n = F.when(F.col("max_drawdown") <= 0, F.lit(cap)).otherwise(F.least(F.lit(cap), F.ceil(F.lit(limit) / F.col("max_drawdown")) - 1))
    return dd.withColumn("size", F.greatest(F.lit(0), n).cast("bigint"))


def compounding(trades: DataFrame, cells: Sequence[tuple[float, float]], capital: float, by: Sequence[str] = ("book",), volume_share: float = 1.0) -> DataFrame:
    """One account per (by, cell) that compounds: what it took, what it skipped and why, final equity,
    worst drawdown as a share of the peak.

    A cell is (most of equity one position may take, most that may be deployed at once), as shares of
    the equity at the entry. Positions are whole shares held to their exits, over sessions too; exits
    at or before an entry land first. Skips: `concurrency` (no budget left, or too small while others
    are open), `ruined` (no equity), `too_small`. With a column `dollar_volume`, a position takes at most
    `volume_share` of it; `capped` counts those taken so. An entry price of zero or none sizes nothing:
    `unpriced` counts such rows, whatever the account holds.

    An account is one sequence: each share count depends on all before it. Its rows are sorted into
    one partition and folded as they stream, so a task holds the open positions and a batch of rows.
    Needs entry_ts, exit_ts, symbol, trade_id, entry_px, qty, net.
    """
    grid = F.array(*[F.struct(F.lit(float(a)).alias("per"), F.lit(float(b)).alias("total")) for a, b in cells])
    cap = F.when(F.col("dollar_volume") > 0, F.floor(F.try_divide(F.col("dollar_volume") * volume_share, F.col("entry_px")))) if "dollar_volume" in trades.columns else F.lit(None)
    legs = trades.withColumn("__c", F.explode(grid)).select(
        *by, "__c.per", "__c.total", "entry_ts", "symbol", "exit_ts", "trade_id", F.col("entry_px").cast("double").alias("px"), F.try_divide("net", "qty").alias("gain"), cap.cast("double").alias("cap"))
    keys = [*by, "per", "total"]
    legs = legs.repartition(*keys).sortWithinPartitions(*keys, "entry_ts", "symbol", "exit_ts", "trade_id")
    counts = ["taken", "concurrency", "ruined", "too_small", "capped", "unpriced"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in legs.select(*keys).schema.fields) + ", " + ", ".join(f"{c} bigint" for c in counts) + ", final double, max_drawdown double"

    def fold(frames):
        import heapq

        now, done = None, []

        def land(upto):
            while held and (upto is None or held[0][0] <= upto):
                _, _, basis, net = heapq.heappop(held)
                book["used"] -= basis
                book["equity"] += net
                book["peak"] = max(book["peak"], book["equity"])
                if book["peak"] > 0:
                    book["worst"] = max(book["worst"], (book["peak"] - book["equity"]) / book["peak"])

        def close():
            land(None)
            done.append((*now, *[n[c] for c in counts], book["equity"], book["worst"]))

        for frame in frames:
            for row in frame.itertuples(index=False):
                key = tuple(row[: len(keys)])
                if key != now:
                    if now is not None:
                        close()
                    now, held, n = key, [], dict.fromkeys(counts, 0)
                    book = {"equity": float(capital), "used": 0.0, "peak": float(capital), "worst": 0.0}
                land(row.entry_ts)
                if not row.px > 0:
                    n["unpriced"] += 1
                    continue
                if book["equity"] <= 0:
                    n["ruined"] += 1
                    continue
                budget = min(row.per * book["equity"], row.total * book["equity"] - book["used"], book["equity"] - book["used"])
                if budget <= 0:
                    n["concurrency"] += 1
                    continue
                shares = budget // row.px
                limited = row.cap == row.cap and row.cap is not None and row.cap < shares
                shares = row.cap if limited else shares
                if shares < 1:
                    n["concurrency" if book["used"] > 0 and not limited else "too_small"] += 1
                    continue
                n["taken"] += 1
                n["capped"] += limited
                heapq.heappush(held, (row.exit_ts, n["taken"], shares * row.px, shares * row.gain))
                book["used"] += shares * row.px
            if done:
                yield pd.DataFrame(done, columns=[*keys, *counts, "final", "max_drawdown"])
                done.clear()
        if now is not None:
            close()
            yield pd.DataFrame(done, columns=[*keys, *counts, "final", "max_drawdown"])

    return legs.mapInPandas(fold, schema)


def void_spans(trades: DataFrame, days: DataFrame) -> DataFrame:
    """Trades whose hold covers none of the listed (symbol, day) rows."""
    d = days.select(F.col("symbol").alias("__s"), F.col("date").alias("__d"))
    return trades.join(d, (F.col("symbol") == F.col("__s")) & (F.col("__d") > F.col("session_date")) & (F.col("__d") <= F.col("exit_date")), "left_anti")


def daily_marks(trades: DataFrame, sessions: DataFrame, costs: Sequence[float] = (0.0, 1.0, 2.0)) -> DataFrame:
    """Trade result spread evenly over its sessions, cumulated at several cost levels per day."""
    s = sessions.select("date", "ordinal")
    a = trades.join(F.broadcast(s.select(F.col("date").alias("session_date"), F.col("ordinal").alias("__a"))), "session_date")
    b = a.join(F.broadcast(s.select(F.col("date").alias("exit_date"), F.col("ordinal").alias("__b"))), "exit_date")
    n = F.col("__b") - F.col("__a") + 1
    rows = b.withColumn("ordinal", F.explode(F.sequence("__a", "__b"))).join(F.broadcast(s), "ordinal")
    day = rows.groupBy("date").agg(F.sum(F.col("gross") / n).alias("gross"), F.sum(1 / n).alias("trades"))
    w = Window.partitionBy().orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    for k, c in enumerate(costs):
        day = day.withColumn(f"cum_{k}", F.sum(F.col("gross") - c * F.col("trades")).over(w))
    return day
