"""The running screen as chained stateful operators under one watermark.

1. Trades are folded to one row per symbol and cadence interval.
2. A sliding window as long as the session, one a tick, adds the intervals up to that tick: the
   symbol's cumulative session state, with what it was one tick before.
3. The clauses are judged per row; a tick keeps its first `top` names, first within shards of symbols,
   then over the shards, so no state row holds more than `top` names a shard.
4. The list of each tick goes to one fold a session, which remembers names until the session has ended.

A tick leaves when the watermark has passed it. Everything up to the fold is engine aggregates; the fold
sees at most `top` names a tick and those that have just stopped to pass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import clock, predicates as P
from tidemark.operators.screen import Screen

SHARDS = 16


def failing(cfg: Screen, change: Column, close: Column, volume: Column, tick: Column) -> Column:
    """The first clause that fails, with its value and its bound; null where all hold."""
    low, high = cfg.price_range
    need = cfg.volume_threshold(tick)
    number = lambda c: F.format_string("%.2f", c.cast("double"))
    return (
        F.when(change < cfg.change_min - P.CHANGE_EPS, F.concat(F.lit("change "), number(change), F.lit(f" < {cfg.change_min:.2f}")))
        .when(~close.between(low, high), F.concat(F.lit("price "), number(close), F.lit(f" outside {low:.2f}-{high:.2f}")))
        .when(volume < need, F.concat(F.lit("volume "), volume.cast("string"), F.lit(" < "), need.cast("string")))
    )


def states(trades: DataFrame, prior: DataFrame, cfg: Screen, late: str) -> DataFrame:
    """A row for each tick, and symbol that passes at it or passed one tick before: at, tick, close, cum_volume, change, reason.

    trades: ts, seq, symbol, px, size, session_date, minute. prior: symbol, date, prior_close, known before the session.
    """
    step = f"{cfg.cadence_minutes} minutes"
    inside = trades.filter((F.col("minute") >= cfg.open_minute) & (F.col("minute") * 60 + cfg.bar_seconds <= cfg.last_minute * 60) & ~P.is_test_symbol(F.col("symbol")))
    folded = (
        inside.withWatermark("ts", late).groupBy("session_date", "symbol", F.window("ts", step))
        .agg(F.max_by("px", F.struct("ts", "seq")).alias("close"), F.sum("size").alias("volume"))
    )
    known = folded.join(prior.select("symbol", F.col("date").alias("session_date"), "prior_close").filter("prior_close > 0"), ["symbol", "session_date"])
    end = F.col("window.end")
    spread = known.withColumn("own", end).withColumn("tick", F.window(F.window_time("window"), f"{cfg.last_minute - cfg.open_minute} minutes", step)).drop("window")
    tick_end = F.col("tick.end")
    minute = clock.minute_of_day(tick_end)
    spread = spread.filter((minute <= cfg.last_minute) & (minute > cfg.open_minute) & (clock.session_date(tick_end) == F.col("session_date")))
    before = F.col("own") < tick_end
    summed = spread.groupBy("session_date", "symbol", "tick").agg(
        F.max_by("close", "own").alias("close"), F.sum("volume").alias("cum_volume"), F.max("prior_close").alias("prior_close"),
        F.max_by(F.when(before, F.col("close")), F.when(before, F.col("own"))).alias("old_close"), F.sum(F.when(before, F.col("volume"))).alias("old_volume"),
    )
    change = lambda c: (F.try_divide(c, "prior_close") - 1) * 100
    now, was = clock.minute_of_day(tick_end), clock.minute_of_day(tick_end) - cfg.cadence_minutes
    judged = summed.select(
        "session_date", "symbol", F.col("tick").alias("window"), now.cast("int").alias("minute"), "close", "cum_volume", change("close").alias("change"),
        failing(cfg, change("close"), F.col("close"), F.col("cum_volume"), now).alias("reason"),
        (F.col("old_close").isNotNull() & failing(cfg, change("old_close"), F.col("old_close"), F.col("old_volume"), was).isNull()).alias("passed_before"),
    )
    return judged.filter(F.col("reason").isNull() | F.col("passed_before"))


def tick_lists(rows: DataFrame, cfg: Screen) -> DataFrame:
    """session_date, window, minute, names (in order, at most `top`), gone (symbol, reason) of each tick."""
    step = f"{cfg.cadence_minutes} minutes"
    place = F.struct((-F.col("change")).alias("order"), "symbol", "close", "cum_volume", "change")
    name = F.when(F.col("reason").isNull(), place)
    lost = F.when(F.col("reason").isNotNull(), F.struct("symbol", "reason"))
    first = lambda c: F.slice(F.array_sort(c), 1, cfg.top)
    shards = rows.groupBy("session_date", "minute", F.pmod(F.xxhash64("symbol"), F.lit(SHARDS)).alias("shard"), F.window(F.window_time("window"), step)).agg(
        first(F.collect_list(name)).alias("names"), F.collect_list(lost).alias("gone"))
    return shards.groupBy("session_date", "minute", F.window(F.window_time("window"), step)).agg(
        first(F.flatten(F.collect_list("names"))).alias("names"), F.array_sort(F.flatten(F.collect_list("gone"))).alias("gone"))


def running_screen(trades: DataFrame, prior: DataFrame, cfg: Screen, late: str) -> DataFrame:
    """The columns of the batch screen, a tick at a time, and its event time `window`."""
    return listed(tick_lists(states(trades, prior, cfg, late), cfg))


def listed(lists: DataFrame) -> DataFrame:
    rows = lists.select("session_date", "window", F.col("minute").alias("tick"), F.posexplode("names").alias("at", "n"))
    return rows.select("session_date", "tick", "n.symbol", "n.close", "n.cum_volume", "n.change", (F.col("at") + 1).alias("position"), "window")


def first_seen(selection: DataFrame) -> DataFrame:
    """One row per symbol-session that ever held a place, once the watermark has passed the UTC day of the session's ticks."""
    day = F.window(F.window_time("window"), "24 hours")
    return selection.groupBy("session_date", "symbol", day).agg(
        F.min("tick").alias("first_seen"), F.min_by("position", "tick").alias("first_rank"), F.min("position").alias("best_rank"), F.count(F.lit(1)).alias("ticks_on"),
    ).drop("window")


TIERS = "session_date date, tick int, hot int, warm int, cold int, names string, added string, removed string"


def ranking(lists: DataFrame, cfg: Screen, band: tuple[float, float]) -> DataFrame:
    """Session memory of the lists, a row a tick: HOT (listed, price in band), WARM (listed, out of band) and
    COLD (listed before, latest first) names, those added, and those removed with the reason.

    names holds the first `top` of the three in order. A session's memory goes when the watermark has passed
    its last tick; a name that is outranked has no failing clause and says so.
    """
    class Memory(StatefulProcessor):
        """ever: the last tick each name was listed at; held: the names of the last tick."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.memory = handle, handle.getValueState("memory", "ever string, held string")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            ever, held = map(json.loads, self.memory.get()) if self.memory.exists() else ({}, [])
            if not self.memory.exists():
                frames = list(rows)
                self.handle.registerTimer(int(frames[0]["session_ends"].iloc[0]))
                rows = iter(frames)
            out = []
            for r in pd.concat(list(rows)).sort_values("minute").itertuples():
                names, reasons = json.loads(r.names), {g["symbol"]: g["reason"] for g in json.loads(r.gone)}
                now = [n["symbol"] for n in names]
                ever.update((n["symbol"], int(r.minute)) for n in names)
                hot = [n["symbol"] for n in names if band[0] <= n["close"] <= band[1]]
                warm = [s for s in now if s not in set(hot)]
                cold = sorted(set(ever) - set(now), key=lambda s: (-ever[s], s))
                removed = [f"{s}: {reasons.get(s, 'outranked')}" for s in sorted(set(held) - set(now))]
                if names or removed:
                    out.append((key[0], r.minute, len(hot), len(warm), len(cold), ",".join([*hot, *warm, *cold][: cfg.top]), ",".join(sorted(set(now) - set(held))), "; ".join(removed)))
                held = now
            self.memory.update((json.dumps(ever), json.dumps(held)))
            yield pd.DataFrame(out, columns=fields)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.memory.clear()
            yield pd.DataFrame([], columns=fields)

        def close(self) -> None:
            pass

    fields = [c.split()[0] for c in TIERS.split(", ")]
    ends = F.unix_millis("window.end") + (cfg.last_minute + cfg.cadence_minutes - F.col("minute")) * 60_000
    rows = lists.select("session_date", F.window_time("window").alias("at"), "minute", ends.alias("session_ends"), F.to_json("names").alias("names"), F.to_json("gone").alias("gone"))
    return rows.groupBy("session_date").transformWithStateInPandas(Memory(), T.StructType.fromDDL(TIERS), "Append", "EventTime")


def changes(tiers: DataFrame) -> DataFrame:
    """session_date, tick, symbol, change, reason: one row per name that was added or removed."""
    part = lambda s, k: F.get(F.split(s, ": ", 2), F.lit(k))
    add = F.transform(F.split("added", ","), lambda s: F.struct(s.alias("symbol"), F.lit("added").alias("change"), F.lit(None).cast("string").alias("reason")))
    gone = F.transform(F.split("removed", "; "), lambda s: F.struct(part(s, 0).alias("symbol"), F.lit("removed").alias("change"), part(s, 1).alias("reason")))
    return tiers.select("session_date", "tick", F.explode(F.concat(add, gone)).alias("c")).select("session_date", "tick", "c.*").filter("symbol <> ''")
