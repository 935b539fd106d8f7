"""Live operators as Structured Streaming jobs.

Windowed aggregates run inside the engine under an event-time watermark; rules that remember rows
fold each key's rows in event order once the watermark has passed them, so their results do not depend
on how rows are dealt to batches. Lateness is an argument of every job. Drained with
Trigger.AvailableNow, a job equals its batch form over the rows the last watermark has passed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import clock
from tidemark.session import shared_folder

SHARDS, DAY_S = 64, 86_400


def read_events(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def ticks(raw: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return raw.select(
        F.col("event_id").alias("seq"), ts.alias("ts"), F.col("user_id").cast("string").alias("symbol"), F.col("event_type").alias("market"),
        F.col("value").alias("px"), (F.get_json_object("props", "$.k").cast("bigint") + 1).alias("size"),
        clock.session_date(ts).alias("session_date"), clock.minute_of_day(ts).alias("minute"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is available into a parquet table and read it back. State is kept in RocksDB, not on the heap."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    root = shared_folder(spark)
    out = f"{root}/out"

    def land(df: DataFrame, epoch: int) -> None:
        df.withColumn("__epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(land).start()
    q.awaitTermination()
    schema = T.StructType(stream.schema.fields + [T.StructField("__epoch", T.IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out).drop("__epoch")


def closed_bars(stream: DataFrame, late: str, minutes: int = 5) -> DataFrame:
    """Bars leave only when the watermark has passed their end; a forming bar never does."""
    return (
        stream.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", f"{minutes} minutes"))
        .agg(F.min_by("px", F.struct("ts", "seq")).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", F.struct("ts", "seq")).alias("close"), F.sum("size").alias("volume"))
        .select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def in_event_order(stream: DataFrame, by: Sequence[str], late: str, columns: str, fold: Callable, out: str, keep_s: int | None = None, shards: int = SHARDS) -> DataFrame:
    """Fold each key's rows in event order, however they are dealt to batches.

    Rows wait in the state until the watermark has passed them, so a batch boundary changes nothing;
    a row later than `late` is dropped by the engine (which counts such rows for windowed aggregates, in
    numRowsDroppedByWatermark, but not for grouped state: `late_rows` counts them beside the fold).
    `columns` are the columns a fold reads, ts and seq among them; fold(memory, rows) takes what it
    remembers of a key (a JSON value, None at first) and dicts in order of (ts, seq), with ts in
    microseconds, and returns both what it remembers and rows of `out` without the key.

    Keys are dealt to `shards` and a shard is one state, so a batch makes one call and one state row a
    shard and not a key. What is remembered of a key goes once the watermark is keep_s past its last row.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    at, seq = names.index("ts"), names.index("seq")
    fields = ["key", *[c.split()[0] for c in out.split(", ")]]
    stamps = {c.split()[0] for c in out.split(", ") if c.split()[1] == "timestamp"}
    key = T.StructType(stream.select(*by).schema.fields)

    def step(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, memory = map(json.loads, state.get) if state.exists else ([], {})
        mark = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for frame in frames:
                plain = frame.assign(ts=frame["ts"].astype("datetime64[us]").astype("int64"))
                waiting += map(list, zip(plain["key"].tolist(), *(plain[c].astype(object).where(plain[c].notna(), None).tolist() for c in names)))
        ready: dict[str, list] = {}
        for r in sorted((r for r in waiting if r[1 + at] <= mark), key=lambda r: (r[1 + at], r[1 + seq])):
            ready.setdefault(r[0], []).append(dict(zip(names, r[1:])))
        waiting = [r for r in waiting if r[1 + at] > mark]
        rows = []
        for k, mine in ready.items():
            kept, made = fold(memory.get(k, [None])[0], mine)
            memory[k] = [kept, mine[-1]["ts"]]
            rows += [(k, *r) for r in made]
        if keep_s is not None:
            memory = {k: m for k, m in memory.items() if m[1] + keep_s * 1_000_000 > mark}
        due = [min(r[1 + at] for r in waiting)] if waiting else []
        if keep_s is not None and memory:
            due.append(min(m[1] for m in memory.values()) + keep_s * 1_000_000)
        if waiting or memory:
            state.update((json.dumps(waiting), json.dumps(memory)))
        else:
            state.remove()
        if due:
            state.setTimeoutTimestamp(max(min(due) // 1000, mark // 1000 + 1))
        made = pd.DataFrame(rows, columns=fields)
        yield made.assign(**{c: pd.to_datetime(made[c], unit="us") for c in stamps})

    mem = T.StructType.fromDDL("waiting string, memory string")
    dealt = stream.withWatermark("ts", late).select(F.pmod(F.xxhash64(*by), F.lit(shards)).alias("shard"), F.to_json(F.struct(*by)).alias("key"), *names)
    folded = dealt.groupBy("shard").applyInPandasWithState(step, T.StructType.fromDDL(f"key string, {out}"), mem, "append", GroupStateTimeout.EventTimeTimeout)
    return folded.select(F.from_json("key", key).alias("k"), *fields[1:]).select("k.*", *fields[1:])


def late_rows(stream: DataFrame, late: str, minutes: int = 60) -> DataFrame:
    """Rows per window under the same watermark as a fold: the engine counts those it drops, in numRowsDroppedByWatermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes")).agg(F.count(F.lit(1)).alias("rows")).select(F.col("window.start").alias("ts"), "rows")


def arrivals(stream: DataFrame, late: str) -> DataFrame:
    """First row of each symbol in each session."""

    def first(memory, rows):
        return True, [] if memory else [(rows[0]["seq"], rows[0]["ts"])]

    return in_event_order(stream, ["session_date", "symbol"], late, "ts timestamp, seq bigint", first, "seq bigint, ts timestamp", keep_s=DAY_S)


def one_signal_per_bar(events: DataFrame, late: str, keep_s: int = DAY_S) -> DataFrame:
    """First signal of each bar per strategy and symbol, of bars that opened at or after the last exit.

    events holds signals (with the start of their bar) and, where the column `kind` says so, exits. Both
    are folded in event order; bars come in that order too, so the last bar and the last exit are all
    that has to be remembered. keep_s is at least the length of a bar and of the longest wait after an exit.
    """

    def first(memory, rows):
        last, left = memory or (None, None)
        out = []
        for r in rows:
            if r["kind"] == "exit":
                left = r["ts"]
            elif r["bar"] != last and (left is None or r["bar"] >= left):
                last = r["bar"]
                out.append((r["bar"], r["seq"]))
        return [last, left], out

    kind = F.col("kind") if "kind" in events.columns else F.lit("signal")
    marked = events.withColumn("kind", kind).withColumn("bar", F.unix_micros("bar_ts"))
    return in_event_order(marked, ["strategy", "symbol"], late, "ts timestamp, seq bigint, bar bigint, kind string", first, "bar_ts timestamp, seq bigint", keep_s=keep_s)


def feed_delay(stream: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """Age of rows when they arrived, per window."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("delay_s").alias("mean_delay"), F.max("delay_s").alias("worst_delay")).select(F.col("window.start").alias("ts"), "n", "mean_delay", "worst_delay")


def sampled_spans(stream: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Unbroken stretches of samples per key; what lies between them is an outage."""
    return stream.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("samples"), F.max("ts").alias("last_ts")).select(
        "symbol", F.col("session_window.start").alias("first_ts"), "last_ts", "samples")


def delayed_floor(df: DataFrame, minutes: int, column: str = "first_seen") -> DataFrame:
    return df.withColumn(column, F.col(column) + minutes)


def fresh_rows(stream: DataFrame, late: str) -> DataFrame:
    """Rows of a symbol from the moment its volume was seen to change in this session. Admission is
    permanent for the session; a key remembers its first volume and whether it was admitted."""

    def admit(memory, rows):
        first, open_ = memory or (rows[0]["size"], False)
        out = []
        for r in rows:
            open_ = open_ or r["size"] != first
            if open_:
                out.append((r["seq"], r["ts"], r["size"]))
        return [first, open_], out

    return in_event_order(stream, ["symbol", "session_date"], late, "ts timestamp, seq bigint, size bigint", admit, "seq bigint, ts timestamp, size bigint", keep_s=DAY_S)


def sell_round_trips(fills: DataFrame, late: str) -> DataFrame:
    """One round trip per sell, against the last buy at an earlier time, per symbol. A symbol's last buy is remembered until the next one."""

    def pair(memory, rows):
        now, before = memory or (None, None)  # the last buy and the last one of an earlier time
        out = []
        for r in rows:
            if r["side"] == "BUY":
                if now is not None and now[0] < r["ts"]:
                    before = now
                now = [r["ts"], r["price"], r["qty"]]
                continue
            buy = now if now is not None and now[0] < r["ts"] else before
            if buy is not None:
                out.append((r["seq"], (r["price"] - buy[1]) * buy[2]))
        return [now, before], out

    return in_event_order(fills, ["symbol"], late, "ts timestamp, seq bigint, side string, price double, qty bigint", pair, "seq bigint, pnl double")
