"""A drained stream gives the same rows however its input is dealt to batches."""

import os
import random

import pandas as pd
import pyarrow.parquet as pq
import pytest

from tidemark.operators import screen as S
from tidemark.streaming import jobs as J, screens as X

CFG = S.Screen(change_min=5.0, price_range=(1.0, 500.0), volume_min=10, cadence_minutes=15, top=3)

JOBS = {
    "arrivals": lambda t: J.arrivals(t, "1 day"),
    "fresh": lambda t: J.fresh_rows(t, "1 day"),
    "signals": lambda t: J.one_signal_per_bar(t.selectExpr("'s' AS strategy", "symbol", "ts", "seq", "date_trunc('hour', ts) AS bar_ts"), "1 day"),
    "trips": lambda t: J.sell_round_trips(t.selectExpr("symbol", "ts", "seq", "CASE WHEN seq % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side", "px AS price", "size AS qty"), "1 day"),
    "bars": lambda t: J.closed_bars(t, "1 day"),
    "signals_and_exits": lambda t: J.one_signal_per_bar(t.selectExpr("'s' AS strategy", "symbol", "ts", "seq", "date_trunc('hour', ts) AS bar_ts", "CASE WHEN seq % 4 = 0 THEN 'exit' ELSE 'signal' END AS kind"), "1 day"),
    "late": lambda t: J.late_rows(t, "1 day"),
    "first_seen": lambda t: X.first_seen(X.running_screen(crowded(t), priors(t.sparkSession), CFG, "1 day")),
    "tiers": lambda t: X.ranking(X.tick_lists(X.states(crowded(t), priors(t.sparkSession), CFG, "1 day"), CFG), CFG, (0.0, 60.0)),
}


def crowded(ticks):
    """A few symbols that trade all the time, moved into the hours of the screen."""
    return ticks.selectExpr("ts", "seq", "concat('S', cast(symbol as int) % 12) AS symbol", "px", "size", "session_date", "minute")


def priors(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2023-12-25', DATE'2024-02-10')) AS date")
    return days.crossJoin(spark.range(12)).selectExpr("concat('S', id) AS symbol", "date", "20D + id AS prior_close")


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """The same events in one file, and in four with rows up to twenty hours out of order between them."""
    whole = pq.read_table("/root/testdata/sf0.001/events.parquet")
    rng = random.Random(1)
    stamps = pd.to_datetime(whole["ts"].to_pandas())
    moved = whole.take((stamps + pd.to_timedelta([rng.uniform(0, 72_000) for _ in range(len(whole))], unit="s")).argsort().to_numpy())
    one, four = tmp_path_factory.mktemp("one"), tmp_path_factory.mktemp("four")
    pq.write_table(whole, one / "events.parquet")
    size = -(-len(moved) // 4)
    for k in range(4):
        path = four / f"events_{k}.parquet"
        pq.write_table(moved.slice(k * size, size), path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # files are read in this order
    pq.write_table(whole.slice(0, 0), four / "events.parquet")
    os.utime(four / "events.parquet", (1_600_000_000, 1_600_000_000))
    return str(one), str(four)


@pytest.mark.parametrize("name", JOBS)
def test_batches_do_not_change_a_stream(spark, folders, name):
    one, four = folders
    got = [sorted(map(repr, J.drain(JOBS[name](J.ticks(J.read_events(spark, folder, 1)))).collect())) for folder in (one, four)]
    assert got[0] and got[0] == got[1]


def test_late_rows_are_counted(spark, folders, tmp_path):
    """The newest file first: the engine reports the rows of the others that it drops."""
    import shutil

    for name in os.listdir(folders[1]):
        shutil.copy(os.path.join(folders[1], name), tmp_path)
        turn = int(name[7]) if name[6] == "_" else 9
        os.utime(tmp_path / name, (1_700_000_000 - turn, 1_700_000_000 - turn))
    stream = J.closed_bars(J.ticks(J.read_events(spark, str(tmp_path), 1)), "1 second")
    q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"]) > 0


def test_the_streamed_screen_is_the_batch_screen(spark, folders):
    """Every tick the watermark has passed, from one and from four shuffled files."""
    raw = spark.read.parquet(f"{folders[0]}/events.parquet")
    ticks = crowded(J.ticks(raw))
    ends = "to_utc_timestamp(cast(session_date AS timestamp) + make_interval(0, 0, 0, 0, 0, tick), 'America/New_York')"
    last = ticks.filter("minute BETWEEN 240 AND 569").selectExpr("max(ts) - INTERVAL 1 DAY AS t").first().t
    from tidemark.operators import bars

    minute = bars.stamp_session(bars.resample_ticks(ticks.drop("session_date", "minute"), 60))
    want = S.running_screen(minute, priors(spark), CFG).filter(f"{ends} <= TIMESTAMP'{last}'")
    want = sorted(map(tuple, want.select("session_date", "tick", "symbol", "close", "cum_volume", "position").collect()))
    for folder in folders:
        got = J.drain(X.running_screen(crowded(J.ticks(J.read_events(spark, folder, 1))), priors(spark), CFG, "1 day").drop("window")).select("session_date", "tick", "symbol", "close", "cum_volume", "position")
        assert want and sorted(map(tuple, got.collect())) == want


def drained_state(spark, stream, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = stream.writeStream.format("noop").option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination()
    return folder


def test_the_state_of_an_ended_session_is_gone(spark, folders, tmp_path):
    """Five later rows move the watermark past every session; what the folds and the ranking remember goes."""
    import json

    whole = pq.read_table(f"{folders[0]}/events.parquet")
    days = tmp_path / "days"
    days.mkdir()
    pq.write_table(whole, days / "events_0.parquet")
    stamps = pd.to_datetime(whole["ts"].to_pandas())
    for k in range(2):
        tail = whole.slice(0, 5)
        moved = tail.to_pandas()
        moved["ts"] = (stamps.max() + pd.Timedelta(days=10 + 10 * k)).floor("D") + pd.Timedelta(hours=10)
        pq.write_table(type(whole).from_pandas(moved, schema=whole.schema), days / f"events_{k + 1}.parquet")
        os.utime(days / f"events_{k + 1}.parquet", (1_900_000_000 + k, 1_900_000_000 + k))
    pq.write_table(whole.slice(0, 0), days / "events.parquet")
    os.utime(days / "events.parquet", (1_600_000_000, 1_600_000_000))
    ticks = J.ticks(J.read_events(spark, str(days), 1))
    at = drained_state(spark, J.arrivals(ticks, "1 hour"), str(tmp_path / "a"))
    held = spark.read.format("statestore").load(at).selectExpr("value.*").collect()
    memories = [json.loads(r[0].memory if hasattr(r[0], "memory") else r.memory) for r in held]
    assert sum(map(len, memories)) <= 10  # of thousands of symbol-sessions
    tiers = X.ranking(X.tick_lists(X.states(crowded(ticks), priors(spark), CFG, "1 hour"), CFG), CFG, (0.0, 60.0))
    at = drained_state(spark, tiers, str(tmp_path / "b"))
    operators = spark.read.format("state-metadata").load(at).collect()
    fold = next(r.operatorId for r in operators if "transformWithState" in r.operatorName)
    left = spark.read.format("statestore").option("operatorId", fold).option("stateVarName", "memory").load(at)
    assert left.count() <= 2
