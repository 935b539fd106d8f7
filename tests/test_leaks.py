"""Later rows never change an earlier value, and the test is able to fail."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import entry as E, recursive as R, rollups as G, screen as S, signals as X, windows as W


@pytest.fixture(scope="module")
def daily(spark):
    r = random.Random(1)
    rows = []
    for s in ("A", "B"):
        c = 100.0
        for d in range(160):
            o, c = c, max(5.0, c * (1 + r.uniform(-0.06, 0.06)))
            rows.append((s, date(2023, 1, 2) + timedelta(days=d), o, max(o, c) * 1.01, min(o, c) * 0.99, c, r.randrange(100, 1000)))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume bigint").cache()


RULES = {
    "screen": lambda d: W.screen_features(d).select("symbol", "date", "rvol", "prior_close"),
    "bollinger": lambda d: W.bollinger(d).select("symbol", "date", "bb_width", "bb_width_rank"),
    "last_pivot": lambda d: W.last_confirmed_pivot(d).select("symbol", "date", "last_high", "last_low"),
    "indicators": lambda d: R.with_indicators(d, ["ema20_seeded", "rsi14", "macd_signal", "atr14"]).select("symbol", "date", "ema20_seeded", "rsi14", "macd_signal", "atr14"),
    "lines": lambda d: X.trend_lines(R.with_indicators(d, ["atr14"])).select("symbol", "date", "line", "line_break"),
    "anchors": lambda d: X.anchor_lines(R.with_indicators(d, ["atr14"]), window=60).select("symbol", "date", "line", "touches"),
    "framing": lambda d: X.framing_states(d).select("symbol", "date", "state"),
    "dips": lambda d: X.impulse_dips(d, by=W.DAY, order="date").select("symbol", "date", "peak", "base"),
    "entry": lambda d: E.momentum_features(d, W.DAY, "date"),
    "tape": lambda d: E.tape_features(d.withColumn("minute", F.lit(600)).withColumn("ts", F.col("date").cast("timestamp")).withColumn("session_date", F.col("date")), by=W.DAY).drop("session_date").withColumn("date", F.col("ts").cast("date")).drop("ts"),
    "regime": lambda d: d.groupBy("date").agg(F.sum("volume").alias("n")).select("date", G.below_earlier_mean("n", "date").alias("cold")),
    "spikes": lambda d: X.prior_spikes(d).select("symbol", "date", "history", "retained"),
}


def rounded(df):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in sorted(df.collect())]


@pytest.mark.parametrize("name", RULES)
def test_prefix_is_unchanged(daily, name):
    cut = F.col("date") < F.lit("2023-04-20").cast("date")
    key = lambda rows: sorted(map(repr, rows))
    whole = [tuple(r) for r in RULES[name](daily).filter(cut).collect()]
    part = [tuple(r) for r in RULES[name](daily.filter(cut)).collect()]
    norm = lambda rows: key(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in rows)
    assert norm(whole) == norm(part)


def test_the_test_can_fail(daily):
    cut = F.col("date") < F.lit("2023-04-20").cast("date")
    peek = lambda d: d.select("symbol", "date", W.lead("close", W.DAY, "date").alias("x"))
    assert set(map(repr, peek(daily).filter(cut).collect())) != set(map(repr, peek(daily.filter(cut)).collect()))


def test_screen_boundaries(spark):
    """A name exactly at each bound passes; ties go to the smaller symbol; no prior close, no row."""
    day = date(2024, 3, 11)
    bars = spark.createDataFrame(
        [("AAA", day, 299, 3.6, 100), ("BBB", day, 299, 3.6, 100), ("LOW", day, 299, 1.99, 500), ("THIN", day, 299, 3.6, 99), ("LATE", day, 300, 9.0, 500), ("NEW", day, 299, 9.0, 500), ("ZVZZT", day, 299, 9.0, 500)],
        "symbol string, session_date date, minute int, close double, volume bigint").withColumn("ts", F.col("minute"))
    prior = spark.createDataFrame([(s, day, p) for s, p in (("AAA", 3.0), ("BBB", 3.0), ("LOW", 1.0), ("THIN", 3.0), ("LATE", 3.0), ("ZVZZT", 3.0), ("NEW", 0.0))], "symbol string, date date, prior_close double")
    cfg = S.Screen(volume_min=100, price_range=(2.0, 25.0), cadence_minutes=60)
    at = S.screen_at(bars, prior, 300, cfg).orderBy("position").collect()
    assert [r["symbol"] for r in at] == ["AAA", "BBB"]
    run = S.running_screen(bars, prior, cfg).filter("tick = 300").orderBy("position").collect()
    assert [(r["symbol"], r["position"]) for r in run] == [("AAA", 1), ("BBB", 2)]
    later = S.running_screen(bars, prior, cfg).filter("tick = 360").collect()
    assert {r["symbol"] for r in later} == {"AAA", "BBB", "LATE"}
