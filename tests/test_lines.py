"""Anchor lines against a plain search, and trend lines whose work follows the bars."""

import random
import time
from datetime import date, timedelta

import pandas as pd
import pytest

from tidemark.operators import signals as X


def series(n, seed):
    rng, px, rows = random.Random(seed), 100.0, []
    for k in range(n):
        px *= 1 + rng.gauss(-0.0005, 0.01)
        rows.append(("S", date(2000, 1, 1) + timedelta(days=k), round(px * 1.004, 2), round(px * 0.996, 2), round(px, 2), 1.0 + rng.random()))
    return rows


DDL = "symbol string, date date, high double, low double, close double, atr14 double"


def anchors(rows, r, window, max_span, buffer=0.10):
    """For each bar: the line's value, from the most extreme pivot that has a valid partner."""
    high, close, atr = [x[2] for x in rows], [x[4] for x in rows], [x[5] for x in rows]
    pivots = [k for k in range(r, len(rows) - r) if high[k] == max(high[k - r : k + r + 1])]
    out = []
    for t in range(len(rows)):
        known = [p for p in pivots if p + r <= t and p > t - window]
        value = None
        for a in sorted(known, key=lambda p: (-high[p], p)) if len(known) > 1 else []:
            best = None
            for b in (p for p in known if a < p <= a + max_span):
                slope = (high[b] - high[a]) / (b - a)
                if slope < 0 and all(close[k] - (high[a] + slope * (k - a)) <= buffer * atr[k] for k in range(a + 1, t)) and (best is None or abs(slope) < abs(best)):
                    best = slope
            if best is not None:
                value = high[a] + best * (t - a)
                break
        out.append(value)
    return out


@pytest.mark.parametrize("max_span", [400, 12])
def test_anchor_lines(spark, max_span):
    rows = series(220, 5)
    got = X.anchor_lines(spark.createDataFrame(rows, DDL), window=60, max_span=max_span).orderBy("date").collect()
    want = anchors(rows, 3, 60, max_span)
    assert sum(w is not None for w in want) > 20
    assert [r.line is None for r in got] == [w is None for w in want]
    assert all(w is None or r.line == pytest.approx(w) for r, w in zip(got, want))


def test_trend_lines_take_time_by_the_bar(spark):
    """A series of ten times the bars takes far less than a hundred times as long."""
    frames = [pd.DataFrame(series(n, 7), columns=["symbol", "date", "high", "low", "close", "atr14"]) for n in (3_000, 30_000)]
    took = []
    for f in frames:
        df = spark.createDataFrame(f.assign(date=f.index), "symbol string, date long, high double, low double, close double, atr14 double")
        X.trend_lines(df).count()
        start = time.time()
        X.trend_lines(df).write.format("noop").mode("overwrite").save()
        took.append(time.time() - start)
    assert took[1] < 30 * max(took[0], 0.1)
