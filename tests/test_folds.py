"""Folds of many keys a call against the rules key by key."""

import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import folds, recursive as R, signals


def bars(keys, seed=1):
    rng, rows = random.Random(seed), []
    for k in range(keys):
        px = rng.uniform(5, 50)
        for d in range(rng.choice([1, 2, 7, 40, 90])):
            px = max(0.0, px * (1 + rng.choice([0, 0.03, -0.03, -1.0 if rng.random() < 0.01 else 0.01])))
            rows.append((f"s{k}", date(2020, 1, 1) + timedelta(days=d), px, px * 1.01, px * 0.98, px))
    return rows


def test_indicators_are_the_rules_key_by_key(spark):
    rows = bars(60)
    names = list(R.RULES)
    shuffled = random.Random(3).sample(rows, len(rows))
    got = R.with_indicators(spark.createDataFrame(shuffled, "symbol string, date date, open double, high double, low double, close double"), names).toPandas()
    got = got.sort_values(["symbol", "date"])
    for _, g in got.groupby("symbol"):
        g = g.reset_index(drop=True)
        last = g["close"].shift(1)
        spans = pd.concat([g["high"] - g["low"], (g["high"] - last).abs(), (g["low"] - last).abs()], axis=1)
        g["__tr"] = spans.max(axis=1)
        for n in names:
            np.testing.assert_allclose(g[n].astype(float), R.RULES[n](g).astype(float), rtol=1e-12, err_msg=n)


@pytest.mark.parametrize("chunk", [1, 50, 10_000])
def test_a_fold_gets_whole_sorted_keys_and_few_calls(spark, chunk):
    rows = bars(40, 2)
    df = spark.createDataFrame(random.Random(4).sample(rows, len(rows)), "symbol string, date date, open double, high double, low double, close double").repartition(3, "symbol")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)

    def fold(g, starts):
        ends = [*starts[1:], len(g)]
        return pd.DataFrame([(g["symbol"][a], z - a, bool(g["date"][a:z].is_monotonic_increasing), len(starts)) for a, z in zip(starts, ends)], columns=["symbol", "n", "sorted", "keys"])

    try:
        got = folds.fold_keys(df, ["symbol"], "date", fold, "symbol string, n bigint, sorted boolean, keys bigint", chunk).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = pd.Series([r[0] for r in rows]).value_counts()
    assert len(got) == 40 and all(r.sorted and r.n == want[r.symbol] for r in got)
    assert max(r.keys for r in got) > 1


def slow_anchor_lines(x, c, room, r, window, max_span):
    """Every bar by itself, as anchor_lines describes it."""
    piv = [i for i in range(r, len(x) - r) if x[i] == max(x[i - r : i + r + 1])]
    out = []
    for t in range(len(x)):
        known = [p for p in piv if p + r <= t and p > t - window]
        found = (None, False, 0, 0)
        for a in sorted(known, key=lambda p: (-x[p], p)):
            slopes = [(x[b] - x[a]) / (b - a) for b in known if a < b <= a + max_span]
            slopes = [s for s in slopes if s < 0 and not any(c[u] - (x[a] + s * (u - a)) > room[u] for u in range(a + 1, t))]
            if slopes:
                s = max(slopes)
                line = x[a] + s * (t - a)
                touches = sum(abs(x[p] - (x[a] + s * (p - a))) <= room[p] for p in known if p >= a)
                found = (line, bool(c[t] - line > room[t]), touches, t - a)
                break
        out.append(found)
    return out


@pytest.mark.parametrize("max_span", [400, 12])
def test_anchor_lines_bar_by_bar_over_many_keys(spark, max_span):
    rng, rows = random.Random(8), []
    for k in range(25):
        px = 20.0
        for d in range(rng.choice([3, 30, 150])):
            px = round(px + rng.choice([-0.5, -0.25, 0, 0.25, 0.5]), 2)
            rows.append((f"s{k}", date(2020, 1, 1) + timedelta(days=d), px + rng.choice([0, 0.25, 1.0]), px, 1.0 + rng.random()))
    df = spark.createDataFrame(random.Random(9).sample(rows, len(rows)), "symbol string, date date, high double, close double, atr14 double")
    got = {(r.symbol, r.date): r for r in signals.anchor_lines(df, window=40, max_span=max_span).collect()}
    seen = 0
    for k in range(25):
        mine = [r for r in rows if r[0] == f"s{k}"]
        want = slow_anchor_lines([r[2] for r in mine], [r[3] for r in mine], [0.1 * r[4] for r in mine], 3, 40, max_span)
        for r, (line, broke, touches, span) in zip(mine, want):
            g = got[r[0], r[1]]
            assert (g.line is None) == (line is None) and (line is None or g.line == pytest.approx(line)), (r, g, line)
            assert (g.line_break, g.touches, g.span) == (broke, touches, span)
            seen += line is not None
    assert seen > 300
