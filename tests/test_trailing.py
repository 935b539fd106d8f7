"""Rules over the rows before each row, walked for many keys at once, against the rules row by row."""

import random
from datetime import date, timedelta

import pytest

from tidemark.operators import folds, signals as X

DDL = "symbol string, date date, high double, low double, close double, note string"


@pytest.fixture(scope="module")
def keys():
    rng, out = random.Random(6), {}
    for k in [*(f"s{i}" for i in range(25)), None]:
        px, mine = 20.0, []
        for d in range(rng.choice([1, 4, 30, 90])):
            px = max(0.0, round(px * rng.choice([1, 1.01, 1.06, 1.3, 0.98, 0.95, 0.7]), 2)) if rng.random() > 0.01 else 0.0
            px = px or (0.0 if rng.random() < 0.5 else 10.0)
            row = [px + rng.choice([0, 0.5]), max(0.0, px - rng.choice([0, 0.5])), px]
            mine.append((k, date(2020, 1, 1) + timedelta(days=d), *[None if rng.random() < 0.03 else v for v in row], f"n{d}"))
        out[k] = mine
    return out


@pytest.fixture(params=[1, 70, 50_000])
def chunk(request, monkeypatch):
    plain = folds.trailing_columns
    monkeypatch.setattr(X, "trailing_columns", lambda *a: plain(*a, chunk=request.param))


def frame(spark, keys):
    rows = [r for mine in keys.values() for r in mine]
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), DDL)


def test_dips_row_by_row(spark, keys, chunk):
    want = {}
    for k, mine in keys.items():
        was = None
        for i, (_, day, _, _, c, note) in enumerate(mine):
            f = list(enumerate(mine))[max(0, i - 20) : i]
            highs = [r[2] for _, r in f if r[2] is not None]
            if not highs or c is None:
                continue
            peak = max(highs)
            at = min(j for j, r in f if r[2] == peak)
            lows = [r[3] for j, r in f if j <= at and r[3] is not None]
            base = min(lows) if lows else 0
            if base > 0 and peak > base and (peak - base) / base >= 0.1 and (peak - c) / peak >= 0.05 and (c - base) / (peak - base) >= 0.5:
                if at != was:
                    want[k, day] = (peak, base, min(1, (c - base) / (peak - base)), note)
                was = at
    df = X.impulse_dips(frame(spark, keys), by=("symbol",), order="date")
    assert {(r.symbol, r.date): (r.peak, r.base, r.retained, r.note) for r in df.collect()} == want and len(want) > 20
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_spikes_row_by_row(spark, keys, chunk):
    want = {}
    for k, mine in keys.items():
        for i, (_, day, *_, note) in enumerate(mine):
            h = [r[4] for r in mine[max(0, i - 65) : max(0, i - 5)] if r[4] is not None]
            lo, best = (h[0] if h else None), (0.0, 0.0, 0.0)
            for x in h:
                gain = (x - lo) / lo if lo else 0.0
                best = (gain, x, lo) if gain > best[0] else best
                lo = min(lo, x)
            run = best[0] if best[0] >= 0.5 else None
            kept = None if run is None else max(0.0, min(1.0, (h[-1] - best[2]) / (best[1] - best[2])))
            word = "too new to judge" if len(h) < 10 else "no prior spike" if run is None else "former runner" if kept >= 0.5 else "pump and dump" if kept < 0.25 else "partial hold"
            want[k, day] = (run, kept, word, note)
    df = X.prior_spikes(frame(spark, keys))
    assert {(r.symbol, r.date): (r.run_pct, r.retained, r.history, r.note) for r in df.collect()} == want
    assert len({w[2] for w in want.values()}) == 5
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
