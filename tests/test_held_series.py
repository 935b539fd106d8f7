"""Held futures series against the rules row by row, and how often their rows are dealt out."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import series as Y


@pytest.fixture(scope="module")
def rows():
    rng, held, px = random.Random(5), [], []
    for root in "ABC":
        c = 0
        for d in range(60):
            day = date(2020, 1, 1) + timedelta(days=d)
            if rng.random() < 0.2:
                continue
            c = max(0, c + rng.choice([0, 0, 0, 0, 1, 1, -1]))
            held.append((root, day, f"{root}-{c}"))
            px += [(root, f"{root}-{k}", day, float(rng.randrange(50, 60)), rng.randrange(1, 9)) for k in range(c + 3) if rng.random() < 0.7]
    return held, px


def frames(spark, rows):
    held, px = rows
    return spark.createDataFrame(held, "root string, date date, contract string"), spark.createDataFrame(px, "root string, contract string, date date, close double, volume bigint")


def brute(rows):
    held, prices = rows[0], {(r, c, d): p for r, c, d, p, _ in rows[1]}
    out = {}
    for root in "ABC":
        mine, last, gaps = [h for h in held if h[0] == root], {}, []
        for i, (_, day, c) in enumerate(mine):
            px = prices.get((root, c, day))
            last[c] = raw = px if px is not None else last.get(c)
            rolled = i > 0 and mine[i - 1][2] != c
            prev = out[root, mine[i - 1][1]]["raw"] if i else None
            base = prev
            if rolled:
                base = prices.get((root, c, mine[i - 1][1]))
                base = raw if base is None else base
            less = lambda a, b: 0.0 if a is None or b is None else a - b
            gaps.append(less(base, prev) if rolled else 0.0)
            out[root, day] = {"raw": raw, "stale": px is None, "rolled": rolled, "base": base, "change": less(raw, base), "gap": gaps[-1]}
        for i, (_, day, _) in enumerate(mine):
            raw = out[root, day]["raw"]
            out[root, day]["cont"] = None if raw is None else raw + sum(gaps[i + 1 :])
    return out


def test_held_series_row_by_row_in_one_shuffle(spark, rows):
    held, px = frames(spark, rows)
    df = Y.held_series(held, px.drop("volume"))
    got = {(r.root, r.date): r.asDict() for r in df.collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and len(want) > 100
    for k, w in want.items():
        for name, v in w.items():
            assert got[k][name] == (v if v is None else pytest.approx(v)), (k, name)
    assert any(w["rolled"] and w["stale"] for w in want.values()) and any(w["gap"] for w in want.values())
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning(") == 1


def test_roll_shares_and_legs_need_no_prices(spark, rows):
    held, px = frames(spark, rows)
    series, volume = brute(rows), {(r, c, d): v for r, c, d, _, v in rows[1]}
    got = {(r.root, r.date): r.share for r in Y.roll_volume_share(Y.with_rolls(held), px.drop("close")).collect()}
    want = {}
    for root, day, c in rows[0]:
        total = sum(v for (r, _, d), v in volume.items() if (r, d) == (root, day))
        if series[root, day]["rolled"] and total:
            want[root, day] = volume.get((root, c, day), 0) / total
    assert got == pytest.approx(want) and 0 < min(v for v in want.values() if v) < 1
    legs = Y.roll_legs(Y.with_rolls(held), 5).collect()
    days = sorted(d for r, d in series if r == "A")
    for r in (x for x in legs if x.root == "A"):
        i = days.index(r.entry_date)
        assert (r.exit_date, r.roll_legs) == (days[i + 5], sum(series["A", d]["rolled"] for d in days[i + 1 : i + 6]))


def test_tranches_are_not_rows(spark, rows):
    held, px = frames(spark, rows)
    s = Y.held_series(held, px.drop("volume")).withColumn("sg", F.lit(1.0)).withColumn("vol", F.when(F.col("raw") > 52, 0.2))
    days = sorted({d for _, d, _ in rows[0]})
    sessions = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, ordinal int")
    df = Y.tranche_book(s, "sg", "vol", 1e4, sessions=sessions)
    got, series, want = {(r.root, r.date): r for r in df.collect()}, brute(rows), {}
    live = {d: sum((series[r, d]["raw"] or 0) > 52 for r in "ABC" if (r, d) in series) for d in days}
    for root in "ABC":
        size = [0.0] * 5
        for d in (d for d in days if (root, d) in series):
            w, was = series[root, d], list(size)
            x = 1000 / (live[d] * w["raw"] * 0.2) if (w["raw"] or 0) > 52 else 0.0
            size[days.index(d) % 5] = float(int(x + 0.5))
            sides = sum(abs(n - o) + (2 * abs(o) if w["rolled"] else 0) for n, o in zip(size, was))
            want[root, d] = (sum(was) * w["change"] / 5, sides / 5, sum(size) / 5)
    assert {k: (r.pnl, r.sides, r.size) for k, r in got.items()} == {k: pytest.approx(v) for k, v in want.items()}
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
