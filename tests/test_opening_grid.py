"""The opening-range grid against a bar-by-bar walk of each cell."""

import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest

from tidemark.operators.opening_grid import OpeningGrid, opening_report, opening_results

G = OpeningGrid(range_pct=(0.2, 30.0), risk_pct=6.0)
DDL = "symbol string, session_date date, ts timestamp, minute int, open double, high double, low double, close double"


def sessions(n, seed):
    rng, rows = random.Random(seed), []
    for k in range(n):
        px, day = rng.uniform(5, 20), date(2024, 1, 1) + timedelta(days=k)
        begin = rng.choice([570, 570, 570, 590])
        for minute in range(begin, 960, 5):
            if rng.random() < 0.05:
                continue
            o = px * (1 + rng.gauss(0, 0.002))
            c = o * (1 + rng.gauss(0.0003, rng.choice([0.002, 0.01])))
            h, low = max(o, c) * (1 + abs(rng.gauss(0, 0.003))), min(o, c) * (1 - abs(rng.gauss(0, 0.003)))
            rows.append(("S", day, datetime(2024, 1, 1) + timedelta(days=k, minutes=minute), minute, o, h, low, c))
            px = c
    return rows


def walk(bars, m, stop_mode, retest, exit_mode):
    """(refused, ret) of one session and cell; bars are (minute, open, high, low, close)."""
    inside = [b for b in bars if b[0] < 570 + m]
    if not inside:
        return "no_range", None
    hi, lo = max(b[2] for b in inside), min(b[3] for b in inside)
    width = hi - lo
    if width / lo * 100 < G.range_pct[0] or width / lo * 100 > G.range_pct[1]:
        return ("too_narrow" if width / lo * 100 < G.range_pct[0] else "too_wide"), None
    trig = next((j for j in range(len(inside), len(bars)) if bars[j][4] > hi), None)
    if trig is None:
        return "no_trigger", None
    entry = trig + 1
    if retest != "none":
        depth, touched, entry = (hi if retest == "level" else lo + G.zone * width), False, None
        for j in range(trig + 1, min(trig + G.retest_bars, len(bars))):
            if bars[j][4] < lo:
                break
            touched = touched or bars[j][3] <= depth
            if touched and bars[j][4] > hi:
                entry = j + 1
                break
        if entry is None:
            return "retest_failed", None
    if entry >= len(bars):
        return "no_entry_bar", None
    if bars[entry][0] >= G.last_entry:
        return "too_late", None
    e = bars[entry][1]
    stop = bars[entry - 1][3] - e * G.stop_buffer if stop_mode == "structure" else e - G.stop_share * width
    risk = e - stop
    if risk <= 0 or risk / e * 100 > G.risk_pct:
        return ("risk_not_positive" if risk <= 0 else "risk_too_wide"), None
    goals = {"r_2": [(e + 2 * risk, 1.0)], "r_1_5": [(e + 1.5 * risk, 1.0)], "r_3_trim": [(e + 2 * risk, 0.5), (e + 3 * risk, 1.0)], "range_1x": [(e + width, 1.0)], "trail": []}[exit_mode]
    left, total, peak, level = 1.0, 0.0, e, stop
    for _, o, h, low, c in bars[entry:]:
        now = max(level, peak * (1 - G.trail)) if exit_mode == "trail" else level
        if low <= now:
            return None, (total + left * (min(o, now) - e)) / e
        if goals and h >= goals[0][0]:
            part = left if goals[0][1] == 1.0 else 0.5
            total += part * (goals[0][0] - e)
            left -= part
            goals = goals[1:]
            if left <= 0:
                return None, total / e
        peak = max(peak, h)
        if exit_mode == "range_1x" and h >= e + 0.5 * width:
            level = max(level, e)
    return None, (total + left * (bars[-1][4] - e)) / e


@pytest.mark.parametrize("seed", [1, 2])
def test_every_cell_is_the_walk(spark, seed):
    rows = sessions(25, seed)
    got = opening_results(spark.createDataFrame(rows, DDL), G).collect()
    assert len(got) == 90 * len({r[1] for r in rows})
    reasons = Counter()
    for r in got:
        bars = [b[3:] for b in rows if b[1] == r.session_date and b[3] <= G.last_bar]
        refused, ret = walk(bars, r.minutes, r.stop, r.retest, r.exit)
        assert r.refused == refused and (ret is None or r.ret == pytest.approx(ret)), (r, refused, ret)
        reasons[refused] += 1
    assert reasons[None] > 200 and len(reasons) >= 5


def test_the_report_has_every_cell_and_its_neighbours(spark):
    t = opening_report(opening_results(spark.createDataFrame(sessions(6, 5), DDL), G), G)
    rows = {tuple(r[a] for a in ("minutes", "stop", "retest", "exit")): r for r in t.collect()}
    assert len(rows) == 90 and all(r.sessions == 6 == r.trades + sum(r[c] for c in r.asDict() if c.startswith(("no_", "too_", "retest_", "risk_"))) for r in rows.values())
    middle = rows[15, "structure", "level", "r_3_trim"]
    near = [(5, "structure", "level", "r_3_trim"), (30, "structure", "level", "r_3_trim"), (15, "range_share", "level", "r_3_trim"), (15, "structure", "none", "r_3_trim"), (15, "structure", "zone", "r_3_trim"), (15, "structure", "level", "r_1_5"), (15, "structure", "level", "range_1x")]
    assert middle.neighbours == 7 and middle.neighbours_positive == pytest.approx(sum(rows[k].net > 0 for k in near) / 7)
    assert opening_report(opening_results(spark.createDataFrame([], DDL), G), G).count() == 90


def test_prices_of_zero_are_refused_not_divided_by(spark):
    def day(k, *prices):
        return [("S", date(2024, 1, 1 + k), datetime(2024, 1, 1 + k) + timedelta(minutes=570 + 5 * i), 570 + 5 * i, o, h, low, c) for i, (o, h, low, c) in enumerate(prices)]

    up, flat = (10.0, 11.0, 10.0, 11.0), (0.0, 0.0, 0.0, 0.0)
    rows = day(0, (10.0, 10.0, 0.0, 10.0), up, up) + day(1, flat, up, up) + day(2, (10.0, 10.2, 10.0, 10.1), up, (0.0, 11.0, 0.0, 11.0))
    got = opening_results(spark.createDataFrame(rows, DDL), OpeningGrid(minutes=(5,), retests=("none",), exits=("r_2",))).collect()
    reasons = {(r.session_date.day, r.stop): r.refused for r in got}
    assert reasons == {(1, "structure"): "too_wide", (1, "range_share"): "too_wide", (2, "structure"): "too_wide", (2, "range_share"): "too_wide",
                       (3, "structure"): "risk_not_positive", (3, "range_share"): "risk_too_wide"}
