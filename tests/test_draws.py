"""Random draws of k rows: the same rows as a rank of all digests, without a shuffle of rows times draws."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from tidemark.operators import stats


@pytest.fixture(scope="module")
def trades(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice("aaaaaabc"), rng.choice([None, rng.uniform(-9, 9), rng.uniform(-9, 9)])) for k in range(900)]
    return rows, spark.createDataFrame(rows, "trade_id long, cell string, net double").repartition(4)


def brute(rows, counts, draws, by_cell=True):
    cells = defaultdict(list)
    for key, cell, net in rows:
        cells[cell if by_cell else ""].append((key, net))
    out = {}
    for d in range(draws):
        picked = [x for c, held in cells.items() for x in sorted(held, key=lambda r: hashlib.md5(f"1|{d}|{r[0]}".encode()).hexdigest())[: counts.get(c, 0)]]
        out[d] = (len(picked), sum(v for _, v in picked if v is not None), sum(v is not None for _, v in picked))
    return out


@pytest.mark.parametrize("crowded", [10_000, 150, 0])
def test_draws_are_the_lowest_digests(spark, trades, crowded):
    rows, df = trades
    counts = {"a": 333, "b": 1, "c": 10_000}
    frame = spark.createDataFrame(list(counts.items()), "cell string, k long")
    got = {r.draw: (r.n, r.total, r.known) for r in stats.lowest_draws(df, frame, ["cell"], 7, "1", "trade_id", "net", crowded).collect()}
    want = brute(rows, counts, 7)
    assert got.keys() == want.keys()
    assert all(got[d][0] == want[d][0] and got[d][2] == want[d][2] and got[d][1] == pytest.approx(want[d][1]) for d in want)


@pytest.mark.parametrize("crowded", [10_000, 5])
def test_draws_from_all_rows(spark, trades, crowded):
    rows, df = trades
    got = {r.draw: (r.n, r.total) for r in stats.lowest_draws(df, spark.createDataFrame([(250,)], "k long"), [], 5, "1", "trade_id", "net", crowded).collect()}
    want = brute(rows, {"": 250}, 5, by_cell=False)
    assert all(got[d][0] == 250 and got[d][1] == pytest.approx(want[d][1]) for d in want)


def test_rows_times_draws_are_not_shuffled(spark, trades):
    """Below an exchange, a generator of draws stands only under a combining aggregate, or after the part that is ranked was chosen."""
    _, df = trades
    frame = spark.createDataFrame([("a", 5)], "cell string, k long")
    plan = stats.lowest_draws(df, frame, ["cell"], 7, "1", "trade_id", "net", 100)._jdf.queryExecution().executedPlan().toString()
    lines = [(len(re.match(r"[\s:|+*-]*", x).group()), x) for x in plan.splitlines() if x.strip()]
    for i, (depth, line) in enumerate(lines):
        if "Generate explode(sequence(" in line or "Generate explode(org" in line:
            above = []
            at = depth
            for d, x in reversed(lines[:i]):
                if d < at:
                    above.append(x)
                    at = d
            first = next(x for x in above if not re.search(r"Project|Filter|Sort|WholeStage|Union", x))
            assert "HashAggregate" in first or "ObjectHashAggregate" in first or "SortAggregate" in first, first
