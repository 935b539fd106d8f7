"""Two-level operators against plain Python on small inputs with a hot key and ties."""

import bisect
import hashlib
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins as J, ledger as B, scale as C, stats as T

T0 = datetime(2024, 1, 2, 14, 0, 0)


def hot_rows(n, seed=3, keys=("hot", "a", "b")):
    r = random.Random(seed)
    return [(keys[0] if r.random() < 0.6 else r.choice(keys[1:]), T0 + timedelta(seconds=r.randrange(0, 20000)), i, float(r.randrange(1, 50))) for i in range(n)]


def test_running_sums_match_a_plain_sum(spark):
    rows = hot_rows(400)
    df = spark.createDataFrame(rows, "k string, ts timestamp, seq bigint, x double")
    got = {r["seq"]: r["s"] for r in C.running_sums(df, ["k"], ["ts", "seq"], {"s": "x"}, C.time_bucket("ts", 1800)).collect()}
    total = {}
    for k, ts, seq, x in sorted(rows, key=lambda r: (r[1], r[2])):
        total[k] = total.get(k, 0.0) + x
        assert got[seq] == pytest.approx(total[k])


def test_hash_ordinal_is_the_digest_order(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("k"))
    got = {(r["g"], r["k"]): r["ordinal"] for r in C.hash_ordinal(df, ["g"], F.col("k")).collect()}
    for g in range(3):
        keys = sorted((str(i) for i in range(300) if i % 3 == g), key=lambda s: hashlib.md5(s.encode()).hexdigest())
        assert [got[(g, k)] for k in keys] == list(range(1, 101))


@pytest.mark.parametrize("tail", [False, True])
def test_exact_quantiles_with_ties_and_heavy_tails(spark, tail):
    r = random.Random(5)
    vals = [("hot", float(r.choice([1, 2, 2, 3]))) for _ in range(300)] + [("b", r.random() ** (-3 if tail else 1)) for _ in range(201)] + [("one", 7.0)]
    df = spark.createDataFrame(vals, "k string, v double")
    got = {x["k"]: x for x in C.exact_quantiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    for k in ("hot", "b", "one"):
        v = [x for kk, x in vals if kk == k]
        for name, q in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
            assert got[k][name] == pytest.approx(float(np.quantile(v, q)))


def quotes_and_fills(n=300, seed=9):
    r = random.Random(seed)
    make = lambda i: ("hot" if r.random() < 0.6 else "c", T0 + timedelta(seconds=r.randrange(0, 15000)), i, float(i))
    return [make(i) for i in range(n)], [make(i) for i in range(n)]


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tolerance", [None, 90.0])
def test_asof_join_against_brute_force(spark, direction, strict, tolerance):
    left, right = quotes_and_fills()
    l = spark.createDataFrame(left, "k string, ts timestamp, seq bigint, x double")
    r = spark.createDataFrame([(k, t, s, v) for k, t, s, v in right], "k string, ts timestamp, seq bigint, v double")
    got = {x["seq"]: x["v"] for x in J.asof_join(l, r, ["k"], ["v"], direction=direction, strict=strict, tolerance_s=tolerance, bucket_s=600).collect()}
    assert len(got) == len(left)
    for k, t, seq, _ in left:
        best = None
        for kk, rt, rs, v in right:
            if kk != k:
                continue
            ok = (rt < t if strict else rt <= t) if direction == "backward" else (rt > t if strict else rt >= t)
            if not ok or (tolerance is not None and abs((rt - t).total_seconds()) > tolerance):
                continue
            rank = (rt, rs) if direction == "backward" else (-rt.timestamp(), -rs)
            if best is None or rank > best[0]:
                best = (rank, v)
        assert got[seq] == (None if best is None else best[1])


def test_trailing_sums_against_brute_force(spark):
    left, right = quotes_and_fills()
    l = spark.createDataFrame(left, "k string, ts timestamp, seq bigint, x double")
    r = spark.createDataFrame(right, "k string, ts timestamp, seq bigint, v double")
    got = {x["seq"]: x["s"] for x in J.trailing_sums(l, r, ["k"], {"s": "v"}, 300, bucket_s=600).collect()}
    for k, t, seq, _ in left:
        want = [v for kk, rt, _, v in right if kk == k and t - timedelta(seconds=300) <= rt < t]
        assert (got[seq] or 0.0) == pytest.approx(sum(want))


def test_preceding_match_consumes_each_alert_once(spark):
    left, right = quotes_and_fills(80)
    day = T0.date()
    l = spark.createDataFrame([(k, day, t, i) for k, t, i, _ in left], "k string, d date, ts timestamp, left_id bigint")
    r = spark.createDataFrame([(k, day, t, i) for k, t, i, _ in right], "k string, d date, ts timestamp, right_id bigint")
    rows = J.pair_up(l, r, ["k", "d"], 600, mode="preceding").collect()
    got = {x["lid"]: x["rid"] for x in rows if x["lid"] is not None and x["rid"] is not None}
    assert sorted(x["lid"] for x in rows if x["lid"] is not None) == sorted(i for _, _, i, _ in left)
    assert sorted(x["rid"] for x in rows if x["rid"] is not None) == sorted(j for _, _, j, _ in right)
    used, want = set(), {}
    for k, t, i, _ in sorted(left, key=lambda x: (x[1], x[2])):
        c = [(rt, j) for kk, rt, j, _ in right if kk == k and rt <= t and (kk, j) not in used]
        if c and (t - max(c)[0]).total_seconds() <= 600:
            used.add((k, max(c)[1]))
            want[i] = max(c)[1]
    assert got == want


def test_cap_replay_against_a_plain_replay(spark):
    r = random.Random(2)
    day = T0.date()
    trades = [(day, f"s{r.randrange(9)}", i, m := r.randrange(0, 60), m + r.randrange(0, 30)) for i in range(200)]
    df = spark.createDataFrame(trades, "session_date date, symbol string, trade_id bigint, entry_minute int, exit_minute int")
    got = {x["trade_id"] for x in B.replay_cap(df, 3).collect()}
    open_, want = [], set()
    for _, s, i, m, x in sorted(trades, key=lambda t: (t[3], t[1], t[2])):
        open_ = [e for e in open_ if e > m]
        if len(open_) < 3:
            open_.append(x)
            want.add(i)
    assert got == want


def test_compounding_against_a_plain_account(spark):
    r = random.Random(4)
    rows = []
    for i in range(160):
        start = T0 + timedelta(minutes=r.randrange(0, 6000))
        rows.append(("ab"[i % 2], f"s{r.randrange(5)}", i, start, start + timedelta(minutes=r.choice((0, 5, 40, 3000))), r.uniform(5, 400), 10, r.uniform(-900, 800), r.choice((None, 300.0, 4000.0, 1e6))))
    df = spark.createDataFrame(rows, "book string, symbol string, trade_id bigint, entry_ts timestamp, exit_ts timestamp, entry_px double, qty bigint, net double, dollar_volume double")
    cells = [(0.6, 1.0), (0.1, 0.3), (0.02, 1.0)]
    got = {(x["book"], x["per"], x["total"]): x for x in B.compounding(df, cells, 1000.0, volume_share=0.5).collect()}
    seen = set()
    for name in "ab":
        for per, total in cells:
            cash, open_, count, peak, worst = 1000.0, [], dict.fromkeys(("taken", "concurrency", "ruined", "too_small", "capped"), 0), 1000.0, 0.0
            mine = sorted((x for x in rows if x[0] == name), key=lambda x: (x[3], x[1], x[4], x[2]))
            for x in [*mine, None]:
                for p in sorted((p for p in open_ if x is None or p[0] <= x[3]), key=lambda p: p[0]):
                    open_.remove(p)
                    cash += p[2]
                    peak = max(peak, cash)
                    worst = max(worst, (peak - cash) / peak)
                if x is None:
                    break
                used = sum(p[1] for p in open_)
                room = min(per * cash, total * cash - used, cash - used)
                want = int(room // x[5]) if room > 0 else 0
                limit = int(0.5 * x[8] // x[5]) if x[8] else want
                if cash <= 0:
                    count["ruined"] += 1
                elif room <= 0 or (want < 1 and limit >= want and used > 0):
                    count["concurrency"] += 1
                elif min(want, limit) < 1:
                    count["too_small"] += 1
                else:
                    count["taken"] += 1
                    count["capped"] += limit < want
                    open_.append((x[4], min(want, limit) * x[5], min(want, limit) * x[7] / x[6]))
            row = got[name, per, total]
            assert {c: row[c] for c in count} == count
            assert row["final"] == pytest.approx(cash) and row["max_drawdown"] == pytest.approx(worst)
            seen |= {c for c in count if count[c]}
    assert {"taken", "concurrency", "too_small", "capped"} <= seen


def test_compounding_counts_a_zero_entry_price(spark):
    rows = [("a", "s", i, T0 + timedelta(minutes=i), T0 + timedelta(minutes=i + 1), px, 10, 5.0, 1e6) for i, px in enumerate((20.0, 0.0, None, 20.0))]
    df = spark.createDataFrame(rows, "book string, symbol string, trade_id bigint, entry_ts timestamp, exit_ts timestamp, entry_px double, qty bigint, net double, dollar_volume double")
    for legs in (df, df.drop("dollar_volume")):
        row = B.compounding(legs, [(0.6, 1.0)], 1000.0).first()
        assert (row.taken, row.unpriced, row.final) == (2, 2, 1000.0 + 30 * 0.5 + 30 * 0.5)


def test_auc_equals_pair_counting(spark):
    r = random.Random(6)
    rows = [(float(r.randrange(8)), r.random() < 0.4) for _ in range(120)]
    got = T.rank_auc(spark.createDataFrame(rows, "v double, p boolean"), "v", F.col("p")).collect()[0]["auc"]
    pos, neg = sorted(v for v, p in rows if p), sorted(v for v, p in rows if not p)
    wins = sum(bisect.bisect_left(neg, v) + (bisect.bisect_right(neg, v) - bisect.bisect_left(neg, v)) / 2 for v in pos)
    assert got == pytest.approx(wins / (len(pos) * len(neg)))


def test_buckets_refuse_an_edge_inside_equal_values(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 30 + [(float(i), 0.0) for i in range(2, 12)], "v double, net double")
    assert T.quantile_buckets(df, "v", 4, "net").count() == 0
    ok = spark.createDataFrame([(float(i), float(i % 2)) for i in range(40)], "v double, net double")
    assert [r["n"] for r in T.quantile_buckets(ok, "v", 4, "net").orderBy("bucket").collect()] == [10, 10, 10, 10]


def test_verdict_needs_to_beat_random_removal(spark):
    """Half of the symbols lose and the gate leaves out one trade at random: four readings can pass, the fifth cannot."""
    rows = [(i, f"s{i % 20}", date(2024, 1, 1) + timedelta(days=i // 20), "early" if i < 100 else "late", 50.0 if i % 2 else -50.0) for i in range(200)]
    base = spark.createDataFrame(rows, "trade_id bigint, symbol string, session_date date, half string, net double")
    few = T.verdict(base, base.filter("trade_id not in (0, 2, 100, 102)"), 200, 0.0, margin=0.0, draws=20, min_p=0.0, drop=0).first()
    assert few["failed"] == "abstention" or few["d_per_trade"] > few["random_p95"]
    all_losers = T.verdict(base, base.filter("net > 0"), 200, 0.0, draws=20).first()
    assert all_losers["d_per_trade"] > all_losers["random_p95"] and all_losers["verdict"] == "PASSES"
    same = T.verdict(base, base, 200, 0.0, draws=20).first()
    assert same["random_p95"] is None and "abstention" in same["failed"]


@pytest.mark.parametrize("outliers", [[], [1e300], [-1e300, 1e300, 0.0]])
def test_no_value_bucket_is_crowded(spark, outliers):
    """One value far off leaves the others spread over the buckets, and the counts below are exact."""
    rng = random.Random(9)
    values = sorted({rng.gauss(0, 1) ** 3 for _ in range(20_000)} | set(outliers))
    df = spark.createDataFrame([("g", v, k % 5 + 1) for k, v in enumerate(values)] + [("h", 1.0, 2)], "g string, v double, n long").repartition(4)
    sizes = C.null_safe_on(df, C.value_edges(df, ["g"], "v"), ["g"]).filter("g = 'g'").groupBy(C.edge_bucket("v").alias("b")).count().collect()
    assert max(r["count"] for r in sizes) <= 0.01 * len(values)
    got = {r.v: r.n_below for r in C.cumulative_counts(df, ["g"], "v", ["n"]).filter("g = 'g'").collect()}
    below = 0
    for k, v in enumerate(values):
        assert got[v] == below
        below += k % 5 + 1
