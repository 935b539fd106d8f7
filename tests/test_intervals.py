"""Greedy non-overlapping selection against a plain walk, in islands and by pointers."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals


def walk(rows):
    """Rows (key, start, end, id) taken, one key after another."""
    taken = set()
    for key in {r[0] for r in rows}:
        busy = None
        for _, a, b, i in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2], r[3])):
            if busy is None or a > busy:
                taken.add(i)
                busy = b
    return taken


def intervals_of(rng, n, span, longest):
    out = []
    for i in range(n):
        a = rng.randrange(span)
        out.append((rng.choice(["hot"] * 8 + ["a", "b", None]), a, a + rng.randrange(longest), i))
    return out


@pytest.mark.parametrize("crowded", [10_000, 3])
@pytest.mark.parametrize("span, longest", [(100_000, 30), (2_000, 60), (400, 300)])
def test_selection_is_the_walk(spark, crowded, span, longest):
    rows = intervals_of(random.Random(span), 900, span, longest)
    df = spark.createDataFrame(rows, "k string, s long, e long, id long").repartition(5)
    got = intervals.non_overlapping(df, "s", "e", ["k"], crowded=crowded)
    # Of rows with one start and end any may stand for the others.
    at = {r[3]: r[:3] for r in rows}
    assert sorted(map(repr, (at[r.id] for r in got.collect()))) == sorted(map(repr, (at[i] for i in walk(rows))))


def test_refused_rows_are_kept(spark):
    rows = [("k", 1, 5, "won"), ("k", 2, 3, "won"), ("k", 5, 9, "lost"), ("k", 6, 7, "won"), ("j", 2, 3, "lost")]
    got = intervals.non_overlapping(spark.createDataFrame(rows, "k string, s long, e long, outcome string"), "s", "e", ["k"], refused="no").collect()
    assert {(r.k, r.s): r.outcome for r in got} == {("k", 1): "won", ("k", 2): "no", ("k", 5): "no", ("k", 6): "won", ("j", 2): "lost"}


def test_a_hot_key_is_many_islands(spark):
    """A key with most rows is split where nothing is open, and its ranges are windows of their own."""
    rows = [("hot", 10 * i, 10 * i + 12 * (i % 3 == 0), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, s long, e long, id long")
    marked = intervals.with_islands(df, "s", "e", ["k"])
    sizes = [r["count"] for r in marked.groupBy("k", "__island").count().collect()]
    assert max(sizes) <= 2 and len(sizes) >= 4000
    assert {r.id for r in intervals.non_overlapping(df, "s", "e", ["k"]).collect()} == walk(rows)


def test_nothing_to_select(spark):
    assert intervals.non_overlapping(spark.createDataFrame([], "k string, s long, e long"), "s", "e", ["k"]).count() == 0


def test_small_keys_need_no_edges(spark, monkeypatch):
    from tidemark.operators import intervals

    rows = [(f"k{k}", s, s + (k + s) % 4) for k in range(50) for s in range(0, 40, 1 + k % 3)]
    want = set()
    for k in range(50):
        busy = None
        for name, s, e in rows:
            if name == f"k{k}" and (busy is None or s > busy):
                want.add((name, s, e))
                busy = e

    def refuse(*_):
        raise AssertionError("edges of a small key")

    monkeypatch.setattr(intervals, "value_edges", refuse)
    got = intervals.non_overlapping(spark.createDataFrame(rows, "symbol string, s int, e int"), "s", "e", ["symbol"]).collect()
    assert {(r.symbol, r.s, r.e) for r in got} == want and len(got) == len(want)
