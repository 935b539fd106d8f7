"""As-of, range, interval and matching joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import micros

HOUR = 3600


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    cols: Sequence[str],
    left_ts: str = "ts",
    right_ts: str = "ts",
    left_seq: str = "seq",
    right_seq: str = "seq",
    direction: str = "backward",
    strict: bool = False,
    tolerance_s: float | None = None,
    bucket_s: int | None = HOUR,
) -> DataFrame:
    """Every left row with `cols` of the nearest right row at or before it (or after it).

    Both sides are tagged, unioned and sorted once per (key, time bucket); the right struct is
    carried by `last ignore nulls`, so no row is multiplied. A key that holds a large part of the
    data is spread over its buckets. Reaching across a bucket edge is done in one of two ways:
    with a tolerance no wider than a bucket each right row is also placed in the next bucket;
    without one, the last right row of every bucket (a partial aggregate) is carried over the
    key's bucket list and enters each later bucket as a seed row. `bucket_s=None` sorts whole
    keys and is meant for inputs whose rows per key are bounded, such as daily bars.
    """
    sign = 1 if direction == "backward" else -1

    def stamp(ts: str) -> Column:
        return micros(F.col(ts).cast("timestamp")) * sign

    right_tag, left_tag = (1, 0) if strict else (0, 1)
    values = F.struct(F.col(right_ts).alias("__rts"), *[F.col(c) for c in cols])
    width = None if bucket_s is None else bucket_s * 1_000_000
    bucket = (lambda c: F.lit(0)) if width is None else (lambda c: F.floor(c / width).cast("bigint"))

    lcols = left.columns
    lrows = left.select(
        *on, stamp(left_ts).alias("__t"), F.lit(left_tag).alias("__tag"),
        F.col(left_seq).cast("bigint").alias("__seq"), F.struct(*lcols).alias("__l"),
    )
    rrows = right.select(
        *on, stamp(right_ts).alias("__t"), F.lit(right_tag).alias("__tag"),
        (F.col(right_seq).cast("bigint") * sign).alias("__seq"), values.alias("__r"),
    )
    lrows = lrows.withColumn("__b", bucket(F.col("__t")))
    rrows = rrows.withColumn("__b", bucket(F.col("__t")))
    if width is not None:
        if tolerance_s is not None and tolerance_s <= bucket_s:
            reach = int(tolerance_s * 1_000_000)
            rrows = rrows.withColumn("__b", F.explode(F.sequence("__b", bucket(F.col("__t") + reach))))
        else:
            ends = (
                lrows.select(*on, "__b", F.lit(1).alias("__has"), F.lit(None).cast(rrows.schema["__r"].dataType).alias("__r"),
                             "__t", "__seq")
                .unionByName(rrows.select(*on, "__b", F.lit(0).alias("__has"), "__r", "__t", "__seq"))
                .groupBy(*on, "__b")
                .agg(F.max("__has").alias("__has"),
                     F.max_by("__r", F.when(F.col("__r").isNotNull(), F.struct("__t", "__seq"))).alias("__r"))
            )
            earlier = Window.partitionBy(*on).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
            seeds = (
                ends.withColumn("__r", F.last("__r", ignorenulls=True).over(earlier))
                .filter((F.col("__has") == 1) & F.col("__r").isNotNull())
                .select(*on, F.lit(-(2**62)).alias("__t"), F.lit(-1).alias("__tag"), F.lit(0).cast("bigint").alias("__seq"),
                        "__r", "__b")
            )
            rrows = rrows.unionByName(seeds)
    rows = lrows.unionByName(rrows, allowMissingColumns=True)
    w = (
        Window.partitionBy(*on, "__b")
        .orderBy("__t", "__tag", "__seq")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    hit = rows.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).filter(F.col("__l").isNotNull())
    if tolerance_s is not None:
        gap = F.col("__t") - stamp_of(F.col("__r.__rts"), sign)
        hit = hit.withColumn("__r", F.when(gap <= int(tolerance_s * 1_000_000), F.col("__r")))
    return hit.select("__l.*", *[F.col(f"__r.{c}").alias(c) for c in cols])


def stamp_of(c: Column, sign: int = 1) -> Column:
    return micros(c.cast("timestamp")) * sign


def interval_join(
    points: DataFrame,
    spells: DataFrame,
    on: Sequence[str],
    point: str,
    start: str = "start",
    end: str = "end",
    how: str = "inner",
) -> DataFrame:
    """Points joined to the half-open spells that cover them; a NULL end is open.

    The join is an equi-join on the key with a residual range test, so Spark is free to
    broadcast the spell table when its statistics say it is small.
    """
    s = spells
    covers = (F.col(f"p.{point}") >= F.col(f"s.{start}")) & (
        F.col(f"s.{end}").isNull() | (F.col(f"p.{point}") < F.col(f"s.{end}"))
    )
    keys = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in on]
    cond = covers
    for k in keys:
        cond = cond & k
    joined = points.alias("p").join(s.alias("s"), cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    extra = [c for c in spells.columns if c not in on]
    return joined.select("p.*", *[F.col(f"s.{c}") for c in extra])


def range_join(
    entries: DataFrame,
    rows: DataFrame,
    on: Sequence[str],
    low: Column,
    high: Column,
    row_ts: str,
    bin_s: int = HOUR,
    how: str = "inner",
    also: Column | None = None,
) -> DataFrame:
    """Rows with low <= ts < high per entry, by equi-join on (key, time bin); `also` is a further condition of the join.

    `low` and `high` are timestamp expressions over the entries. Each entry is copied to the
    bins its interval meets; each row lies in one bin, so no pair is made twice.
    """
    width = bin_s * 1_000_000
    e = entries.withColumn("__lo", micros(low)).withColumn("__hi", micros(high))
    e = e.withColumn(
        "__bin",
        F.explode_outer(F.when(F.col("__hi") > F.col("__lo"), F.sequence(
            F.floor(F.col("__lo") / width).cast("bigint"), F.floor((F.col("__hi") - 1) / width).cast("bigint")))),
    )
    r = rows.withColumn("__rt", micros(row_ts)).withColumn("__bin", F.floor(F.col("__rt") / width).cast("bigint"))
    cond = (F.col("e.__bin") == F.col("r.__bin")) & (F.col("r.__rt") >= F.col("e.__lo")) & (
        F.col("r.__rt") < F.col("e.__hi")
    )
    for k in on:
        cond = cond & (F.col(f"e.{k}") == F.col(f"r.{k}"))
    cond = cond if also is None else cond & also
    joined = e.alias("e").join(r.alias("r"), cond, how)
    extra = [c for c in rows.columns if c not in entries.columns]
    return joined.select(*[F.col(f"e.{c}") for c in entries.columns], *[F.col(f"r.{c}") for c in extra])


def ahead_aggregates(points: DataFrame, rows: DataFrame, on: Sequence[str], aggs: dict[str, tuple[str, Callable[[Column], Column]]], window_s: int, ts: str = "ts", bucket_s: int = HOUR) -> DataFrame:
    """Aggregates (output: column of rows and function) over rows in [t, t + window) for every point, without making pairs.

    As `trailing_sums`, with a RANGE frame that looks ahead; rows near a bucket's start are copied to the one before.
    """
    if window_s > bucket_s:
        raise ValueError("window wider than a bucket")
    width, span = bucket_s * 1_000_000, window_s * 1_000_000
    p = points.select(*on, micros(ts).alias("__t"), F.struct(*points.columns).alias("__p"), F.floor(micros(ts) / width).cast("bigint").alias("__b"))
    r = rows.select(*on, micros(ts).alias("__t"), *[F.col(c).alias(f"__s_{o}") for o, (c, _) in aggs.items()])
    r = r.withColumn("__b", F.explode(F.sequence(F.floor((F.col("__t") - span + 1) / width).cast("bigint"), F.floor(F.col("__t") / width).cast("bigint"))))
    u = p.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*on, "__b").orderBy("__t").rangeBetween(0, span - 1)
    u = u.select("__p", *[fn(F.col(f"__s_{o}")).over(w).alias(o) for o, (_, fn) in aggs.items()])
    return u.filter("__p IS NOT NULL").select("__p.*", *aggs)


def trailing_sums(
    points: DataFrame,
    rows: DataFrame,
    on: Sequence[str],
    sums: dict[str, str],
    window_s: int,
    ts: str = "ts",
    bucket_s: int = HOUR,
    include_now: bool = False,
) -> DataFrame:
    """Sums over rows in [t - window, t) for every point, without making pairs.

    Points and rows are unioned per (key, time bucket) and summed over a RANGE frame; rows near
    a bucket's end are copied to the next bucket so that every frame is whole. The frame reaches
    at most one bucket back, so `window_s` must not exceed `bucket_s`.
    """
    if window_s > bucket_s:
        raise ValueError("window wider than a bucket")
    width, span = bucket_s * 1_000_000, window_s * 1_000_000
    pcols = points.columns
    p = points.select(*on, micros(ts).alias("__t"), F.struct(*pcols).alias("__p"),
                      F.floor(micros(ts) / width).cast("bigint").alias("__b"))
    r = rows.select(*on, micros(ts).alias("__t"), *[F.col(s).alias(f"__s_{o}") for o, s in sums.items()])
    r = r.withColumn("__b", F.explode(F.sequence(
        F.floor(F.col("__t") / width).cast("bigint"), F.floor((F.col("__t") + span) / width).cast("bigint"))))
    u = p.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*on, "__b").orderBy("__t").rangeBetween(-span, 0 if include_now else -1)
    for out in sums:
        u = u.withColumn(out, F.sum(f"__s_{out}").over(w))
    return u.filter(F.col("__p").isNotNull()).select("__p.*", *sums)


def pair_up(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    tolerance_s: float,
    left_id: str = "left_id",
    right_id: str = "right_id",
    mode: str = "nearest",
    shards: int = 8,
) -> DataFrame:
    """One-to-one matching per key; rows of either side without a partner come with NULLs.

    mode 'preceding': left rows in time order take the nearest earlier unused right row.
    mode 'nearest': candidate pairs by (|dt|, left time) are taken while both ends are free.
    The greedy step is a path inside a key, so `on` ends with a session date that bounds it. Keys
    are packed into (date, hash shard) groups to spare one Python call per key; only ids and
    stamps travel, and a right row can only serve a left row of its own key.
    """
    span = int(tolerance_s * 1_000_000)
    shard = F.pmod(F.xxhash64(*on), F.lit(shards)).alias("__shard")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in on]).alias("__key")
    l = left.select(*on, key, shard, F.col(left_id).alias("lid"), micros("ts").alias("lt"))
    r = right.select(*on, key, shard, F.col(right_id).alias("rid"), micros("ts").alias("rt"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in l.select(*on).schema.fields)

    def match(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pairs = {}
        lp, rp = lp.sort_values(["__key", "lt", "lid"]), rp.sort_values(["__key", "rt", "rid"])
        rkeys, lkeys = rp["__key"].to_numpy(), lp["__key"].to_numpy()
        rtimes, rids = rp["rt"].to_numpy(), rp["rid"].to_numpy()
        names, begin = np.unique(lkeys, return_index=True)
        for k, at, to in zip(names, begin, [*begin[1:], len(lkeys)]):
            a, b = np.searchsorted(rkeys, k), np.searchsorted(rkeys, k, side="right")
            if a == b:
                continue
            times, ids, free = rtimes[a:b], rids[a:b], np.ones(b - a, dtype=bool)
            left_rows = list(zip(lp["lt"].to_numpy()[at:to], lp["lid"].to_numpy()[at:to]))
            if mode == "preceding":
                waiting, seen = [], 0  # the nearest earlier right row is always the last one waiting
                for t, i in left_rows:
                    while seen < len(times) and times[seen] <= t:
                        waiting.append(seen)
                        seen += 1
                    if waiting and t - times[waiting[-1]] <= span:
                        j = waiting.pop()
                        pairs[i] = (ids[j], t - times[j])
                continue
            near = [
                (abs(times[j] - t), t, i, j)
                for t, i in left_rows
                for j in range(np.searchsorted(times, t - span), np.searchsorted(times, t + span, side="right"))
            ]
            for _, t, i, j in sorted(near):
                if i not in pairs and free[j]:
                    free[j] = False
                    pairs[i] = (ids[j], times[j] - t)
        out = lp[lp["lid"].isin(list(pairs))].copy()
        out["rid"] = [pairs[i][0] for i in out["lid"]]
        out["dt_us"] = [pairs[i][1] for i in out["lid"]]
        return out[[*on, "lid", "rid", "dt_us"]]

    groups = [on[-1], "__shard"]
    pairs = l.groupBy(*groups).cogroup(r.groupBy(*groups)).applyInPandas(match, f"{fields}, lid bigint, rid bigint, dt_us bigint")
    both = pairs.join(l.select(*on, "lid"), [*on, "lid"], "right").select(*pairs.columns)
    alone = r.join(pairs.select("rid"), "rid", "left_anti").select(*on, F.lit(None).cast("bigint").alias("lid"), "rid", F.lit(None).cast("bigint").alias("dt_us"))
    return both.unionByName(alone)


def left_on_ordinal(df: DataFrame, calendar: DataFrame, offset: int, cols: Sequence[str], prefix: str) -> DataFrame:
    """Values of the same symbol `offset` sessions away, by calendar ordinal."""
    other = df.select(
        "symbol", (F.col("ordinal") - offset).alias("ordinal"), *[F.col(c).alias(f"{prefix}{c}") for c in cols]
    )
    return df.join(other, ["symbol", "ordinal"], "left")
