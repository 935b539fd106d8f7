"""Set operations on symbol-days, holdout splits and reproducible samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scale import hash_ordinal

KEY = ("symbol", "session_date")


def overlap(a: DataFrame, b: DataFrame, on: Sequence[str] = KEY) -> DataFrame:
    """Counts in both, only left, only right, and Jaccard."""
    l = a.select(*on).distinct().withColumn("__a", F.lit(1))
    r = b.select(*on).distinct().withColumn("__b", F.lit(1))
    return l.join(r, list(on), "full_outer").agg(
        F.count(F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), 1)).alias("both"),
        F.count(F.when(F.col("__b").isNull(), 1)).alias("only_left"),
        F.count(F.when(F.col("__a").isNull(), 1)).alias("only_right"),
    ).withColumn("jaccard", F.try_divide(F.col("both"), F.col("both") + F.col("only_left") + F.col("only_right")))


def restrict(rows: DataFrame, dates: DataFrame, on: str = "session_date") -> DataFrame:
    return rows.join(dates.select(on).distinct(), on, "left_semi")


def first_file_wins(rows: DataFrame, date: str = "session_date", file_no: str = "file_no") -> DataFrame:
    """Per date keep the rows of the lowest-numbered file that has the date."""
    best = rows.groupBy(date).agg(F.min(file_no).alias(file_no))
    return rows.join(best, [date, file_no], "left_semi")


def session_split(rows: DataFrame, date: str = "session_date", lock: float = 0.3) -> DataFrame:
    """early / late / locked per session: the last `lock` of sessions is locked, the rest is cut
    at its median. The ordered step runs over distinct sessions only."""
    days = rows.select(date).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy())
    k = F.row_number().over(Window.partitionBy().orderBy(date))
    training = (F.col("__n") - F.floor(F.col("__n") * lock)).cast("int")
    marked = days.withColumn("__n", n).withColumn("__k", k).withColumn("__t", training)
    part = (
        F.when(F.col("__k") > F.col("__t"), "locked")
        .when(F.col("__k") <= F.floor(F.col("__t") / 2), "early")
        .otherwise("late")
    )
    return rows.join(F.broadcast(marked.select(date, part.alias("part"))), date)


def halves_cut(rows: DataFrame, date: str = "session_date") -> DataFrame:
    """The median session as a one-row table: rows before it are the early half."""
    days = rows.select(date).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy())
    k = F.row_number().over(Window.partitionBy().orderBy(date))
    return (
        days.withColumn("__n", n).withColumn("__k", k)
        .filter(F.col("__k") == F.floor(F.col("__n") / 2) + 1)
        .select(F.col(date).alias("cut"))
    )


def with_half(rows: DataFrame, date: str = "session_date") -> DataFrame:
    cut = F.broadcast(halves_cut(rows, date))
    return rows.join(cut, how="cross").withColumn(
        "half", F.when(F.col(date) < F.col("cut"), "early").otherwise("late")
    ).drop("cut")


def fingerprint(rows: DataFrame, on: Sequence[str] = KEY) -> DataFrame:
    """Order-independent identity of a key set, built from per-row digests so nothing is gathered."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in on])), 1, 12), 16, 10)
    return rows.select(*on).distinct().agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum(digest.cast("decimal(20,0)")).cast("decimal(38,0)").alias("digest_sum")
    )


def three_way(rows: DataFrame, date: Column, holdout_from: str, seen_from: str, excluded: Sequence[tuple[str, str]] = ()) -> DataFrame:
    part = F.when(date >= F.lit(seen_from).cast("date"), "seen").when(
        date >= F.lit(holdout_from).cast("date"), "holdout").otherwise("training")
    out = rows.withColumn("part", part)
    for a, b in excluded:
        out = out.filter(~date.between(F.lit(a).cast("date"), F.lit(b).cast("date")))
    return out


def segments(df: DataFrame, by=("symbol",), order: str = "ordinal", code: str | None = None, max_gap: int = 5) -> DataFrame:
    """A new segment starts after a gap of more than `max_gap` sessions or a code change."""
    w = Window.partitionBy(*by).orderBy(order)
    fresh = F.lag(order).over(w).isNull() | (F.col(order) - F.lag(order).over(w) > max_gap)
    if code is not None:
        fresh = fresh | (F.col(code) != F.lag(code).over(w))
    return df.withColumn("__f", fresh.cast("int")).withColumn(
        "segment", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("__f")


def missing_sessions(calendar: DataFrame, rows: DataFrame, by: Sequence[str] = ("symbol",), date: str = "date") -> DataFrame:
    """Sessions inside each key's own span that have no row, with the share missing per year."""
    days = calendar.select(date).distinct()
    ends = days.agg(F.min(date).alias("from"), F.max(date).alias("to")).filter("`from` is not null")
    # Sessions up to each day of the calendar: the sessions of a span are a difference of two of them.
    w = Window.partitionBy().orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    upto = ends.select(F.explode(F.sequence(F.date_sub("from", 1), "to")).alias("day")).join(days.select(F.col(date).alias("day"), F.lit(1).alias("one")), "day", "left")
    upto = upto.select("day", F.coalesce(F.sum("one").over(w), F.lit(0)).alias("upto"))
    span = rows.groupBy(*by).agg(F.min(date).alias("lo"), F.max(date).alias("hi")).join(F.broadcast(ends), how="cross")
    years = span.withColumn("year", F.explode(F.sequence(F.year("lo"), F.year("hi"))))
    inside = lambda d: F.greatest(F.least(d, F.col("to")), F.date_sub("from", 1))
    first = inside(F.date_sub(F.greatest(F.col("lo"), F.make_date("year", F.lit(1), F.lit(1))), 1))
    last = inside(F.least(F.col("hi"), F.make_date("year", F.lit(12), F.lit(31))))
    years = years.select(*by, "year", first.alias("first"), last.alias("last"))
    years = years.join(upto.select(F.col("day").alias("first"), F.col("upto").alias("__a")), "first").join(upto.select(F.col("day").alias("last"), F.col("upto").alias("__b")), "last")
    have = rows.select(*by, date).distinct().join(days, date).groupBy(*by, F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("__n"))
    out = years.join(have, [*by, "year"], "left").withColumn("sessions", F.col("__b") - F.col("__a")).filter("sessions > 0")
    out = out.withColumn("missing", F.col("sessions") - F.coalesce("__n", F.lit(0)))
    return out.select(*by, "year", "sessions", "missing", (F.col("missing") / F.col("sessions")).alias("missing_share"))


def reject_sample(rejects: DataFrame, selected: DataFrame, n: int, date: str = "date", seed: str = "0") -> DataFrame:
    """Rejects drawn per session in proportion to the selected rows, by hash order."""
    counts = selected.groupBy(date).agg(F.count(F.lit(1)).alias("__c"))
    total = counts.agg(F.sum("__c").alias("__total"))
    want = counts.join(F.broadcast(total), how="cross").select(
        date, F.bround(F.col("__c") / F.col("__total") * n).cast("bigint").alias("want"))
    key = F.concat_ws("|", F.lit(seed), "symbol", F.col(date).cast("string"))
    ranked = hash_ordinal(rejects, [date], key, "draw_order")
    return ranked.join(want, date).filter(F.col("draw_order") <= F.col("want"))


def turnover(picks: DataFrame, day: str = "ordinal") -> DataFrame:
    """Share of the two days' union that changed, between consecutive days.

    Counted by joining a day's picks to the next day's, so no day's list is gathered.
    """
    days = picks.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy().orderBy(day)
    prev = days.withColumn("prev_day", F.lag(day).over(w)).withColumn("prev_n", F.lag("n").over(w))
    p = picks.select("symbol", F.col(day).alias("__d"))
    both = (
        picks.join(F.broadcast(prev.select(day, "prev_day")), day)
        .join(p, (picks["symbol"] == p["symbol"]) & (F.col("prev_day") == F.col("__d")), "left_semi")
        .groupBy(day).agg(F.count(F.lit(1)).alias("common"))
    )
    out = prev.filter("prev_day is not null").join(both, day, "left").na.fill(0, ["common"])
    union = F.col("n") + F.col("prev_n") - F.col("common")
    return out.select(day, (union - F.col("common")).alias("changed"), union.alias("union_size"),
                      ((union - F.col("common")) / union).alias("turnover"))


def every_kth(rows: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """Rows at evenly spaced positions of the dated list."""
    from tidemark.operators.ledger import global_position

    return global_position(rows, order, "position").filter((F.col("position") - 1) % k == 0)


def crc_subset(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """The n rows with the lowest crc32, a top-n that never sorts the table."""
    return rows.withColumn("crc", F.crc32(key.cast("binary"))).orderBy("crc", key).limit(n)


def presentation_order(rows: DataFrame, strata: Sequence[str], key: Column) -> DataFrame:
    """Stratified order in which every prefix is close to proportional."""
    size = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("stratum_size"))
    return (
        hash_ordinal(rows, list(strata), key, "in_stratum")
        .join(size, list(strata))
        .withColumn("place", (F.col("in_stratum") - 0.5) / F.col("stratum_size"))
    )
