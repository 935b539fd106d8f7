"""Trading calendar built from rules: holidays, early closes, daylight-saving edges, event dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Exchange closures that follow no rule.
UNSCHEDULED = ("2001-09-11 2001-09-12 2001-09-13 2001-09-14 2004-06-11 2007-01-02 2012-10-29 2012-10-30 2018-12-05 2025-01-09").split()


def days(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")
    )


def nth_weekday(date: Column, month: int, dow: int, n: int) -> Column:
    """dow: 1 Sunday .. 7 Saturday."""
    return (F.month(date) == month) & (F.dayofweek(date) == dow) & (F.ceil(F.dayofmonth(date) / 7) == n)


def last_weekday(date: Column, month: int, dow: int) -> Column:
    return (F.month(date) == month) & (F.dayofweek(date) == dow) & (F.month(F.date_add(date, 7)) != month)


def observed(date: Column, month: int, day: int) -> Column:
    """A fixed holiday, moved to Friday or Monday when it falls on a weekend."""
    on = lambda d: (F.month(d) == month) & (F.dayofmonth(d) == day)
    dow = F.dayofweek(date)
    return ((dow >= 2) & (dow <= 6) & on(date)) | ((dow == 6) & on(F.date_add(date, 1))) | ((dow == 2) & on(F.date_sub(date, 1)))


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday by the anonymous computus."""
    fl = lambda c: F.floor(c)
    a, b, c = year % 19, fl(year / 100), year % 100
    d, e = fl(b / 4), b % 4
    g = fl((8 * b + 13) / 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = fl(c / 4), c % 4
    l = (32 + 2 * e + 2 * i - h - k) % 7
    m = fl((a + 11 * h + 22 * l) / 451)
    month = fl((h + l - 7 * m + 114) / 31)
    day = (h + l - 7 * m + 114) % 31 + 1
    return F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))


def with_holidays(calendar: DataFrame) -> DataFrame:
    """Adds holiday, early_close and session flags to a date table."""
    d = F.col("date")
    holiday = (
        observed(d, 1, 1) | nth_weekday(d, 1, 2, 3) | nth_weekday(d, 2, 2, 3)
        | (d == F.date_sub(easter(F.year(d)), 2)) | last_weekday(d, 5, 2)
        | ((F.year(d) >= 2022) & observed(d, 6, 19)) | observed(d, 7, 4) | nth_weekday(d, 9, 2, 1)
        | nth_weekday(d, 11, 5, 4) | observed(d, 12, 25) | d.cast("string").isin(UNSCHEDULED)
    )
    dow = F.dayofweek(d)
    eve = dow.between(2, 5) & (
        ((F.month(d) == 7) & (F.dayofmonth(d) == 3)) | ((F.month(d) == 12) & (F.dayofmonth(d) == 24))
    )
    early = nth_weekday(F.date_sub(d, 1), 11, 5, 4) | eve
    week = dow.between(2, 6)
    return calendar.withColumn("holiday", week & holiday).withColumn(
        "early_close", week & ~holiday & early).withColumn("session", week & ~holiday)


def dst_transitions(calendar: DataFrame) -> DataFrame:
    """Dates whose UTC offset differs from the day before."""
    noon = F.col("date").cast("timestamp") + F.expr("INTERVAL 12 HOURS")
    offset = (F.unix_timestamp(F.from_utc_timestamp(noon, "America/New_York")) - F.unix_timestamp(noon)) / 3600
    w = Window.partitionBy().orderBy("date")
    return calendar.withColumn("offset", offset.cast("int")).withColumn("prev", F.lag("offset").over(w)).filter(
        "offset <> prev").select("date", "offset")


def with_ordinal(calendar: DataFrame) -> DataFrame:
    """Session ordinals. The table is one row per date, so the single ordered window is small."""
    return calendar.withColumn("ordinal", F.row_number().over(Window.partitionBy().orderBy("date")))


def weekly_events(calendar: DataFrame, dow: int) -> DataFrame:
    """A weekly release on weekday `dow`, one day later in a week whose Monday..release day holds
    a holiday."""
    c = with_holidays(calendar)
    start = F.date_trunc("week", F.col("date")).cast("date")
    weeks = c.withColumn("week", start)
    delayed = weeks.groupBy("week").agg(
        F.max(F.when((F.dayofweek("date") >= 2) & (F.dayofweek("date") <= dow) & F.col("holiday"), 1).otherwise(0)).alias("late")
    )
    return delayed.select(F.date_add("week", F.col("late") + (dow - 2)).alias("date"), (F.col("late") == 1).alias("delayed"))


def nearest_session(dates: DataFrame, sessions: DataFrame, max_back: int = 5) -> DataFrame:
    """The session at or before each date, at most `max_back` calendar days earlier."""
    s = sessions.select(F.col("date").alias("session"))
    reach = dates.select("date").distinct().withColumn(
        "session", F.explode(F.sequence(F.lit(0), F.lit(max_back)))).select(
        "date", F.date_sub("date", F.col("session")).alias("session"))
    found = reach.join(F.broadcast(s), "session").groupBy("date").agg(F.max("session").alias("session"))
    return dates.join(found, "date", "left")
