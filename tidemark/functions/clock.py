"""Wall-clock functions. Stamps are UTC; sessions are New York time by zone rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"
PRE_OPEN, REGULAR_OPEN, REGULAR_CLOSE, POST_CLOSE = 240, 570, 960, 1200


def micros(ts) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def floor_to(ts, seconds: int) -> Column:
    """Start of the left-closed interval of this width that holds the stamp."""
    width = seconds * 1_000_000
    return F.timestamp_micros((F.floor(micros(ts) / F.lit(width)) * width).cast("bigint"))


def local(ts, zone: str = NEW_YORK) -> Column:
    return F.from_utc_timestamp(ts, zone)


def minute_of_day(ts, zone: str = NEW_YORK) -> Column:
    wall = local(ts, zone)
    return (F.hour(wall) * 60 + F.minute(wall)).cast("int")


def session_date(ts, zone: str = NEW_YORK) -> Column:
    return F.to_date(local(ts, zone))


def hhmm(minute: Column) -> Column:
    """Minute of day as HH:MM, which sorts in clock order."""
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), (minute % 60).cast("int"))


def session_block(minute: Column) -> Column:
    return (
        F.when(minute < REGULAR_OPEN, "PRE").when(minute < REGULAR_CLOSE, "RTH").otherwise("POST")
    )


def half_hour_block(minute: Column) -> Column:
    return hhmm((F.floor(minute / 30) * 30).cast("int"))


def in_session(ts, date: Column, start_minute: int, end_minute: int) -> Column:
    """Left-labelled bars, so the window is half-open."""
    m = minute_of_day(ts)
    return (session_date(ts) == date) & (m >= start_minute) & (m < end_minute)


def visible_at(ts: Column, at: Column, bar_seconds: int = 60) -> Column:
    """A bar is readable once it has closed, and only from 04:00 of the reader's own date."""
    closes = ts + F.expr(f"INTERVAL {bar_seconds} SECONDS")
    return (closes <= at) & (session_date(ts) == session_date(at)) & (minute_of_day(ts) >= PRE_OPEN)


def futures_session(ts) -> Column:
    """Around-the-clock session label: a bar from 18:00 on belongs to the next date."""
    wall = local(ts)
    return F.to_date(wall + F.expr("INTERVAL 6 HOURS"))


def exchange_open(ts) -> Column:
    """Sunday 18:00 to Friday 17:00, less the 17:00 maintenance hour."""
    wall = local(ts)
    m = F.hour(wall) * 60 + F.minute(wall)
    dow = F.dayofweek(wall)
    return (
        F.when(dow == 7, False)
        .when(dow == 1, m >= 1080)
        .when(dow == 6, m < 1020)
        .otherwise((m < 1020) | (m >= 1080))
    )


def in_maintenance(ts) -> Column:
    return F.hour(local(ts)) == 17


def regular_close_minute(early: Column) -> Column:
    return F.when(early, 780).otherwise(960)


def flat_minute(early: Column) -> Column:
    return F.when(early, 775).otherwise(955)


def hour_slot(minute: Column, start: int = REGULAR_OPEN, width: int = 60) -> Column:
    return F.floor((minute - start) / width).cast("int")


def clock_seconds_between(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / 1e6
