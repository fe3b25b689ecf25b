"""Times of day, dates and nanosecond clocks. Nanoseconds are BIGINT: a TIMESTAMP holds microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import div

DAY_MS = 86_400_000
SHANGHAI_OFFSET_MS = 8 * 3_600_000


def micros(ts: Column) -> Column:
    """Epoch microseconds of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def recv_ns(ts: Column) -> Column:
    return micros(ts) * 1000


def millis_of_day(ts: Column) -> Column:
    return F.pmod(div(micros(ts), 1000), F.lit(DAY_MS))


def encode_hhmmssmmm(ms: Column) -> Column:
    h, m, s = div(ms, 3_600_000), div(ms, 60_000) % 60, div(ms, 1000) % 60
    return h * 10_000_000 + m * 100_000 + s * 1000 + ms % 1000


def decode_hhmmssmmm(t: Column) -> Column:
    """Milliseconds of the day, or null if the hour, minute or second is out of range."""
    h, m, s = div(t, 10_000_000), div(t, 100_000) % 100, div(t, 1000) % 100
    ok = (t >= 0) & (h < 24) & (m < 60) & (s < 60)
    return F.when(ok, h * 3_600_000 + m * 60_000 + s * 1000 + t % 1000)


def time_text(t: Column) -> Column:
    """HH:MM:SS.mmm"""
    p = F.lpad(t.cast("string"), 9, "0")
    return F.concat_ws(".", F.concat_ws(":", F.substring(p, 1, 2), F.substring(p, 3, 2), F.substring(p, 5, 2)), F.substring(p, 7, 3))


def in_session(t: Column) -> Column:
    """09:30-11:30 or 13:00-15:00."""
    return t.between(93_000_000, 113_000_000) | t.between(130_000_000, 150_000_000)


def exchange_ns(date: Column, t: Column) -> Column:
    """Epoch nanoseconds of an exchange time in Shanghai; null if the time is invalid."""
    return (F.unix_date(date).cast("long") * DAY_MS + decode_hhmmssmmm(t) - SHANGHAI_OFFSET_MS) * 1_000_000


def weekday(date: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(date) - 1


def next_trading_day(date: Column) -> Column:
    """The next weekday; no holidays."""
    return F.date_add(date, F.when(weekday(date) == 5, 3).when(weekday(date) == 6, 2).otherwise(1))


OPEN, MORNING_CLOSE, AFTERNOON_OPEN, CLOSE = 34_200_000, 41_400_000, 46_800_000, 54_000_000


def advance(ms: int, days: int, step: int) -> tuple[int, int]:
    """The next event time after ``step`` milliseconds and the trading days passed: past the close the next
    day's opening, inside the midday pause its end. A recurrence: walk it within one instrument."""
    if step > CLOSE - min(ms, CLOSE):
        return OPEN, days + 1
    ms += step
    return (AFTERNOON_OPEN if MORNING_CLOSE < ms < AFTERNOON_OPEN else ms), days
