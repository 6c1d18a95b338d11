"""Half-hour steps, fixed-offset local time, calendar parts and holiday rules.

Time is carried as ``step``: the number of half-hours since 1970-01-01 00:00 UTC.
Local time is UTC plus a fixed number of hours (no daylight saving).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP_SECONDS = 1800
SLOTS_PER_DAY = 48


def step_of(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / STEP_SECONDS)


def step_ts(step: Column) -> Column:
    return F.timestamp_seconds(step * STEP_SECONDS)


def ts_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def shift_hours(ts: Column, hours: int) -> Column:
    """Fixed-offset shift (P-06)."""
    return ts.cast("timestamp") + F.make_interval(hours=F.lit(hours))


def local_step(step: Column, tz_hours: int) -> Column:
    return step + 2 * tz_hours


def slot_of(step: Column, tz_hours: int) -> Column:
    """Half-hour of the local day, 0..47."""
    return F.pmod(local_step(step, tz_hours), F.lit(SLOTS_PER_DAY))


def day_of(step: Column, tz_hours: int) -> Column:
    return F.floor(local_step(step, tz_hours) / SLOTS_PER_DAY)


def weekday_of(step: Column, tz_hours: int) -> Column:
    """Monday = 0. Day 0 (1970-01-01) is a Thursday."""
    return F.pmod(day_of(step, tz_hours) + 3, F.lit(7))


def local_date(step: Column, tz_hours: int) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day_of(step, tz_hours).cast("int"))


def parse_slot_date(text: Column, tz_hours: int) -> Column:
    """``YYYYMMDDSS`` local text with SS = 01..48 to a UTC timestamp (P-03)."""
    day = F.to_timestamp(F.substring(text, 1, 8), "yyyyMMdd")
    slot = F.substring(text, 9, 2).cast("int")
    return day + F.make_interval(mins=(slot - 1) * 30) - F.make_interval(hours=F.lit(tz_hours))


def parse_minute_text(text: Column, tz_hours: int) -> Column:
    """``YYYYMMDDHHmm`` local text to UTC (P-04)."""
    return F.to_timestamp(text, "yyyyMMddHHmm") - F.make_interval(hours=F.lit(tz_hours))


def parse_utc_suffix(text: Column) -> Column:
    """``2013-01-01 00:00:00 +0000 UTC`` to a timestamp (P-05)."""
    return F.to_timestamp(F.regexp_replace(text, r"\s+\+\d+ UTC$", ""))


def minutes_of_day(text: Column) -> Column:
    """``HH:mm`` text to minutes, anything else to null (P-33)."""
    t = F.try_to_timestamp(text, F.lit("HH:mm"))
    return F.hour(t) * 60 + F.minute(t)


def cyclic(x: Column, period: int) -> tuple[Column, Column]:
    angle = x * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def temporal_columns(ts_local: Column) -> dict[str, Column]:
    """Ten cyclic columns and the weekend flag of a local timestamp (P-12, P-13)."""
    hour = F.hour(ts_local)
    parts = {
        "slot": (hour * 2 + F.floor(F.minute(ts_local) / 30), 48),
        "hour": (hour, 24),
        "weekday": (F.weekday(ts_local), 7),
        "month": (F.month(ts_local) - 1, 12),
        "doy": (F.dayofyear(ts_local) - 1, 366),
    }
    out: dict[str, Column] = {}
    for name, (x, period) in parts.items():
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclic(x, period)
    out["is_weekend"] = (F.weekday(ts_local) >= 5).cast("int")
    return out


# US federal holidays, as month/day and as the nth weekday of a month.
FIXED_HOLIDAYS = [(1, 1), (7, 4), (11, 11), (12, 25)]
NTH_WEEKDAY_HOLIDAYS = [(1, 0, 3), (2, 0, 3), (9, 0, 1), (10, 0, 2), (11, 3, 4)]
LAST_WEEKDAY_HOLIDAYS = [(5, 0)]


def is_us_holiday(d: Column) -> Column:
    """Rule-based holiday test of a date, no table needed (P-15)."""
    month, day, weekday = F.month(d), F.dayofmonth(d), F.weekday(d)
    nth = F.ceil(day / 7)
    tests = [(month == m) & (day == dd) for m, dd in FIXED_HOLIDAYS]
    tests += [(month == m) & (weekday == wd) & (nth == n) for m, wd, n in NTH_WEEKDAY_HOLIDAYS]
    tests += [
        (month == m) & (weekday == wd) & (day + 7 > F.dayofmonth(F.last_day(d)))
        for m, wd in LAST_WEEKDAY_HOLIDAYS
    ]
    # Independence Day observed: Friday the 3rd or Monday the 5th of July.
    tests += [
        (month == 7) & (day == 3) & (weekday == 4),
        (month == 7) & (day == 5) & (weekday == 0),
    ]
    hit = tests[0]
    for t in tests[1:]:
        hit = hit | t
    return hit
