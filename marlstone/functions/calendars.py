"""Exchange calendars: the sessions up to a date, from weekdays less holidays that are computed or given."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Days on which the Hong Kong exchange is closed, as published for 2025 and 2026.
HONG_KONG = (
    "2025-01-01", "2025-01-29", "2025-01-30", "2025-01-31", "2025-04-04", "2025-04-18", "2025-04-21", "2025-05-01", "2025-05-05", "2025-07-01", "2025-10-01", "2025-10-07", "2025-10-29", "2025-12-25", "2025-12-26",
    "2026-01-01", "2026-02-17", "2026-02-18", "2026-02-19", "2026-04-03", "2026-04-06", "2026-04-07", "2026-05-01", "2026-05-25", "2026-06-19",
)


def easter(year: int) -> date:
    """Sunday of Easter by the anonymous Gregorian rule."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return date(year, month, day + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th weekday (Monday 0) of a month; the last one for n = -1."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def new_york(year: int) -> list[date]:
    """Days on which the New York exchange is closed: moved off weekends, but for New Year's Day on a Saturday."""
    near = lambda d: d - timedelta(1) if d.weekday() == 5 else d + timedelta(1) if d.weekday() == 6 else d
    days = [near(date(year, 7, 4)), near(date(year, 12, 25)), _nth(year, 1, 0, 3), _nth(year, 2, 0, 3), easter(year) - timedelta(2), _nth(year, 5, 0, -1), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4)]
    first = date(year, 1, 1)
    if first.weekday() != 5:
        days.append(near(first))
    if year >= 2022:
        days.append(near(date(year, 6, 19)))
    return sorted(days)


def holidays(market: str, first: int, last: int) -> list[date]:
    if market == "HK":
        return [d for d in map(date.fromisoformat, HONG_KONG) if first <= d.year <= last]
    return [d for y in range(first, last + 1) for d in new_york(y)] if market == "US" else []


def business_dates(end: str | date, n: int, closed: list[date] = ()) -> list[date]:
    """The last n weekdays up to `end`, less those closed."""
    day, out, shut = date.fromisoformat(str(end)), [], set(closed)
    while len(out) < n:
        if day.weekday() < 5 and day not in shut:
            out.append(day)
        day -= timedelta(1)
    return out[::-1]


def sessions(market: str, end: str | date, n: int) -> list[date]:
    """The last n sessions of a market (US, HK) up to `end`."""
    year = date.fromisoformat(str(end)).year
    return business_dates(end, n, holidays(market, year - n // 200 - 2, year))


def calendar(spark: SparkSession, market: str, first: str, last: str) -> DataFrame:
    """(dt) of all sessions of a market between two dates."""
    shut = [str(d) for d in holidays(market, int(first[:4]), int(last[:4]))]
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("dt"))
    days = days.where(F.dayofweek("dt").between(2, 6))
    return days.where(~F.col("dt").cast("string").isin(shut)) if shut else days
