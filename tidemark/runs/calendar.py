"""New York session calendar: closures by rule, and the special ones of the last decades by date."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession

EXCHANGES = {"XNYS": "America/New_York"}
#: Days without a session that no rule gives (mourning, attacks, storms).
CLOSED = frozenset(map(date.fromisoformat, (
    "1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09",
)))


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    first = date(year, month, 1)
    return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))


def _easter(year: int) -> date:
    """Gregorian Easter Sunday by the anonymous algorithm."""
    a, b, c = year % 19, year // 100, year % 100
    d, e = b // 4, b % 4
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    m = (a + 11 * h) // 319
    r = (2 * e + 2 * (c // 4) - c % 4 - h + m + 32) % 7
    month = (h - m + r + 90) // 25
    return date(year, month, (h - m + r + month + 19) % 32)


def _observed(day: date) -> date | None:
    """A holiday on a Sunday is kept on Monday, one on a Saturday on Friday."""
    return day + timedelta({5: -1, 6: 1}.get(day.weekday(), 0))


@lru_cache(maxsize=None)
def holidays(year: int) -> frozenset[date]:
    last_monday = _nth(year, 5, 0, 4) if _nth(year, 5, 0, 5).month != 5 else _nth(year, 5, 0, 5)
    new_year = date(year, 1, 1)
    days = [_nth(year, 1, 0, 3), _nth(year, 2, 0, 3), _easter(year) - timedelta(2), last_monday, _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), _observed(date(year, 7, 4)), _observed(date(year, 12, 25))]
    if new_year.weekday() != 5:  # on a Saturday it is not made up for
        days.append(_observed(new_year))
    if year >= 2022:
        days.append(_observed(date(year, 6, 19)))
    return frozenset(days)


def is_session(day: date) -> bool:
    return day.weekday() < 5 and day not in holidays(day.year) and day not in CLOSED


def sessions(spark: SparkSession, first: date, last: date, exchange: str = "XNYS") -> DataFrame:
    """The calendar as a table ``session date, close_utc timestamp``, to be joined with panels."""
    days = (first + timedelta(k) for k in range((last - first).days + 1))
    rows = [(d, close_time(d, exchange).replace(tzinfo=None)) for d in days if is_session(d)]
    return spark.createDataFrame(rows, "session date, close_utc timestamp_ntz")


def close_time(day: date, exchange: str = "XNYS") -> datetime:
    """End of a session in UTC: four in the afternoon, one on the short days."""
    if exchange not in EXCHANGES:
        raise ValueError(f"unknown exchange {exchange!r}")
    short = {_nth(day.year, 11, 3, 4) + timedelta(1), date(day.year, 12, 24), date(day.year, 7, 3)}
    return datetime.combine(day, time(13 if day in short else 16), ZoneInfo(EXCHANGES[exchange])).astimezone(ZoneInfo("UTC"))


def next_session(day: date) -> date | None:
    return next((d for d in (day + timedelta(k) for k in range(1, 31)) if is_session(d)), None)


def last_completed(now: datetime, exchange: str = "XNYS") -> date:
    """The last session whose close is not after ``now``."""
    today = now.date()
    for k in range(31):
        day = today - timedelta(k)
        if is_session(day) and close_time(day, exchange) <= now:
            return day
    raise ValueError("no completed session within 30 days")
