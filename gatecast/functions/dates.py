"""Date and time expressions. Stored times are UTC; local fields are derived on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatecast.functions.labels import DAY_PARTS, ZONE


def season_to_year(season: Column, date_text: Column, months: tuple[int, ...] = (7, 8, 9, 10, 11, 12)) -> Column:
    """Calendar year of ``dd/MM HH:mm`` in a season named by its closing year."""
    opening = date_text.rlike("/(" + "|".join(f"{m:02d}" for m in months) + ") ")
    year = season.try_cast("int")
    return F.when(opening, year - 1).when(~opening, year)


def season_of(day: Column, first_month: int = 7) -> Column:
    """Season, named by its closing year, that a calendar date falls in."""
    return F.year(day) + F.when(F.month(day) >= first_month, 1).otherwise(0)


def parse_local_ts(year: Column, date_text: Column) -> Column:
    """Wall-clock time from a year and ``dd/MM HH:mm``; null when unreadable."""
    return F.try_to_timestamp(F.concat_ws(" ", year.cast("string"), date_text), F.lit("yyyy dd/MM HH:mm"))


def to_utc(local: Column, zone: str = ZONE) -> Column:
    """Wall-clock time in ``zone`` to UTC, summer time included."""
    return F.to_utc_timestamp(local, zone)


def day_part(ts: Column) -> Column:
    """Part of the day by the hour; null outside all parts."""
    hour = F.hour(ts)
    (a, b, label), *rest = DAY_PARTS
    out = F.when(hour.between(a, b), label)
    for a, b, label in rest:
        out = out.when(hour.between(a, b), label)
    return out


def floor_hour(ts: Column) -> Column:
    """Down to the full hour."""
    return F.date_trunc("hour", ts)


def iso_key(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of a UTC time."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day_key(ts: Column) -> Column:
    """``YYYY-MM-DD`` of a UTC time."""
    return F.date_format(ts, "yyyy-MM-dd")


def month(ts: Column) -> Column:
    return F.month(ts)


def week_of_year_simple(ts: Column) -> Column:
    """Seven-day blocks counted from 1 January (not the ISO week)."""
    return F.floor((F.dayofyear(ts) - 1) / 7).cast("int") + 1


def holiday_season_flag(ts: Column) -> Column:
    """1 from 26 June to 12 August (day 31 of a month does not occur in June), else 0."""
    m, d = F.month(ts), F.dayofmonth(ts)
    inside = (m == 7) | ((m == 6) & d.between(26, 30)) | ((m == 8) & d.between(1, 12))
    return F.when(inside, 1).when(~inside, 0)


def stored_timestamp(column: Column) -> Column:
    """Timestamp from its stored text or seconds; null when unreadable."""
    return column.try_cast("timestamp")
