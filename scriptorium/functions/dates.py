"""Dates and intervals. "Today" is always a parameter."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of intervals in days, number words, and days of a unit.
NAMED_INTERVALS = {"daily": 1, "weekly": 7, "biweekly": 14, "fortnightly": 14, "monthly": 30, "quarterly": 91}
NUMBER_WORDS = {"": 1, "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "six": 6}
UNIT_DAYS = {"d": 1, "w": 7, "m": 30}
_INTERVAL = r"(?:every\s+)?(\d+|a|an|one|two|three|four|six)?\s*(d|day|days|w|wk|week|weeks|m|mo|month|months)"
DAYS_OF_YEAR = 365.25


def parse_date(c: Column) -> Column:
    """A date from yyyy, yyyy-mm or yyyy-mm-dd, or with slashes, month and day held within their bounds, 28 in February."""
    c = F.replace(F.substring(c, 1, 10), F.lit("/"), F.lit("-"))
    part = lambda i: F.try_to_number(F.get(F.split(c, "-"), F.lit(i)), F.lit("9999")).cast("int")
    month = F.least(F.greatest(F.coalesce(part(1), F.lit(1)), F.lit(1)), F.lit(12))
    longest = F.when(month == 2, 28).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    day = F.least(F.greatest(F.coalesce(part(2), F.lit(1)), F.lit(1)), longest)
    return F.when(c.rlike(r"^\d{4}"), F.make_date(F.substring(c, 1, 4).cast("int"), month, day))


def age_years(published: Column, year: Column, today: date, missing: float = 3.0) -> Column:
    """Years since publication: by date, else since 1 July of the year, else `missing`."""
    at = F.coalesce(published, F.make_date(year, F.lit(7), F.lit(1)))
    return F.when(at.isNull(), missing).otherwise(F.greatest(F.lit(0.0), F.date_diff(F.lit(today), at) / F.lit(DAYS_OF_YEAR)))


def interval_days(text: str | int) -> int:
    """Days of an interval such as 30, 2w, every 2 weeks or monthly."""
    said = str(text).strip().lower()
    shaped = re.fullmatch(_INTERVAL, said)
    if said in NAMED_INTERVALS:
        days = NAMED_INTERVALS[said]
    elif said.isdigit():
        days = int(said)
    elif shaped:
        number, unit = shaped[1] or "", shaped[2]
        days = (int(number) if number.isdigit() else NUMBER_WORDS[number]) * UNIT_DAYS[unit[0]]
    else:
        raise ValueError(f"not an interval: {text!r}")
    if not 1 <= days <= 366:
        raise ValueError("an interval has 1 to 366 days")
    return days


def parse_interval(c: Column) -> Column:
    """interval_days() as a Column; null where the text is no interval or out of bounds."""
    said = F.lower(F.trim(c))
    whole = f"^{_INTERVAL}$"
    number, unit = F.regexp_extract(said, whole, 1), F.regexp_extract(said, whole, 2)
    named = F.create_map(*[F.lit(x) for pair in NAMED_INTERVALS.items() for x in pair])
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    units = F.create_map(*[F.lit(x) for pair in UNIT_DAYS.items() for x in pair])
    count = F.coalesce(number.try_cast("int"), F.try_element_at(words, number))
    shaped = F.when(said.rlike(whole), count * F.try_element_at(units, F.substring(unit, 1, 1)))
    days = F.coalesce(F.try_element_at(named, said), F.when(said.rlike(r"^\d+$"), said.try_cast("int")), shaped)
    return F.when(days.between(1, 366), days)


def normalize_date(c: Column) -> Column:
    """The first day of a yyyy or yyyy-mm, or the day itself."""
    return F.date_format(F.coalesce(F.substring(c, 1, 10).try_cast("date")), "yyyy-MM-dd")


def window_start(last_success: Column, since: Column, now: Column, overlap: int = 10, lookback: int = 20, first_years: int = 3) -> Column:
    """Where a run's window begins (D06; D07 with a null `since`): an overlap before the last success, a least look-back,
    never before `since`."""
    later = F.least(F.date_sub(last_success, overlap), F.date_sub(now, lookback))
    first = F.coalesce(since, F.date_sub(now, 365 * first_years))
    start = F.when(last_success.isNotNull(), later).otherwise(first)
    return F.when(since.isNotNull() & (start < since), since).otherwise(start)


def next_run(status: Column, now: Column, interval: Column, retry_days: int = 1) -> Column:
    """The next slot of a scheduled run: an interval on, or a day after an exception."""
    return F.when(status == "error", F.date_add(now, retry_days)).otherwise(F.date_add(now, interval))


def outside_window(day: Column, year: Column, start: str | None, end: str | None) -> Column:
    """Why a record lies outside a window, or null (P04). Whole dates compare as text, others by year; undated ones pass."""
    on = F.substring(F.coalesce(day, F.lit("")), 1, 10)
    whole = F.length(on) == 10
    text = year.cast("string")
    out = F.lit(None).cast("string")
    if end:
        out = F.when(whole & (on > end[:10]), F.concat(F.lit("published "), on, F.lit(f", after requested window ({end[:10]})"))).when(
            ~whole & (year > int(end[:4])), F.concat(F.lit("published "), text, F.lit(f", after requested window ({end[:10]})"))
        )
    if start:
        early = F.when(whole & (on < start[:10]), F.concat(F.lit("published "), on, F.lit(f", before requested window ({start[:10]})"))).when(
            ~whole & (year < int(start[:4])), F.concat(F.lit("published "), text, F.lit(f", before requested window ({start[:10]})"))
        )
        out = F.coalesce(early, out)
    return out
