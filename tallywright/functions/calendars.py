"""Public holidays and weekend days per country as small constant tables.

The dates follow from rules (fixed days, days counted from Easter, n-th weekdays,
observed days), so the table is generated for any covered year instead of typed in.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywright.constants import CALENDAR_FIRST_YEAR, CALENDAR_LAST_YEAR, WEEKEND_DAYS
from tallywright.functions.tables import constant_table

# --- Fixed values: month-day holidays and offsets in days from Easter Sunday ------------------
FIXED_DAYS = {
    "IT": "01-01 01-06 04-25 05-01 06-02 08-15 11-01 12-08 12-25 12-26",
    "DE": "01-01 05-01 10-03 12-25 12-26",
    "FR": "01-01 05-01 05-08 07-14 08-15 11-01 11-11 12-25",
    "ES": "01-01 01-06 05-01 08-15 10-12 11-01 12-06 12-08 12-25",
    "MT": "01-01 02-10 03-19 03-31 05-01 06-07 06-29 08-15 09-08 09-21 12-08 12-13 12-25",
    "IE": "01-01 03-17 12-25 12-26",
    "CY": "01-01 01-06 03-25 04-01 05-01 08-15 10-01 10-28 12-24 12-25 12-26",
}
EASTER_OFFSETS = {
    "IT": [1],
    "DE": [-2, 1, 39, 50],
    "FR": [1, 39, 50],
    "ES": [-2],
    "MT": [-2],
    "IE": [1],
}
ORTHODOX_EASTER_OFFSETS = {"CY": [-48, -2, 1, 50]}
# (month, weekday Monday = 0, n-th occurrence; -1 is the last one)
NTH_WEEKDAYS = {
    "IE": [(2, 0, 1), (5, 0, 1), (6, 0, 1), (8, 0, 1), (10, 0, -1)],
    "US": [(1, 0, 3), (2, 0, 3), (5, 0, -1), (9, 0, 1), (10, 0, 2), (11, 3, 4)],
}
US_OBSERVED_DAYS = "01-01 06-19 07-04 11-11 12-25"
IT_EXTRA_DAY_FROM = (2026, "10-04")
ES_LAST_YEAR = 2026


def _easter(year: int) -> date:
    century, in_century = divmod(year, 100)
    moon = (19 * (year % 19) + century - century // 4 - (8 * century + 13) // 25 + 15) % 30
    moon -= (moon // 28) * (1 - (29 // (moon + 1)) * ((21 - year % 19) // 11))
    weekday = (year + year // 4 + moon + 2 - century + century // 4) % 7
    offset = moon - weekday
    month = 3 + (offset + 40) // 44
    return date(year, month, offset + 28 - 31 * (month // 4))


def _orthodox_easter(year: int) -> date:
    moon = (19 * (year % 19) + 15) % 30
    weekday = (2 * (year % 4) + 4 * (year % 7) - moon + 34) % 7
    month, day = divmod(moon + weekday + 114, 31)
    return date(year, month, day + 1) + timedelta(days=13)


def _nth_weekday(year: int, month: int, weekday: int, nth: int) -> date:
    if nth > 0:
        first = date(year, month, 1)
        return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (nth - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    return last - timedelta(days=(last.weekday() - weekday) % 7)


def _month_day(year: int, text: str) -> date:
    month, day = text.split("-")
    return date(year, int(month), int(day))


def _observed(day: date) -> date:
    return day + timedelta(days={5: -1, 6: 1}.get(day.weekday(), 0))


def holidays_of(country: str, year: int) -> list[date]:
    """Sorted holidays of one country and year; empty where no official list is covered."""
    if country == "IL" or (country == "ES" and year > ES_LAST_YEAR):
        return []
    days = {_month_day(year, text) for text in FIXED_DAYS.get(country, "").split()}
    days |= {_easter(year) + timedelta(days=n) for n in EASTER_OFFSETS.get(country, [])}
    days |= {_orthodox_easter(year) + timedelta(days=n) for n in ORTHODOX_EASTER_OFFSETS.get(country, [])}
    days |= {_nth_weekday(year, *rule) for rule in NTH_WEEKDAYS.get(country, [])}
    if country == "US":
        around = [_observed(_month_day(y, text)) for y in (year, year + 1) for text in US_OBSERVED_DAYS.split()]
        days |= {day for day in around if day.year == year}
    if country == "IT" and year >= IT_EXTRA_DAY_FROM[0]:
        days.add(_month_day(year, IT_EXTRA_DAY_FROM[1]))
    if country == "ES":
        days = {day for day in days if day.weekday() != 6}
    return sorted(days)


def check_country(country: str) -> None:
    if country not in WEEKEND_DAYS:
        raise ValueError(f"unsupported country {country!r}; known: {', '.join(WEEKEND_DAYS)}")


def holiday_calendar(
    spark: SparkSession, country: str | None = None, first_year: int | None = None, last_year: int | None = None
) -> DataFrame:
    """(country, holiday) rows of one or all countries over a covered range of years."""
    first = CALENDAR_FIRST_YEAR if first_year is None else first_year
    last = CALENDAR_LAST_YEAR if last_year is None else last_year
    if country is not None:
        check_country(country)
    if first > last:
        raise ValueError("the first year is after the last year")
    uncovered = [y for y in range(first, last + 1) if not CALENDAR_FIRST_YEAR <= y <= CALENDAR_LAST_YEAR]
    if uncovered:
        raise ValueError(f"years not covered: {', '.join(map(str, uncovered))}")
    countries = [country] if country else list(WEEKEND_DAYS)
    rows = [(c, day) for c in countries for y in range(first, last + 1) for day in holidays_of(c, y)]
    return constant_table(spark, "country string, holiday date", rows)


def country_calendar(spark: SparkSession) -> DataFrame:
    """One row per country: its weekend days and the years for which holidays are known."""
    rows = [
        (c, days, [y for y in range(CALENDAR_FIRST_YEAR, CALENDAR_LAST_YEAR + 1) if holidays_of(c, y)])
        for c, days in WEEKEND_DAYS.items()
    ]
    return constant_table(spark, "country string, country_weekend array<int>, covered_years array<int>", rows)


def weekend_calendar(spark: SparkSession, country: str | None = None) -> DataFrame:
    """(country, weekday) rows, Monday = 0."""
    if country is not None:
        check_country(country)
    table = country_calendar(spark)
    if country is not None:
        table = table.filter(F.col("country") == country)
    return table.select("country", F.explode("country_weekend").alias("weekday"))
