"""Date scalar functions: Column to Column."""

from __future__ import annotations

import datetime as dt
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtime.functions.freq import Freq


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def floor_date(idx, unit: str = "D") -> Column:
    """Start of the period of ``unit`` that holds the date; weeks start on Monday; null stays null."""
    return Freq.of(unit).floor(_c(idx))


def ceil_date(idx, unit: str = "D") -> Column:
    """Start of the period after the one that holds the date, also for a date on a border."""
    f = Freq.of(unit)
    start = f.floor(_c(idx))
    if f.calendar:
        return F.add_months(F.to_date(start), f.months).cast("timestamp")
    return f.plus(start, 1)


def week_of_month(idx) -> Column:
    return F.floor((F.dayofmonth(_c(idx)) - 1) / 7).cast("int") + 1


def is_datetime_string(x) -> Column:
    """Whether a text can be read as a date or timestamp."""
    return F.coalesce(F.try_to_timestamp(_c(x)).isNotNull(), F.lit(False))


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    first = dt.date(year, month, 1)
    return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))


def _last(year: int, month: int, weekday: int) -> dt.date:
    end = (dt.date(year + month // 12, month % 12 + 1, 1)) - dt.timedelta(1)
    return end - dt.timedelta((end.weekday() - weekday) % 7)


def us_holidays(year: int) -> list[tuple[dt.date, str]]:
    """Federal holidays of the United States in a year by their rules, with the observed day of those that fall on a weekend."""
    fixed = [(1, 1, "New Year's Day", 0), (6, 19, "Juneteenth National Independence Day", 2021), (7, 4, "Independence Day", 0), (11, 11, "Veterans Day", 1938), (12, 25, "Christmas Day", 0)]
    out = [(dt.date(year, m, d), name) for m, d, name, since in fixed if year >= since]
    for day, name in [*out, (dt.date(year + 1, 1, 1), "New Year's Day")]:
        shift = {5: -1, 6: 1}.get(day.weekday(), 0)
        moved = day + dt.timedelta(shift)
        if shift and moved.year == year:
            out.append((moved, f"{name} (observed)"))
    out = [x for x in out if x[0].year == year]
    out += [(_nth(year, 2, 0, 3), "Washington's Birthday"), (_last(year, 5, 0), "Memorial Day"), (_nth(year, 9, 0, 1), "Labor Day"),
            (_nth(year, 10, 0, 2), "Columbus Day"), (_nth(year, 11, 3, 4), "Thanksgiving Day")]
    if year >= 1986:
        out.append((_nth(year, 1, 0, 3), "Martin Luther King Jr. Day"))
    return sorted(out)


def easter(year: int) -> dt.date:
    """Easter Sunday of the Gregorian calendar, by the anonymous algorithm published in 1876."""
    golden, century = year % 19, year // 100
    leap = (19 * golden + century - century // 4 - (century - (century + 8) // 25 + 1) // 3 + 15) % 30
    day = (32 + 2 * (century % 4) + 2 * (year % 100 // 4) - leap - year % 100 % 4) % 7
    back = (golden + 11 * leap + 22 * day) // 451
    n = leap + day - 7 * back + 114
    return dt.date(year, n // 31, n % 31 + 1)


def _calendar(fixed: list[tuple[int, int, str, int]], moving: list[tuple[int, str]]):
    """Rule of holidays on fixed days (month, day, name, first year) and days after Easter Sunday."""

    def rule(year: int) -> list[tuple[dt.date, str]]:
        out = [(dt.date(year, m, d), name) for m, d, name, since in fixed if year >= since]
        return sorted(out + [(easter(year) + dt.timedelta(n), name) for n, name in moving])

    return rule


# National holidays of countries whose rules need no substitute days
german_holidays = _calendar([(1, 1, "Neujahr", 0), (5, 1, "Erster Mai", 0), (10, 3, "Tag der Deutschen Einheit", 1990), (12, 25, "Erster Weihnachtstag", 0), (12, 26, "Zweiter Weihnachtstag", 0)],
                            [(-2, "Karfreitag"), (1, "Ostermontag"), (39, "Christi Himmelfahrt"), (50, "Pfingstmontag")])
french_holidays = _calendar([(1, 1, "Jour de l'an", 0), (5, 1, "Fête du Travail", 1919), (5, 8, "Fête de la Victoire", 1982), (7, 14, "Fête nationale", 0), (8, 15, "Assomption", 0), (11, 1, "Toussaint", 0), (11, 11, "Armistice", 1922),
                             (12, 25, "Noël", 0)], [(1, "Lundi de Pâques"), (39, "Ascension"), (50, "Lundi de Pentecôte")])
italian_holidays = _calendar([(1, 1, "Capodanno", 0), (1, 6, "Epifania del Signore", 1986), (4, 25, "Festa della Liberazione", 1946), (5, 1, "Festa dei Lavoratori", 1946), (6, 2, "Festa della Repubblica", 2001), (8, 15, "Assunzione della Vergine", 0),
                              (11, 1, "Tutti i Santi", 0), (12, 8, "Immacolata Concezione", 0), (12, 25, "Natale", 0), (12, 26, "Santo Stefano", 1947)], [(0, "Pasqua di Resurrezione"), (1, "Lunedì dell'Angelo")])

COUNTRIES = {"Germany": german_holidays, "DE": german_holidays, "France": french_holidays, "FR": french_holidays, "Italy": italian_holidays, "IT": italian_holidays,
             "UnitedStates": us_holidays, "US": us_holidays, "USA": us_holidays, "United States": us_holidays}


@lru_cache
def holiday_list(country_name: str, first: int = 1900, last: int = 2100) -> tuple[tuple[dt.date, str], ...]:
    rule = COUNTRIES.get(country_name)
    if rule is None:
        raise ValueError(f"no holiday calendar for {country_name!r}")
    return tuple(x for y in range(first, last + 1) for x in rule(y))


def holiday_table(spark: SparkSession, country_name: str = "UnitedStates", first: int = 1900, last: int = 2100) -> DataFrame:
    """(holiday_date, holiday_name): a few thousand rows at most, one a date."""
    names: dict[dt.date, str] = {}
    for day, name in holiday_list(country_name, first, last):
        names[day] = f"{names[day]}, {name}" if day in names else name
    return spark.createDataFrame(sorted(names.items()), "holiday_date date, holiday_name string")


def is_holiday(idx, country_name: str = "UnitedStates") -> Column:
    """Whether the date is a holiday, as an expression over the calendar's rules (years 1900 to 2100)."""
    days = sorted({d for d, _ in holiday_list(country_name)})
    return F.to_date(_c(idx)).isin(*days)
