"""Frequencies and durations: parsing, floors, bins and sequences."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of time units
ALIASES = {
    "ns": "ns", "n": "ns", "us": "us", "u": "us", "microsecond": "us", "microseconds": "us", "ms": "ms", "l": "ms", "millisecond": "ms", "milliseconds": "ms",
    "s": "s", "sec": "s", "secs": "s", "second": "s", "seconds": "s", "t": "min", "min": "min", "mins": "min", "minute": "min", "minutes": "min",
    "h": "h", "hr": "h", "hrs": "h", "hour": "h", "hours": "h", "d": "D", "day": "D", "days": "D", "b": "B", "bday": "B",
    "w": "W", "wk": "W", "week": "W", "weeks": "W", "me": "ME", "month": "ME", "months": "ME", "mon": "ME", "q": "QE", "qe": "QE", "quarter": "QE", "quarters": "QE",
    "qs": "QS", "y": "YE", "a": "YE", "ye": "YE", "yr": "YE", "year": "YE", "years": "YE", "ys": "YS", "as": "YS",
}
MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "D": 86_400_000_000, "W": 7 * 86_400_000_000}
MONTHS = {"MS": 1, "ME": 1, "QS": 3, "QE": 3, "YS": 12, "YE": 12}
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def canonicalize_frequency_unit(unit: str) -> str:
    """Standard name of a unit; 'M' is the month end, 'MS' the month start, 'm' the minute."""
    if unit == "M":
        return "ME"
    if unit == "MS":
        return "MS"
    if unit == "m":
        return "min"
    name = ALIASES.get(unit.lower())
    if name is None:
        raise ValueError(f"unknown frequency unit {unit!r}")
    return name


def parse_freq_str(freq: str) -> tuple[int, str, str | None]:
    """(quantity, unit, anchor) of '2W-MON', '15min', '3 days'."""
    m = re.fullmatch(r"\s*(\d+)?\s*([A-Za-z]+)(?:-([A-Za-z]{3}))?\s*", freq)
    if not m:
        raise ValueError(f"can't read frequency {freq!r}")
    return int(m[1] or 1), m[2], m[3].upper() if m[3] else None


@dataclass(frozen=True)
class Freq:
    n: int
    unit: str
    anchor: str | None = None

    @staticmethod
    def of(freq: str | Freq) -> Freq:
        if isinstance(freq, Freq):
            return freq
        try:
            n, unit, anchor = parse_freq_str(freq)
        except ValueError:  # of several parts, such as 1h30min
            months, micros = parse_human_duration(freq)
            if months or micros < 1:
                raise
            unit = next(u for u in ("D", "h", "min", "s", "ms", "us") if micros % MICROS[u] == 0)
            return Freq(micros // MICROS[unit], unit)
        if n < 1:
            raise ValueError("a frequency's quantity is at least 1")
        return Freq(n, canonicalize_frequency_unit(unit), anchor)

    def __str__(self) -> str:
        return f"{self.n if self.n > 1 else ''}{self.unit}" + (f"-{self.anchor}" if self.anchor else "")

    @property
    def calendar(self) -> bool:
        return self.unit in MONTHS

    @property
    def micros(self) -> int:
        return self.n * MICROS[self.unit]

    @property
    def months(self) -> int:
        return self.n * MONTHS[self.unit]

    def label(self, date: Column, origin: Column | None = None) -> Column:
        """Label of the bin that holds ``date``: the bin's start, but its last day for W, ME, QE and YE. ``origin`` is the first date of the
        series; multiples are counted from its bin."""
        t = date.cast("timestamp")
        day = F.to_date(t)
        if self.unit == "B":
            return F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0))).cast("timestamp")
        if self.unit == "W":
            end = F.next_day(F.date_sub(day, 1), self.anchor or "SUN")
            if self.n > 1 and origin is not None:
                first = F.next_day(F.date_sub(F.to_date(origin.cast("timestamp")), 1), self.anchor or "SUN")
                step = 7 * self.n
                end = F.date_add(first, (F.ceil(F.datediff(end, first) / step) * step).cast("int"))
            return end.cast("timestamp")
        if self.calendar:
            m = F.year(day) * 12 + F.month(day) - 1
            unit = MONTHS[self.unit]
            slot = F.floor(m / unit)
            if self.n > 1 and origin is not None:
                first = F.floor((F.year(origin) * 12 + F.month(origin) - 1) / unit)
                rounder = F.ceil if self.unit.endswith("E") else F.floor
                slot = first + rounder((slot - first) / self.n) * self.n
            start = slot * unit
            begin = F.make_date(F.floor(start / 12).cast("int"), (start % 12 + 1).cast("int"), F.lit(1))
            return (begin if self.unit.endswith("S") else F.last_day(F.add_months(begin, unit - 1))).cast("timestamp")
        micros = F.unix_micros(t)
        base = F.lit(0)
        if 86_400_000_000 % self.micros and origin is not None:
            base = F.unix_micros(F.date_trunc("day", origin.cast("timestamp")))
        return F.timestamp_micros((F.floor((micros - base) / self.micros) * self.micros + base).cast("bigint"))

    def floor(self, date: Column) -> Column:
        """Start of the period that holds ``date``; weeks start on Monday, multiples of months, quarters and years count within the year or from
        year 0, other multiples from 1970-01-01."""
        t = date.cast("timestamp")
        if self.unit == "W" and self.n == 1:
            return F.date_trunc("week", t)
        if self.calendar:
            day = F.to_date(t)
            months = self.months
            if months <= 12 and 12 % months == 0:
                return F.make_date(F.year(day), (F.floor((F.month(day) - 1) / months) * months + 1).cast("int"), F.lit(1)).cast("timestamp")
            m = F.floor((F.year(day) * 12 + F.month(day) - 1) / months) * months
            return F.make_date(F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"), F.lit(1)).cast("timestamp")
        if self.unit == "B":
            return self.label(date)
        return F.timestamp_micros((F.floor(F.unix_micros(t) / self.micros) * self.micros).cast("bigint"))

    def plus(self, date: Column, k: Column | int = 1) -> Column:
        """``date`` moved by ``k`` steps (k may be a column); ends of months stay ends of months."""
        k = F.lit(k) if isinstance(k, int) else k
        t = date.cast("timestamp")
        if self.calendar:
            day = F.to_date(t)
            moved = F.add_months(F.trunc(day, "month"), (k * self.months).cast("int"))
            if self.unit.endswith("E"):
                return F.last_day(moved).cast("timestamp")
            return F.date_add(moved, F.least(F.dayofmonth(day) - 1, F.dayofmonth(F.last_day(moved)) - 1)).cast("timestamp") + (t - F.date_trunc("day", t))
        if self.unit == "B":
            # business days: weekends are skipped; a weekend start counts from the Friday before
            day = F.to_date(self.label(t))
            steps = (k * self.n).cast("int")
            w = F.weekday(day) + steps
            return F.date_add(day, (steps + 2 * F.floor(w / 5)).cast("int")).cast("timestamp")
        return F.timestamp_micros((F.unix_micros(t) + k * self.micros).cast("bigint"))

    def anchor_of(self, date: Column) -> Column:
        """The first date from ``date`` on that the frequency itself can hold: ends and starts of periods, given weekdays, business days."""
        t = date.cast("timestamp")
        if self.unit == "W" or (self.calendar and self.unit.endswith("E")):
            return self.label(t)
        if self.calendar:
            start = F.to_date(Freq(1, self.unit).floor(t))
            return F.when(F.to_date(t) == start, t).otherwise(F.add_months(start, MONTHS[self.unit]).cast("timestamp"))
        if self.unit == "B":
            day = F.to_date(t)
            return F.when(F.weekday(day) < 5, t).otherwise(F.date_add(day, 7 - F.weekday(day)).cast("timestamp"))
        return t

    def steps_between(self, first: Column, last: Column) -> Column:
        """Number of whole steps from label ``first`` to label ``last``."""
        if self.calendar:
            months = (F.year(last) * 12 + F.month(last)) - (F.year(first) * 12 + F.month(first))
            return F.floor(months / self.months).cast("bigint")
        if self.unit == "B":
            a, b = F.to_date(first), F.to_date(last)
            monday = lambda d: F.date_sub(d, F.weekday(d))
            return F.floor((F.datediff(monday(b), monday(a)) / 7 * 5 + F.weekday(b) - F.weekday(a)) / self.n).cast("bigint")
        return F.floor((F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / self.micros).cast("bigint")

    def grid(self, first: Column, last: Column) -> Column:
        """Array of the labels from ``first`` to ``last``; empty if last is before first."""
        n = self.steps_between(first, last)
        return F.when(n >= 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(0).cast("bigint"))), lambda k: self.plus(first, k))).otherwise(F.array().cast("array<timestamp>"))


def normalize_frequency_alias(freq: str) -> str:
    """'M' as 'ME', 'H' as 'h', 'T' as 'min' and so on; multiples and anchors stay."""
    return str(Freq.of(freq))


_PART = re.compile(r"(\d+(?:\.\d+)?)?\s*([A-Za-z]+)")
DURATION_MICROS = MICROS | {"ns": 0}


def parse_human_duration(text: str | int | float) -> tuple[int, int]:
    """(months, microseconds) of '3 days', '2 weeks 4 hours', '1 month'; a bare number is seconds. Months and longer take whole quantities."""
    if isinstance(text, (int, float)):
        return 0, round(text * 1_000_000)
    body = text.strip().lower().replace(",", " ").replace(" and ", " ")
    if re.fullmatch(r"-?\d+(\.\d+)?", body):
        return 0, round(float(body) * 1_000_000)
    months, micros, at = 0, 0, 0
    for m in _PART.finditer(body):
        if body[at : m.start()].strip():
            raise ValueError(f"can't read duration {text!r}")
        at = m.end()
        unit = "min" if m[2] == "m" else canonicalize_frequency_unit(m[2])
        q = float(m[1] or 1)
        if unit in MONTHS:
            if q != int(q):
                raise ValueError("months and longer take whole quantities")
            months += int(q) * MONTHS[unit]
        else:
            micros += round(q * DURATION_MICROS.get(unit, MICROS["D"]))
    if at == 0 or body[at:].strip():
        raise ValueError(f"can't read duration {text!r}")
    return months, micros


def add_duration(date: Column, duration: str | int | float) -> Column:
    months, micros = parse_human_duration(duration)
    t = date.cast("timestamp")
    if months:
        t = t + F.make_ym_interval(F.lit(0), F.lit(months))
    return F.timestamp_micros((F.unix_micros(t) + F.lit(micros)).cast("bigint"))
