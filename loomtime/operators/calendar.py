"""Calendar and holiday features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtime.functions.dates import holiday_table, week_of_month
from loomtime.functions.select import Panel, check_date, unpack


def signature(d: Column) -> dict[str, Column]:
    """The 29 calendar features of a date by suffix."""
    t = d.cast("timestamp")
    day = F.to_date(t)
    same = lambda a: (day == a).cast("int")
    quarter_start = F.to_date(F.date_trunc("quarter", t))
    q_end = F.last_day(F.add_months(quarter_start, 2))
    y = F.year(day)
    return {
        "index_num": F.unix_seconds(t), "year": y, "year_iso": F.extract(F.lit("YEAROFWEEK"), t).cast("int"),
        "yearstart": same(F.trunc(day, "year")), "yearend": same(F.make_date(y, F.lit(12), F.lit(31))),
        "leapyear": (((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)).cast("int"), "half": F.when(F.quarter(day) <= 2, 1).otherwise(2),
        "quarter": F.quarter(day), "quarteryear": F.concat(y.cast("string"), F.lit("Q"), F.quarter(day).cast("string")),
        "quarterstart": same(quarter_start), "quarterend": same(q_end), "month": F.month(day), "month_lbl": F.date_format(t, "MMMM"),
        "monthstart": same(F.trunc(day, "month")), "monthend": same(F.last_day(day)), "yweek": F.weekofyear(day), "mweek": week_of_month(day),
        "wday": F.weekday(day) + 1, "wday_lbl": F.date_format(t, "EEEE"), "mday": F.dayofmonth(day), "qday": F.datediff(day, quarter_start) + 1,
        "yday": F.dayofyear(day), "weekend": (F.weekday(day) > 5).cast("int"), "hour": F.hour(t), "minute": F.minute(t), "second": F.second(t),
        "msecond": (F.unix_micros(t) % 1_000_000).cast("int"), "nsecond": F.when(t.isNotNull(), 0), "am_pm": F.when(F.hour(t) <= 12, "am").when(t.isNotNull(), "pm"),
    }


def augment_timeseries_signature(data: DataFrame | Panel, date_column: str) -> DataFrame:
    """``data`` with 29 columns date_suffix. Null dates have null features; 'weekend' is Sunday alone and 'am' lasts through hour 12, both as long
    agreed for these features."""
    df, _ = unpack(data)
    check_date(df, date_column)
    return df.withColumns({f"{date_column}_{k}": c for k, c in signature(F.col(date_column)).items()})


def get_timeseries_signature(data: DataFrame, date_column: str) -> DataFrame:
    """The dates with their 29 features alone."""
    return augment_timeseries_signature(data.select(date_column), date_column)


def augment_holiday_signature(data: DataFrame | Panel, date_column: str, country_name: str = "UnitedStates", calendar: DataFrame | None = None) -> DataFrame:
    """``data`` with is_holiday, before_holiday (the next day is one), after_holiday and holiday_name ('' on other days).

    ``calendar`` (holiday_date, holiday_name) takes the place of a country's rules; several names of a day are put together. Only holidays within the table's own first and last day count, so the edges' neighbours outside read 0. Null dates read 0. A country's
    calendar is a table of a few thousand fixed rows, so it is sent to the executors; one given is joined as its size allows.
    """
    df, _ = unpack(data)
    check_date(df, date_column)
    spark = df.sparkSession
    day = F.to_date(date_column)
    span = df.agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    if calendar is None:
        cal, sent = holiday_table(spark, country_name), F.broadcast
    else:
        days = calendar.where("holiday_date IS NOT NULL").groupBy(F.to_date("holiday_date").alias("holiday_date"))
        cal, sent = days.agg(F.array_join(F.array_sort(F.collect_set("holiday_name")), ", ").alias("holiday_name")), lambda x: x
    if span["a"] is not None:
        cal = cal.where(F.col("holiday_date").between(F.lit(span["a"]), F.lit(span["b"])))
    out = df
    for name, shift in (("is_holiday", 0), ("before_holiday", 1), ("after_holiday", -1)):
        mark = cal.select(F.date_sub("holiday_date", shift).alias(f"__d{shift}"), F.lit(1).alias(name), *([F.col("holiday_name")] if shift == 0 else []))
        out = out.join(sent(mark), day == F.col(f"__d{shift}"), "left").drop(f"__d{shift}")
    return out.select(*df.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in ("is_holiday", "before_holiday", "after_holiday")], F.coalesce("holiday_name", F.lit("")).alias("holiday_name"))


def get_holiday_signature(data: DataFrame, date_column: str, country_name: str = "UnitedStates", calendar: DataFrame | None = None) -> DataFrame:
    return augment_holiday_signature(data.select(date_column), date_column, country_name, calendar)
