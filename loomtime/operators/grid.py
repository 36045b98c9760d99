"""Padding to a regular grid, future dates and date sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtime.functions.dates import is_holiday
from loomtime.functions.freq import Freq, add_duration
from loomtime.functions.select import Panel, check_date, unpack
from loomtime.runtime import free_name


def _bound(given, base: Column) -> Column:
    """A date, or a duration from the first date on."""
    if given is None:
        return base
    if isinstance(given, str):
        try:
            return add_duration(base, given)
        except ValueError:
            return F.lit(given).cast("timestamp")
    return F.lit(given).cast("timestamp")


def pad_by_time(data: DataFrame | Panel, date_column: str, freq: str = "D", start_date=None, end_date=None, fillna=None, by: Sequence[str] = ()) -> DataFrame:
    """Each series on the full grid of ``freq`` between the first and last date of the whole table (or the dates given; a duration counts from the first date).

    Rows off the grid are left out, repeated rows on it stay. ``fillna`` fills every other column of added rows and of nulls; without it,
    columns with one value in a series (null counts as a value) are filled forward. Rows without date or with a null key are left out; an empty
    table gives no rows. The grid is made on the executors from one row of bounds.
    """
    df, keys = unpack(data, by)
    check_date(df, date_column)
    f = Freq.of(freq)
    given = F.col(date_column).isNotNull()
    for k in keys:
        given &= F.col(k).isNotNull()
    rows = df.where(given).withColumn(date_column, F.col(date_column).cast("timestamp"))
    bounds = rows.agg(F.min(date_column).alias("a"), F.max(date_column).alias("b"))
    first = bounds.select(_bound(start_date, F.col("a")).alias("lo"), (_bound(end_date, F.col("a")) if end_date is not None else F.col("b")).alias("hi")).first()
    if first["lo"] is None or first["hi"] is None:
        return rows.limit(0)
    if first["lo"] > first["hi"]:
        raise ValueError("start_date lies after end_date")
    lo, hi = F.lit(first["lo"]).cast("timestamp"), F.lit(first["hi"]).cast("timestamp")
    start = F.when(f.label(lo) < lo, f.plus(f.label(lo), 1)).otherwise(f.label(lo)) if f.calendar or f.unit in ("W", "B") else lo
    keyed = rows.select(*keys).distinct() if keys else df.sparkSession.range(1).drop("id")
    grid = keyed.select(*keys, F.explode(f.grid(start, hi)).alias(date_column))
    full = grid.join(rows, [*keys, date_column], "left")
    others = [c for c in rows.columns if c not in keys and c != date_column]
    if fillna is not None:
        full = full.withColumns({c: F.coalesce(F.col(c), F.lit(fillna).cast(rows.schema[c].dataType)) for c in others})
    elif keys and others:
        constant = rows.groupBy(*keys).agg(*[(F.min(c).eqNullSafe(F.max(c)) & (F.count(c) == F.count(F.lit(1)))).alias(f"__{c}") for c in others])
        full = full.join(constant, keys, "left")
        w = Window.partitionBy(*keys).orderBy(date_column).rowsBetween(Window.unboundedPreceding, 0)
        full = full.withColumns({c: F.when(F.col(f"__{c}"), F.coalesce(c, F.last(c, True).over(w))).otherwise(F.col(c)) for c in others})
    return full.select(*rows.columns)


def future_frame(data: DataFrame | Panel, date_column: str, length_out: int | str, freq: str | None = None, force_regular: bool = False,
                 bind_data: bool = True, by: Sequence[str] = (), skip_partial: bool = True) -> DataFrame:
    """Each series with the next ``length_out`` dates after its last one (or the dates alone); the other columns are null there.

    A last date inside a period counts as that period's date (the month's end, the next month's start, the coming weekday) unless ``skip_partial`` is off;
    then that date is the first of the future.

    ``length_out`` is a number of rows, or a duration such as '3 months'. Without ``freq`` it is inferred from the whole table's dates. A series
    without dates has no future; null keys form a series of their own.
    """
    from loomtime.operators.frequency import get_frequency

    df, keys = unpack(data, by)
    check_date(df, date_column)
    if freq is None:
        freq = get_frequency(group_first(df, keys, date_column), date_column, force_regular=force_regular)
    f = Freq.of(freq)
    last = df.groupBy(*keys).agg(F.max(F.col(date_column).cast("timestamp")).alias("__last")).where("__last IS NOT NULL")
    anchor = f.anchor_of(F.col("__last"))
    first = F.when((anchor > F.col("__last")) & F.lit(not skip_partial), anchor).otherwise(f.plus(anchor, 1))
    if isinstance(length_out, str):
        ahead = f.grid(first, add_duration(F.col("__last"), length_out))
    else:
        if length_out < 1:
            raise ValueError("length_out is at least 1")
        ahead = F.transform(F.sequence(F.lit(0), F.lit(int(length_out) - 1)), lambda k: f.plus(first, k))
    future = last.select(*keys, F.explode(ahead).alias(date_column)).withColumn(date_column, F.col(date_column).cast(df.schema[date_column].dataType))
    return df.unionByName(future, allowMissingColumns=True) if bind_data else future


def group_first(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Dates of the first series only (in order of its keys), from which a frequency is inferred."""
    if not keys:
        return df.select(date)
    first = df.select(*keys).distinct().orderBy(*keys).limit(1)
    same = None
    marked = first.select(*[F.col(k).alias(f"__{k}") for k in keys])
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = test if same is None else same & test
    return df.join(F.broadcast(marked), same, "left_semi").select(date)  # one row is sent


def make_future_timeseries(spark: SparkSession, idx, length_out: int | str, freq: str | None = None, force_regular: bool = False) -> DataFrame:
    """(date): the dates after the last one of a list of dates, or of a one-column frame."""
    dates = [idx] if isinstance(idx, str) else idx
    df = idx if isinstance(idx, DataFrame) else spark.createDataFrame([(str(d),) for d in dates], "date string").select(F.col("date").cast("timestamp").alias("date"))
    return future_frame(df, df.columns[0], length_out, freq, force_regular, bind_data=False)


def _days(spark: SparkSession, start: str, end: str) -> DataFrame:
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return spark.range(1).select(F.explode(F.when(F.lit(start).cast("date") <= F.lit(end).cast("date"), days)).alias("date"))


def make_weekday_sequence(spark: SparkSession, start_date: str, end_date: str, sunday_to_thursday: bool = False, remove_holidays: bool = False, country: str = "UnitedStates") -> DataFrame:
    """(date): the working days between two dates."""
    d = F.weekday("date")
    keep = d.isin(6, 0, 1, 2, 3) if sunday_to_thursday else d < 5
    return _days(spark, start_date, end_date).where(keep & (~is_holiday("date", country) if remove_holidays else F.lit(True)))


def make_weekend_sequence(spark: SparkSession, start_date: str, end_date: str, friday_saturday: bool = False, remove_holidays: bool = False, country: str = "UnitedStates") -> DataFrame:
    """(date): the weekend days between two dates."""
    d = F.weekday("date")
    keep = d.isin(4, 5) if friday_saturday else d >= 5
    return _days(spark, start_date, end_date).where(keep & (~is_holiday("date", country) if remove_holidays else F.lit(True)))
