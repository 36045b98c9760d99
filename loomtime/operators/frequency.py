"""Cadence of series: summaries of dates and steps, inferred frequencies, seasonal and trend periods."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtime.functions.freq import Freq
from loomtime.functions.select import Panel, check_date, unpack

# Seconds of time units (usual, least, most), and the seasonal and trend period that go with a median step's unit
UNITS = (("sec", 0, 0, 0), ("min", 60, 60, 60), ("hour", 3600, 3600, 3600), ("day", 86400, 86400, 86400), ("week", 604800, 604800, 604800),
         ("month", 2678400, 2419200, 2678400), ("quarter", 7948800, 7776000, 7948800), ("year", 31622400, 31536000, 31622400))
TEMPLATE = {"S": ("1H", "12H"), "T": ("1D", "14D"), "H": ("1D", "1M"), "D": ("1W", "1Q"), "W": ("1Q", "1Y"), "M": ("1Y", "5Y"), "Q": ("1Y", "10Y"), "Y": ("5Y", "30Y")}
REGULAR = {"A-DEC": "Y", "Q-DEC": "Q", "W-SUN": "W", "B": "D", "BM": "M", "BME": "M", "BQ": "Q", "BQE": "Q", "BA": "A", "BYE": "Y", "BY": "Y", "BMS": "MS", "BQS": "QS", "BYS": "YS", "BAS": "AS"}
_S = {u: (usual, least) for u, usual, least, _ in UNITS}


def timeseries_unit_frequency_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(UNITS), "unit string, freq int, freq_min int, freq_max int")


def time_scale_template(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in TEMPLATE.items()], "median_unit string, seasonal_period string, trend_period string")


def unit_and_scale(seconds: Column) -> tuple[Column, Column]:
    """(unit, scale) of a median step as expressions."""
    unit = (F.when(seconds < _S["min"][0], "S").when(seconds < _S["hour"][0], "T").when(seconds < _S["day"][0], "H").when(seconds < _S["week"][0], "D")
            .when(seconds < _S["month"][1], "W").when(seconds < _S["quarter"][1], "M").when(seconds < _S["year"][1], "Q").when(seconds.isNotNull(), "Y"))
    rounded = lambda u: F.bround(seconds / _S[u][0], 1)
    scale = (F.when(unit == "S", seconds).when(unit == "T", seconds / 60).when(unit == "H", seconds / 3600).when(unit == "D", seconds / 86400)
             .when(unit == "W", seconds / 604800).when(unit == "M", rounded("month")).when(unit == "Q", rounded("quarter")).otherwise(rounded("year")))
    part = scale - F.floor(scale)
    to_days = unit.isin("M", "Q", "Y") & (part >= 0.1) & (part <= 0.9)
    return F.when(to_days, "D").otherwise(unit), F.when(to_days, F.floor(seconds / 86400).cast("double")).otherwise(scale.cast("double"))


def _steps(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    rows = df.where(F.col(date).isNotNull()).select(*keys, (F.unix_micros(F.col(date).cast("timestamp")) / 1e6).alias("__s"), F.col(date).cast("timestamp").alias("__d"))
    return rows.withColumn("__step", F.col("__s") - F.lag("__s").over(Window.partitionBy(*keys).orderBy("__s")))


def _diff_columns() -> list[Column]:
    q = F.percentile("__step", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    at = lambda i: q.getItem(i)
    return [at(0).alias("diff_min_seconds"), at(1).alias("diff_q25_seconds"), at(2).alias("diff_median_seconds"), F.avg("__step").alias("diff_mean_seconds"),
            at(3).alias("diff_q75_seconds"), at(4).alias("diff_max_seconds")]


def get_date_summary(data: DataFrame | Panel, date_column: str, by: Sequence[str] = ()) -> DataFrame:
    """date_n, date_tz, date_start and date_end of each series."""
    df, keys = unpack(data, by)
    check_date(df, date_column)
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    return df.groupBy(*keys).agg(F.count(date_column).alias("date_n"), F.lit(zone).alias("date_tz"), F.min(date_column).alias("date_start"), F.max(date_column).alias("date_end"))


def get_diff_summary(data: DataFrame | Panel, date_column: str, by: Sequence[str] = (), numeric: bool = True) -> DataFrame:
    """Least, quartiles, mean and greatest of the steps between dates, in seconds, or as intervals."""
    df, keys = unpack(data, by)
    check_date(df, date_column)
    out = _steps(df, keys, date_column).groupBy(*keys).agg(*_diff_columns())
    return out if numeric else _intervals(out).drop(*[c for c in out.columns if c.endswith("_seconds")])


def _intervals(df: DataFrame) -> DataFrame:
    return df.withColumns({c.removesuffix("_seconds"): F.make_dt_interval(secs=F.col(c).cast("decimal(18,6)")) for c in df.columns if c.startswith("diff_")})


def ts_summary(data: DataFrame | Panel, date_column: str, by: Sequence[str] = (), inferred: bool = True) -> DataFrame:
    """One row a series: count, zone, start and end of its dates, the median step with unit and scale, and the steps' summary in seconds and as intervals.

    ``freq_inferred_unit`` (unless ``inferred`` is off) comes from the series' first ten dates. Null dates are left out; a series of one date has null steps.
    """
    df, keys = unpack(data, by)
    check_date(df, date_column)
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    staged = _steps(df, keys, date_column).withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy("__s")))
    out = staged.groupBy(*keys).agg(F.count("__d").alias("date_n"), F.lit(zone).alias("date_tz"), F.min("__d").alias("date_start"), F.max("__d").alias("date_end"),
                                    *_diff_columns(), F.sort_array(F.collect_list(F.when(F.col("__row") <= 10, F.col("__s")))).alias("__ten"))
    unit, scale = unit_and_scale(F.col("diff_median_seconds"))
    out = out.withColumns({"freq_median_seconds": F.col("diff_median_seconds"), "freq_median_scale": scale, "freq_median_unit": unit})
    if inferred:
        @F.pandas_udf("string")
        def infer(first: pd.Series) -> pd.Series:
            return first.map(lambda s: infer_frequency(pd.to_datetime(np.asarray(s, float), unit="s")))

        out = out.withColumn("freq_inferred_unit", infer("__ten"))
    return _intervals(out.drop("__ten"))


def infer_frequency(dates: pd.DatetimeIndex, force_regular: bool = False) -> str | None:
    """Frequency name of a few dates if they are regular."""
    if len(dates) < 3:
        return None
    try:
        found = pd.infer_freq(dates.round("us"))
    except ValueError:
        return None
    return REGULAR.get(found, found) if force_regular and found else found


def _first_dates(df: DataFrame, date: str, n: int) -> pd.DatetimeIndex:
    return pd.DatetimeIndex([r[0] for r in df.where(F.col(date).isNotNull()).select(F.col(date).cast("timestamp").alias("d")).orderBy("d").limit(n).collect()])


def get_frequency_summary(data: DataFrame, date_column: str, force_regular: bool = False) -> dict:
    """Inferred unit, median step in seconds, its scale and unit, of the dates of a table."""
    check_date(data, date_column)
    row = _steps(data, [], date_column).agg(F.percentile("__step", 0.5).alias("m"))
    unit, scale = unit_and_scale(F.col("m"))
    r = row.select("m", unit.alias("u"), scale.alias("s")).first()
    return {"freq_inferred_unit": infer_frequency(_first_dates(data, date_column, 10), force_regular), "freq_median_seconds": r["m"], "freq_median_scale": r["s"], "freq_median_unit": r["u"]}


def get_frequency(data: DataFrame, date_column: str, force_regular: bool = False, numeric: bool = False):
    """The inferred frequency's name, else one made of the median step ('31D', '1MS' if the first date is a month's first); numeric: the scale."""
    s = get_frequency_summary(data, date_column, force_regular)
    if numeric:
        return s["freq_median_scale"]
    if s["freq_inferred_unit"]:
        return s["freq_inferred_unit"]
    if s["freq_median_unit"] is None:
        raise ValueError("too few dates for a frequency")
    start = "S" if s["freq_median_unit"] in ("M", "Q", "Y") and _first_dates(data, date_column, 1)[0].day == 1 else ""
    return f"{int(s['freq_median_scale'])}{s['freq_median_unit']}{start}"


def _period(data, date_column, force_regular, numeric, which: int):
    s = get_frequency_summary(data, date_column, force_regular)
    unit, scale = s["freq_median_unit"], s["freq_median_scale"]
    if unit is None:
        raise ValueError("too few dates for a period")
    if unit == "D" and scale > 1:
        unit = "Y" if scale > 360 else "Q" if scale > 31 else "M"
    period = TEMPLATE[unit][which]
    if not numeric:
        return period
    slots = data.where(F.col(date_column).isNotNull()).groupBy(Freq.of(period).floor(F.col(date_column)).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return slots.agg(F.percentile("n", 0.5)).first()[0]


def get_seasonal_frequency(data: DataFrame, date_column: str, force_regular: bool = False, numeric: bool = False):
    """Usual seasonal period for the dates' median step, or (numeric) the median number of rows in one."""
    return _period(data, date_column, force_regular, numeric, 0)


def get_trend_frequency(data: DataFrame, date_column: str, force_regular: bool = False, numeric: bool = False):
    """Usual trend period for the dates' median step, or (numeric) the median number of rows in one."""
    return _period(data, date_column, force_regular, numeric, 1)


def local_period(dates: pd.Series, which: int) -> float:
    """Median number of rows in the seasonal (0) or trend (1) period of one series' dates."""
    d = pd.DatetimeIndex(dates.dropna()).sort_values()
    if len(d) < 2:
        return 1.0
    sec = float(np.median(np.diff(d.values).astype("timedelta64[us]").astype(float))) / 1e6
    edges = [("S", 60), ("T", 3600), ("H", 86400), ("D", 604800), ("W", 2419200), ("M", 7776000), ("Q", 31536000)]
    unit = next((u for u, top in edges if sec < top), "Y")
    scale = {"D": sec / 86400, "M": round(sec / 2678400, 1), "Q": round(sec / 7948800, 1), "Y": round(sec / 31622400, 1)}.get(unit, 1)
    if unit in "MQY" and 0.1 <= scale - int(scale) <= 0.9:
        unit, scale = "D", sec // 86400
    if unit == "D" and scale > 1:
        unit = "Y" if scale > 360 else "Q" if scale > 31 else "M"
    f = Freq.of(TEMPLATE[unit][which])
    if f.calendar:
        slot = (d.year * 12 + d.month - 1) // f.months
    elif f.unit == "W":
        slot = (d.values.astype("datetime64[D]").astype(np.int64) + 3) // (7 * f.n)
    else:
        slot = d.values.astype("datetime64[us]").astype(np.int64) // f.micros
    return float(np.median(np.unique(slot, return_counts=True)[1]))
