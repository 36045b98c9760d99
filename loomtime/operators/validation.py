"""Time-based cross-validation: splits as a small table, rows marked by expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtime.functions.select import check_date

# Words for units of the sizes
_UNITS = {"days": "days", "day": "days", "D": "days", "hours": "hours", "hour": "hours", "h": "hours", "minutes": "minutes", "minute": "minutes", "seconds": "seconds",
          "second": "seconds", "weeks": "weeks", "week": "weeks", "W": "weeks", "months": "months", "month": "months", "years": "years", "year": "years"}


@dataclass
class TimeSeriesCV:
    """Splits of ``train_size`` and ``forecast_horizon`` units with ``gap`` between, moved on by ``stride`` (0: the horizon).

    'rolling' windows keep their length, 'expanding' ones start at the first date. 'forward' counts from the first date on, 'backward' from the
    unit after the last one back. Spans hold their start and not their end.
    """

    frequency: str = "days"
    train_size: int = 30
    forecast_horizon: int = 7
    gap: int = 0
    stride: int = 0
    window: str = "rolling"
    mode: str = "backward"
    split_limit: int | None = None
    _step: pd.DateOffset = field(init=False, repr=False)

    def __post_init__(self) -> None:
        if self.frequency not in _UNITS:
            raise ValueError(f"unknown frequency {self.frequency!r}")
        if self.train_size < 1 or self.forecast_horizon < 1 or self.gap < 0 or self.stride < 0:
            raise ValueError("sizes are positive, gap and stride not negative")
        if self.window not in ("rolling", "expanding") or self.mode not in ("backward", "forward"):
            raise ValueError("window is 'rolling' or 'expanding', mode 'backward' or 'forward'")

    def _units(self, k: int) -> pd.DateOffset:
        return pd.DateOffset(**{_UNITS[self.frequency]: k})

    def spans(self, start, end) -> list[tuple]:
        """(train_start, train_end, forecast_start, forecast_end) of each split between two dates."""
        start, end = pd.Timestamp(start), pd.Timestamp(end) + self._units(1)
        stride = self.stride or self.forecast_horizon
        out = []
        k = 0
        while self.split_limit is None or k < self.split_limit:
            if self.mode == "forward":
                train_start = start + self._units(stride * k)
                train_end = train_start + self._units(self.train_size)
                fc_start = train_end + self._units(self.gap)
                fc_end = fc_start + self._units(self.forecast_horizon)
            else:
                fc_end = end - self._units(stride * k)
                fc_start = fc_end - self._units(self.forecast_horizon)
                train_end = fc_start - self._units(self.gap)
                train_start = train_end - self._units(self.train_size)
            if train_start < start or fc_end > end:
                break
            out.append((start if self.window == "expanding" else train_start, train_end, fc_start, fc_end))
            k += 1
        return out

    def _bounds(self, data: DataFrame, date_column: str, start_dt, end_dt) -> list[tuple]:
        check_date(data, date_column)
        r = data.agg(F.min(F.col(date_column).cast("timestamp")).alias("a"), F.max(F.col(date_column).cast("timestamp")).alias("b")).first()
        a, b = start_dt or r["a"], end_dt or r["b"]
        return [] if a is None or b is None else self.spans(a, b)

    def splits(self, data: DataFrame, date_column: str, start_dt=None, end_dt=None) -> DataFrame:
        """(split, train_start, train_end, forecast_start, forecast_end), numbered from 1; an empty table has no splits."""
        return self._table(data.sparkSession, self._bounds(data, date_column, start_dt, end_dt))

    @staticmethod
    def _table(spark: SparkSession, spans: list[tuple]) -> DataFrame:
        rows = [(i + 1, *[t.to_pydatetime() for t in s]) for i, s in enumerate(spans)]
        return spark.createDataFrame(rows, "split int, train_start timestamp, train_end timestamp, forecast_start timestamp, forecast_end timestamp")

    def split(self, data: DataFrame, date_column: str, start_dt=None, end_dt=None) -> Iterator[tuple[DataFrame, DataFrame]]:
        """(train, forecast) frames of each split, as filters."""
        d = F.col(date_column)
        for a, b, c, e in self._bounds(data, date_column, start_dt, end_dt):
            yield (data.where((d >= F.lit(a.to_pydatetime())) & (d < F.lit(b.to_pydatetime()))), data.where((d >= F.lit(c.to_pydatetime())) & (d < F.lit(e.to_pydatetime()))))

    def mark(self, data: DataFrame, date_column: str, start_dt=None, end_dt=None) -> DataFrame:
        """Each row once for each split it is in, with ``split`` and ``role`` ('train' or 'forecast'); no join, one pass."""
        d = F.col(date_column).cast("timestamp")
        tags = []
        for i, (a, b, c, e) in enumerate(self._bounds(data, date_column, start_dt, end_dt)):
            for role, lo, hi in (("train", a, b), ("forecast", c, e)):
                tags.append(F.when((d >= F.lit(lo.to_pydatetime())) & (d < F.lit(hi.to_pydatetime())), F.struct(F.lit(i + 1).alias("split"), F.lit(role).alias("role"))))
        if not tags:
            return data.limit(0).select("*", F.lit(0).alias("split"), F.lit("").alias("role"))
        return data.select("*", F.inline(F.array_compact(F.array(*tags))))

    def glimpse(self, data: DataFrame, date_column: str) -> str:
        rows = [f"Split {i + 1}: train {a} to {b}, forecast {c} to {e}" for i, (a, b, c, e) in enumerate(self._bounds(data, date_column, None, None))]
        print("\n".join(rows))
        return "\n".join(rows)

    def plot_data(self, data: DataFrame, date_column: str, value_column: str) -> DataFrame:
        return self.mark(data.select(date_column, value_column), date_column)


def TimeSeriesCVSplitter(data: DataFrame, date_column: str, **settings) -> DataFrame:  # noqa: N802
    """The splits of a table as a table; positions of rows mean nothing here."""
    return TimeSeriesCV(**settings).splits(data, date_column)
