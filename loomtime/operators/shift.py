"""Lags, leads, differences and percent changes."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtime.functions.freq import add_duration
from loomtime.functions.select import Panel, check_date, check_values, resolve_column_selection, unpack
from loomtime.operators.series import series_map


def order_window(keys: Sequence[str], date: str, tie: str | Sequence[str] | None = None):
    """Window of a series in order of its dates; ``tie`` orders rows of one date."""
    extra = [tie] if isinstance(tie, str) else list(tie or ())
    return Window.partitionBy(*keys).orderBy(date, *extra)


def steps_of(spec) -> list[int]:
    """A number, a pair (from, to) both included, or a list of positive numbers."""
    if isinstance(spec, bool):
        raise TypeError("a number of rows, not a truth value")
    if isinstance(spec, int):
        out = [spec]
    elif isinstance(spec, tuple) and len(spec) == 2:
        out = list(range(spec[0], spec[1] + 1))
    else:
        out = [int(x) for x in spec]
    if not out or min(out) < 1:
        raise ValueError("numbers of rows are positive")
    return out


def resolve_lag_sequence(data: DataFrame, date_column: str, lags, clamp: bool = True) -> list[int]:
    """Lags 0..n of a number, a pair or list as it is, or a phrase ('30 days': as many rows as lie within it from the first date on)."""
    n = data.agg(F.count(date_column).alias("n"), F.min(date_column).alias("a")).first()
    if isinstance(lags, str):
        end = F.lit(n["a"]).cast("timestamp")
        upto = data.where(F.col(date_column) <= add_duration(end, lags)).count() - 1
        out = list(range(0, max(upto, 0) + 1))
    elif isinstance(lags, int):
        out = list(range(0, lags + 1))
    elif isinstance(lags, tuple):
        out = list(range(lags[0], lags[1] + 1))
    else:
        out = sorted(set(int(x) for x in lags))
    return [x for x in out if x <= max(n["n"] - 1, 0)] if clamp else out


def _shift(data, date_column, value_column, spec, by, tie, make) -> DataFrame:
    df, keys = unpack(data, by)
    check_date(df, date_column)
    values = resolve_column_selection(df, value_column)
    w = order_window(keys, date_column, tie)
    return df.withColumns({name: c for v in values for k in steps_of(spec) for name, c in make(v, k, w)})


def _hot_shift(data, date_column, value_column, spec, by, order_by, name: str, sign: int) -> DataFrame:
    df, keys = unpack(data, by)
    check_date(df, date_column)
    values = resolve_column_selection(df, value_column)
    check_values(df, values)
    steps = steps_of(spec)
    names = {(v, k): f"{v}_{name}_{k}" for v in values for k in steps}

    def kernel(body: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({n: body.groupby("__s", sort=False)[v].shift(sign * k) for (v, k), n in names.items()})

    ties = [order_by] if isinstance(order_by, str) else list(order_by or ())
    back, ahead = (max(steps), 0) if sign > 0 else (0, max(steps))
    return series_map(df, keys, [date_column, *ties], values, [(n, "double") for n in names.values()], kernel, back, ahead=ahead)


def augment_lags(data: DataFrame | Panel, date_column: str, value_column, lags=1, by: Sequence[str] = (), order_by=None, hot: bool = False) -> DataFrame:
    """value_lag_k for each k: the value k rows before in the series (null where there is none). ``hot`` cuts a series too long for one task's sort over the
    cluster (numbers only, as doubles)."""
    if hot:
        return _hot_shift(data, date_column, value_column, lags, by, order_by, "lag", 1)
    return _shift(data, date_column, value_column, lags, by, order_by, lambda v, k, w: [(f"{v}_lag_{k}", F.lag(v, k).over(w))])


def augment_leads(data: DataFrame | Panel, date_column: str, value_column, leads=1, by: Sequence[str] = (), order_by=None, hot: bool = False) -> DataFrame:
    """value_lead_k for each k: the value k rows after in the series (null where there is none). ``hot`` as for lags."""
    if hot:
        return _hot_shift(data, date_column, value_column, leads, by, order_by, "lead", -1)
    return _shift(data, date_column, value_column, leads, by, order_by, lambda v, k, w: [(f"{v}_lead_{k}", F.lead(v, k).over(w))])


def _change(now: Column, before: Column) -> Column:
    return F.try_divide(now.cast("double"), before.cast("double")) - 1


def augment_diffs(data: DataFrame | Panel, date_column: str, value_column, periods=1, normalize: bool = False, by: Sequence[str] = (), order_by=None) -> DataFrame:
    """value_diff_k, the change over k rows; normalised as value_pctdiff_k, the change relative to the earlier value with gaps filled
    forward first (null where that value is 0)."""
    if not normalize:
        return _shift(data, date_column, value_column, periods, by, order_by, lambda v, k, w: [(f"{v}_diff_{k}", F.col(v) - F.lag(v, k).over(w))])
    df, keys = unpack(data, by)
    check_date(df, date_column)
    values = resolve_column_selection(df, value_column)
    w = order_window(keys, date_column, order_by)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    filled = df.withColumns({f"__ff_{v}": F.last(v, True).over(upto) for v in values})
    out = filled.withColumns({f"{v}_pctdiff_{k}": _change(F.col(f"__ff_{v}"), F.lag(f"__ff_{v}", k).over(w)) for v in values for k in steps_of(periods)})
    return out.drop(*[f"__ff_{v}" for v in values])


def augment_pct_change(data: DataFrame | Panel, date_column: str, value_column, periods=1, by: Sequence[str] = (), order_by=None) -> DataFrame:
    """value_pctdiff_k; see ``augment_diffs``."""
    return augment_diffs(data, date_column, value_column, periods, True, by, order_by)
