"""Rolling, expanding and exponentially weighted features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtime.functions.select import Panel, check_date, resolve_column_selection, unpack
from loomtime.operators.series import memory_of, series_map, whole_series
from loomtime.operators.shift import order_window, steps_of
from loomtime.runtime import numeric


@dataclass(frozen=True)
class Quantile:
    """A configured quantile; interpolation 'linear', 'lower', 'higher', 'nearest' or 'midpoint'."""

    q: float = 0.5
    interpolation: str = "linear"

    @property
    def label(self) -> str:
        return f"quantile_{round(self.q * 100):d}"


def pd_quantile(q: float = 0.5, interpolation: str = "midpoint", **_) -> tuple[str, Quantile]:
    return "quantile", Quantile(q, interpolation)


def pl_quantile(quantile: float = 0.5, interpolation: str = "midpoint", **_) -> tuple[str, Quantile]:
    return "quantile", Quantile(quantile, interpolation)


@dataclass(frozen=True)
class Pair:
    """Correlation ('corr') or sample covariance ('cov') with another column."""

    kind: str
    other: str


def pair(kind: str, other: str) -> tuple[str, Pair]:
    """Function of two columns for a rolling or expanding window: pair('corr', 'high'). The names 'corr' and 'cov' alone are those of a column with itself."""
    if kind not in ("corr", "cov"):
        raise ValueError("a pair's function is 'corr' or 'cov'")
    return f"{kind}_{other}", Pair(kind, other)


def _paired(df: DataFrame, x: Column, p: Pair, w, least: int) -> Column:
    y = numeric(df, p.other)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    value = F.try_divide(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)) if p.kind == "corr" else F.covar_samp(x, y).over(w)
    return _guarded(value, x, w, max(least, 2))


def _quantile(x: Column, w, q: Quantile) -> Column:
    if q.interpolation == "linear":
        return F.percentile(x, q.q).over(w)
    values = F.sort_array(F.collect_list(x).over(w))
    h = (F.size(values) - 1) * F.lit(float(q.q))
    lo, hi = F.floor(h).cast("int"), F.ceil(h).cast("int")
    at = lambda i: F.try_element_at(values, i + 1)
    if q.interpolation == "midpoint":
        return (at(lo) + at(hi)) / 2
    pick = {"lower": lo, "higher": hi, "nearest": F.bround(h).cast("int")}[q.interpolation]
    return at(pick)


def _moments(x: Column, w, name: str) -> Column:
    n = F.count(x).over(w).cast("double")
    if name == "skew":
        g = F.skewness(x).over(w)
        return F.when(n > 2, F.nanvl(g, F.lit(None).cast("double")) * F.sqrt(n * (n - 1)) / (n - 2))
    g = F.kurtosis(x).over(w)
    return F.when(n > 3, ((n + 1) * F.nanvl(g, F.lit(None).cast("double")) + 6) * (n - 1) / ((n - 2) * (n - 3)))


#: windowed aggregates by name
NATIVE: dict[str, Callable[[Column, object], Column]] = {
    "mean": lambda x, w: F.avg(x).over(w), "sum": lambda x, w: F.sum(x).over(w), "std": lambda x, w: F.stddev_samp(x).over(w),
    "var": lambda x, w: F.var_samp(x).over(w), "min": lambda x, w: F.min(x).over(w), "max": lambda x, w: F.max(x).over(w),
    "median": lambda x, w: F.percentile(x, 0.5).over(w), "count": lambda x, w: F.count(x).over(w).cast("double"),
    "quantile": lambda x, w: F.percentile(x, 0.5).over(w), "skew": lambda x, w: _moments(x, w, "skew"), "kurt": lambda x, w: _moments(x, w, "kurt"),
    "sem": lambda x, w: F.try_divide(F.stddev_samp(x).over(w), F.sqrt(F.count(x).over(w) - 1)),
}


def _functions(window_func) -> list[tuple[str, object]]:
    """(label, name | Quantile | callable) of each function asked for."""
    one = isinstance(window_func, (str, tuple)) or callable(window_func)
    out: list[tuple[str, object]] = []
    for f in [window_func] if one else list(window_func):
        if isinstance(f, str):
            out.append(("quantile_50" if f == "quantile" else f, f))
        elif isinstance(f, tuple):
            label, what = f
            out.append((what.label if isinstance(what, Quantile) and label == "quantile" else label, what))
        else:
            out.append((getattr(f, "__name__", "custom"), f))
    return out


def _guarded(value: Column, x: Column, w, least: int) -> Column:
    return F.when(F.count(x).over(w) >= least, value) if least > 0 else value


def _order_statistic(f) -> bool:
    return isinstance(f, Quantile) or (isinstance(f, str) and f in ("median", "quantile"))


def _moving_quantile(windows, f):
    return windows.quantile(f.q, interpolation=f.interpolation) if isinstance(f, Quantile) else windows.median()


def _as_pandas(f):
    """A function for pandas' windows: quantiles as functions of an array."""
    if isinstance(f, Quantile) or f == "quantile":
        q = f if isinstance(f, Quantile) else Quantile()
        return lambda x: np.nanquantile(x, q.q, method=q.interpolation)
    return f


def _pandas_window(name, window: int | None, least: int, center: bool):
    def apply(g: pd.Series):
        r = g.rolling(window, min_periods=least, center=center) if window else g.expanding(min_periods=least)
        if callable(name):
            return r.apply(name, raw=True)
        return getattr(r, name)()

    return apply


def augment_rolling(data: DataFrame | Panel, date_column: str, value_column, window_func="mean", window=2, min_periods: int | None = None,
                    center: bool = False, by: Sequence[str] = (), order_by=None, hot: bool = False) -> DataFrame:
    """value_rolling_function_win_w over the last w rows of the series (centred ones: w // 2 before).

    ``min_periods`` defaults to the first window and stays so for further ones. Null and NaN values don't count. Named functions are window
    expressions; a (name, function over an array) pair runs in Arrow batches with the rows it looks back on. ``hot`` runs named functions so, too:
    a series too long for one task's sort is then cut over the cluster.
    """
    df, keys = unpack(data, by)
    check_date(df, date_column)
    values = resolve_column_selection(df, value_column)
    w0 = order_window(keys, date_column, order_by)
    new, custom = {}, []
    least = min_periods
    for size in steps_of(window):
        least = size if least is None else least
        w = w0.rowsBetween(-(size // 2), size - 1 - size // 2) if center else w0.rowsBetween(-(size - 1), 0)
        for v in values:
            x = numeric(df, v)
            for label, f in _functions(window_func):
                name = f"{v}_rolling_{label}_win_{size}"
                if isinstance(f, Pair):
                    new[name] = _paired(df, x, f, w, least)
                elif hot:
                    custom.append((name, v, _as_pandas(f), size, least))
                elif not center and _order_statistic(f):  # the window expression would count a frame's values anew for each row
                    custom.append((name, v, f, size, least))
                elif isinstance(f, str) and f in NATIVE:
                    new[name] = _guarded(NATIVE[f](x, w), F.lit(1) if f == "count" else x, w, least)
                elif isinstance(f, Quantile):
                    new[name] = _guarded(_quantile(x, w, f), x, w, least)
                else:
                    custom.append((name, v, f, size, least))
    out = df.withColumns(new)
    if custom:
        out = _custom(out, keys, date_column, order_by, custom, center)
    return out


def _custom(df, keys, date, tie, custom, center: bool) -> DataFrame:
    ties = [tie] if isinstance(tie, str) else list(tie or ())
    inputs = list(dict.fromkeys(v for _, v, _, _, _ in custom))
    def kernel(body: pd.DataFrame) -> pd.DataFrame:
        new = {}
        for n, v, f, size, least in custom:
            if _order_statistic(f) and not center:  # sorted windows move on by a row each; series lie one after the other, so rows come back in order
                new[n] = _moving_quantile(body.groupby("__s", sort=False)[v].rolling(size, min_periods=max(least, 0)), f).to_numpy()
            else:
                new[n] = body.groupby("__s", sort=False)[v].transform(_pandas_window(f, size, least, center)).to_numpy()
        return pd.DataFrame(new)

    return series_map(df, keys, [date, *ties], inputs, [(n, "double") for n, *_ in custom], kernel, max(size for *_, size, _ in custom) - 1,
                      ahead=max((size - 1) // 2 for *_, size, _ in custom) if center else 0)


def augment_expanding(data: DataFrame | Panel, date_column: str, value_column, window_func="mean", min_periods: int | None = None, by: Sequence[str] = (), order_by=None) -> DataFrame:
    """value_expanding_function over all rows of the series up to each one; ``min_periods`` defaults to 1."""
    df, keys = unpack(data, by)
    check_date(df, date_column)
    values = resolve_column_selection(df, value_column)
    least = 1 if min_periods is None else min_periods
    w = order_window(keys, date_column, order_by).rowsBetween(Window.unboundedPreceding, 0)
    new, custom = {}, []
    for v in values:
        x = numeric(df, v)
        for label, f in _functions(window_func):
            name = f"{v}_expanding_{label}"
            if isinstance(f, Pair):
                new[name] = _paired(df, x, f, w, least)
            elif isinstance(f, str) and f in NATIVE and not _order_statistic(f):
                new[name] = _guarded(NATIVE[f](x, w), x, w, least)
            else:
                custom.append((name, v, f))
    out = df.withColumns(new)
    if custom:
        ties = [order_by] if isinstance(order_by, str) else list(order_by or ())

        def whole(part: pd.DataFrame) -> pd.DataFrame:
            made = {}
            for n, v, f in custom:
                x = part[v].astype(float)
                made[n] = _moving_quantile(x.expanding(min_periods=max(least, 0)), f) if _order_statistic(f) else _pandas_window(f, None, least, False)(x)
            return part.assign(**made)

        out = whole_series(out, keys, [date_column, *ties], [T.StructField(n, T.DoubleType()) for n, *_ in custom], whole)
    return out


def _plain(value, kind: str):
    """A function's result as Spark takes it: a number, or a mapping or series as a map, or an array."""
    if kind == "double":
        return float(value)
    if kind.startswith("map"):
        return {str(k): float(v) for k, v in (value.items() if hasattr(value, "items") else enumerate(value))}
    return [float(v) for v in value]


def augment_rolling_apply(data: DataFrame | Panel, date_column: str, window_func, window=2, min_periods: int | None = None, center: bool = False,
                          by: Sequence[str] = (), order_by=None, return_type: str = "double") -> DataFrame:
    """rolling_name_win_w for each (name, function) and window: the function gets the pandas frame of the window's rows (all columns) and returns a number, or with
    ``return_type`` 'map<string,double>' or 'array<double>' several. A function from a window to a Column, as (name, lambda w: F.max('a').over(w)), stays an expression."""
    df, keys = unpack(data, by)
    check_date(df, date_column)
    ties = [order_by] if isinstance(order_by, str) else list(order_by or ())
    funcs = [window_func] if isinstance(window_func, tuple) else list(window_func)
    w0 = order_window(keys, date_column, order_by)
    native, custom = {}, []
    for size in steps_of(window):
        least = size if min_periods is None else min_periods
        before, after = (size // 2, (size - 1) // 2) if center else (size - 1, 0)
        w = w0.rowsBetween(-before, after)
        for name, f in funcs:
            out = f"rolling_{name}_win_{size}"
            c = _as_column(f, w)
            if c is not None:
                native[out] = F.when(F.count(F.lit(1)).over(w) >= least, c)
            else:
                custom.append((out, f, before, after, least))
    res = df.withColumns(native)
    if custom:
        def whole(part: pd.DataFrame) -> pd.DataFrame:
            n = len(part)
            new = {}
            for name, f, before, after, least in custom:
                spans = [(max(0, i - before), min(n, i + after + 1)) for i in range(n)]
                new[name] = [_plain(f(part.iloc[a:b]), return_type) if b - a >= least else None for a, b in spans]
            return part.assign(**{k: pd.Series(v, dtype=float if return_type == "double" else object) for k, v in new.items()})

        kind = T.DataType.fromDDL(return_type)
        res = whole_series(res, keys, [date_column, *ties], [T.StructField(n, kind) for n, *_ in custom], whole)
    return res


def correlation(a: str, b: str, w=None) -> Column:
    """Pearson correlation over a window, or as an aggregate; null without spread (the built-in one fails there)."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    cov, sx, sy = [p.over(w) for p in parts] if w is not None else parts
    return F.try_divide(cov, sx * sy)


def _as_column(f, w) -> Column | None:
    """What ``f`` makes of a window if it is made for one; a function of a frame fails on a window in one of these ways. Errors of expressions pass on."""
    try:
        c = f(w)
    except (TypeError, AttributeError, KeyError, IndexError, ValueError):
        return None
    return c if isinstance(c, Column) else None


def augment_expanding_apply(data: DataFrame | Panel, date_column: str, window_func, min_periods: int | None = None, by: Sequence[str] = (), order_by=None,
                            return_type: str = "double") -> DataFrame:
    """expanding_name for each (name, function): the function gets the pandas frame of the series up to the row, or is a function from a window to a Column."""
    df, keys = unpack(data, by)
    check_date(df, date_column)
    ties = [order_by] if isinstance(order_by, str) else list(order_by or ())
    least = 1 if min_periods is None else min_periods
    w = order_window(keys, date_column, order_by).rowsBetween(Window.unboundedPreceding, 0)
    native, custom = {}, []
    for name, f in [window_func] if isinstance(window_func, tuple) else list(window_func):
        c = _as_column(f, w)
        if c is not None:
            native[f"expanding_{name}"] = F.when(F.count(F.lit(1)).over(w) >= least, c)
        else:
            custom.append((f"expanding_{name}", f))
    res = df.withColumns(native)
    if custom:
        def whole(part: pd.DataFrame) -> pd.DataFrame:
            new = {name: [_plain(f(part.iloc[: i + 1]), return_type) if i + 1 >= least else None for i in range(len(part))] for name, f in custom}
            return part.assign(**{k: pd.Series(v, dtype=float if return_type == "double" else object) for k, v in new.items()})

        kind = T.DataType.fromDDL(return_type)
        res = whole_series(res, keys, [date_column, *ties], [T.StructField(n, kind) for n, *_ in custom], whole)
    return res


def _alpha(kind: str, v: float) -> float:
    return {"alpha": v, "com": 1 / (1 + v), "span": 2 / (1 + v), "halflife": 1 - 0.5 ** (1 / v)}[kind]


def augment_ewm(data: DataFrame | Panel, date_column: str, value_column, window_func="mean", alpha=None, com=None, span=None, halflife=None,
                adjust: bool = True, min_periods: int = 0, ignore_na: bool = False, by: Sequence[str] = (), order_by=None) -> DataFrame:
    """value_ewm_function_decay_x: exponentially weighted mean, std, var or sum of the series up to each row, for one kind of decay (a number or a list).

    Rows older than a double can tell apart weigh nothing, so a hot series is cut where needed and each piece starts with the rows that still
    count; null values age the earlier ones unless ``ignore_na``.
    """
    df, keys = unpack(data, by)
    check_date(df, date_column)
    values = resolve_column_selection(df, value_column)
    given = {k: v for k, v in (("alpha", alpha), ("com", com), ("span", span), ("halflife", halflife)) if v is not None}
    if len(given) != 1:
        raise ValueError("give one of alpha, com, span and halflife")
    (kind, setting), = given.items()
    settings = list(setting) if isinstance(setting, (list, tuple)) else [setting]
    funcs = [window_func] if isinstance(window_func, str) else list(window_func)
    ties = [order_by] if isinstance(order_by, str) else list(order_by or ())
    jobs = [(f"{v}_ewm_{f}_{kind}_{s}", v, f, s) for v in values for f in funcs for s in settings]

    def kernel(body: pd.DataFrame) -> pd.DataFrame:
        new = {}
        for name, v, f, s in jobs:
            run = lambda g, f=f, s=s: getattr(g.ewm(alpha=_alpha(kind, s), adjust=adjust, min_periods=min_periods, ignore_na=ignore_na), f)()
            new[name] = body.groupby("__s", sort=False)[v].transform(run)
        return pd.DataFrame(new)

    halo = max(memory_of(_alpha(kind, s)) for s in settings) + min_periods
    return series_map(df, keys, [date_column, *ties], values, [(n, "double") for n, *_ in jobs], kernel, halo)
