"""Decomposition, anomalies and diagnostics of series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtime.functions.freq import parse_human_duration
from loomtime.functions.select import Panel, check_date, check_values, unpack
from loomtime.operators.calendar import signature
from loomtime.operators.frequency import local_period
from loomtime.operators.series import grouped, whole_series


def _build(n: int, span: int, first: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(first, first + count, dtype=float)
    q = min(span, n)
    low = np.clip(np.round(at).astype(int) - (q - 1) // 2, 0, n - q)
    near = low[:, None] + np.arange(q)
    d = near - at[:, None]
    reach = np.maximum(np.abs(d).max(1, keepdims=True) + max(0, span - n) / 2, 1e-9)
    return near, d, (1 - np.minimum(np.abs(d) / (reach * 1.0000001), 1) ** 3) ** 3


_kept = lru_cache(64)(_build)


def _neighbourhoods(n: int, span: int, first: int, count: int):
    """(rows, distances, tricube weights) of the neighbours of each position; the same for every series of a length, so small ones are kept."""
    return (_kept if count * min(span, n) <= 200_000 else _build)(n, span, first, count)


def loess(y: np.ndarray, span: int, degree: int, weight: np.ndarray | None = None, first: int = 0, count: int | None = None) -> np.ndarray:
    """Local regression of values at 0..n-1 (of each row of a table), evaluated at ``count`` whole positions from ``first`` on, with tricube and
    given weights."""
    table = np.atleast_2d(y)
    n = table.shape[1]
    count = n if count is None else count
    near, d, tricube = _neighbourhoods(n, span, first, count)
    q = near.shape[1]
    out = np.empty((len(table), count))
    step = max(1, 4_000_000 // max(1, q * len(table)))
    for a in range(0, count, step):
        s = slice(a, a + step)
        values = table[:, near[s]]
        w = np.broadcast_to(tricube[s], values.shape) if weight is None else tricube[s] * np.atleast_2d(weight)[:, near[s]]
        total = w.sum(2)
        safe = np.where(total > 0, total, 1)
        mean, level = (w * d[s]).sum(2) / safe, (w * values).sum(2) / safe
        if degree > 0:
            spread = (w * d[s] ** 2).sum(2) / safe - mean**2
            cross = (w * d[s] * values).sum(2) / safe - mean * level
            slope = np.divide(cross, spread, out=np.zeros_like(spread), where=spread > 1e-9)
            level = level - slope * mean
        out[:, s] = np.where(total > 0, level, values.mean(2))
    return out[0] if np.ndim(y) == 1 else out


def _average(x: np.ndarray, n: int) -> np.ndarray:
    return np.convolve(x, np.full(n, 1 / n), mode="valid")


def stl(y: np.ndarray, period: int, seasonal: int, trend: int, robust: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seasonal-trend decomposition by local regression: (seasonal, trend, remainder), which add up to ``y``."""
    n = len(y)
    if n < 2 * period:
        t = loess(y, max(3, min(trend, n)), 1) if n > 2 else np.full(n, y.mean() if n else 0)
        return np.zeros(n), t, y - t
    low_pass = period + 1 if period % 2 == 0 else period
    season, tr, weight = np.zeros(n), np.zeros(n), None
    long, size = n % period, n // period
    groups = [(np.arange(a, b), np.arange(a, b)[:, None] + np.arange(k) * period) for a, b, k in ((0, long, size + 1), (long, period, size)) if b > a]
    for outer in range(15 if robust else 1):
        for _ in range(2 if robust else 5):
            free = y - tr
            cycle = np.empty(n + 2 * period)
            for phases, rows in groups:  # phases of as many rows side by side
                sub = free[rows]
                fit = loess(sub, seasonal, 1, None if weight is None else weight[rows], -1, rows.shape[1] + 2)
                cycle[phases[:, None] + np.arange(rows.shape[1] + 2) * period] = fit
            low = loess(_average(_average(_average(cycle, period), period), 3), low_pass, 1)
            season = cycle[period : period + n] - low
            tr = loess(y - season, trend, 1, weight)
        if robust:
            r = np.abs(y - season - tr)
            h = 6 * np.median(r)
            if h <= 1e-12:
                break
            new = (1 - np.minimum(r / h, 1) ** 2) ** 2
            if weight is not None and np.abs(new - weight).max() < 1e-3:
                break
            weight = new
    return season, tr, y - season - tr


def classical(y: np.ndarray, period: int, model: str = "additive") -> tuple[np.ndarray, np.ndarray]:
    """(seasonal, trend) by centred moving averages; the trend's ends go on along lines through its nearest ``period`` points."""
    n = len(y)
    if n < 2 * period or period < 2:
        return np.full(n, 0.0 if model == "additive" else 1.0), np.full(n, y.mean() if n else 0.0)
    filt = np.full(period, 1 / period) if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
    half = len(filt) // 2
    trend = np.full(n, np.nan)
    trend[half : n - half] = np.convolve(y, filt, mode="valid")
    good = np.arange(half, n - half)
    for head, pick in ((np.arange(half), good[:period]), (np.arange(n - half, n), good[-period:])):
        k, c = np.polyfit(pick, trend[pick], 1) if len(pick) > 1 else (0.0, trend[pick][0])
        trend[head] = k * head + c
    free = y - trend if model == "additive" else y / trend
    phase = np.array([free[p::period].mean() for p in range(period)])
    phase = phase - phase.mean() if model == "additive" else phase / phase.mean()
    return np.resize(phase, n), trend


def _odd(n: int) -> int:
    return n + 1 if n % 2 == 0 else n


def anomalize(data: DataFrame | Panel, date_column: str, value_column: str, period: int | None = None, trend: int | None = None, method: str = "stl",
              decomp: str = "additive", clean: str = "min_max", iqr_alpha: float = 0.05, clean_alpha: float = 0.75, max_anomalies: float = 0.2,
              bind_data: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """observed, seasonal, seasadj, trend, remainder, anomaly, anomaly_score, anomaly_direction, recomposed_l1, recomposed_l2 and observed_clean for each row.

    The series is decomposed by 'stl' or 'twitter' (classical seasons, medians of equal blocks as trend); its remainders' quartiles set the limits. Null values are
    interpolated for the decomposition and are never anomalies. ``max_anomalies`` is accepted and has no effect. A series of fewer than
    three rows has a flat decomposition.
    """
    if method not in ("stl", "twitter"):
        raise ValueError("method is 'stl' or 'twitter'")
    if clean not in ("min_max", "linear"):
        raise ValueError("clean is 'min_max' or 'linear'")
    df, keys = unpack(data, by)
    check_date(df, date_column)
    check_values(df, [value_column])
    d = T.DoubleType()
    fields = [T.StructField(n, d) for n in ("observed", "seasonal", "seasadj", "trend", "remainder")] + [T.StructField("anomaly", T.StringType()), T.StructField("anomaly_score", d),
              T.StructField("anomaly_direction", T.IntegerType())] + [T.StructField(n, d) for n in ("recomposed_l1", "recomposed_l2", "observed_clean")]

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        raw = part[value_column].astype(float)
        y = raw.interpolate(limit_direction="both").fillna(0).to_numpy()
        n = len(y)
        p = int(period or local_period(part[date_column], 0) or 1)
        t = int(trend or local_period(part[date_column], 1) or 1)
        p, t = max(p, 1), max(t, 1)
        if method == "stl":
            season, level, _ = stl(y, p, max(_odd(p), 3), max(_odd(t), 3), True) if p > 1 else (np.zeros(n), loess(y, max(3, t), 1) if n > 2 else np.full(n, y.mean()), None)
        else:
            season, _ = classical(y, p, decomp)
            blocks = max(1, int(np.round(n / t)))
            size, more = divmod(n, blocks)
            block = np.repeat(np.arange(blocks), [size + (b < more) for b in range(blocks)])
            level = pd.Series(y - season).groupby(block).transform("median").to_numpy()
        rest = y - season - level
        q1, q3 = np.percentile(rest, [25, 75])
        reach = 0.15 / iqr_alpha * (q3 - q1)
        l1, l2 = -(q1 + reach), q3 + reach
        way = np.where(rest > l2, 1, np.where(rest < l1, -1, 0))
        way[raw.isna().to_numpy()] = 0
        r1, r2 = season + level + l1, season + level + l2
        if clean == "linear":
            cleaned = raw.where(way == 0).interpolate(limit_direction="both").to_numpy()
        else:
            pull = (1 - clean_alpha) * (r2 - r1) / 2
            cleaned = np.where(way == -1, r1 + pull, np.where(way == 1, r2 - pull, raw))
        return part.assign(observed=raw, seasonal=season, seasadj=raw - season, trend=level, remainder=raw - season - level, anomaly=np.where(way != 0, "Yes", "No"),
                           anomaly_score=np.abs(rest - (l1 + l2) / 2), anomaly_direction=way, recomposed_l1=r1, recomposed_l2=r2, observed_clean=cleaned)

    keep = df.columns if bind_data else [*keys, date_column]
    clash = [f.name for f in fields if f.name in keep]
    if clash:
        raise ValueError(f"columns {clash} are there already")
    return whole_series(df, keys, [date_column], fields, kernel, keep)


def _rows_of(value, dates: pd.Series, which: int) -> int:
    if value is None or value == "auto":
        return max(int(np.ceil(local_period(dates, which))), 2)
    if isinstance(value, (int, float)):
        return max(int(round(value)), 2)
    months, micros = parse_human_duration(value)
    span = micros / 1e6 + months * 2629746
    step = float(np.median(np.diff(np.sort(dates.dropna().values)).astype("timedelta64[us]").astype(float))) / 1e6
    return max(int(round(span / step)), 2) if step > 0 else 2


def stl_diagnostics(data: DataFrame | Panel, date_column: str, value_column: str, frequency="auto", trend="auto", robust: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """(groups, date, observed, season, trend, remainder, seasadj): STL of each series; gaps are interpolated, windows are odd. A series without any value
    raises ValueError."""
    df, keys = unpack(data, by)
    check_date(df, date_column)
    check_values(df, [value_column])

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        raw = part[value_column].astype(float)
        if raw.isna().all():
            raise ValueError("a series has no value at all")
        y = raw.interpolate(limit_direction="both").to_numpy()
        n = len(y)
        p = max(2, min(_rows_of(frequency, part[date_column], 0), n))
        t = min(_odd(max(3, _rows_of(trend, part[date_column], 1))), n - (1 - n % 2))
        season, level, rest = stl(y, p, _odd(max(p, 7)), max(t, 3), robust)
        return part.assign(observed=raw, season=season, trend=level, remainder=rest, seasadj=raw - season)

    fields = [T.StructField(c, T.DoubleType()) for c in ("observed", "season", "trend", "remainder", "seasadj")]
    return whole_series(df, keys, [date_column], fields, kernel, [*keys, date_column])


def levinson(acf: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocorrelations (lag 0 first) by the Levinson-Durbin recursion."""
    out = np.ones(len(acf))
    phi = np.zeros(0)
    error = 1.0
    for k in range(1, len(acf)):
        r = (acf[k] - phi @ acf[k - 1 : 0 : -1][: k - 1]) / error if k > 1 else acf[1]
        phi = np.r_[phi - r * phi[::-1], r]
        error *= 1 - r * r
        out[k] = r
        if error <= 1e-15:
            out[k + 1 :] = np.nan
            break
    return out


def _lagged(x: np.ndarray, y: np.ndarray, lags: int) -> np.ndarray:
    """Correlations of x ahead of y by 0..lags rows, over the whole series' scale."""
    n = len(x)
    a, b = x - x.mean(), y - y.mean()
    size = 1 << (2 * n - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)[: lags + 1]
    scale = np.sqrt((a @ a) * (b @ b))
    return full / scale if scale > 0 else np.full(lags + 1, np.nan)


def acf_diagnostics(data: DataFrame | Panel, date_column: str, value_column: str, ccf_columns: Sequence[str] | str | None = None, lags=1000, by: Sequence[str] = ()) -> DataFrame:
    """(groups, metric, lag, value, white_noise_upper, white_noise_lower): ACF, PACF and CCF_column at each lag up to half the series.

    Null values are left out before; a series of fewer than two values has no rows. ``lags`` is a number (0 up to it), a pair, a list or a duration.
    """
    df, keys = unpack(data, by)
    check_date(df, date_column)
    others = [ccf_columns] if isinstance(ccf_columns, str) else list(ccf_columns or ())
    check_values(df, [value_column, *others])
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("metric", T.StringType()), T.StructField("lag", T.IntegerType()), T.StructField("value", T.DoubleType()),
                          T.StructField("white_noise_upper", T.DoubleType()), T.StructField("white_noise_lower", T.DoubleType())])

    def wanted(part: pd.DataFrame) -> np.ndarray:
        if isinstance(lags, str):
            months, micros = parse_human_duration(lags)
            end = part[date_column].min() + pd.DateOffset(months=months) + pd.Timedelta(micros, "us")
            return np.arange(max(int((part[date_column] <= end).sum()) - 1, 0) + 1)
        return np.arange(lags + 1) if isinstance(lags, int) else np.arange(lags[0], lags[1] + 1) if isinstance(lags, tuple) else np.array(sorted(set(lags)))

    def each(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(date_column, kind="stable")
        x = part[value_column].astype(float).dropna().to_numpy()
        if len(x) < 2:
            return pd.DataFrame(columns=schema.names)
        top = min(len(x) - 1, max(len(x) // 2 - 1, 0) or len(x) - 1)
        use = wanted(part)
        use = use[use <= top]
        use = use if len(use) else np.array([0])
        acf = _lagged(x, x, int(use.max()))
        found = {"ACF": acf, "PACF": levinson(acf)}
        for c in others:
            pair = part[[value_column, c]].astype(float).dropna().to_numpy()
            if len(pair) >= 2:
                found[f"CCF_{c}"] = _lagged(pair[:, 0], pair[:, 1], min(int(use.max()), max(len(pair) // 2 - 1, 0)))
        edge = 2 / np.sqrt(len(x))
        rows = [(m, int(k), float(v[k])) for m, v in found.items() for k in use if k < len(v)]
        out = pd.DataFrame(rows, columns=["metric", "lag", "value"]).assign(white_noise_upper=edge, white_noise_lower=-edge)
        for k in keys:
            out[k] = part[k].iloc[0]
        return out[schema.names]

    return grouped(df, keys).applyInPandas(each, schema)


# Seasonal features, the calendar features they show, the lengths of their units in seconds, and the features for a median step below a bound
FEATURES = {"second": "second", "minute": "minute", "hour": "hour", "wday.lbl": "wday_lbl", "week": "yweek", "month.lbl": "month_lbl", "quarter": "quarter", "year": "year"}
LENGTHS = {"second": 1, "minute": 60, "hour": 3600, "wday.lbl": 86400, "week": 604800, "month.lbl": 2629800, "quarter": 7889400, "year": 31557600}
BANDS = ((60, ("second", "minute", "hour", "wday.lbl", "week", "month.lbl")), (3600, ("minute", "hour", "wday.lbl", "week", "month.lbl")),
         (86400, ("hour", "wday.lbl", "week", "month.lbl", "quarter", "year")), (604800, ("wday.lbl", "week", "month.lbl", "quarter", "year")), (2678400, ("week", "month.lbl", "quarter", "year")))


def seasonal_diagnostics(data: DataFrame | Panel, date_column: str, value_column: str, feature_set="auto", by: Sequence[str] = ()) -> DataFrame:
    """(groups, date, value, seasonal_feature, seasonal_value): each row once for each seasonal feature. 'auto' takes the features that suit any series'
    median step and span two of their units; a series with none, or of fewer than three dates, counts for 'year'."""
    df, keys = unpack(data, by)
    check_date(df, date_column)
    check_values(df, [value_column])
    names = [feature_set] if isinstance(feature_set, str) else list(feature_set or ["auto"])
    names = [{"wdaylbl": "wday.lbl", "weekday": "wday.lbl", "weekdaylbl": "wday.lbl", "monthlbl": "month.lbl"}.get(k, k) for k in (n.strip().lower().replace(" ", "") for n in names)]
    chosen: list[str] = []
    if "auto" in names:
        s = F.unix_micros(F.col(date_column).cast("timestamp")) / 1e6
        steps = df.where(F.col(date_column).isNotNull()).select(*keys, s.alias("s")).withColumn("d", F.col("s") - F.lag("s").over(Window.partitionBy(*keys).orderBy("s")))
        series = steps.groupBy(*keys).agg(F.percentile("d", 0.5).alias("m"), (F.max("s") - F.min("s")).alias("span"), F.count(F.lit(1)).alias("n"))
        tests = []
        edges = [0, *[b for b, _ in BANDS], float("inf")]
        for i, feats in enumerate([*[f for _, f in BANDS], ("month.lbl", "quarter", "year")]):
            here = (F.col("n") >= 3) & (F.col("m") >= edges[i]) & (F.col("m") < edges[i + 1])
            tests += [(f, here & (F.col("span") >= 2 * LENGTHS[f])) for f in feats]
        held = [F.coalesce(t, F.lit(False)) for _, t in tests]
        none = ~reduce(Column.__or__, held)
        seen = series.agg(*[F.coalesce(F.bool_or(t), F.lit(False)).alias(f"t{i}") for i, t in enumerate([*held, none])]).first()
        auto = {f for i, f in enumerate([*[f for f, _ in tests], "year"]) if seen[i]}
        chosen = [f for f in FEATURES if f in auto] or ["year"]
    for n in names:
        if n != "auto":
            if n not in FEATURES:
                raise ValueError(f"unknown seasonal feature {n!r}")
            if n not in chosen:
                chosen.append(n)
    sig = signature(F.col(date_column))
    pairs = F.array(*[F.struct(F.lit(f).alias("seasonal_feature"), sig[FEATURES[f]].cast("string").alias("seasonal_value")) for f in chosen])
    return df.select(*keys, date_column, value_column, F.inline(pairs))
