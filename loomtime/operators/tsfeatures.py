"""Features that describe whole series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtime.functions.freq import Freq
from loomtime.functions.select import Panel, check_date, check_values, unpack
from loomtime.operators.decompose import _lagged, _odd, levinson, stl
from loomtime.operators.frequency import local_period
from loomtime.operators.series import grouped

NAN = float("nan")


def _acf(x: np.ndarray, n: int) -> np.ndarray:
    r = _lagged(x, x, min(n, max(len(x) - 1, 0))) if len(x) > 1 else np.array([1.0])
    return np.r_[r, np.full(n + 1 - len(r), np.nan)]


def _r2(y: np.ndarray, x: np.ndarray) -> float:
    a = np.column_stack([np.ones(len(y)), x])
    if len(y) <= a.shape[1]:
        return NAN
    fit = a @ np.linalg.lstsq(a, y, rcond=None)[0]
    total = ((y - y.mean()) ** 2).sum()
    return float(1 - ((y - fit) ** 2).sum() / total) if total > 0 else NAN


def _embed(x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    v = np.lib.stride_tricks.sliding_window_view(x, lags + 1)
    return v[:, -1], v[:, :-1][:, ::-1]


def acf_features(x, m):
    d1, d2 = np.diff(x), np.diff(x, 2)
    a, b, c = _acf(x, max(10, m)), _acf(d1, 10), _acf(d2, 10)
    sq = lambda v: float((v[1:11] ** 2).sum())
    return {"x_acf1": a[1], "x_acf10": sq(a), "diff1_acf1": b[1], "diff1_acf10": sq(b), "diff2_acf1": c[1], "diff2_acf10": sq(c), "seas_acf1": a[m] if m > 1 else NAN}


def arch_stat(x, m, lags: int = 12):
    x = x - x.mean()
    return {"arch_lm": _r2(*_embed(x**2, lags)) if len(x) > 2 * lags + 2 else NAN}


def crossing_points(x, m):
    above = x <= np.median(x)
    return {"crossing_points": float((above[1:] != above[:-1]).sum())}


def entropy(x, m):
    p = np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2
    p = p / p.sum() if p.sum() > 0 else p
    p = p[p > 0]
    return {"entropy": float(-(p * np.log(p)).sum() / np.log(len(x) / 2)) if len(x) > 4 and len(p) else NAN}


def flat_spots(x, m):
    try:
        level = pd.cut(pd.Series(x), 10, labels=False).to_numpy()
    except ValueError:
        return {"flat_spots": NAN}
    edges = np.flatnonzero(np.r_[True, np.diff(level) != 0, True])
    return {"flat_spots": float(np.diff(edges).max())}


def heterogeneity(x, m):
    n = len(x)
    p = min(12, n // 10) or 1
    if n < 12:
        return dict.fromkeys(("arch_acf", "garch_acf", "arch_r2", "garch_r2"), NAN)
    y, lagged = _embed(x, p)
    a = np.column_stack([np.ones(len(y)), lagged])
    white = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    sq = white**2
    var = np.empty(len(sq))
    var[0] = sq.mean()
    for t in range(1, len(sq)):  # fixed GARCH(1,1) filter
        var[t] = 0.05 * sq.mean() + 0.1 * sq[t - 1] + 0.85 * var[t - 1]
    z = sq / np.maximum(var, 1e-12)
    stat = lambda v: float((_acf(v, 12)[1:13] ** 2).sum())
    lags = min(12, len(sq) // 3)
    return {"arch_acf": stat(sq), "garch_acf": stat(z), "arch_r2": _r2(*_embed(sq, lags)), "garch_r2": _r2(*_embed(z, lags))}


def _smooth_search(run: Callable[[Sequence[float]], float], sizes: Sequence[np.ndarray]) -> list[float]:
    """Coordinate search on grids, refined twice."""
    best = [float(g[len(g) // 2]) for g in sizes]
    width = 1.0
    for _ in range(3):
        for i in range(len(best)):
            options = np.clip(best[i] + width * np.linspace(-0.5, 0.5, 9), 1e-4, 0.9999)
            best[i] = float(min(options, key=lambda o, i=i: run([*best[:i], o, *best[i + 1 :]])))
        width /= 3
    return best


def _holt_error(x: np.ndarray, a: float, b: float) -> float:
    level, slope, err = x[0], x[1] - x[0], 0.0
    for v in x[1:]:
        e = v - level - slope
        err += e * e
        level, slope = level + slope + a * e, slope + a * b * e
    return err


def holt_parameters(x, m):
    if len(x) < 6:
        return {"alpha": NAN, "beta": NAN}
    a, b = _smooth_search(lambda p: _holt_error(x[-500:], *p), [np.linspace(0, 1, 9)] * 2)
    return {"alpha": a, "beta": b}


def _hw_error(x: np.ndarray, m: int, a: float, b: float, g: float) -> float:
    level, slope = x[:m].mean(), (x[m : 2 * m].mean() - x[:m].mean()) / m
    season = list(x[:m] - level)
    err = 0.0
    for t, v in enumerate(x[m:]):
        e = v - level - slope - season[t % m]
        err += e * e
        level, slope = level + slope + a * e, slope + a * b * e
        season[t % m] += g * (1 - a) * e
    return err


def hw_parameters(x, m):
    if m < 2 or len(x) < 2 * m + 3:
        return {"hw_alpha": NAN, "hw_beta": NAN, "hw_gamma": NAN}
    x = x[-max(500, 4 * m):]
    a, b, g = _smooth_search(lambda p: _hw_error(x, m, *p), [np.linspace(0, 1, 9)] * 3)
    return {"hw_alpha": a, "hw_beta": b, "hw_gamma": g}


def _tiles(x, m):
    w = m if m > 1 else 10
    n = len(x) // w
    return x[: n * w].reshape(n, w) if n > 1 else None


def lumpiness(x, m):
    t = _tiles(x, m)
    return {"lumpiness": float(t.var(1, ddof=1).var(ddof=1)) if t is not None and t.shape[1] > 1 else 0.0}


def stability(x, m):
    t = _tiles(x, m)
    return {"stability": float(t.mean(1).var(ddof=1)) if t is not None else 0.0}


def nonlinearity(x, m):
    if len(x) < 15 or x.std() == 0:
        return {"nonlinearity": NAN}
    z = (x - x.mean()) / x.std()
    y, lag = z[1:], z[:-1]
    a = np.column_stack([np.ones(len(y)), lag])
    e = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    b = np.column_stack([a, lag**2, lag**3])
    u = e - b @ np.linalg.lstsq(b, e, rcond=None)[0]
    return {"nonlinearity": float(10 * len(y) * np.log((e @ e) / (u @ u)) / len(x)) if (u @ u) > 0 else NAN}


def pacf_features(x, m):
    def head(v):
        n = min(max(len(v) // 2 - 1, 1), max(5, m))
        p = levinson(_acf(v, n)) if len(v) > 3 and v.std() > 0 else np.full(n + 1, np.nan)
        return p

    p, p1, p2 = head(x), head(np.diff(x)), head(np.diff(x, 2))
    sq = lambda v: float((v[1:6] ** 2).sum()) if len(v) >= 6 else NAN
    return {"x_pacf5": sq(p), "diff1x_pacf5": sq(p1), "diff2x_pacf5": sq(p2), "seas_pacf": float(p[m]) if 1 < m < len(p) else NAN}


def stl_features(x, m):
    n = len(x)
    season, trend, rest = stl(x, m, 11, _odd(max(7, int(1.5 * m) + 1)), False) if m > 1 and n >= 2 * m else stl(x, 1, 7, _odd(max(7, n // 10)), False)
    deseason, detrend = x - season, x - trend
    share = lambda part, whole: float(max(0, min(1, 1 - part.var(ddof=1) / whole.var(ddof=1)))) if n > 2 and whole.var(ddof=1) > 1e-12 else 0.0
    loo = (rest.var(ddof=1) * (n - 1) - (rest - rest.mean()) ** 2) / max(n - 2, 1) if n > 2 else np.zeros(n)
    t = np.linspace(-1, 1, n)
    q, _ = np.linalg.qr(np.column_stack([np.ones(n), t, t**2])) if n > 3 else (np.zeros((n, 3)), None)
    e = _acf(rest, 10)
    sign = np.sign(q[-1]) if n > 3 else np.ones(3)
    out = {"nperiods": float(m > 1), "seasonal_period": float(m), "trend": share(rest, deseason), "spike": float(loo.var()), "linearity": float(trend @ q[:, 1] * sign[1]),
           "curvature": float(trend @ q[:, 2] * sign[2]), "e_acf1": float(e[1]), "e_acf10": float((e[1:11] ** 2).sum())}
    if m > 1:
        out |= {"seasonal_strength": share(rest, detrend), "peak": float(season[:m].argmax() + 1) if n >= m else NAN, "trough": float(season[:m].argmin() + 1) if n >= m else NAN}
    else:
        out |= {"seasonal_strength": NAN, "peak": NAN, "trough": NAN}
    return out


def _long_run(e: np.ndarray, lags: int) -> float:
    n = len(e)
    return float(e @ e / n + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1)))


def unitroot_kpss(x, m):
    n = len(x)
    if n < 10:
        return {"unitroot_kpss": NAN}
    e = x - x.mean()
    s = _long_run(e, int(np.trunc(4 * (n / 100) ** 0.25)))
    return {"unitroot_kpss": float((np.cumsum(e) ** 2).sum() / n**2 / s) if s > 0 else NAN}


def unitroot_pp(x, m):
    n = len(x) - 1
    if n < 10:
        return {"unitroot_pp": NAN}
    y, lag = x[1:], x[:-1]
    a = np.column_stack([np.ones(n), lag])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    e = y - a @ b
    g0, lam = float(e @ e / n), _long_run(e, int(np.trunc(4 * (n / 100) ** 0.25)))
    spread = ((lag - lag.mean()) ** 2).sum()
    return {"unitroot_pp": float(n * (b[1] - 1) - 0.5 * n**2 * (lam - g0) / spread) if spread > 0 else NAN}


def series_length(x, m):
    return {"series_length": float(len(x))}


def hurst(x, m):
    """Slope of log R/S over log size, from halves down to eight values."""
    n = len(x)
    if n < 16 or x.std() == 0:
        return {"hurst": NAN}
    sizes, rs = [], []
    w = n
    while w >= 8:
        t = x[: n // w * w].reshape(-1, w)
        c = np.cumsum(t - t.mean(1, keepdims=True), axis=1)
        s = t.std(1)
        ok = s > 0
        if ok.any():
            sizes.append(w)
            rs.append(np.mean((c.max(1) - c.min(1))[ok] / s[ok]))
        w //= 2
    return {"hurst": float(np.polyfit(np.log(sizes), np.log(rs), 1)[0]) if len(sizes) > 1 else NAN}


FAMILIES = {f.__name__: f for f in (acf_features, arch_stat, crossing_points, entropy, flat_spots, heterogeneity, holt_parameters, lumpiness, nonlinearity, pacf_features,
                                    stl_features, stability, hw_parameters, unitroot_kpss, unitroot_pp, series_length, hurst)}


def ts_features(data: DataFrame | Panel, date_column: str, value_column: str, features: Sequence[str] | None = None, freq: int | str | None = None, scale: bool = True,
                by: Sequence[str] = ()) -> DataFrame:
    """One row a series with the features of the families named (all 17 by default).

    ``freq`` is the seasonal period in rows, or is guessed from the dates. ``scale`` standardises the values first. Null values are left out; what a short or
    constant series can't tell is null.
    """
    df, keys = unpack(data, by)
    check_date(df, date_column)
    check_values(df, [value_column])
    names = list(features or FAMILIES)
    unknown = [n for n in names if n not in FAMILIES]
    if unknown:
        raise ValueError(f"unknown features {unknown}")
    rng = np.sin(np.arange(64) * 1.7) + np.arange(64) * 0.01
    columns = [c for n in names for c in FAMILIES[n](rng, 4)]
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(c, T.DoubleType()) for c in columns])
    rows_a_season = {"h": 24, "D": 7, "W": 52, "ME": 12, "MS": 12, "QE": 4, "QS": 4, "B": 5}
    fixed = rows_a_season.get(Freq.of(freq).unit, 1) if isinstance(freq, str) else freq

    def each(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(date_column, kind="stable")
        x = part[value_column].astype(float).dropna().to_numpy()
        m = int(fixed or max(1, round(local_period(part[date_column], 0)))) if len(x) else 1
        if scale and len(x) > 1 and x.std(ddof=1) > 0:
            x = (x - x.mean()) / x.std(ddof=1)
        row = {}
        for n in names:
            try:
                row |= FAMILIES[n](x, m)
            except (ValueError, IndexError, np.linalg.LinAlgError):
                pass
        clean = {c: (float(row[c]) if c in row and np.isfinite(row[c]) else None) for c in columns}
        return pd.DataFrame([{**{k: part[k].iloc[0] for k in keys}, **clean}], columns=schema.names).astype({c: "float64" for c in columns})

    out = grouped(df.select(*keys, date_column, value_column), keys).applyInPandas(each, schema)
    return out.select(*keys, *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in columns])
