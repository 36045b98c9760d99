"""Fourier, Hilbert, wavelet and spline features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtime.functions.select import Panel, check_date, resolve_column_selection, unpack
from loomtime.operators.series import whole_series
from loomtime.operators.shift import order_window, steps_of


def augment_fourier(data: DataFrame | Panel, date_column: str, periods=1, max_order: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """date_sin_K_p and date_cos_K_p for orders K up to ``max_order`` and periods p, in units of the series' median step between dates. A series of
    one date, or whose median step is 0, has nulls."""
    df, keys = unpack(data, by)
    check_date(df, date_column)
    seconds = F.unix_micros(F.col(date_column).cast("timestamp")) / 1e6
    w = order_window(keys, date_column)
    whole = Window.partitionBy(*keys)
    staged = df.withColumns({"__s": seconds}).withColumns({"__step": F.col("__s") - F.lag("__s").over(w)})
    staged = staged.withColumns({"__x": F.try_divide(F.col("__s") - F.min("__s").over(whole), F.percentile("__step", 0.5).over(whole))})
    turn = lambda k, p: F.lit(2 * np.pi * k / p) * F.col("__x")
    new = {f"{date_column}_{n}_{k}_{p}": f(turn(k, p)) for p in steps_of(periods) for k in range(1, max_order + 1) for n, f in (("sin", F.sin), ("cos", F.cos))}
    return staged.withColumns(new).drop("__s", "__step", "__x")


def augment_hilbert(data: DataFrame | Panel, date_column: str, value_column, by: Sequence[str] = (), order_by=None) -> DataFrame:
    """value_hilbert_real and value_hilbert_imag: the analytic signal of each series (nulls count as 0)."""
    df, keys = unpack(data, by)
    check_date(df, date_column)
    values = resolve_column_selection(df, value_column)

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        new = {}
        n = len(part)
        gain = np.zeros(n)
        gain[0] = 1
        gain[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            gain[n // 2] = 1
        for v in values:
            z = np.fft.ifft(np.fft.fft(part[v].astype(float).fillna(0).to_numpy()) * gain)
            new |= {f"{v}_hilbert_real": z.real, f"{v}_hilbert_imag": z.imag}
        return part.assign(**new)

    ties = [order_by] if isinstance(order_by, str) else list(order_by or ())
    return whole_series(df, keys, [date_column, *ties], [T.StructField(f"{v}_hilbert_{p}", T.DoubleType()) for v in values for p in ("real", "imag")], kernel)


def _kernel(method: str, t: np.ndarray) -> np.ndarray:
    """Fixed formulas of the three wavelets: centre frequency 1/2 for 'morlet' and 5 for 'analytic_morlet', width 1 for 'bump'."""
    bell = np.exp(-(t**2) / 2)
    if method == "morlet":
        return np.exp(1j * np.pi * t) * bell
    if method == "analytic_morlet":
        return np.exp(10j * np.pi * t) * bell
    if method == "bump":
        inside = np.abs(t) < 1
        return np.where(inside, np.exp(-2 / np.where(inside, 1 - t**2, 1)), 0).astype(complex)
    raise ValueError("method is 'morlet', 'bump' or 'analytic_morlet'")


def augment_wavelet(data: DataFrame | Panel, date_column: str, value_column: str, method: str = "morlet", sample_rate: float = 1000.0, scales: Sequence[float] = (1, 2, 4),
                    by: Sequence[str] = (), order_by=None) -> DataFrame:
    """method_scale_s_real and _imag: convolution of each series with the wavelet at each scale."""
    df, keys = unpack(data, by)
    check_date(df, date_column)
    _kernel(method, np.zeros(1))
    if not all(scales):
        raise ValueError("scales are not zero")

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        x = part[value_column].astype(float).fillna(0).to_numpy()
        n = len(x)
        t = np.arange(-n // 2, n // 2) / sample_rate
        new = {}
        for s in scales:
            z = np.convolve(x, np.conj(_kernel(method, t / s)), mode="same") / np.sqrt(abs(s)) if n else np.empty(0, complex)
            new |= {f"{method}_scale_{s}_real": z.real, f"{method}_scale_{s}_imag": z.imag}
        return part.assign(**new)

    ties = [order_by] if isinstance(order_by, str) else list(order_by or ())
    return whole_series(df, keys, [date_column, *ties], [T.StructField(f"{method}_scale_{s}_{p}", T.DoubleType()) for s in scales for p in ("real", "imag")], kernel)


def bspline_basis(x: np.ndarray, inner: np.ndarray, degree: int, lo: float, hi: float) -> np.ndarray:
    """Cox-de Boor basis over clamped knots; each row adds up to 1 within the bounds."""
    knots = np.r_[[lo] * (degree + 1), np.sort(inner), [hi] * (degree + 1)]
    x = np.clip(x, lo, hi)
    spans = len(knots) - 1
    b = np.zeros((len(x), spans))
    last = max(i for i in range(spans) if knots[i] < knots[i + 1]) if hi > lo else 0
    for i in range(spans):
        b[:, i] = (x >= knots[i]) & ((x < knots[i + 1]) | ((i == last) & (x == knots[i + 1])))
    for d in range(1, degree + 1):
        nxt = np.zeros((len(x), spans - d))
        for i in range(spans - d):
            left, right = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
            if left > 0:
                nxt[:, i] += (x - knots[i]) / left * b[:, i]
            if right > 0:
                nxt[:, i] += (knots[i + d + 1] - x) / right * b[:, i + 1]
        b = nxt
    return b


def natural_basis(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Cardinal natural cubic splines: column j is the spline that is 1 at knot j and 0 at the others."""
    k = len(knots)
    h = np.diff(knots)
    a, r = np.zeros((k, k)), np.zeros((k, k))
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, k - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i, i - 1 : i + 2] = 6 / h[i - 1], -6 / h[i - 1] - 6 / h[i], 6 / h[i]
    curve = np.linalg.solve(a, r)
    return _cubic(x, knots, h, curve, np.eye(k))


def cyclic_basis(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Cardinal cyclic cubic splines: value, slope and curvature agree at both ends."""
    k = len(knots) - 1
    h = np.diff(knots)
    a, r = np.zeros((k, k)), np.zeros((k, k))
    for i in range(k):
        p, q = (i - 1) % k, (i + 1) % k
        a[i, p] += h[p]
        a[i, i] += 2 * (h[p] + h[i])
        a[i, q] += h[i]
        r[i, p] += 6 / h[p]
        r[i, i] -= 6 / h[p] + 6 / h[i]
        r[i, q] += 6 / h[i]
    curve = np.linalg.solve(a, r)
    wrap = np.r_[np.arange(k), 0]
    x = knots[0] + np.mod(x - knots[0], knots[-1] - knots[0])
    return _cubic(x, knots, h, curve[wrap], np.eye(k)[wrap])


def _cubic(x, knots, h, curve, value) -> np.ndarray:
    i = np.clip(np.searchsorted(knots, x, side="right") - 1, 0, len(h) - 1)
    d = h[i][:, None]
    left, right = (knots[i + 1] - x)[:, None], (x - knots[i])[:, None]
    inside = (left**3 * curve[i] + right**3 * curve[i + 1]) / (6 * d) + (value[i] / d - curve[i] * d / 6) * left + (value[i + 1] / d - curve[i + 1] * d / 6) * right
    return inside


def augment_spline(data: DataFrame | Panel, date_column: str, value_column: str, spline_type: str = "bs", df: int = 5, degree: int = 3, knots: Sequence[float] | None = None,
                   include_intercept: bool = False, lower_bound: float | None = None, upper_bound: float | None = None, prefix: str | None = None,
                   by: Sequence[str] = (), order_by=None) -> DataFrame:
    """Spline basis of the values of each series: value_bspline_degree_d_i, value_natural_spline_i or value_cyclic_spline_i for i from 1.

    Inner knots are quantiles of the series unless given. Null values have null features; a series without spread has zeros.
    """
    frame, keys = unpack(data, by)
    check_date(frame, date_column)
    kind = {"bs": "bs", "basis": "bs", "bspline": "bs", "natural": "natural", "ns": "natural", "cr": "natural", "cyclic": "cyclic", "cc": "cyclic"}.get(spline_type)
    if kind is None:
        raise ValueError(f"unknown spline {spline_type!r}")
    inner_count = len(knots) if knots is not None else {"bs": df - degree - (1 if include_intercept else 0), "natural": df - 1 - (1 if include_intercept else 0), "cyclic": df - (1 if include_intercept else 0)}[kind]
    if inner_count < 0:
        raise ValueError("df is too small for the degree")
    columns = {"bs": inner_count + degree + (1 if include_intercept else 0), "natural": inner_count + 1 + (1 if include_intercept else 0), "cyclic": inner_count + (1 if include_intercept else 0)}[kind]
    stem = prefix or {"bs": f"{value_column}_bspline_degree_{degree}", "natural": f"{value_column}_natural_spline", "cyclic": f"{value_column}_cyclic_spline"}[kind]
    names = [f"{stem}_{i + 1}" for i in range(columns)]

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        v = part[value_column].astype(float).to_numpy()
        ok = ~np.isnan(v)
        out = np.full((len(v), columns), np.nan)
        x = v[ok]
        if len(x):
            lo = x.min() if lower_bound is None else lower_bound
            hi = x.max() if upper_bound is None else upper_bound
            inner = np.asarray(knots, float) if knots is not None else np.quantile(x, np.linspace(0, 1, inner_count + 2)[1:-1])
            every = np.unique(np.r_[lo, inner, hi])
            if hi <= lo or (kind != "bs" and len(every) != inner_count + 2):
                out[ok] = 0
            else:
                b = bspline_basis(x, inner, degree, lo, hi) if kind == "bs" else natural_basis(x, every) if kind == "natural" else cyclic_basis(x, every)
                b = b if include_intercept else b[:, 1:]
                out[ok, : b.shape[1]] = b[:, :columns]
        return part.assign(**dict(zip(names, out.T)))

    ties = [order_by] if isinstance(order_by, str) else list(order_by or ())
    return whole_series(frame, keys, [date_column, *ties], [T.StructField(n, T.DoubleType()) for n in names], kernel)
