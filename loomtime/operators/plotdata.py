"""The queries behind the usual charts, as tables; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtime.functions.freq import Freq
from loomtime.functions.select import Panel, check_date, resolve_column_selection, unpack
from loomtime.operators.series import whole_series


def lowess(x: np.ndarray, y: np.ndarray, frac: float = 0.2, rounds: int = 3) -> np.ndarray:
    """Robust locally weighted regression at sorted x."""
    n = len(x)
    q = min(n, max(2, int(np.ceil(frac * n))))
    low = np.clip(np.arange(n) - q // 2, 0, n - q)
    near = low[:, None] + np.arange(q)
    d = x[near] - x[:, None]
    w0 = (1 - np.minimum(np.abs(d) / np.maximum(np.abs(d).max(1, keepdims=True) * 1.0001, 1e-12), 1) ** 3) ** 3
    robust, fit = np.ones(n), y.astype(float)
    for _ in range(rounds + 1):
        w = w0 * robust[near]
        total = np.maximum(w.sum(1), 1e-12)
        m, v = (w * d).sum(1) / total, (w * y[near]).sum(1) / total
        sxx = (w * (d - m[:, None]) ** 2).sum(1)
        slope = np.divide((w * (d - m[:, None]) * y[near]).sum(1), sxx, out=np.zeros(n), where=sxx > 1e-12)
        fit = v - slope * m
        r = np.abs(y - fit)
        h = 6 * np.median(r)
        if h <= 0:
            break
        robust = (1 - np.minimum(r / h, 1) ** 2) ** 2
    return fit


def timeseries_data(data: DataFrame | Panel, date_column: str, value_column, smooth: bool = True, smooth_frac: float = 0.2, by: Sequence[str] = ()) -> DataFrame:
    """(groups, date, name, value, smooth): values of several columns one below the other, with a smoother of each series."""
    df, keys = unpack(data, by)
    check_date(df, date_column)
    values = resolve_column_selection(df, value_column)
    pairs = F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values])
    long = df.select(*keys, date_column, F.inline(pairs))
    if not smooth:
        return long

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        ok = part["value"].notna().to_numpy() & part[date_column].notna().to_numpy()
        out = np.full(len(part), np.nan)
        if ok.sum() > 2:
            t = pd.to_datetime(part[date_column][ok]).astype("int64").to_numpy().astype(float)
            span = t[-1] - t[0]
            out[ok] = lowess((t - t[0]) / (span or 1), part["value"].to_numpy()[ok], smooth_frac)
        return part.assign(smooth=out)

    return whole_series(long, [*keys, "name"], [date_column], [T.StructField("smooth", T.DoubleType())], kernel)


def boxplot_data(data: DataFrame | Panel, date_column: str, value_column: str, period: str = "1MS", smooth_func: str = "mean", by: Sequence[str] = ()) -> DataFrame:
    """(groups, period start, n, min, q1, median, q3, max, smooth): five numbers and the mean or median of each period."""
    df, keys = unpack(data, by)
    check_date(df, date_column)
    v = F.col(value_column).cast("double")
    smooth = F.avg(v) if smooth_func == "mean" else F.percentile(v, 0.5)
    five = F.percentile(v, F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    rows = df.where(F.col(date_column).isNotNull() & v.isNotNull()).withColumn("__p", Freq.of(period).floor(F.col(date_column)))
    out = rows.groupBy(*keys, "__p").agg(F.count(v).alias("n"), five.alias("f"), smooth.alias("smooth"))
    return out.select(*keys, F.col("__p").alias(date_column), "n", *[F.col("f")[i].alias(n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))], "smooth")


def regression_data(data: DataFrame | Panel, date_column: str, value_column: str, regressors: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(groups, date, observed, fitted) of a least-squares line in time for each series, or on given columns. One line is two aggregates and stays an expression;
    several regressors are solved from their cross products, which are aggregates too."""
    df, keys = unpack(data, by)
    check_date(df, date_column)
    xs = list(regressors or [])
    t = F.unix_micros(F.col(date_column).cast("timestamp")) / 86_400e6
    rows = df.withColumns({"__y": F.col(value_column).cast("double"), **({f"__x{i}": F.col(x).cast("double") for i, x in enumerate(xs)} if xs else {"__x0": t})})
    n = max(len(xs), 1)
    whole = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in ["__y", *[f"__x{i}" for i in range(n)]]))
    if n == 1:
        fit = whole.groupBy(*keys).agg(F.try_divide(F.covar_pop("__y", "__x0"), F.var_pop("__x0")).alias("__b"), F.avg("__y").alias("__my"), F.avg("__x0").alias("__mx"))
        joined = rows.join(fit, keys, "left") if keys else rows.crossJoin(F.broadcast(fit))
        return joined.select(*keys, date_column, F.col("__y").alias("observed"), (F.col("__my") + F.col("__b") * (F.col("__x0") - F.col("__mx"))).alias("fitted"))
    means = whole.groupBy(*keys).agg(*[F.avg(f"__x{i}").alias(f"__m{i}") for i in range(n)])
    centred = whole.join(means, keys, "left") if keys else whole.crossJoin(F.broadcast(means))
    at = lambda j: F.lit(1.0) if j == 0 else F.col(f"__x{j - 1}") - F.col(f"__m{j - 1}")
    cross = centred.groupBy(*keys).agg(*[F.sum(at(i) * at(j)).alias(f"s{i}_{j}") for i in range(n + 1) for j in range(i, n + 1)], *[F.sum(at(i) * F.col("__y")).alias(f"t{i}") for i in range(n + 1)],
                                       *[F.first(f"__m{i}").alias(f"__m{i}") for i in range(n)])
    names = [f"s{i}_{j}" for i in range(n + 1) for j in range(i, n + 1)] + [f"t{i}" for i in range(n + 1)]

    @F.pandas_udf("array<double>")
    def solve(s: pd.DataFrame) -> pd.Series:
        out = []
        for r in s.itertuples(index=False):
            v = dict(zip(names, r))
            a = np.array([[v[f"s{min(i, j)}_{max(i, j)}"] for j in range(n + 1)] for i in range(n + 1)], float)
            out.append(np.linalg.lstsq(a, np.array([v[f"t{i}"] for i in range(n + 1)], float), rcond=None)[0].tolist())
        return pd.Series(out)

    fit = cross.select(*keys, *[f"__m{i}" for i in range(n)], solve(F.struct(*names)).alias("__b"))
    joined = rows.join(fit, keys, "left") if keys else rows.crossJoin(F.broadcast(fit))
    value = F.col("__b")[0]
    for i in range(n):
        value = value + F.col("__b")[i + 1] * (F.col(f"__x{i}") - F.col(f"__m{i}"))
    return joined.select(*keys, date_column, F.col("__y").alias("observed"), value.alias("fitted"))


def anomalies_data(anomalized: DataFrame, date_column: str, by: Sequence[str] = ()) -> DataFrame:
    """Observed values, limits and marks of ``anomalize``'s result."""
    return anomalized.select(*by, date_column, "observed", "recomposed_l1", "recomposed_l2", "anomaly", "anomaly_direction", "anomaly_score")


def anomalies_decomp_data(anomalized: DataFrame, date_column: str, by: Sequence[str] = ()) -> DataFrame:
    """(groups, date, component, value) of the decomposition in ``anomalize``'s result."""
    parts = ("observed", "seasonal", "trend", "remainder")
    return anomalized.select(*by, date_column, F.inline(F.array(*[F.struct(F.lit(p).alias("component"), F.col(p).alias("value")) for p in parts])))


def anomalies_cleaned_data(anomalized: DataFrame, date_column: str, by: Sequence[str] = ()) -> DataFrame:
    """Observed and cleaned values of ``anomalize``'s result."""
    return anomalized.select(*by, date_column, "observed", "observed_clean")
