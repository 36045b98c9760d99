"""Technical indicators and rolling risk measures, all row-preserving: warm-up rows are null, zero denominators give null.

Every verb takes ``by`` (the series), a date, and optionally ``order_by`` for rows of one date.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtime.functions.select import Panel, check_date, unpack
from loomtime.operators.series import memory_of, series_map
from loomtime.operators.shift import order_window, steps_of
from loomtime.runtime import numeric


def _start(data, date, by, tie):
    df, keys = unpack(data, by)
    check_date(df, date)
    return df, keys, order_window(keys, date, tie), [date, *([tie] if isinstance(tie, str) else list(tie or ()))]


def _rows(w, n: int):
    return w.rowsBetween(-(n - 1), 0)


def _enough(x: Column, w, n: int, value: Column) -> Column:
    return F.when(F.count(x).over(w) >= n, value)


def _with_temporary(df: DataFrame, temporary: dict[str, Column], final: dict[str, Column]) -> DataFrame:
    return df.withColumns(temporary).withColumns(final).drop(*temporary)


def augment_rsi(data: DataFrame | Panel, date_column: str, close_column: str, periods=14, by: Sequence[str] = (), order_by=None) -> DataFrame:
    """close_rsi_p = 100 - 100 / (1 + mean gain / mean loss) over p rows; the first change counts as 0; no losses give 100, no changes null."""
    df, _, w, _ = _start(data, date_column, by, order_by)
    c = numeric(df, close_column)
    change = F.coalesce(c - F.lag(c).over(w), F.lit(0.0))
    tmp = {"__gain": F.greatest(change, F.lit(0.0)), "__loss": F.greatest(-change, F.lit(0.0))}
    final = {}
    for p in steps_of(periods):
        wp = _rows(w, p)
        g, l = F.avg("__gain").over(wp), F.avg("__loss").over(wp)  # noqa: E741
        final[f"{close_column}_rsi_{p}"] = _enough(F.col("__gain"), wp, p, F.when((l == 0) & (g == 0), None).when(l == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(g, l))))
    return _with_temporary(df, tmp, final)


def augment_cmo(data: DataFrame | Panel, date_column: str, close_column: str, periods=14, by: Sequence[str] = (), order_by=None) -> DataFrame:
    """close_cmo_p = 100 (gains - losses) / (gains + losses) over the last p changes."""
    df, _, w, _ = _start(data, date_column, by, order_by)
    c = numeric(df, close_column)
    change = c - F.lag(c).over(w)
    tmp = {"__gain": F.greatest(change, F.when(change.isNotNull(), 0.0)), "__loss": F.greatest(-change, F.when(change.isNotNull(), 0.0))}
    final = {}
    for p in steps_of(periods):
        wp = _rows(w, p)
        g, l = F.sum("__gain").over(wp), F.sum("__loss").over(wp)  # noqa: E741
        final[f"{close_column}_cmo_{p}"] = _enough(F.col("__gain"), wp, p, 100 * F.try_divide(g - l, g + l))
    return _with_temporary(df, tmp, final)


def augment_roc(data: DataFrame | Panel, date_column: str, close_column: str, periods=1, start_index: int = 0, by: Sequence[str] = (), order_by=None) -> DataFrame:
    """close_roc_start_p: the value ``start_index`` rows ago relative to the one p rows ago, minus 1."""
    df, _, w, _ = _start(data, date_column, by, order_by)
    c = numeric(df, close_column)
    ps = steps_of(periods)
    if start_index >= min(ps):
        raise ValueError("start_index lies below the periods")
    now = F.lag(c, start_index).over(w) if start_index else c
    return df.withColumns({f"{close_column}_roc_{start_index}_{p}": F.try_divide(now, F.lag(c, p).over(w)) - 1 for p in ps})


def augment_bbands(data: DataFrame | Panel, date_column: str, close_column: str, periods=20, std_dev=2, by: Sequence[str] = (), order_by=None) -> DataFrame:
    """close_bband_middle/upper/lower_p_s: mean of p rows and s sample standard deviations to either side."""
    df, _, w, _ = _start(data, date_column, by, order_by)
    c = numeric(df, close_column)
    new = {}
    for p in steps_of(periods):
        wp = _rows(w, p)
        mean, std = F.avg(c).over(wp), F.stddev_samp(c).over(wp)
        for s in std_dev if isinstance(std_dev, (list, tuple)) else [std_dev]:
            for part, value in (("middle", mean), ("upper", mean + std * float(s)), ("lower", mean - std * float(s))):
                new[f"{close_column}_bband_{part}_{p}_{float(s):.1f}"] = _enough(c, wp, p, value)
    return df.withColumns(new)


def _true_range(df, w, high, low, close) -> Column:
    h, l, before = numeric(df, high), numeric(df, low), F.lag(numeric(df, close)).over(w)  # noqa: E741
    return F.greatest(h - l, F.abs(h - before), F.abs(l - before))


def augment_atr(data: DataFrame | Panel, date_column: str, high_column: str, low_column: str, close_column: str, periods=20, normalize: bool = False,
                by: Sequence[str] = (), order_by=None) -> DataFrame:
    """close_atr_p: mean true range of up to p rows; close_natr_p: in percent of the close."""
    df, _, w, _ = _start(data, date_column, by, order_by)
    final = {}
    for p in steps_of(periods):
        mean = F.avg("__tr").over(_rows(w, p))
        final[f"{close_column}_{'n' if normalize else ''}atr_{p}"] = F.try_divide(mean, numeric(df, close_column)) * 100 if normalize else mean
    return _with_temporary(df, {"__tr": _true_range(df, w, high_column, low_column, close_column)}, final)


def augment_stochastic_oscillator(data: DataFrame | Panel, date_column: str, high_column: str, low_column: str, close_column: str, k_periods=14, d_periods=3,
                                  by: Sequence[str] = (), order_by=None) -> DataFrame:
    """close_stoch_k_k: the close's place between lowest low and highest high of up to k rows, in percent; close_stoch_d_k_d: its mean over up to d rows."""
    df, _, w, _ = _start(data, date_column, by, order_by)
    first, second = {}, {}
    for k in steps_of(k_periods):
        wk = _rows(w, k)
        lo, hi = F.min(numeric(df, low_column)).over(wk), F.max(numeric(df, high_column)).over(wk)
        name = f"{close_column}_stoch_k_{k}"
        first[name] = 100 * F.try_divide(numeric(df, close_column) - lo, hi - lo)
        for d in steps_of(d_periods):
            second[f"{close_column}_stoch_d_{k}_{d}"] = F.avg(name).over(_rows(w, d))
    return df.withColumns(first).withColumns(second)


def augment_drawdown(data: DataFrame | Panel, date_column: str, close_column: str, by: Sequence[str] = (), order_by=None) -> DataFrame:
    """close_peak, close_drawdown and close_drawdown_pct: the highest value so far and the distance from it."""
    df, _, w, _ = _start(data, date_column, by, order_by)
    c = numeric(df, close_column)
    peak = F.when(c.isNotNull(), F.max(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = df.withColumns({f"{close_column}_peak": peak})
    p = F.col(f"{close_column}_peak")
    return out.withColumns({f"{close_column}_drawdown": c - p, f"{close_column}_drawdown_pct": F.try_divide(c - p, p)})


def augment_qsmomentum(data: DataFrame | Panel, date_column: str, close_column: str, roc_fast_period=21, roc_slow_period=252, returns_period=126,
                       by: Sequence[str] = (), order_by=None) -> DataFrame:
    """close_qsmom_f_s_r = (slow rate of change - fast rate of change) / population deviation of the last r returns, for f < s and r <= s; needs s + 1 rows with a value."""
    df, _, w, _ = _start(data, date_column, by, order_by)
    c = numeric(df, close_column)
    tmp = {"__ret": F.try_divide(c, F.lag(c).over(w)) - 1}
    final = {}
    for f in steps_of(roc_fast_period):
        for s in steps_of(roc_slow_period):
            for r in steps_of(returns_period):
                if f < s and r <= s:
                    sd = F.stddev_pop("__ret").over(_rows(w, r))
                    fast, slow = F.lag(c, f).over(w), F.lag(c, s).over(w)
                    gap = F.try_divide(fast - slow, slow + 1e-10) - F.try_divide(c - fast, fast + 1e-10)
                    final[f"{close_column}_qsmom_{f}_{s}_{r}"] = F.when((F.count(c).over(_rows(w, s + 1)) == s + 1) & (sd >= 1e-10), F.try_divide(gap, sd))
    return _with_temporary(df, tmp, final)


def augment_fip_momentum(data: DataFrame | Panel, date_column: str, close_column: str, window=252, fip_method: str = "original", skip_window: int = 0,
                         by: Sequence[str] = (), order_by=None) -> DataFrame:
    """close_fip_momentum_w: total return of w rows times (share of falling - share of rising rows), or with 'modified' the total's sign times the opposite
    difference; the series' first ``skip_window`` rows are null."""
    if fip_method not in ("original", "modified"):
        raise ValueError("fip_method is 'original' or 'modified'")
    df, _, w, _ = _start(data, date_column, by, order_by)
    c = numeric(df, close_column)
    tmp = {"__ret": F.try_divide(c, F.lag(c).over(w)) - 1, "__row": F.row_number().over(w)}
    r = F.col("__ret")
    final = {}
    for n in steps_of(window):
        wn = _rows(w, n)
        total = F.product(1 + r).over(wn) - 1
        up, down = F.avg((r > 0).cast("double")).over(wn), F.avg((r < 0).cast("double")).over(wn)
        value = total * (down - up) if fip_method == "original" else F.signum(total) * (up - down)
        final[f"{close_column}_fip_momentum_{n}"] = F.when((F.count(r).over(wn) >= n) & (F.col("__row") > skip_window), value)
    return _with_temporary(df, tmp, final)


RISK_METRICS = ("sharpe_ratio", "sortino_ratio", "treynor_ratio", "information_ratio", "omega_ratio", "volatility_annualized", "skewness", "kurtosis")


def augment_rolling_risk_metrics(data: DataFrame | Panel, date_column: str, close_column: str, window=252, risk_free_rate: float = 0.0, benchmark_column: str | None = None,
                                 annualization_factor: int = 252, metrics: Sequence[str] | None = None, by: Sequence[str] = (), order_by=None) -> DataFrame:
    """close_metric_w on log returns of up to w rows, from w // 2 returns on. Treynor and information ratio need a benchmark; the information ratio is not annualised;
    skewness and (excess) kurtosis are those of the population."""
    chosen = list(metrics or RISK_METRICS)
    unknown = set(chosen) - set(RISK_METRICS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    df, _, w, _ = _start(data, date_column, by, order_by)

    def log_return(name: str) -> Column:
        x = numeric(df, name)
        ratio = F.try_divide(x, F.lag(x).over(w))
        return F.when(ratio > 0, F.ln(ratio))

    tmp = {"__r": log_return(close_column)}
    if benchmark_column:
        tmp["__b"] = log_return(benchmark_column)
    r, b = F.col("__r"), F.col("__b")
    scale = math.sqrt(annualization_factor)
    final = {}
    for n in steps_of(window):
        wn = _rows(w, n)
        least = max(1, n // 2)
        mean = F.avg(r).over(wn)
        excess = mean - risk_free_rate
        std = F.stddev_samp(r).over(wn)
        down = F.avg(F.pow(F.least(r, F.when(r.isNotNull(), 0.0)), 2)).over(wn)
        spread = F.var_pop(r).over(wn)
        made = {
            "sharpe_ratio": F.try_divide(excess, std) * scale, "sortino_ratio": F.when(down > 1e-20, excess / F.sqrt(down) * scale), "volatility_annualized": std * scale,
            "omega_ratio": F.try_divide(F.sum(F.greatest(r, F.when(r.isNotNull(), 0.0))).over(wn), -F.sum(F.least(r, F.when(r.isNotNull(), 0.0))).over(wn)),
            "skewness": F.when(spread > 0, F.skewness(r).over(wn)), "kurtosis": F.when(spread > 0, F.kurtosis(r).over(wn)),
        }
        if benchmark_column:
            both = F.count(r * b).over(wn) >= least
            cov = F.avg(r * b).over(wn) - mean * F.avg(b).over(wn)
            var = F.avg(b * b).over(wn) - F.pow(F.avg(b).over(wn), 2)
            made["treynor_ratio"] = F.when(both, F.try_divide(excess, F.try_divide(cov, var)) * scale)
            made["information_ratio"] = F.when(both, F.try_divide(mean - F.avg(b).over(wn), F.stddev_samp(r - b).over(wn)))
        for m in chosen:
            if m in made:
                final[f"{close_column}_{m}_{n}"] = _enough(r, wn, least, made[m])
    return _with_temporary(df, tmp, final)


def _ema(g, alpha: float, least: int = 0):
    return g.transform(lambda s: s.ewm(alpha=alpha, adjust=False, min_periods=least).mean())


def augment_macd(data: DataFrame | Panel, date_column: str, close_column: str, fast_period: int = 12, slow_period: int = 26, signal_period: int = 9,
                 by: Sequence[str] = (), order_by=None) -> DataFrame:
    """close_macd_line_f_s_g, close_macd_signal_line_f_s_g and close_macd_histogram_f_s_g from recursive averages of spans f, s and g."""
    df, keys, _, order = _start(data, date_column, by, order_by)
    tail = f"{fast_period}_{slow_period}_{signal_period}"
    names = [f"{close_column}_macd_{x}_{tail}" for x in ("line", "signal_line", "histogram")]
    a, b, c = (2 / (1 + n) for n in (fast_period, slow_period, signal_period))

    def kernel(body: pd.DataFrame) -> pd.DataFrame:
        g = body.groupby("__s", sort=False)[close_column]
        line = _ema(g, a) - _ema(g, b)
        signal = _ema(line.groupby(body["__s"], sort=False), c)
        return pd.DataFrame(dict(zip(names, (line, signal, line - signal))))

    return series_map(df, keys, order, [close_column], [(n, "double") for n in names], kernel, max(memory_of(a), memory_of(b)) + memory_of(c))


def augment_ppo(data: DataFrame | Panel, date_column: str, close_column: str, fast_period: int = 12, slow_period: int = 26, by: Sequence[str] = (), order_by=None) -> DataFrame:
    """close_ppo_line_f_s: the fast average's distance from the slow one, in percent."""
    df, keys, _, order = _start(data, date_column, by, order_by)
    name = f"{close_column}_ppo_line_{fast_period}_{slow_period}"
    a, b = 2 / (1 + fast_period), 2 / (1 + slow_period)

    def kernel(body: pd.DataFrame) -> pd.DataFrame:
        g = body.groupby("__s", sort=False)[close_column]
        slow = _ema(g, b)
        return pd.DataFrame({name: (_ema(g, a) - slow) / slow.where(slow != 0) * 100})

    return series_map(df, keys, order, [close_column], [(name, "double")], kernel, max(memory_of(a), memory_of(b)))


def augment_adx(data: DataFrame | Panel, date_column: str, high_column: str, low_column: str, close_column: str, periods=14, by: Sequence[str] = (), order_by=None) -> DataFrame:
    """close_plus_di_p, close_minus_di_p and close_adx_p with averages of weight 1 / p, from p rows on."""
    df, keys, _, order = _start(data, date_column, by, order_by)
    ps = steps_of(periods)
    names = [f"{close_column}_{x}_{p}" for p in ps for x in ("plus_di", "minus_di", "adx")]

    def kernel(body: pd.DataFrame) -> pd.DataFrame:
        s = body["__s"]
        h, l, c = (body[x] for x in (high_column, low_column, close_column))  # noqa: E741
        by_series = lambda x: x.groupby(s, sort=False)
        before = by_series(c).shift(1)
        tr = pd.concat([h - l, (h - before).abs(), (l - before).abs()], axis=1).max(axis=1)
        up, down = h - by_series(h).shift(1), by_series(l).shift(1) - l
        plus, minus = (pd.Series(np.where(x > y, np.maximum(x, 0), 0.0), index=body.index) for x, y in ((up, down), (down, up)))
        new = {}
        for p in ps:
            smooth = _ema(by_series(tr), 1 / p, p)
            smooth = smooth.where(smooth != 0)
            pdi, mdi = 100 * _ema(by_series(plus), 1 / p, p) / smooth, 100 * _ema(by_series(minus), 1 / p, p) / smooth
            total = (pdi + mdi).where(pdi + mdi != 0)
            dx = 100 * (pdi - mdi).abs() / total
            new |= {f"{close_column}_plus_di_{p}": pdi, f"{close_column}_minus_di_{p}": mdi, f"{close_column}_adx_{p}": _ema(by_series(dx), 1 / p, p)}
        return pd.DataFrame(new)

    return series_map(df, keys, order, list(dict.fromkeys([high_column, low_column, close_column])), [(n, "double") for n in names], kernel, max(2 * memory_of(1 / p) + 2 * p for p in ps))


def augment_ewma_volatility(data: DataFrame | Panel, date_column: str, close_column: str, decay_factor: float = 0.94, window=20, by: Sequence[str] = (), order_by=None) -> DataFrame:
    """close_ewma_vol_w_decay: root of the recursive mean of squared log returns, from w returns on."""
    df, keys, _, order = _start(data, date_column, by, order_by)
    ws = steps_of(window)
    names = {n: f"{close_column}_ewma_vol_{n}_{decay_factor:.2f}" for n in ws}

    def kernel(body: pd.DataFrame) -> pd.DataFrame:
        s = body["__s"]
        ratio = body[close_column] / body.groupby("__s", sort=False)[close_column].shift(1)
        ratio = ratio.where((ratio > 0) & np.isfinite(ratio))
        square = np.log(ratio) ** 2
        return pd.DataFrame({names[n]: np.sqrt(_ema(square.groupby(s, sort=False), 1 - decay_factor, n)) for n in ws})

    return series_map(df, keys, order, [close_column], [(n, "double") for n in names.values()], kernel, memory_of(1 - decay_factor) + max(ws) + 1)


def rescaled_range(window: np.ndarray) -> np.ndarray:
    """Exponent ln(R/S) / ln(n) of each row of values; NaN for fewer than 8, constant or gappy rows, or a result outside 0..1."""
    n = window.shape[1]
    if n < 8:
        return np.full(len(window), np.nan)
    centred = window - window.mean(1, keepdims=True)
    path = np.cumsum(centred, axis=1)
    reach, spread = path.max(1) - path.min(1), window.std(1)
    with np.errstate(all="ignore"):
        h = np.log(reach / spread) / np.log(n)
    flat = (window == window[:, :1]).all(1)
    return np.where(flat | ~((h >= 0) & (h <= 1)), np.nan, h)


def augment_hurst_exponent(data: DataFrame | Panel, date_column: str, close_column: str, window=100, by: Sequence[str] = (), order_by=None) -> DataFrame:
    """close_hurst_w: rescaled-range exponent of the last w values."""
    df, keys, _, order = _start(data, date_column, by, order_by)
    ws = steps_of(window)

    def kernel(body: pd.DataFrame) -> pd.DataFrame:
        x, s = body[close_column].to_numpy(), body["__s"].to_numpy()
        new = {}
        for n in ws:
            out = np.full(len(x), np.nan)
            if len(x) >= n:
                same = np.flatnonzero(s[n - 1 :] == s[: len(s) - n + 1])
                view = np.lib.stride_tricks.sliding_window_view(x, n)
                for a in range(0, len(same), 4096):
                    part = same[a : a + 4096]
                    out[part + n - 1] = rescaled_range(view[part])
            new[f"{close_column}_hurst_{n}"] = out
        return pd.DataFrame(new)

    return series_map(df, keys, order, [close_column], [(f"{close_column}_hurst_{n}", "double") for n in ws], kernel, max(ws) - 1)


def _hmm(x: np.ndarray, states: int, rounds: int, start: tuple | None):
    """Gaussian hidden Markov model by Baum-Welch with scaling: (means, variances, transitions, first weights, smoothed states of the values).

    Forward and backward weights are products of one matrix a value, built for all values at once by doubling.
    """
    n = len(x)
    if start is None:
        means = np.quantile(x, (np.arange(states) + 0.5) / states)
        var = np.full(states, x.var() + 1e-12)
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9)
        first = np.full(states, 1 / states)
    else:
        means, var, move, first = (a.copy() for a in start)
    floor = max(x.var() * 1e-4, 1e-14)
    last = None
    smooth = np.full((n, states), 1 / states)
    for _ in range(rounds):
        emit = np.exp(-0.5 * (x[:, None] - means) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
        scale = np.empty(n)
        scale[0] = (first * emit[0]).sum()
        ahead = move * emit[1:, None]
        ahead /= ahead.max((1, 2), keepdims=True)
        after = ahead.copy()
        d = 1
        while d < n - 1:
            ahead[d:] = ahead[:-d] @ ahead[d:]
            after[:-d] = after[:-d] @ after[d:]
            ahead /= ahead.max((1, 2), keepdims=True)
            after /= after.max((1, 2), keepdims=True)
            d *= 2
        fwd = np.concatenate([(first * emit[0])[None], (first * emit[0]) @ ahead])
        fwd /= fwd.sum(1, keepdims=True)
        bwd = np.concatenate([after.sum(2), np.ones((1, states))])
        bwd /= (fwd * bwd).sum(1, keepdims=True)
        scale[1:] = (fwd[:-1] @ move * emit[1:]).sum(1)
        smooth = fwd * bwd
        pair = (fwd[:-1, :, None] * move * (emit[1:] * bwd[1:] / scale[1:, None])[:, None, :]).sum(0)
        like = np.log(scale).sum()
        weight = smooth.sum(0) + 1e-10
        means = (smooth * x[:, None]).sum(0) / weight
        var = np.maximum((smooth * (x[:, None] - means) ** 2).sum(0) / weight, floor)
        move = (pair + 1e-6) / (pair + 1e-6).sum(1, keepdims=True)
        first = smooth[0]
        if last is not None and abs(like - last) < 1e-4 * max(1, abs(last)):
            break
        last = like
    return means, var, move, first, smooth


def augment_regime_detection(data: DataFrame | Panel, date_column: str, close_column: str, window=252, n_regimes: int = 2, step_size: int = 1, n_iter: int = 100,
                             by: Sequence[str] = (), order_by=None) -> DataFrame:
    """close_regime_w: state of the last log return in a Gaussian hidden Markov model refitted on each window, states numbered by rising mean.

    A fit starts from the one before; with ``step_size`` each fit gives the last ``step_size`` returns of its window their own states, and a last one those
    left at the end. Windows need max(w // 2, 10 n_regimes) returns; a row without a return has no state.
    A series runs in one task, as each fit starts from the one before.
    """
    from pyspark.sql import types as T

    from loomtime.operators.series import whole_series

    df, keys, _, order = _start(data, date_column, by, order_by)
    ws = steps_of(window)

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        c = part[close_column].astype(float)
        ratio = c / c.shift(1)
        r = np.log(ratio.where(ratio > 0)).to_numpy()
        new = {}
        for w in ws:
            out, model, done = [None] * len(r), None, -1
            least = max(w // 2, 10 * n_regimes)
            for i in range(len(r)):
                regular = (i - w + 1) % step_size == 0
                if not regular and i < len(r) - 1:
                    continue
                at = np.arange(max(0, i - w + 1), i + 1)
                at = at[~np.isnan(r[at])]
                if len(at) >= least:
                    *model, smooth = _hmm(r[at], n_regimes, n_iter, model)
                    states = np.argsort(np.argsort(model[0]))[smooth.argmax(1)]
                    fresh = np.arange(len(at)) >= len(at) - step_size if regular else at > done
                    for k in np.flatnonzero(fresh):
                        out[at[k]] = int(states[k])
                    done = i
            new[f"{close_column}_regime_{w}"] = pd.array(out, dtype="Int32")
        return part.assign(**new)

    return whole_series(df, keys, order, [T.StructField(f"{close_column}_regime_{w}", T.IntegerType()) for w in ws], kernel)
