"""Small literal inputs with known results."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtime.functions.dates import ceil_date, floor_date, is_holiday, week_of_month
from loomtime.functions.freq import Freq, normalize_frequency_alias, parse_freq_str, parse_human_duration
from loomtime.functions.select import (Panel, contains, drop_zero_variance, ends_with, filter_by_time, flatten_multiindex_column_names, glimpse, group, matches,
                                       reduce_memory_usage, resolve_column_selection, sort_dataframe, starts_with, transform_columns)
from loomtime.operators import ranges
from loomtime.operators.series import series_map
from loomtime.operators import apply, basis, calendar, decompose, finance, frequency, funnel, grid, plotdata, rolling, shift, timeagg, tsfeatures, validation


def frame(spark, data: dict):
    pdf = pd.DataFrame(data)
    return spark.createDataFrame(pdf)


def days(start, n):
    return pd.date_range(start, periods=n, freq="D")


def test_summarize_monthly_sums(spark):
    df = frame(spark, {"date": days("2020-01-01", 60), "value": range(1, 61)})
    out = timeagg.summarize_by_time(df, "date", "value", "M", "sum").orderBy("date").toPandas()
    assert list(out.value) == [496, 1334] and list(out.date) == [pd.Timestamp("2020-01-31"), pd.Timestamp("2020-02-29")]


@pytest.mark.parametrize("freq", ["D", "2D", "W", "MS", "ME", "QS", "QE", "YS", "YE", "6h", "h", "2MS"])
def test_summarize_matches_pandas(spark, freq):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"date": pd.Timestamp("2020-01-05 03:10") + pd.to_timedelta(rng.integers(0, 400 * 24, 300), "h"), "value": rng.normal(size=300).round(3), "g": rng.choice(["a", "b"], 300)})
    out = timeagg.summarize_by_time(spark.createDataFrame(pdf), "date", "value", freq, ["sum", "mean", "count"], by=["g"]).toPandas().sort_values(["g", "date"]).reset_index(drop=True)
    want = pdf.set_index("date").groupby("g")["value"].resample(freq).agg(["sum", "mean", "count"]).fillna(0).reset_index()
    assert list(out.date) == list(want.date)
    np.testing.assert_allclose(out[["value_sum", "value_mean", "value_count"]], want[["sum", "mean", "count"]], atol=1e-9)


def test_summarize_edges(spark):
    df = spark.createDataFrame([(None, None, 1.0), ("a", dt.datetime(2020, 1, 1), float("nan")), ("a", dt.datetime(2020, 1, 3), 2.0), (None, dt.datetime(2020, 1, 1), 5.0)], "g string, date timestamp, value double")
    out = timeagg.summarize_by_time(group(df, "g"), "date", "value", "D", "mean", fillna=None).orderBy("date").collect()
    assert [r["value"] for r in out] == [None, None, 2.0]
    assert timeagg.summarize_by_time(df.limit(0), "date", "value", "D", by=["g"]).count() == 0
    with pytest.raises(ValueError):
        timeagg.summarize_by_time(df, "date", "value", "D", "nonsense")
    with pytest.raises(TypeError):
        timeagg.summarize_by_time(df, "g", "value")
    wide = timeagg.summarize_by_time(df, "date", "value", "D", "sum", True, by=["g"])
    assert wide.columns == ["date", "value_a"]


def test_summarize_callable_and_apply(spark):
    df = frame(spark, {"g": list("AAABB"), "date": pd.to_datetime(["2023-01-01", "2023-01-02", "2023-01-03", "2023-01-01", "2023-01-03"]), "value": [1, 2, 3, 4, 5]})
    out = timeagg.summarize_by_time(df, "date", "value", "D", ["sum", ("range", lambda x: x.max() - x.min())], by=["g"])
    assert out.columns[-2:] == ["value_sum", "value_range"] and out.count() == 6
    got = timeagg.apply_by_time(df, "date", "D", by=["g"], total=lambda p: p["value"].sum(), n=lambda p: len(p)).orderBy("g", "date").toPandas()
    assert list(got.total) == [1, 2, 3, 4, 0, 5] and list(got.n) == [1, 1, 1, 1, 0, 1]


def test_pad(spark):
    df = frame(spark, {"date": days("2022-01-01", 6), "value": [1, 2, 3, 4, 5, 6], "group": list("ABABBA")})
    out = grid.pad_by_time(df, "date", "D", by=["group"]).toPandas()
    assert len(out) == 12 and out.value.isna().sum() == 6
    assert grid.pad_by_time(df, "date", "D", end_date="2022-01-10", fillna=0, by=["group"]).where("value = 0").count() == 14
    assert grid.pad_by_time(df.limit(0), "date", "D").count() == 0
    with pytest.raises(ValueError):
        grid.pad_by_time(df, "date", "D", "2023-01-01", "2022-01-01")


def test_pad_keeps_constant_columns(spark):
    df = frame(spark, {"date": pd.to_datetime(["2022-01-01", "2022-01-03"]), "g": ["a", "a"], "kind": ["k", "k"], "value": [1.0, 2.0]})
    out = grid.pad_by_time(df, "date", "D", by=["g"]).orderBy("date").toPandas()
    assert list(out.kind) == ["k"] * 3 and out.value.isna().tolist() == [False, True, False]


def test_future(spark):
    df = frame(spark, {"date": days("2022-01-03", 4), "value": [1, 2, 3, 4]})
    out = grid.future_frame(df, "date", 2).orderBy("date").toPandas()
    assert list(out.date[-2:]) == [pd.Timestamp("2022-01-07"), pd.Timestamp("2022-01-08")]
    b = frame(spark, {"date": pd.bdate_range("2022-01-03", periods=10), "value": range(10)})
    dates = [r["date"] for r in grid.future_frame(b, "date", 3, bind_data=False).orderBy("date").collect()]
    assert [d.day for d in dates] == [17, 18, 19]
    assert grid.future_frame(df, "date", "3 days", "D", bind_data=False).count() == 3
    assert [r["date"].strftime("%m-%d") for r in grid.make_future_timeseries(spark, ["2024-01-31", "2024-02-29", "2024-03-31"], 2).orderBy("date").collect()] == ["04-30", "05-31"]


def test_sequences(spark):
    assert grid.make_weekday_sequence(spark, "2023-01-01", "2023-01-08").count() == 5
    assert grid.make_weekday_sequence(spark, "2023-01-01", "2023-01-08", True).count() == 6
    assert grid.make_weekday_sequence(spark, "2023-07-03", "2023-07-07", remove_holidays=True).count() == 4
    assert grid.make_weekend_sequence(spark, "2023-01-01", "2023-01-08").count() == 3


def test_filter_bounds(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 12, 31), ), (dt.datetime(2020, 12, 31, 5), ), (dt.datetime(2021, 1, 1, 23, 59), ), (None, )], "date timestamp")
    assert filter_by_time(df, "date").count() == 3
    assert filter_by_time(df, "date", "start", "2020").count() == 1
    assert filter_by_time(df, "date", "2020-12-31", "2020-12-31").count() == 2
    assert filter_by_time(df, "date", "2021-01-01 23", "end").count() == 1


def test_dates(spark):
    one = spark.createDataFrame([(dt.datetime(2022, 1, 4, 1, 2, 3),)], "t timestamp")
    got = one.select(floor_date("t", "W"), floor_date("t", "M"), floor_date("t", "2Q"), floor_date("t", "h"), ceil_date("t", "D"), ceil_date("t", "Y"), week_of_month("t")).first()
    assert got[0] == dt.datetime(2022, 1, 3) and got[1] == dt.datetime(2022, 1, 1) and got[2] == dt.datetime(2022, 1, 1) and got[3] == dt.datetime(2022, 1, 4, 1)
    assert got[4] == dt.datetime(2022, 1, 5) and got[5] == dt.datetime(2023, 1, 1) and got[6] == 1
    on_border = spark.createDataFrame([(dt.datetime(2022, 1, 1),)], "t timestamp").select(ceil_date("t", "M")).first()[0]
    assert on_border == dt.datetime(2022, 2, 1)
    assert parse_freq_str("2W-MON") == (2, "W", "MON") and normalize_frequency_alias("H") == "h" and str(Freq.of("3 days")) == "3D"
    assert parse_human_duration("1 month 2 days") == (1, 2 * 86_400_000_000) and parse_human_duration(5) == (0, 5_000_000)
    for bad in ("", "1.5 months", "3 parsecs"):
        with pytest.raises(ValueError):
            parse_human_duration(bad)
    assert one.select(is_holiday(F.lit("2024-07-04"))).first()[0] is True
    with pytest.raises(ValueError):
        is_holiday("t", "Atlantis")


def test_holidays_and_signature(spark):
    df = frame(spark, {"date": days("2023-01-01", 10)})
    out = calendar.augment_holiday_signature(df, "date").orderBy("date").toPandas()
    assert out.is_holiday[0] == 1 and out.holiday_name[0].startswith("New Year") and out.after_holiday.sum() == 2
    sig = calendar.get_timeseries_signature(df, "date").orderBy("date").toPandas()
    assert sig.shape[1] == 30 and sig.date_weekend[0] == 1 and sig.date_weekend[6] == 0 and sig.date_quarteryear[0] == "2023Q1"


def test_selectors(spark):
    df = spark.createDataFrame([(1, 2.5, "x", 7)], "price int, price_usd double, name string, k int")
    assert resolve_column_selection(df, [starts_with("price"), "name"]) == ["price", "price_usd", "name"]
    assert resolve_column_selection(df, contains("USD", case=False)) == ["price_usd"] and resolve_column_selection(df, ends_with("e")) == ["price", "name"]
    assert resolve_column_selection(df, matches("^k$")) == ["k"] and resolve_column_selection(df, None, allow_none=True) == []
    with pytest.raises(ValueError):
        resolve_column_selection(df, "nope")
    assert drop_zero_variance(df.union(df.withColumn("k", F.lit(8)))).columns == ["k"]
    assert transform_columns(df, "price.*", lambda c: c + 1).first()["price_usd"] == 3.5
    assert flatten_multiindex_column_names([("a", "b"), "c"]) == ["a_b", "c"] and "price" in glimpse(df)
    assert dict(reduce_memory_usage(df).dtypes)["price"] == "tinyint" and dict(reduce_memory_usage(df).dtypes)["price_usd"] == "float"
    assert isinstance(group(df, "name"), Panel) and sort_dataframe(df, "k").count() == 1


def test_shift(spark):
    df = frame(spark, {"date": days("2021-01-01", 6), "value": [10, 12, 15, 18, 21, 25], "id": list("AAABBB")})
    out = shift.augment_diffs(group(df, "id"), "date", "value", [1, 2]).orderBy("id", "date").toPandas()
    assert out.value_diff_1.isna().sum() == 2 and list(out.value_diff_1.dropna()) == [2, 3, 3, 4]
    pct = shift.augment_pct_change(group(df, "id"), "date", "value").orderBy("date").toPandas()
    assert pct.value_pctdiff_1[1] == pytest.approx(0.2)
    zero = frame(spark, {"date": days("2021-01-01", 3), "value": [0.0, 1.0, 2.0]})
    assert shift.augment_pct_change(zero, "date", "value").where("value_pctdiff_1 IS NULL").count() == 2
    lag = shift.augment_lags(df, "date", "value", (1, 3))
    assert lag.columns[-3:] == ["value_lag_1", "value_lag_2", "value_lag_3"]
    assert shift.augment_leads(df, "date", "value").orderBy("date").first()["value_lead_1"] == 12
    assert shift.resolve_lag_sequence(df, "date", "2 days") == [0, 1, 2] and shift.resolve_lag_sequence(df, "date", 100) == list(range(6))
    with pytest.raises(ValueError):
        shift.augment_lags(df, "date", "value", 0)


def test_rolling_keeps_first_min_periods(spark):
    df = frame(spark, {"date": days("2021-01-01", 3), "value": [1, 2, 3]})
    out = rolling.augment_rolling(df, "date", "value", ["mean", "sum"], [2, 3]).orderBy("date").toPandas()
    assert np.isnan(out.value_rolling_mean_win_3[0]) and list(out.value_rolling_mean_win_3[1:]) == [1.5, 2.0]


@pytest.mark.parametrize("func", ["mean", "sum", "std", "var", "min", "max", "median", "count", "skew", "kurt", "sem"])
@pytest.mark.parametrize("center", [False, True])
def test_rolling_matches_pandas(spark, func, center):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"date": days("2021-01-01", 40), "value": rng.normal(size=40)})
    pdf.loc[[3, 17], "value"] = np.nan
    got = rolling.augment_rolling(spark.createDataFrame(pdf), "date", "value", func, 6, 4, center).orderBy("date").toPandas()[f"value_rolling_{func}_win_6"]
    want = getattr(pdf.value.rolling(6, min_periods=4, center=center), func)()
    np.testing.assert_allclose(got.to_numpy(float), want, atol=1e-8)


def test_rolling_custom_and_quantiles(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"date": list(days("2021-01-01", 30)) * 2, "value": rng.normal(size=60), "g": ["a"] * 30 + ["b"] * 30})
    df = spark.createDataFrame(pdf)
    out = rolling.augment_rolling(df, "date", "value", [("iqr", lambda x: np.subtract(*np.percentile(x, [75, 25]))), rolling.pd_quantile(0.3, "midpoint"), "rank"], 5, by=["g"]).toPandas().sort_values(["g", "date"])
    pdf = pdf.sort_values(["g", "date"])
    r = pdf.groupby("g").value.rolling(5)
    np.testing.assert_allclose(out.value_rolling_iqr_win_5, r.apply(lambda x: np.subtract(*np.percentile(x, [75, 25])), raw=True), atol=1e-9)
    np.testing.assert_allclose(out.value_rolling_quantile_30_win_5, r.quantile(0.3, interpolation="midpoint"), atol=1e-9)
    np.testing.assert_allclose(out.value_rolling_rank_win_5, r.rank(), atol=1e-9)
    e = rolling.augment_expanding(df, "date", "value", ["median", ("last", lambda x: x[-1])], by=["g"]).toPandas().sort_values(["g", "date"])
    np.testing.assert_allclose(e.value_expanding_median, pdf.groupby("g").value.expanding().median(), atol=1e-9)
    np.testing.assert_allclose(e.value_expanding_last, pdf.value, atol=1e-9)


def test_apply_windows(spark):
    pdf = pd.DataFrame({"date": days("2021-01-01", 12), "a": np.arange(12.0), "b": np.arange(12.0) ** 2})
    df = spark.createDataFrame(pdf)
    out = rolling.augment_rolling_apply(df, "date", [("corr", lambda w: rolling.correlation("a", "b", w)), ("span", lambda p: p["b"].max() - p["a"].min())], 4).orderBy("date").toPandas()
    np.testing.assert_allclose(out.rolling_corr_win_4, pdf.a.rolling(4).corr(pdf.b), atol=1e-8)
    assert out.rolling_span_win_4[5] == 25 - 2
    e = rolling.augment_expanding_apply(df, "date", [("total", lambda p: p["a"].sum())]).orderBy("date").toPandas()
    assert e.expanding_total.iloc[-1] == 66
    fit = lambda p: pd.Series(np.polyfit(p["a"], p["b"], 1), index=["slope", "start"])
    many = rolling.augment_rolling_apply(df, "date", ("line", fit), 3, return_type="map<string,double>").orderBy("date").collect()
    assert many[1]["rolling_line_win_3"] is None and many[5]["rolling_line_win_3"]["slope"] == pytest.approx(8)
    pair = rolling.augment_expanding_apply(df, "date", ("ends", lambda p: [p["a"].min(), p["a"].max()]), 2, return_type="array<double>").orderBy("date").collect()
    assert pair[0]["expanding_ends"] is None and pair[4]["expanding_ends"] == [0, 4]


@pytest.mark.parametrize("settings", [{"alpha": 0.3, "adjust": False}, {"span": 7}, {"halflife": 3.0, "ignore_na": True}, {"com": 2.0, "adjust": False, "min_periods": 3}])
def test_ewm_matches_pandas(spark, settings):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"date": list(days("2021-01-01", 200)) * 2, "value": rng.normal(size=400), "g": ["a"] * 200 + ["b"] * 200})
    pdf.loc[[5, 50, 51, 300], "value"] = np.nan
    out = rolling.augment_ewm(spark.createDataFrame(pdf).repartition(3), "date", "value", ["mean", "std"], by=["g"], **settings).toPandas().sort_values(["g", "date"])
    kind = next(k for k in settings if k in ("alpha", "span", "halflife", "com"))
    g = pdf.sort_values(["g", "date"]).groupby("g").value.ewm(**settings)
    np.testing.assert_allclose(out[f"value_ewm_mean_{kind}_{settings[kind]}"].to_numpy(float), g.mean(), atol=1e-9)
    np.testing.assert_allclose(out[f"value_ewm_std_{kind}_{settings[kind]}"].to_numpy(float), g.std(), atol=1e-9)
    with pytest.raises(ValueError):
        rolling.augment_ewm(spark.createDataFrame(pdf), "date", "value", alpha=0.1, span=3)


@pytest.fixture(scope="module")
def prices():
    rows = []
    for g, base in (("A", 900.0), ("B", 20.0)):
        for i in range(400):
            c = base * (1 + 0.0005 * i) + base / 50 * np.sin(i / 3) + base / 90 * np.cos(i * 1.7)
            rows.append((g, pd.Timestamp("2023-01-01") + pd.Timedelta(days=i), c, c + base / 90, c - base / 80, base + i * base / 500))
    return pd.DataFrame(rows, columns=["symbol", "date", "close", "high", "low", "benchmark"])


FINANCE = {
    "rsi": lambda d, by: finance.augment_rsi(d, "date", "close", [5, 14], by=by), "cmo": lambda d, by: finance.augment_cmo(d, "date", "close", by=by),
    "roc": lambda d, by: finance.augment_roc(d, "date", "close", 5, 1, by=by), "bbands": lambda d, by: finance.augment_bbands(d, "date", "close", 20, [1.5, 2], by=by),
    "atr": lambda d, by: finance.augment_atr(d, "date", "high", "low", "close", by=by), "stoch": lambda d, by: finance.augment_stochastic_oscillator(d, "date", "high", "low", "close", by=by),
    "drawdown": lambda d, by: finance.augment_drawdown(d, "date", "close", by=by), "qsmom": lambda d, by: finance.augment_qsmomentum(d, "date", "close", 5, 60, 30, by=by),
    "fip": lambda d, by: finance.augment_fip_momentum(d, "date", "close", 60, "modified", 70, by=by), "risk": lambda d, by: finance.augment_rolling_risk_metrics(d, "date", "close", 60, benchmark_column="benchmark", by=by),
    "macd": lambda d, by: finance.augment_macd(d, "date", "close", by=by), "ppo": lambda d, by: finance.augment_ppo(d, "date", "close", by=by), "adx": lambda d, by: finance.augment_adx(d, "date", "high", "low", "close", by=by),
    "ewma": lambda d, by: finance.augment_ewma_volatility(d, "date", "close", by=by), "hurst": lambda d, by: finance.augment_hurst_exponent(d, "date", "close", 50, by=by),
    "regime": lambda d, by: finance.augment_regime_detection(d, "date", "close", 60, 2, 30, 10, by=by),
}


@pytest.mark.parametrize("name", FINANCE)
def test_finance_groups_are_apart(spark, prices, name):
    df = spark.createDataFrame(prices).repartition(3)
    whole = FINANCE[name](df, ["symbol"]).where("symbol = 'B'").toPandas().sort_values("date").reset_index(drop=True)
    alone = FINANCE[name](df.where("symbol = 'B'"), []).toPandas().sort_values("date").reset_index(drop=True)
    assert list(whole.columns) == list(alone.columns) and len(whole) == 400
    new = [c for c in whole.columns if c not in prices.columns]
    assert new and all(whole[c].notna().any() for c in new)
    for c in new:
        np.testing.assert_allclose(whole[c].to_numpy(float), alone[c].to_numpy(float), rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("step", [1, 20])
def test_regimes_between_refits_are_decoded(spark, step):
    rng = np.random.default_rng(15)
    up = np.arange(250) // 7 % 2  # changes between refits
    close = 100 * np.exp(np.cumsum(np.where(up, 0.03, -0.03) + rng.normal(0, 0.004, 250)))
    close[120] = np.nan
    pdf = pd.DataFrame({"date": pd.date_range("2023-01-01", periods=250), "close": close})
    got = finance.augment_regime_detection(spark.createDataFrame(pdf), "date", "close", 60, 2, step).toPandas().sort_values("date").close_regime_60.to_numpy(float)
    assert np.isnan(got[[120, 121]]).all()  # no return, no state
    late = np.r_[60:120, 122:250]
    assert (got[late] == up[late]).mean() > 0.97


def test_finance_formulas(spark, prices):
    one = prices[prices.symbol == "A"].reset_index(drop=True)
    df = spark.createDataFrame(one).repartition(5)
    c = one.close
    ema = lambda s, n: s.ewm(span=n, adjust=False).mean()
    line = ema(c, 12) - ema(c, 26)
    got = finance.augment_macd(df, "date", "close").toPandas().sort_values("date")
    np.testing.assert_allclose(got.close_macd_line_12_26_9, line, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(got.close_macd_signal_line_12_26_9, ema(line, 9), rtol=1e-9, atol=1e-9)
    r = np.log(c / c.shift())
    vol = finance.augment_ewma_volatility(df, "date", "close").toPandas().sort_values("date")
    np.testing.assert_allclose(vol["close_ewma_vol_20_0.94"], np.sqrt((r**2).ewm(alpha=0.06, adjust=False, min_periods=20).mean()), rtol=1e-9)
    risk = finance.augment_rolling_risk_metrics(df, "date", "close", 60, metrics=["skewness", "kurtosis", "sharpe_ratio"]).toPandas().sort_values("date")
    w = r.iloc[-60:]
    m = w - w.mean()
    assert risk.close_skewness_60.iloc[-1] == pytest.approx((m**3).mean() / (m**2).mean() ** 1.5)
    assert risk.close_kurtosis_60.iloc[-1] == pytest.approx((m**4).mean() / (m**2).mean() ** 2 - 3)


def test_rsi_known(spark):
    up = frame(spark, {"date": days("2024-01-01", 20), "close": np.arange(1.0, 21)})
    got = finance.augment_rsi(up, "date", "close", 5).orderBy("date").toPandas().close_rsi_5
    assert got[:4].isna().all() and (got[4:] == 100).all()
    flat = frame(spark, {"date": days("2024-01-01", 20), "close": [10.0] * 20})
    assert finance.augment_rsi(flat, "date", "close", 5).where("close_rsi_5 IS NOT NULL").count() == 0


def test_basis(spark):
    pdf = pd.DataFrame({"date": days("2021-01-01", 64), "value": np.sin(np.arange(64) / 5)})
    df = spark.createDataFrame(pdf)
    f = basis.augment_fourier(df, "date", 7, 1).orderBy("date").toPandas()
    np.testing.assert_allclose(f.date_sin_1_7, np.sin(2 * np.pi * np.arange(64) / 7), atol=1e-9)
    h = basis.augment_hilbert(df, "date", "value").orderBy("date").toPandas()
    np.testing.assert_allclose(h.value_hilbert_real, pdf.value, atol=1e-9)
    w = basis.augment_wavelet(df, "date", "value", "bump", 1.0, [3]).toPandas()
    assert {"bump_scale_3_real", "bump_scale_3_imag"} <= set(w.columns)
    for kind, rows in (("bs", True), ("natural", False), ("cyclic", False)):
        s = basis.augment_spline(df, "date", "value", kind, 6, include_intercept=True).toPandas()
        new = [c for c in s.columns if "spline" in c]
        assert len(new) == 6 and s[new].notna().all().all()
        np.testing.assert_allclose(s[new].sum(axis=1), 1, atol=1e-8)


@pytest.mark.parametrize("freq,unit", [("min", "T"), ("h", "H"), ("D", "D"), ("W", "W"), ("MS", "M"), ("QS", "Q"), ("YS", "Y")])
def test_cadence(spark, freq, unit):
    df = spark.createDataFrame(pd.DataFrame({"date": pd.date_range("2020-01-01", periods=24, freq=freq)}))
    row = frequency.ts_summary(df, "date").first()
    assert row["date_n"] == 24 and row["freq_median_unit"] == unit and row["freq_inferred_unit"] is not None
    assert Freq.of(frequency.get_frequency(df, "date").split("-")[0]).n == 1


def test_periods(spark):
    df = spark.createDataFrame(pd.DataFrame({"date": pd.date_range("2020-01-01", periods=800, freq="D")}))
    assert frequency.get_seasonal_frequency(df, "date") == "1W" and frequency.get_seasonal_frequency(df, "date", numeric=True) == 7
    assert frequency.get_trend_frequency(df, "date") == "1Q" and 90 <= frequency.get_trend_frequency(df, "date", numeric=True) <= 92
    assert frequency.local_period(df.toPandas().date, 0) == 7
    assert frequency.get_date_summary(df, "date").first()["date_n"] == 800 and frequency.get_diff_summary(df, "date").first()["diff_mean_seconds"] == 86400
    assert frequency.timeseries_unit_frequency_table(spark).count() == 8 and frequency.time_scale_template(spark).count() == 8


def test_decomposition_adds_up(spark):
    n = 140
    y = np.sin(2 * np.pi * np.arange(n) / 7) * 3 + np.arange(n) * 0.1
    s, t, r = decompose.stl(y, 7, 7, 15, True)
    np.testing.assert_allclose(s + t + r, y, atol=1e-9)
    assert np.abs(r).max() < 0.2 and np.corrcoef(s, np.sin(2 * np.pi * np.arange(n) / 7))[0, 1] > 0.99
    df = frame(spark, {"date": days("2021-01-01", n), "value": y})
    out = decompose.stl_diagnostics(df, "date", "value").toPandas()
    np.testing.assert_allclose(out.season + out.trend + out.remainder, out.observed, atol=1e-9)


@pytest.mark.parametrize("method", ["stl", "twitter"])
@pytest.mark.parametrize("clean", ["min_max", "linear"])
def test_anomalize_finds_a_spike(spark, method, clean):
    y = np.sin(2 * np.pi * np.arange(120) / 7) + np.random.default_rng(5).normal(0, 0.1, 120)
    y[60] += 20
    df = frame(spark, {"date": days("2021-01-01", 120), "value": y, "extra": ["x"] * 120})
    out = decompose.anomalize(df, "date", "value", 7, 30, method, clean=clean).orderBy("date").toPandas()
    assert out.columns[-11:].tolist() == ["observed", "seasonal", "seasadj", "trend", "remainder", "anomaly", "anomaly_score", "anomaly_direction", "recomposed_l1", "recomposed_l2", "observed_clean"]
    assert out.anomaly[60] == "Yes" and out.anomaly_direction[60] == 1 and out.observed_clean[60] < 10


def test_acf(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"id": ["a"] * 50 + ["b"] * 50, "date": list(days("2020-01-01", 50)) * 2, "value": rng.normal(size=100).cumsum(), "driver": rng.normal(size=100)})
    out = decompose.acf_diagnostics(group(spark.createDataFrame(pdf), "id"), "date", "value", "driver", 8).toPandas()
    a = out[(out.id == "a")].set_index(["metric", "lag"]).value
    x = pdf[pdf.id == "a"].value.to_numpy() - pdf[pdf.id == "a"].value.mean()
    for k in range(1, 9):
        assert a["ACF", k] == pytest.approx((x[k:] * x[:-k]).sum() / (x**2).sum())
    assert a["ACF", 0] == pytest.approx(1) and a["PACF", 1] == pytest.approx(a["ACF", 1])
    m = np.array([[a["ACF", abs(i - j)] for j in range(3)] for i in range(3)])
    assert a["PACF", 3] == pytest.approx(np.linalg.solve(m, [a["ACF", 1], a["ACF", 2], a["ACF", 3]])[-1])
    assert set(out.metric) == {"ACF", "PACF", "CCF_driver"}


def test_seasonal_features_by_step_and_span(spark):
    hours, short = pd.date_range("2020-01-01", periods=24, freq="h"), days("2020-01-01", 24)
    two = lambda a, b: frame(spark, {"id": ["A"] * 24 + ["B"] * 24, "date": [*a, *b], "value": np.arange(48.0)})
    of = lambda df: {r[0] for r in df.select("seasonal_feature").distinct().collect()}
    hourly = frame(spark, {"date": hours, "value": np.arange(24.0)})
    assert of(decompose.seasonal_diagnostics(hourly, "date", "value")) == {"hour"}
    assert of(decompose.seasonal_diagnostics(hourly, "date", "value", ["hour", "wday.lbl"])) == {"hour", "wday.lbl"}
    assert of(decompose.seasonal_diagnostics(group(two(hours, short), "id"), "date", "value")) == {"hour", "wday.lbl", "week"}
    assert of(decompose.seasonal_diagnostics(hourly.limit(2), "date", "value")) == {"year"}


def test_filter_by_time_has_no_nan(spark):
    df = spark.createDataFrame([("2022-03-01", float("nan")), ("2022-03-02", 1.0)], "d string, v double").select(F.to_timestamp("d").alias("date"), "v")
    assert filter_by_time(df, "date", "2022").orderBy("date").toArrow()["v"].to_pylist() == [None, 1.0]


def test_funnel(spark):
    df = spark.createDataFrame([("Yes", "A", 1.0), ("No", "A", 2.0), ("Yes", "B", 3.0), ("No", "B", 4.0)] * 5, "Outcome string, Segment string, x double")
    b = funnel.binarize(df)
    assert "Outcome__Yes" in b.columns and "Segment__A" in b.columns and b.agg(F.sum("Outcome__Yes")).first()[0] == 10
    c = funnel.correlate(b, "Outcome__Yes").toPandas()
    assert c.correlation.abs().is_monotonic_decreasing and set(c.columns) == {"feature", "bin", "correlation"}
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"a": rng.normal(size=80).round(1), "b": rng.integers(0, 5, 80), "c": rng.normal(size=80)})
    pdf["flat"] = 1.0
    x = spark.createDataFrame(pdf)

    def tau(u, v):  # tau-b over all pairs
        su, sv = np.sign(u[:, None] - u), np.sign(v[:, None] - v)
        return (su * sv).sum() / np.sqrt((su**2).sum() * (sv**2).sum())

    want = {"pearson": lambda u, v: np.corrcoef(u, v)[0, 1], "spearman": lambda u, v: np.corrcoef(pd.Series(u).rank(), pd.Series(v).rank())[0, 1], "kendall": tau}
    for method, f in want.items():
        got = funnel.correlate(x, "a", method).toPandas().set_index("feature").correlation
        for k in "abc":
            assert got[k] == pytest.approx(f(pdf[k].to_numpy(float), pdf.a.to_numpy()))
        assert np.isnan(got["flat"])
    many = funnel.binarize(x.select("c"))
    assert len(many.columns) == 4 and many.select(sum(F.col(f"`{c}`") for c in many.columns).alias("s")).agg(F.min("s"), F.max("s")).first()[:] == (1, 1)
    for bad in (x.withColumn("n", F.lit(None).cast("int")), x.withColumn("t", F.current_timestamp()), x.limit(0)):
        with pytest.raises(ValueError):
            funnel.binarize(bad)


def test_validation(spark):
    df = frame(spark, {"date": days("2023-01-01", 60), "value": range(60)})
    cv = validation.TimeSeriesCV("days", 20, 5, gap=1, mode="backward", window="rolling")
    splits = cv.splits(df, "date").orderBy("split").toPandas()
    assert splits.forecast_end[0] == pd.Timestamp("2023-03-02") and (splits.forecast_start - splits.train_end == pd.Timedelta(days=1)).all()
    train, test = next(cv.split(df, "date"))
    assert train.count() == 20 and test.count() == 5
    marked = cv.mark(df, "date").groupBy("split", "role").count().toPandas()
    assert set(marked[marked.role == "train"]["count"]) == {20} and set(marked[marked.role == "forecast"]["count"]) == {5}
    fwd = validation.TimeSeriesCV("days", 20, 5, mode="forward", window="expanding", split_limit=3).splits(df, "date").toPandas()
    assert (fwd.train_start == pd.Timestamp("2023-01-01")).all() and len(fwd) == 3
    assert cv.splits(df.limit(0), "date").count() == 0 and "Split 1" in cv.glimpse(df, "date") and cv.plot_data(df, "date", "value").count() > 0
    assert validation.TimeSeriesCVSplitter(df, "date", train_size=10).count() > 0
    with pytest.raises(ValueError):
        validation.TimeSeriesCV(train_size=0)


def test_features(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"id": ["a"] * 150 + ["b"] * 3 + ["c"] * 30, "date": [*days("2020-01-01", 150), *days("2020-01-01", 3), *days("2020-01-01", 30)], "value": [*rng.normal(size=150).cumsum(), 1.0, 2.0, np.nan, *[4.0] * 30]})
    out = tsfeatures.ts_features(group(spark.createDataFrame(pdf), "id"), "date", "value", freq=7).toPandas().set_index("id")
    assert out.loc["a"].notna().all() and out.loc["a", "series_length"] == 150 and out.loc["b", "series_length"] == 2
    assert 0 <= out.loc["a", "trend"] <= 1 and out.loc["a", "x_acf1"] > 0.8 and out.loc["a", "hurst"] > 0.5
    with pytest.raises(ValueError):
        tsfeatures.ts_features(spark.createDataFrame(pdf), "date", "value", ["nope"])


def test_plot_data(spark):
    pdf = pd.DataFrame({"id": ["a"] * 40 + ["b"] * 40, "date": list(days("2020-01-01", 40)) * 2, "value": np.arange(80.0), "x": np.sin(np.arange(80.0))})
    df = spark.createDataFrame(pdf)
    long = plotdata.timeseries_data(group(df, "id"), "date", ["value", "x"]).toPandas()
    assert len(long) == 160 and np.abs(long[long.name == "value"].smooth - long[long.name == "value"].value).max() < 1e-6
    assert plotdata.boxplot_data(group(df, "id"), "date", "value", "1W").count() == 12
    r = plotdata.regression_data(group(df, "id"), "date", "value", ["x", "value"]).toPandas()
    np.testing.assert_allclose(r.fitted, r.observed, atol=1e-6)
    np.testing.assert_allclose(plotdata.regression_data(df.where("id = 'a'"), "date", "value").toPandas().eval("fitted - observed"), 0, atol=1e-6)
    an = decompose.anomalize(df.where("id = 'a'"), "date", "value", 7, 30)
    assert plotdata.anomalies_data(an, "date").count() == 40 and plotdata.anomalies_decomp_data(an, "date").count() == 160 and plotdata.anomalies_cleaned_data(an, "date").count() == 40


def test_group_apply(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 7.0)], "g string, v double")
    assert {r["g"]: r["value"] for r in apply.parallel_apply(df, lambda p: p["v"].sum(), by=["g"]).collect()} == {"a": 4.0, "b": 5.0, None: 7.0}
    out = apply.progress_apply(group(df, "g"), lambda p: pd.DataFrame({"top": [p["v"].max()]}), "top double")
    assert out.columns == ["g", "top"] and out.count() == 3
    with pytest.raises(ValueError):
        apply.parallel_apply(df, len)


def test_public_names(spark):
    import loomtime

    assert all(callable(getattr(loomtime, n)) for n in loomtime.__all__) and len(loomtime.__all__) > 80
    with pytest.raises(AttributeError):
        loomtime.nope  # noqa: B018
    df = spark.createDataFrame([("2023-01-01", "x", dt.datetime(2023, 1, 1))], "a string, b string, c timestamp")
    assert loomtime.get_timeseries_cols(df) == ["a", "c"] and not loomtime.has_timeseries_col(df.select("b"))


@pytest.mark.parametrize("idx,n,freq,start,step", [
    ("2011-01-01", 5, "D", "2011-01-02", "D"), (["2010-12-31", "2011-01-01"], 5, None, "2011-01-02", "D"), (["2011-01-01", "2011-02-01"], 4, "H", "2011-02-01 01:00", "h"),
    ("2011-01-01", 5, "MS", "2011-02-01", "MS"), (["2010-12-01", "2011-01-01"], 5, None, "2011-02-01", "MS"), (["2011-01-01", "2011-02-01"], 4, "D", "2011-02-02", "D"),
    ("2011-01-01", 5, "Q", "2011-06-30", "QE"), (["2011-01-01", "2011-04-01"], 5, None, "2011-07-01", "QS"), ("2011-01-01", 5, "1H30min", "2011-01-01 01:30", "90min"),
    ("2024-01-15", 2, "MS", "2024-03-01", "MS"), ("2022-01-08", 3, "B", "2022-01-11", "B"), ("2022-01-04", 2, "W", "2022-01-16", "W")])
def test_future_dates(spark, idx, n, freq, start, step):
    got = [r["date"] for r in grid.make_future_timeseries(spark, idx, n, freq).orderBy("date").collect()]
    assert got == [t.to_pydatetime() for t in pd.date_range(start, periods=n, freq=step)]


@pytest.mark.parametrize("freq,days_between,unit,season,trend", [("D", 1, "D", "1W", "1Q"), ("W", 7, "W", "1Q", "1Y"), ("ME", 31, "M", "1Y", "5Y"), ("QE", 92, "Q", "1Y", "10Y"), ("YE", 365, "Y", "5Y", "30Y")])
def test_frequency_tables(spark, freq, days_between, unit, season, trend):
    df = spark.createDataFrame(pd.DataFrame({"date": pd.date_range("2021-01-01", "2023-12-31", freq=freq)}))
    s = frequency.get_frequency_summary(df, "date", True)
    assert (s["freq_median_seconds"], s["freq_median_scale"], s["freq_median_unit"]) == (days_between * 86400, 1.0, unit)
    assert freq != "W" or s["freq_inferred_unit"] == "W"
    assert frequency.get_seasonal_frequency(df, "date") == season and frequency.get_trend_frequency(df, "date") == trend


def test_hot_series_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": ["hot"] * 900 + ["b"] * 60 + [None] * 5, "date": [*pd.date_range("2020-01-01", periods=900, freq="h"), *days("2020-01-01", 60), *days("2020-01-01", 5)], "value": rng.normal(size=965)})
    df = spark.createDataFrame(pdf, "g string, date timestamp, value double").repartition(6)
    plain = rolling.augment_rolling(shift.augment_lags(df, "date", "value", [1, 30], by=["g"]), "date", "value", ["mean", "std", "max", "quantile"], [5, 200], by=["g"])
    cut = rolling.augment_rolling(shift.augment_lags(df, "date", "value", [1, 30], by=["g"], hot=True), "date", "value", ["mean", "std", "max", "quantile"], [5, 200], by=["g"], hot=True)
    a, b = (x.toPandas().sort_values(["g", "date"]).reset_index(drop=True)[plain.columns] for x in (plain, cut))
    pd.testing.assert_frame_equal(a, b, check_exact=False, atol=1e-9)
    assert cut.rdd.getNumPartitions() > 1
    # looking ahead, with slices far smaller than the series
    monkeypatch.setattr(ranges, "MOST", 100)
    own = [("range", lambda x: x.max() - x.min())]
    plain = rolling.augment_rolling(shift.augment_leads(df, "date", "value", [1, 30], by=["g"]), "date", "value", ["mean", "max"], [4, 9], 1, True, by=["g"])
    cut = rolling.augment_rolling(shift.augment_leads(df, "date", "value", [1, 30], by=["g"], hot=True), "date", "value", ["mean", "max", *own], [4, 9], 1, True, by=["g"], hot=True)
    a, b = (x.toPandas().sort_values(["g", "date"]).reset_index(drop=True) for x in (plain, cut))
    pd.testing.assert_frame_equal(a, b[a.columns], check_exact=False, atol=1e-9)
    hot = b[b.g == "hot"].value
    np.testing.assert_allclose(b[b.g == "hot"].value_rolling_range_win_9, hot.rolling(9, 1, center=True).max() - hot.rolling(9, 1, center=True).min())


def test_long_series_are_cut_without_a_trace(spark):
    rng = np.random.default_rng(21)
    pdf = pd.DataFrame({"id": ["hot"] * 2000 + ["a"] * 40 + ["b"] * 3, "date": [*days("2015-01-01", 2000), *days("2020-01-01", 40), *days("2020-01-01", 3)], "value": rng.normal(size=2043)})
    df = spark.createDataFrame(pdf)
    kernel = lambda b: pd.DataFrame({"m": b.groupby("__s", sort=False)["value"].transform(lambda x: x.rolling(30, min_periods=1).max())})
    whole = series_map(df, ["id"], ["date"], ["value"], [("m", "double")], kernel, 29).toPandas().sort_values(["id", "date"]).reset_index(drop=True)
    for most in (1000, 100, 20):  # slices longer and shorter than what they look back on
        cut = series_map(df, ["id"], ["date"], ["value"], [("m", "double")], kernel, 29, most).toPandas().sort_values(["id", "date"]).reset_index(drop=True)
        pd.testing.assert_frame_equal(whole, cut, check_exact=True)


@pytest.mark.parametrize("parts", ["10", "1000"])
def test_what_the_driver_sees_does_not_grow_with_partitions(spark, parts, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    seen = []
    for name in ("collect", "toArrow", "toPandas"):
        old = getattr(Classic, name)
        monkeypatch.setattr(Classic, name, lambda self, *a, old=old, **k: (lambda got: seen.append(got.num_rows if hasattr(got, "num_rows") else len(got)) or got)(old(self, *a, **k)))
    df = frame(spark, {"id": ["a", "b"] * 300, "date": list(days("2020-01-01", 300)) * 2, "value": np.arange(600.0)})
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rolling.augment_ewm(group(df, "id"), "date", "value", alpha=0.001, adjust=False)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(seen) <= 1


def test_kendall_in_parts_is_that_over_all_pairs(spark):
    rng = np.random.default_rng(31)
    pdf = pd.DataFrame({"a": rng.integers(0, 60, 3000).astype(float), "b": rng.normal(size=3000).round(1)})
    pdf["b"] += pdf.a / 20
    d = spark.createDataFrame(pdf)
    u, v = pdf.a.to_numpy(), pdf.b.to_numpy()
    su, sv = np.sign(u[:, None] - u), np.sign(v[:, None] - v)
    want = (su * sv).sum() / np.sqrt(np.abs(su).sum() * np.abs(sv).sum())
    for rows in (1_000_000, 300, 40):
        assert funnel.kendall_tau(d, "a", "b", rows) == pytest.approx(want, abs=1e-12)
    y, w = rng.integers(0, 9, 50), rng.integers(1, 4, 50)
    assert funnel.inversions(y, w) == sum(w[i] * w[j] for i in range(50) for j in range(i + 1, 50) if y[i] > y[j])


def test_holidays_of_other_countries_and_of_a_table(spark):
    from loomtime.functions.dates import easter, holiday_list

    assert [easter(y) for y in (1961, 2000, 2019, 2024, 2038)] == [dt.date(1961, 4, 2), dt.date(2000, 4, 23), dt.date(2019, 4, 21), dt.date(2024, 3, 31), dt.date(2038, 4, 25)]
    assert (dt.date(2024, 5, 9), "Christi Himmelfahrt") in holiday_list("Germany") and (dt.date(2023, 5, 29), "Lundi de Pentecôte") in holiday_list("France")
    df = frame(spark, {"date": days("2024-03-28", 6)})
    out = calendar.augment_holiday_signature(df, "date", "DE").orderBy("date").toPandas()
    assert out.is_holiday.tolist() == [0, 1, 0, 0, 1, 0] and out.holiday_name[4] == "Ostermontag" and out.before_holiday.tolist() == [1, 0, 0, 1, 0, 0]
    own = spark.createDataFrame([("2024-03-30", "b"), ("2024-03-30", "a"), (None, "c")], "d string, holiday_name string").select(F.to_date("d").alias("holiday_date"), "holiday_name")
    out = calendar.augment_holiday_signature(df, "date", calendar=own).orderBy("date").toPandas()
    assert out.is_holiday.tolist() == [0, 0, 1, 0, 0, 0] and out.holiday_name[2] == "a, b"
    with pytest.raises(ValueError):
        holiday_list("Atlantis")


def test_verbs_as_methods(spark):
    df = frame(spark, {"id": ["a", "b"] * 5, "date": list(days("2020-01-01", 5)) * 2, "value": np.arange(10.0)})
    chained = group(df, "id").augment_lags("date", "value", 1).augment_rolling("date", "value", "mean", 2)
    plain = rolling.augment_rolling(shift.augment_lags(df, "date", "value", 1, by=["id"]), "date", "value", "mean", 2, by=["id"])
    assert isinstance(chained, Panel) and chained.by == ("id",) and chained.data.orderBy("id", "date").collect() == plain.orderBy("id", "date").collect()
    assert group(df.where("id = 'a'")).get_frequency("date") == "D" and group(df, "id").ts_summary("date").data.count() == 2
    for name in ("no_such_verb", "pd_quantile", "__deepcopy__"):
        with pytest.raises(AttributeError):
            getattr(group(df, "id"), name)
