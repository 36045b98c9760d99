"""Time-series and data-preparation operators on PySpark DataFrames; public names load on first use."""

from importlib import import_module

_MODULES = {
    "functions.freq": "Freq canonicalize_frequency_unit normalize_frequency_alias parse_freq_str parse_human_duration",
    "functions.dates": "ceil_date floor_date holiday_table is_datetime_string is_holiday week_of_month",
    "functions.select": "Panel contains drop_zero_variance ends_with filter_by_time flatten_multiindex_column_names get_timeseries_cols glimpse group has_timeseries_col matches reduce_memory_usage "
                        "resolve_column_selection sort_dataframe starts_with transform_columns",
    "operators.apply": "parallel_apply progress_apply",
    "operators.basis": "augment_fourier augment_hilbert augment_spline augment_wavelet",
    "operators.calendar": "augment_holiday_signature augment_timeseries_signature get_holiday_signature get_timeseries_signature",
    "operators.decompose": "acf_diagnostics anomalize seasonal_diagnostics stl_diagnostics",
    "operators.finance": "augment_adx augment_atr augment_bbands augment_cmo augment_drawdown augment_ewma_volatility augment_fip_momentum augment_hurst_exponent augment_macd augment_ppo augment_qsmomentum "
                         "augment_regime_detection augment_roc augment_rolling_risk_metrics augment_rsi augment_stochastic_oscillator",
    "operators.frequency": "get_date_summary get_diff_summary get_frequency get_frequency_summary get_seasonal_frequency get_trend_frequency time_scale_template timeseries_unit_frequency_table ts_summary",
    "operators.funnel": "binarize correlate correlation_funnel",
    "operators.grid": "future_frame make_future_timeseries make_weekday_sequence make_weekend_sequence pad_by_time",
    "operators.gridfill": "regularize",
    "operators.missing": "fill_missing",
    "operators.rolling": "augment_ewm augment_expanding augment_expanding_apply augment_rolling augment_rolling_apply pair pd_quantile pl_quantile",
    "operators.shift": "augment_diffs augment_lags augment_leads augment_pct_change resolve_lag_sequence",
    "operators.spikes": "flag_implausible",
    "operators.timeagg": "apply_by_time summarize_by_time",
    "operators.trailing": "trailing_totals",
    "operators.tsfeatures": "ts_features",
    "operators.validation": "TimeSeriesCV TimeSeriesCVSplitter",
    "sources.datasets": "get_available_datasets load_dataset write_dataset",
    "sources.feature_store": "FeatureStore FeatureStoreAccessor feature_store load_feature_set log_feature_set",
    "streaming.streams": "drawdown_stream ewm_stream session_stream summarize_stream",
}
_HOME = {name: module for module, names in _MODULES.items() for name in names.split()}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(name)
    return getattr(import_module(f"loomtime.{_HOME[name]}"), name)


def __dir__() -> list[str]:
    return __all__
