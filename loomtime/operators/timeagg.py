"""Aggregation of series by calendar bins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtime.functions.freq import Freq
from loomtime.functions.select import Panel, check_date, check_values, resolve_column_selection, unpack
from loomtime.runtime import free_name, nan_to_null

#: aggregations by name: (expression of value and date, value of an empty bin)
AGGREGATES: dict[str, tuple[Callable[[Column, Column], Column], int | None]] = {
    "sum": (lambda v, d: F.coalesce(F.sum(v), F.lit(0.0)), 0),
    "mean": (lambda v, d: F.avg(v), None),
    "median": (lambda v, d: F.percentile(v, 0.5), None),
    "min": (lambda v, d: F.min(v), None),
    "max": (lambda v, d: F.max(v), None),
    "std": (lambda v, d: F.stddev_samp(v), None),
    "var": (lambda v, d: F.var_samp(v), None),
    "first": (lambda v, d: F.min_by(v, F.when(v.isNotNull(), d)), None),
    "last": (lambda v, d: F.max_by(v, F.when(v.isNotNull(), d)), None),
    "count": (lambda v, d: F.count(v), 0),
    "nunique": (lambda v, d: F.countDistinct(v), 0),
    "prod": (lambda v, d: F.coalesce(F.product(v), F.lit(1.0)), 1),
    "sem": (lambda v, d: F.stddev_samp(v) / F.sqrt(F.count(v)), None),
    "quantile": (lambda v, d: F.percentile(v, 0.5), None),
}
AGGREGATES["average"] = AGGREGATES["mean"]


def first_dates(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(date).alias("__first"))


def with_label(df: DataFrame, keys: Sequence[str], date: str, freq: Freq, name: str) -> DataFrame:
    """``df`` with its bin's label; multiples of an anchored unit are counted from each series' first date."""
    anchored = (freq.n > 1 and (freq.calendar or freq.unit == "W")) or (freq.unit in ("D", "h", "min", "s") and bool(86_400_000_000 % freq.micros))
    if not anchored:
        return df.withColumn(name, freq.label(F.col(date)))
    if keys:
        df = df.join(first_dates(df, keys, date), list(keys))
    else:
        df = df.crossJoin(F.broadcast(first_dates(df, keys, date)))  # one row
    return df.withColumn(name, freq.label(F.col(date), F.col("__first"))).drop("__first")


def complete_bins(binned: DataFrame, keys: Sequence[str], label: str, freq: Freq, empty: dict[str, object]) -> DataFrame:
    """One row for each bin from a series' first to its last; ``empty`` has what the columns of an added bin hold. Works on aggregated rows: each
    one is followed by the labels up to the next, so that no grid is joined."""
    following = F.lead(label).over(Window.partitionBy(*keys).orderBy(label))
    grid = freq.grid(F.col(label), F.coalesce(freq.plus(F.col("__next"), -1), F.col(label)))
    out = binned.withColumn("__next", following).select("*", F.posexplode(grid).alias("__k", "__at"))
    names = [c for c in binned.columns if c not in keys and c != label]
    return out.select(*keys, F.col("__at").alias(label), *[F.when(F.col("__k") == 0, F.col(c)).otherwise(F.lit(empty.get(c))).alias(c) for c in names])


def _aggregates(values: Sequence[str], agg_func, date: str) -> tuple[list[Column], dict[str, object]]:
    one = isinstance(agg_func, str) or isinstance(agg_func, tuple) or callable(agg_func)
    funcs = [agg_func] if one else list(agg_func)
    columns, empty = [], {}
    for v in values:
        x = nan_to_null(F.col(v).cast("double"))
        for f in funcs:
            if isinstance(f, str):
                if f not in AGGREGATES:
                    raise ValueError(f"unknown aggregation {f!r}")
                name = v if one else f"{v}_{f}"
                make, nothing = AGGREGATES[f]
                columns.append(make(x, F.col(date)).alias(name))
            else:
                label, call = f if isinstance(f, tuple) else (getattr(f, "__name__", "custom"), f)
                name, nothing = (v if one else f"{v}_{label}"), None
                columns.append(_callable_aggregate(call, v).alias(name))
            empty[name] = nothing
    return columns, empty


def _callable_aggregate(call: Callable, value: str) -> Column:
    """``call`` over a bin's values: an expression if it takes a Column to a Column, else a grouped pandas function."""
    try:
        made = call(F.col(value))
        if isinstance(made, Column):
            return made
    except (TypeError, AttributeError, KeyError, IndexError, ValueError):
        pass  # a function of values fails on a Column in one of these ways; errors of expressions pass on

    @F.pandas_udf("double")
    def grouped(x: pd.Series) -> float:
        r = call(x)
        return float(r) if r is not None else float("nan")

    return nan_to_null(grouped(F.col(value).cast("double")))


def summarize_by_time(data: DataFrame | Panel, date_column: str, value_column, freq: str = "D", agg_func="sum", wide_format: bool = False,
                      fillna=0, by: Sequence[str] = (), max_wide: int = 2000) -> DataFrame:
    """Each series aggregated to bins of ``freq``, empty bins between its first and last included.

    Bins of W, ME, QE and YE carry their last day, all others their start. One aggregation by name keeps the value's name; a list gives
    value_name. ``agg_func`` also takes (name, function) pairs. Empty bins: 0 for sum, count and nunique, else null; then ``fillna`` (None: stay null)
    fills nulls. Rows without date or with a null group key are left out; NaN is null; an empty table gives no rows. ``wide_format`` puts
    each group in columns of its own (more than ``max_wide`` groups raise ValueError).
    """
    df, keys = unpack(data, by)
    check_date(df, date_column)
    values = resolve_column_selection(df, value_column)
    check_values(df, values)
    f = Freq.of(freq)
    given = F.col(date_column).isNotNull()
    for k in keys:
        given &= F.col(k).isNotNull()
    rows = df.where(given).select(*keys, F.col(date_column).cast("timestamp").alias(date_column), *values)
    columns, empty = _aggregates(values, agg_func, date_column)
    label = free_name(df, "bin")
    binned = with_label(rows, keys, date_column, f, label).groupBy(*keys, label).agg(*columns)
    names = [c for c in binned.columns if c not in keys and c != label]
    full = complete_bins(binned, keys, label, f, empty)
    if fillna is not None:
        full = full.withColumns({n: F.coalesce(F.col(n), F.lit(fillna)) for n in names})
    out = full.select(*keys, F.col(label).alias(date_column), *names)
    return widen(out, keys, date_column, names, fillna, max_wide) if wide_format and keys else out


def widen(df: DataFrame, keys: Sequence[str], date: str, names: Sequence[str], fillna, max_wide: int) -> DataFrame:
    """Groups as columns name_key; the keys are collected once, so there is a bound on them."""
    key = F.concat_ws("_", *[F.col(k).cast("string") for k in keys])
    found = [r[0] for r in df.select(key.alias("k")).distinct().orderBy("k").limit(max_wide + 1).collect()]
    if len(found) > max_wide:
        raise ValueError(f"more than max_wide={max_wide} groups for a wide table")
    picked = df.select(date, key.alias("__key"), *names).groupBy(date).pivot("__key", found).agg(*[F.first(n).alias(n) for n in names])
    fill = (lambda c: F.coalesce(c, F.lit(fillna))) if fillna is not None else (lambda c: c)
    return picked.select(date, *[fill(F.col(f"`{k}`" if len(names) == 1 else f"`{k}_{n}`")).alias(f"{n}_{k}") for n in names for k in found])


def apply_by_time(data: DataFrame | Panel, date_column: str, freq: str = "D", wide_format: bool = False, fillna=0, by: Sequence[str] = (),
                  max_wide: int = 2000, **named_funcs) -> DataFrame:
    """One column for each named function of a bin's rows. A function is a Column (an aggregate, the fast way), or takes the bin's pandas frame to a
    number; such a one also gets the empty frame for empty bins. Otherwise as ``summarize_by_time``."""
    df, keys = unpack(data, by)
    check_date(df, date_column)
    f = Freq.of(freq)
    given = F.col(date_column).isNotNull()
    for k in keys:
        given &= F.col(k).isNotNull()
    label = free_name(df, "bin")
    rows = with_label(df.where(given), keys, date_column, f, label)
    exprs = {n: e for n, e in named_funcs.items() if isinstance(e, Column)}
    calls = {n: e for n, e in named_funcs.items() if not isinstance(e, Column)}
    empty: dict[str, object] = dict.fromkeys(named_funcs)
    if not calls:
        binned = rows.groupBy(*keys, label).agg(*[e.alias(n) for n, e in exprs.items()])
    else:
        if exprs:
            raise ValueError("give either columns or functions")
        schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(label, T.TimestampType())] + [T.StructField(n, T.DoubleType()) for n in calls])

        def each(part: pd.DataFrame) -> pd.DataFrame:
            body = part.drop(columns=[label])
            return pd.DataFrame([[*(part[k].iloc[0] for k in keys), part[label].iloc[0], *(float(c(body)) for c in calls.values())]], columns=schema.names)

        binned = rows.groupBy(*keys, label).applyInPandas(each, schema)
        none = df.limit(0).toPandas()
        for n, c in calls.items():
            try:
                v = float(c(none))
                empty[n] = v if v == v else None
            except Exception:
                empty[n] = None
    full = complete_bins(binned, keys, label, f, empty)
    names = list(named_funcs)
    if fillna is not None:
        full = full.withColumns({n: F.coalesce(nan_to_null(F.col(n)) if n in calls else F.col(n), F.lit(fillna)) for n in names})
    out = full.select(*keys, F.col(label).alias(date_column), *names)
    return widen(out, keys, date_column, names, fillna, max_wide) if wide_format and keys else out
