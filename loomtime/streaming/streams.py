"""Streaming forms of verbs whose state is small."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtime.functions.freq import Freq
from loomtime.operators.timeagg import AGGREGATES
from loomtime.runtime import nan_to_null


def summarize_stream(stream: DataFrame, date_column: str, value_column: str, freq: str = "h", agg_func: str | Sequence[str] = "sum", by: Sequence[str] = (), watermark: str = "1 hour") -> DataFrame:
    """Tumbling bins of a stream: rows later than ``watermark`` are left out, a bin comes out once it can't change. Months and longer have no
    streaming form and raise ValueError; medians, quantiles and distinct counts neither."""
    f = Freq.of(freq)
    if f.calendar or f.unit in ("B", "W"):
        raise ValueError("a streaming bin is at most days long")
    funcs = [agg_func] if isinstance(agg_func, str) else list(agg_func)
    bad = [x for x in funcs if x not in ("sum", "mean", "min", "max", "std", "var", "count", "first", "last")]
    if bad:
        raise ValueError(f"no streaming form of {bad}")
    v, d = nan_to_null(F.col(value_column).cast("double")), F.col(date_column)
    aggs = [AGGREGATES[x][0](v, d).alias(value_column if isinstance(agg_func, str) else f"{value_column}_{x}") for x in funcs]
    out = stream.withWatermark(date_column, watermark).groupBy(F.window(date_column, f"{f.micros // 1000} milliseconds").alias("__w"), *by).agg(*aggs)
    return out.select(*by, F.col("__w.start").alias(date_column), *[c for c in out.columns if c not in by and c != "__w"])


def session_stream(stream: DataFrame, date_column: str, gap: str = "30 minutes", by: Sequence[str] = (), watermark: str = "1 hour") -> DataFrame:
    """(by, session_start, session_end, n): runs of rows no further apart than ``gap``."""
    out = stream.withWatermark(date_column, watermark).groupBy(*by, F.session_window(date_column, gap).alias("__w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("__w.start").alias("session_start"), F.col("__w.end").alias("session_end"), "n")


def _stateful(stream: DataFrame, date: str, value: str, by: Sequence[str], fields: list[T.StructField], state: str, step) -> DataFrame:
    schema = T.StructType([stream.schema[k] for k in by] + [stream.schema[date], T.StructField(value, T.DoubleType()), *fields])

    def each(key, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else None
        rows = pd.concat(list(parts)).sort_values(date, kind="stable")
        out = []
        for d, v in zip(rows[date], rows[value].astype(float)):
            now, made = step(now, v)
            out.append((*key, d, v, *made))
        held.update(now)
        yield pd.DataFrame(out, columns=schema.names)

    return stream.groupBy(*by).applyInPandasWithState(each, schema, state, "append", GroupStateTimeout.NoTimeout)


def ewm_stream(stream: DataFrame, date_column: str, value_column: str, alpha: float, by: Sequence[str]) -> DataFrame:
    """value_ewm_mean_alpha_a of each series as its rows arrive (recursive form); the state is one number a series. Rows are taken in order of
    arrival between batches and in order of dates within one."""
    def step(now, v):
        if v != v:
            return (now[0] if now else float("nan"),), (now[0] if now else None,)
        y = v if now is None or now[0] != now[0] else (1 - alpha) * now[0] + alpha * v
        return (y,), (y,)

    return _stateful(stream, date_column, value_column, by, [T.StructField(f"{value_column}_ewm_mean_alpha_{alpha}", T.DoubleType())], "y double", step)


def drawdown_stream(stream: DataFrame, date_column: str, close_column: str, by: Sequence[str]) -> DataFrame:
    """close_peak and close_drawdown of each series as its rows arrive."""
    def step(now, v):
        peak = now[0] if now else float("-inf")
        if v != v:
            return (peak,), (None, None)
        peak = max(peak, v)
        return (peak,), (peak, v - peak)

    return _stateful(stream, date_column, close_column, by, [T.StructField(f"{close_column}_peak", T.DoubleType()), T.StructField(f"{close_column}_drawdown", T.DoubleType())], "peak double", step)
