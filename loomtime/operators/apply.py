"""Functions over the groups of a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomtime.functions.select import Panel, unpack
from loomtime.operators.series import grouped


def parallel_apply(data: DataFrame | Panel, func: Callable[[pd.DataFrame], object], schema: str | T.StructType | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``func`` over each group's pandas frame: a number (result column 'value') or, with ``schema`` (a string or type of the columns besides the keys), a frame.

    A group has to fit a task; where it may not, use the aggregate and window verbs.
    """
    df, keys = unpack(data, by)
    if not keys:
        raise ValueError("give the columns to group by")
    body = T.StructType([T.StructField("value", T.DoubleType())]) if schema is None else (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    extra = [f for f in body.fields if f.name not in keys]
    full = T.StructType([df.schema[k] for k in keys] + extra)

    def each(part: pd.DataFrame) -> pd.DataFrame:
        r = func(part)
        out = r.copy() if isinstance(r, pd.DataFrame) else pd.DataFrame({"value": [float(r)]})
        for k in keys:
            out[k] = part[k].iloc[0]
        return out[full.names]

    return grouped(df, keys).applyInPandas(each, full)


def progress_apply(data: DataFrame | Panel, func: Callable[[pd.DataFrame], object], schema: str | T.StructType | None = None, by: Sequence[str] = ()) -> DataFrame:
    """As ``parallel_apply``; progress shows in Spark's own console and UI."""
    return parallel_apply(data, func, schema, by)
