"""Python kernels over ordered series, hot series included.

``series_map`` is for kernels that look back a bounded number of rows (recursions count as such once older rows weigh less than a
double can show). A series is one task's as long as it fits there; a longer one is cut into slices over the cluster, and a slice gets the rows before
it. ``whole_series`` is for algorithms that need a whole series at once (decomposition, transforms); a series then has to
fit a task, so such verbs are meant for pre-aggregated series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtime.operators.ranges import EDGE, PIECE, pieces, starts_of, streamed
from loomtime.runtime import free_name, partitions


def memory_of(alpha: float) -> int:
    """Rows after which a weight (1 - alpha)^k is below a double's precision."""
    return 1 if alpha >= 1 else math.ceil(37 / -math.log1p(-alpha))


def series_map(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], fields: Sequence[tuple[str, str]],
               kernel: Callable[[pd.DataFrame], pd.DataFrame], halo: int, most: int | None = None, ahead: int = 0) -> DataFrame:
    """``df`` with new columns ``fields`` (name, type) by ``kernel``, which gets the ``inputs`` as doubles with a column __s numbering the
    series, rows in order, and returns the new columns row by row. ``halo`` is the number of earlier rows a row depends on,
    ``ahead`` that of later ones.

    A series of more than ``most`` rows is cut into slices, each with these rows beside it (see ``pieces``). Null keys are a series; rows with a
    null order come first.
    """
    code = free_name(df, "series")
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]) if keys else F.lit("")
    columns = {f"{code}v{i}": F.col(c).cast("double") for i, c in enumerate(inputs)}
    helpers = list(columns)
    names = dict(zip(inputs, helpers))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in streamed(batches, [code, PIECE]):
            mark = np.zeros(part.num_rows, np.int64)
            mark[starts_of(part, [code, PIECE])[1:]] = 1
            made = kernel(pd.DataFrame({"__s": np.cumsum(mark), **{n: part[c].to_numpy() for n, c in names.items()}}))
            own = part[EDGE].to_numpy() == 0
            t = part.drop_columns([code, PIECE, EDGE, *helpers])
            for name, kind in fields:
                t = t.append_column(name, _column(made[name], kind))
            yield from (t if own.all() else t.filter(pa.array(own))).to_batches(max_chunksize=20_000)

    schema = T.StructType(list(df.schema.fields) + [T.StructField(n, T.DoubleType() if k == "double" else T.IntegerType() if k == "int" else T.StringType()) for n, k in fields])
    whole, slices = pieces(df.withColumns({code: key, **columns}), code, list(order), halo, ahead, most=most)
    out = whole.mapInArrow(run, schema)
    return out if slices is None else out.unionByName(slices.mapInArrow(run, schema))


def _column(x: pd.Series, kind: str) -> pa.Array:
    if kind == "string":
        return pa.array(x.tolist(), pa.string())
    v = x.to_numpy(dtype=float)
    return pa.array(v, pa.float64(), mask=np.isnan(v)) if kind == "double" else pa.array(np.nan_to_num(v).astype(np.int32), pa.int32(), mask=np.isnan(v))


def whole_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[T.StructField], kernel: Callable[[pd.DataFrame], pd.DataFrame],
                 keep: Sequence[str] | None = None) -> DataFrame:
    """``kernel`` over each whole series in order: it gets the series' rows and returns rows with the columns ``keep`` (default: all of ``df``) and ``fields``."""
    keep = list(df.columns if keep is None else keep)
    schema = T.StructType([df.schema[c] for c in keep] + list(fields))
    order = list(order)

    def each(part: pd.DataFrame) -> pd.DataFrame:
        return kernel(part.sort_values(order, kind="stable").reset_index(drop=True))[schema.names]

    return grouped(df, keys).applyInPandas(each, schema)


def grouped(df: DataFrame, keys: Sequence[str]):
    """``df`` grouped by keys, or as one group. The number of partitions is given, as adaptive execution would put small groups of little data but
    long Python work into one task."""
    if keys:
        return df.repartition(partitions(df.sparkSession), *keys).groupBy(*keys)
    one = free_name(df, "one")
    return df.withColumn(one, F.lit(0)).groupBy(one)
