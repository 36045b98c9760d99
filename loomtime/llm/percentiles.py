"""Exact percentiles per group of very large numeric columns.

Readings are counted by distinct value where they lie, so ties don't travel; then the column is sorted once over the whole cluster by (group, value). Each partition counts its first and last group,
the only groups that can continue in a neighbour; from these counts (two rows a partition) every group knows its
offset in every partition, so each target position is located where it lies and the neighbouring order statistics are
interpolated exactly (error 0, the linear rule of SQL's percentile_cont).

The mergeable summary is the run-length form (group, value, n): summaries of days, files or partitions are put together
by ``merge_runs`` and lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtime.operators.ranges import runs_of, streamed
from loomtime.runtime import checkpointed, range_partitions


def value_runs(df: DataFrame, by: str, value: str) -> DataFrame:
    """Summary (by, value, n) of all readings. Null and NaN values are left out, a null group is a group of its own, ties and
    repeated rows add to n; other columns are ignored. An empty table gives an empty summary."""
    v = F.col(value).cast("double")
    kept = df.where(v.isNotNull() & ~F.isnan(v)).select(F.col(by).alias("by"), v.alias("value"))
    return kept.groupBy("by", "value").agg(F.count(F.lit(1)).alias("n"))


def merge_runs(*summaries: DataFrame) -> DataFrame:
    """Summaries of separate days or files as one."""
    whole = summaries[0]
    for s in summaries[1:]:
        whole = whole.unionByName(s)
    return whole.groupBy("by", "value").agg(F.sum("n").alias("n"))


def _groups(t: pa.Table):
    """Rows sorted by group and value: group starts, the groups, values and the running count before each row."""
    starts = runs_of(t["by"])
    keys = t["by"].combine_chunks()
    return starts, keys.take(pa.array(starts)), t["value"].to_numpy(), np.r_[0, np.cumsum(t["n"].to_numpy())]


def _edge_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Readings of a partition's first and last group, added up batch by batch."""
    held: list = []  # [group, count] of the first and, if it is another one, the last group so far
    for b in batches:
        if b.num_rows:
            starts, groups, values, before = _groups(pa.Table.from_batches([b]))
            counts = before[np.r_[starts[1:], len(values)]] - before[starts]
            for k in sorted({0, len(starts) - 1}):
                name, n = groups[k].as_py(), int(counts[k])
                if held and held[-1][0] == name:
                    held[-1][1] += n
                else:
                    held = [*held[:1], [name, n]]
    if held:
        here = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([here] * len(held), pa.int32()), pa.array([h[0] for h in held], groups.type), pa.array([h[1] for h in held], pa.int64())], names=["pid", "by", "n"])


def percentiles_of_runs(runs: DataFrame, probabilities: Sequence[float], names: Sequence[str], parts: int | None = None) -> DataFrame:
    """(by, n, one column a probability) from a summary (by, value, n); see ``percentiles``."""
    if not all(0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities lie between 0 and 1")
    key = runs.schema["by"].dataType
    ordered = runs.repartitionByRange(parts or range_partitions(runs), "by", "value").sortWithinPartitions("by", "value")
    ordered = checkpointed(ordered)

    edge_schema = T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("by", key), T.StructField("n", T.LongType())])
    edges: dict = {}
    for pid, group, n in ordered.mapInArrow(_edge_counts, edge_schema).collect():  # at most two rows a partition
        edges.setdefault(group, {})[pid] = n
    spanning = {g: c for g, c in edges.items() if len(c) > 1}
    probs = np.asarray(probabilities, float)

    def locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        for t in streamed(batches, ["by"]):
            starts, groups, values, before = _groups(t)
            ends = np.r_[starts[1:], len(values)]
            local = before[ends] - before[starts]
            offset, total = np.zeros(len(starts), np.int64), local.copy()
            for i in {0, len(starts) - 1}:
                counts = spanning.get(groups[i].as_py())
                if counts:
                    offset[i] = sum(n for pid, n in counts.items() if pid < here)
                    total[i] = sum(counts.values())
            out = [groups, pa.array(total)]
            for p in probs:
                low = np.floor((total - 1) * p).astype(np.int64)
                for k in (low, np.minimum(low + 1, total - 1)):
                    inside = (k >= offset) & (k < offset + local)
                    at = np.searchsorted(before, np.where(inside, before[starts] + k - offset, 0), side="right") - 1
                    out.append(pa.array(values[at], mask=~inside))
            yield pa.RecordBatch.from_arrays(out, names=["by", "n", *(f"{s}{i}" for i in range(len(probs)) for s in ("lo", "hi"))])

    fields = [T.StructField("by", key), T.StructField("n", T.LongType())]
    fields += [T.StructField(f"{s}{i}", T.DoubleType()) for i in range(len(probs)) for s in ("lo", "hi")]
    found = ordered.mapInArrow(locate, T.StructType(fields))
    # a group spread over partitions has each order statistic in one of them; all others are null there
    whole = found.groupBy("by").agg(F.max("n").alias("n"), *(F.max(f.name).alias(f.name) for f in fields[2:]))
    columns = []
    for i, (p, name) in enumerate(zip(probs, names, strict=True)):
        h = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        columns.append(F.when((lo == hi) | (h == F.floor(h)), lo).otherwise(lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return whole.select("by", "n", *columns)


def percentiles(df: DataFrame, by: str, value: str, probabilities: Sequence[float], names: Sequence[str] | None = None) -> DataFrame:
    """(by, n, one column a probability): exact percentiles of ``value`` in each group.

    Null and NaN values are left out; a group with none but such values has no row; a null group is a group of its own;
    infinities are values; one reading is every percentile of its group; an empty table gives no rows. Output names clash
    with nothing as other input columns are dropped.
    """
    names = list(names or (f"p{round(p * 100):02d}" for p in probabilities))
    out = percentiles_of_runs(value_runs(df, by, value), probabilities, names)
    return out.withColumnRenamed("by", by)
