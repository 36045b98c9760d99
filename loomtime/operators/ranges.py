"""Rows in order by key for Python kernels, hot keys included, and sums and medians over sorted data.

``pieces`` gives a key to one task as long as it fits there; a key beyond ``MOST`` rows is cut into slices by a sort over the whole cluster, and each
slice gets the rows beside it by a shuffle. What the driver sees is a handful of numbers a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtime.runtime import checkpointed, partitions, range_partitions

MOST = 1_000_000  # rows of a key that one task takes at once
PIECE, EDGE = "__loom_piece", "__loom_edge"


def sorted_once(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys``, written to the checkpoint folder.

    Equal keys share a partition; a hot leading key spreads over as many partitions as its rows need. Later jobs over the
    result see the same partitions under the same numbers, whatever happens to the executors.
    """
    ordered = df.repartitionByRange(parts or range_partitions(df), *keys).sortWithinPartitions(*keys)
    return checkpointed(ordered)


def whole_partition(batches: Iterable[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def runs_of(column: pa.ChunkedArray) -> np.ndarray:
    """Starts of the runs of equal neighbours (null equals null)."""
    keys = column.combine_chunks()
    keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
    codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.r_[0, np.flatnonzero(np.diff(codes)) + 1]


def starts_of(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Starts of the runs in which all of the columns stay equal."""
    return np.unique(np.concatenate([runs_of(table[n]) for n in names]))


def streamed(batches: Iterable[pa.RecordBatch], names: Sequence[str], least: int = 200_000) -> Iterator[pa.Table]:
    """Whole runs of equal ``names``, some ``least`` rows together; only what is yielded is held."""
    held: list[pa.Table] = []
    rows, last = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        cut = int(starts_of(t, names)[-1])
        fresh = cut > 0 or tuple(t[n][0].as_py() for n in names) != last
        if fresh and rows + cut >= max(1, least):
            yield pa.concat_tables([*held, t.slice(0, cut)])
            held, rows = [t.slice(cut)], t.num_rows - cut
        else:
            held.append(t)
            rows += t.num_rows
        last = tuple(t[n][-1].as_py() for n in names)
    if rows:
        yield pa.concat_tables(held)


def pieces(df: DataFrame, key: str, order: Sequence[str], before: int, after: int = 0, eligible: Callable[[pa.Table], np.ndarray] | None = None,
           most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(whole keys, slices of hot keys): ``df`` with columns PIECE and EDGE, each key (and slice) in one partition, rows sorted by key, slice, EDGE and order.

    The second frame (None if no key has more than ``most`` rows) holds the hot keys, cut over the cluster by ``order``; EDGE is -1 for up to ``before``
    rows before a slice and 1 for up to ``after`` rows behind it, copied there from its neighbours, and 0 for its own. ``eligible`` says which of a sorted
    slice's rows may be copied (all by default). ``key`` is a column of texts without nulls; ``order`` should end in something that tells rows apart.
    """
    most = most or MOST
    spark = df.sparkSession

    def laid(rows: DataFrame, parts: int) -> DataFrame:
        return rows.repartition(parts, key, PIECE).sortWithinPartitions(key, PIECE, EDGE, *order)

    whole = df.withColumns({PIECE: F.lit(0), EDGE: F.lit(0)})
    large = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    total = large.agg(F.sum("n")).first()[0]
    if not total:
        return laid(whole, partitions(spark)), None
    keys = checkpointed(large.select(key))
    parts = max(2, -(-2 * total // most))
    ordered = df.join(keys, key, "left_semi").select(df.columns).repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    ordered = checkpointed(ordered.withColumns({PIECE: F.spark_partition_id(), EDGE: F.lit(0)}))

    def borders(part: pa.Table):
        """Rows of the first and of the last key that may be copied."""
        starts = runs_of(part[key])
        may = np.flatnonzero(np.ones(part.num_rows, bool) if eligible is None else eligible(part))
        return may[may < (starts[1] if len(starts) > 1 else part.num_rows)], may[may >= starts[-1]], len(starts) == 1

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = whole_partition(batches)
        if part is not None:
            first, last, one = borders(part)
            row = (part[PIECE][0].as_py(), part[key][0].as_py(), len(first), part[key][-1].as_py(), len(last), one)
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["p", "first", "n_first", "last", "n_last", "one"])

    facts = sorted(ordered.mapInArrow(count, "p int, first string, n_first int, last string, n_last int, one boolean").collect())
    sends: dict[int, list[tuple[int, int, int]]] = {}  # slice: (where to, which side of it, rows)
    for i, f in enumerate(facts):
        for way, need, name in ((-1, before, f.first), (1, after, f.last)):
            j = i + way
            while need > 0 and 0 <= j < len(facts) and (facts[j].last if way < 0 else facts[j].first) == name:
                n = min(need, facts[j].n_last if way < 0 else facts[j].n_first)
                if n:
                    sends.setdefault(facts[j].p, []).append((f.p, way, n))
                need -= n
                j = j + way if facts[j].one else -1

    def copy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = whole_partition(batches)
        if part is None:
            return
        first, last, _ = borders(part)
        for to, way, n in sends.get(part[PIECE][0].as_py(), ()):
            t = part.take(pa.array(last[len(last) - n :] if way < 0 else first[:n]))
            for name, value in ((PIECE, to), (EDGE, way)):
                t = t.set_column(t.schema.get_field_index(name), name, pa.array(np.full(n, value, np.int32)))
            yield from t.to_batches()

    slices = laid(ordered.unionByName(ordered.mapInArrow(copy, ordered.schema)), max(parts, partitions(spark)))
    return laid(whole.join(keys, key, "left_anti").select(whole.columns), partitions(spark)), slices


def running_total(df: DataFrame, key: str, amount: str, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with the total of ``amount`` over all rows up to each one in order of ``key``, over the whole table and without one task
    holding it: partitions of the sorted table add up their own rows, and get the totals of those before from one number each."""
    from pyspark import TaskContext

    ordered = sorted_once(df, key, parts=parts or partitions(df.sparkSession))  # rows pass through, a partition of any size will do

    def total(batches):
        n = sum(float(np.nansum(b.column(b.schema.get_field_index(amount)).to_numpy(zero_copy_only=False).astype(float))) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n])], names=["pid", "n"])

    sums = {r["pid"]: r["n"] for r in ordered.select(amount).mapInArrow(total, "pid int, n double").collect()}
    before, so_far = {}, 0.0
    for pid in sorted(sums):
        before[pid], so_far = so_far, so_far + sums[pid]

    def add(batches):
        at = before.get(TaskContext.get().partitionId(), 0.0)
        for b in batches:
            if b.num_rows:
                x = np.nan_to_num(b.column(b.schema.get_field_index(amount)).to_numpy(zero_copy_only=False).astype(float))
                run = at + np.cumsum(x)
                at = float(run[-1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(run)], names=[*b.schema.names, name])

    return ordered.mapInArrow(add, T.StructType([*ordered.schema.fields, T.StructField(name, T.DoubleType())]))


def group_medians(df: DataFrame, key: str, value: str) -> dict[str, tuple[float, int]]:
    """(exact median, number of values) of each of a bounded number of groups; a group of any size, as it spreads over the sorted partitions."""
    from pyspark import TaskContext

    ordered = sorted_once(df.select(key, value), key, value)

    def groups(batches):
        part = whole_partition(batches)
        if part is not None:
            starts = runs_of(part[key])
            yield part[key].take(pa.array(starts)).combine_chunks(), starts, np.r_[starts[1:], part.num_rows], part[value].to_numpy()

    def count(batches):
        for names, starts, ends, _ in groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(starts), pa.int32()), names, pa.array(ends - starts)], names=["pid", "key", "n"])

    before, total = {}, {}
    for pid, name, n in sorted(map(tuple, ordered.mapInArrow(count, "pid int, key string, n bigint").collect())):
        before[pid, name] = total.get(name, 0)
        total[name] = before[pid, name] + n

    def pick(batches):
        pid = TaskContext.get().partitionId()
        for names, starts, ends, x in groups(batches):
            for name, a, b in zip(names.to_pylist(), starts, ends):
                n, at = total[name], before[pid, name]
                got = [float(x[a + k - at]) for k in ((n - 1) // 2, n // 2) if at <= k < at + b - a]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(got)), pa.array(got)], names=["key", "x"])

    middle: dict[str, list[float]] = {}
    for name, x in ordered.mapInArrow(pick, "key string, x double").collect():
        middle.setdefault(name, []).append(x)
    return {name: (sum(xs) / 2, total[name]) for name, xs in middle.items()}
