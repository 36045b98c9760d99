"""Totals and averages over trailing days, quiet days included.

Lines become one row per entity and day (combined before the shuffle). Time is cut into tiles of ``TILE`` days; a day's row goes to its
own tile and, if it still counts there, to the next one as its halo of preceding days. A partition packs its entities' tiles
into one dense block (entities x days) and multiplies it by a banded 0/1 window operator per period, so a hot entity is split by time
and no task holds a whole history.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtime.operators.ranges import runs_of
from loomtime.runtime import partitions

TILE = 64


def band(window: int, halo: int, tile: int = TILE) -> np.ndarray:
    """Operator of shape (halo + tile, tile): column j adds the ``window`` days that end on day j of the tile."""
    day = np.arange(halo + tile)[:, None] - halo
    out = np.arange(tile)[None, :]
    return ((day <= out) & (day > out - window)).astype(float)


def distinct_lines(df: DataFrame, keys: Sequence[str], latest: str | None, columns: Sequence[str]) -> DataFrame:
    """One row for each key: the one loaded last (ties: the greatest values). Rows with a null in the key can't be told to be repeats and all stay."""
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    body = F.struct(*([F.col(latest).alias("_latest")] if latest else []), *[F.col(c) for c in columns])
    kept = df.where(whole).groupBy(*keys).agg(F.max(body).alias("_line")).select(*[F.col(f"_line.{c}").alias(c) for c in columns])
    return kept.unionByName(df.where(~whole).select(*columns))


def trailing_totals(lines: DataFrame, entity: str, date: str, amount: str, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """(entity, day, lines, then total_w, count_w and average_w for each window w): one row for each entity and day from its first
    to its last day.

    ``lines`` counts the day's rows, also those without amount; totals and averages leave null and NaN amounts out; a window without
    amounts has total 0, count 0 and a null average. Rows without entity or date don't count; repeated rows count each (see
    ``distinct_lines``); an empty table gives no rows; other columns are ignored.
    """
    windows = sorted(set(int(w) for w in windows))
    if not windows or windows[0] < 1:
        raise ValueError("windows are numbers of days from 1 up")
    halo = windows[-1] - 1
    ahead = -(-halo // TILE)
    v = F.col(amount).cast("double")
    v = F.when(F.isnan(v), None).otherwise(v)
    daily = (lines.select(F.col(entity).cast("string").alias("entity"), F.unix_date(F.to_date(date)).alias("day"), v.alias("v"))
             .where("entity IS NOT NULL AND day IS NOT NULL")
             .groupBy("entity", "day").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"), F.count("v").alias("n"), F.count(F.lit(1)).alias("lines")))
    tile = F.expr(f"cast(floor(day / {TILE}) as int)")
    spans = daily.groupBy("entity").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    frame = spans.withColumn("tile", F.explode(F.sequence(F.floor(F.col("first") / TILE).cast("int"), F.floor(F.col("last") / TILE).cast("int"))))
    frame = frame.select("entity", "tile", F.lit(None).cast("int").alias("day"), F.lit(None).cast("double").alias("total"), F.col("first").cast("bigint").alias("n"), F.col("last").cast("bigint").alias("lines"))
    placed = daily.select("entity", F.explode(F.sequence(tile, tile + ahead)).alias("tile"), "day", "total", "n", "lines")
    placed = placed.where(F.col("day") >= F.col("tile") * TILE - halo)
    bands = [band(w, halo) for w in windows]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for b in batches:
            if b.num_rows:
                held.append(pa.Table.from_batches([b]))
                rows += b.num_rows
            if rows >= 200_000:
                t = pa.concat_tables(held)
                e = runs_of(t["entity"])
                cut = int(e[-1])
                tiles = t["tile"].to_numpy()
                steps = np.flatnonzero(np.diff(tiles[cut:])) + 1
                cut = cut + int(steps[-1]) if len(steps) else cut
                if cut:
                    yield from block(t.slice(0, cut))
                held, rows = [t.slice(cut)], t.num_rows - cut
        if rows:
            yield from block(pa.concat_tables(held))

    def block(t: pa.Table) -> Iterator[pa.RecordBatch]:
        tiles = t["tile"].to_numpy()
        change = np.zeros(len(tiles), bool)
        change[runs_of(t["entity"])] = True
        change[1:] |= np.diff(tiles) != 0
        row = np.cumsum(change) - 1
        begin = np.flatnonzero(change)
        is_frame = t["day"].is_null().to_numpy() if hasattr(t["day"], "is_null") else np.isnan(t["day"].to_numpy())
        n, lines = t["n"].to_numpy(), t["lines"].to_numpy()
        first, last = np.zeros(len(begin), np.int64), np.full(len(begin), -1, np.int64)
        first[row[is_frame]], last[row[is_frame]] = n[is_frame], lines[is_frame]
        data = ~is_frame
        at = t["day"].fill_null(0).to_numpy()[data] - tiles[data].astype(np.int64) * TILE + halo
        total, count, own = (np.zeros((len(begin), halo + TILE)) for _ in range(3))
        total[row[data], at], count[row[data], at], own[row[data], at] = t["total"].to_numpy()[data], n[data], lines[data]
        day = tiles[begin].astype(np.int64)[:, None] * TILE + np.arange(TILE)
        inside = (day >= first[:, None]) & (day <= last[:, None])
        who, when = np.nonzero(inside)
        names = t["entity"].combine_chunks().take(pa.array(begin)).take(pa.array(who))
        columns = [names, pa.array(day[inside].astype(np.int32)), pa.array(own[:, halo:][inside].astype(np.int64))]
        for b in bands:
            s, c = (total @ b)[inside], (count @ b)[inside]
            columns += [pa.array(s), pa.array(c.astype(np.int64)), pa.array(np.divide(s, c, out=np.zeros_like(s), where=c > 0), mask=c == 0)]
        if len(who):
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    schema = T.StructType([T.StructField("entity", T.StringType()), T.StructField("day", T.IntegerType()), T.StructField("lines", T.LongType())])
    for w in windows:
        schema = schema.add(f"total_{w}", T.DoubleType()).add(f"count_{w}", T.LongType()).add(f"average_{w}", T.DoubleType())
    ordered = frame.unionByName(placed).repartition(partitions(lines.sparkSession), "entity", "tile").sortWithinPartitions("entity", "tile")
    out = ordered.mapInArrow(run, schema)
    return out.select(F.col("entity").alias(entity), F.date_from_unix_date("day").alias("day"), *[f.name for f in schema.fields[2:]])
