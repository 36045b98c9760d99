"""Irregular readings onto a regular grid, gaps filled by iterative singular-spectrum imputation.

Readings are first reduced to one mean per source and hour, on every executor before anything moves, so a dense source weighs no more than its hours. The
time of a source is cut into buckets of ``BUCKET`` hours of absolute time; a bucket takes ``HALO`` hours of its neighbours along and then is work of its own,
so a long source spreads over the cluster. All buckets of a batch are imputed side by side: a bucket is embedded as a Hankel trajectory of ``LAG`` hours (of
half its length if that is less), projected on its leading singular vectors, averaged back along the diagonals, and the missing entries are replaced until
they stop moving; a bucket that doesn't is marked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtime.operators.ranges import starts_of, streamed
from loomtime.runtime import partitions

HOUR = 3_600_000_000
BUCKET = 336  # two weeks
HALO = 48  # hours of either neighbour
LAG = 24
RANK = 4  # level, and a daily wave with a change of its height
SETTLED = 2e-3  # of the bucket's standard deviation
SAFETY = 2000  # rounds after which a bucket that still moves is given up and marked
BLOCK = 16  # buckets embedded at once


def _interpolate(x: np.ndarray, known: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows with their unknown entries on straight lines between known ones (ends held)."""
    n, width = x.shape
    at = np.arange(width)
    left = np.maximum.accumulate(np.where(known, at, -1), axis=1)
    right = np.minimum.accumulate(np.where(known, at, width)[:, ::-1], axis=1)[:, ::-1]
    rows = np.arange(n)[:, None]
    lo, hi = x[rows, np.clip(left, 0, width - 1)], x[rows, np.clip(right, 0, width - 1)]
    part = (at - left) / np.maximum(right - left, 1)
    return np.where(left < 0, hi, np.where(right >= width, lo, lo + (hi - lo) * part))


def _first_guess(x: np.ndarray, known: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The rows' mean day plus what is left of it on straight lines; hours of the day that are never known count as the row's mean."""
    n, width = x.shape
    days = width // LAG  # the width is a number of whole days
    sums, counts = (a.reshape(n, days, LAG).sum(1) for a in (np.where(known, x, 0.0), known.astype(float)))
    mean = (sums.sum(1) / np.maximum(counts.sum(1), 1))[:, None]
    day = np.where((counts > 1) & (counts.sum(1) >= 2 * LAG)[:, None], sums / np.maximum(counts, 1), mean)
    course = np.tile(day, (1, days))
    return course + _interpolate(np.where(known, x - course, 0.0), known, size)


def _settle(y: np.ndarray, known: np.ndarray, size: np.ndarray, lag: int, rank_kept: int) -> np.ndarray:
    """Replaces the gaps of standardized buckets in place until each bucket moves by at most SETTLED in a round whose singular vectors are exact;
    the rows that did. A bucket is given up after SAFETY rounds or four times the range of what is known."""
    width = y.shape[1]
    inside = np.arange(width) < size[:, None]
    windows = (np.arange(width - lag + 1) <= (size - lag)[:, None]).astype(float)
    cover = np.zeros(y.shape)
    for j in range(lag):
        cover[:, j : j + windows.shape[1]] += windows
    cover = np.maximum(cover, 1)
    gap = inside & ~known
    limit = 4 * np.abs(np.where(known, y, 0)).max(1)
    settled, live, base = np.zeros(len(y), bool), np.arange(len(y)), np.empty((len(y), lag, rank_kept))
    exact = np.ones(len(y), bool)  # decomposed anew this round
    for _ in range(SAFETY):
        keep = []
        for a in range(0, len(live), BLOCK):
            r = live[a : a + BLOCK]
            was = y[r]
            seen = np.lib.stride_tricks.sliding_window_view(was, windows.shape[1], axis=1) * windows[r, None]
            cov = np.matmul(seen, seen.transpose(0, 2, 1))
            new = exact[r]
            if new.any():
                _, vectors = np.linalg.eigh(cov[new])
                base[r[new]] = vectors[:, :, -rank_kept:]
            if not new.all():  # the leading singular vectors move little: one step of subspace iteration follows them
                base[r[~new]], _ = np.linalg.qr(np.matmul(cov[~new], base[r[~new]]))
            rank = np.matmul(base[r], np.matmul(base[r].transpose(0, 2, 1), seen))
            smooth = np.zeros(was.shape)
            for j in range(lag):
                smooth[:, j : j + rank.shape[2]] += rank[:, j]
            step = np.where(gap[r], smooth / cover[r] - was, 0)
            y[r] = was + step
            still = np.abs(step).max(1) > SETTLED
            settled[r] = ~still & new
            exact[r] = ~still & ~new
            keep.append(r[~settled[r] & (np.abs(y[r]).max(1) <= limit[r])])
        live = np.concatenate(keep)
        if not len(live):
            break
    return settled


def fill(x: np.ndarray, known: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (rows, padded to one width of whole days) with unknown entries filled, and the rows whose imputation was given up; only the first ``size``
    entries of a row count.

    Rows shorter than 2*LAG are embedded with a lag of half their length (2 at least) and as many singular vectors as half of that, at most RANK. Rows given up
    (those that move on after SAFETY rounds, and those that settle or run off beyond twice the range of what is known) are filled by their mean day and straight
    lines. A row without a known entry stays NaN."""
    filled = _first_guess(np.where(known, x, 0.0), known, size)
    count = known.sum(1)
    filled[count == 0] = np.nan
    lost = np.zeros(len(x), bool)
    lags = np.clip(size // 2, 2, LAG)
    gaps = (count > 0) & (count < size)
    for lag in np.unique(lags[gaps]):
        r = np.flatnonzero(gaps & (lags == lag))
        width = x.shape[1] if lag == LAG else int(size[r].max())
        y, k, n = filled[r, :width], known[r, :width], count[r]
        mean = (np.where(k, y, 0).sum(1) / n)[:, None]
        spread = np.sqrt((np.where(k, y - mean, 0) ** 2).sum(1) / n)[:, None]
        spread[spread == 0] = 1
        y = np.where(np.arange(width) < size[r, None], (y - mean) / spread, 0)
        bound = np.maximum(2 * np.abs(np.where(k, y, 0)).max(1), SETTLED)
        good = _settle(y, k, size[r], int(lag), max(1, min(RANK, int(lag) // 2))) & (np.abs(y).max(1) <= bound)
        better = filled[r]
        better[good, :width] = (y * spread + mean)[good]
        filled[r] = better
        lost[r] = ~good
    return np.where(known, x, filled), lost


def impute(x: np.ndarray, known: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``fill`` without its marks."""
    return fill(x, known, size)[0]


def _regular(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hours of whole buckets, each headed by a row without hour that has the first and last hour of its source, as the hours of the grid."""
    for t in streamed(batches, ["id", "bucket"]):
        starts = starts_of(t, ["id", "bucket"])
        head = t["hour"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        which = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, t.num_rows]))
        real = head[starts]  # others are a neighbour's hours beyond the source's end
        if not real.any():
            continue
        number = np.cumsum(real) - 1
        names, bucket = t["id"].combine_chunks().take(pa.array(starts[real])), t["bucket"].to_numpy()[starts[real]]
        first, last = t["first"].to_numpy(zero_copy_only=False)[starts[real]].astype(np.int64), t["last"].to_numpy(zero_copy_only=False)[starts[real]].astype(np.int64)
        low, high = np.maximum(bucket * BUCKET, first), np.minimum(bucket * BUCKET + BUCKET - 1, last)
        begin = np.maximum(low - HALO, first)
        size = np.minimum(high + HALO, last) - begin + 1
        rows = np.flatnonzero(~head & real[which])
        own = number[which[rows]]
        hour = t["hour"].to_numpy(zero_copy_only=False)[rows].astype(np.int64)
        table, mask, count = np.zeros((len(names), BUCKET + 2 * HALO)), np.zeros((len(names), BUCKET + 2 * HALO), bool), np.zeros((len(names), BUCKET + 2 * HALO), np.int64)
        at = hour - begin[own]
        table[own, at], mask[own, at], count[own, at] = t["value"].to_numpy(zero_copy_only=False)[rows], True, t["n"].to_numpy(zero_copy_only=False)[rows].astype(np.int64)
        full, lost = fill(table, mask, size)
        # the buckets' own hours
        length = high - low + 1
        who = np.repeat(np.arange(len(names)), length)
        step = np.arange(len(who)) - np.repeat(np.r_[0, np.cumsum(length)[:-1]], length)
        place = step + (low - begin)[who]
        value, known, readings = full[who, place], mask[who, place], count[who, place]
        empty = ~known & np.isnan(value)
        status = np.where(known, 0, np.where(empty, 2, np.where(lost[who], 3, 1)))
        labels = pa.DictionaryArray.from_arrays(pa.array(status, pa.int8()), pa.array(["observed", "filled", "missing", "unsettled"])).dictionary_decode()
        out = pa.Table.from_arrays([names.take(pa.array(who)), pa.array((low[who] + step) * HOUR), pa.array(value, mask=empty), pa.array(readings), labels],
                                   names=["id", "start_us", "value", "n_readings", "status"])
        yield from out.to_batches(max_chunksize=200_000)


def regularize(df: DataFrame, source: str = "id", date: str = "date", value: str = "value") -> DataFrame:
    """(source, hour_start, value, n_readings, status): one row for each source and clock hour from its first to its last reading.

    ``status`` is 'observed' (value: mean of the hour's distinct readings), 'filled' (value imputed), 'unsettled' (value given by mean day and straight lines,
    as the bucket's imputation doesn't settle) or 'missing' (nothing known in the hour's bucket and ``HALO`` hours round it; value null). Rows without source,
    date or value (null, NaN) are no readings; repeated readings (same source, date and value) count once; a source of one reading has one row; infinite values
    are left out like NaN. An empty table gives no rows; other columns are ignored.
    """
    t, v = F.col(date).cast("timestamp"), F.col(value).cast("double")
    ok = F.col(source).isNotNull() & t.isNotNull() & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = df.where(ok).select(F.col(source).cast("string").alias("id"), F.unix_micros(t).alias("t"), v.alias("v"))
    clock = F.expr(f"cast(floor(t / {HOUR}) as bigint)")
    # distinct readings; both steps combine before they shuffle
    distinct = rows.distinct().withColumn("hour", clock)
    hourly = distinct.groupBy("id", "hour").agg(F.avg("v").alias("value"), F.count(F.lit(1)).alias("n"))
    bucket, place = F.expr(f"cast(floor(hour / {BUCKET}) as bigint)"), F.expr(f"pmod(hour, {BUCKET})")
    near = F.array_compact(F.array(bucket, F.when(place < HALO, bucket - 1), F.when(place >= BUCKET - HALO, bucket + 1)))
    none = F.lit(None).cast("bigint")
    hours = hourly.select("id", F.explode(near).alias("bucket"), "hour", "value", "n", none.alias("first"), none.alias("last"))
    ends = rows.groupBy("id").agg(F.min("t").alias("a"), F.max("t").alias("z")).select("id", *(F.expr(f"cast(floor({c} / {HOUR}) as bigint)").alias(n) for c, n in (("a", "first"), ("z", "last"))))
    heads = ends.select("id", F.explode(F.sequence(F.expr(f"cast(floor(first / {BUCKET}) as bigint)"), F.expr(f"cast(floor(last / {BUCKET}) as bigint)"))).alias("bucket"),
                        none.alias("hour"), F.lit(None).cast("double").alias("value"), none.alias("n"), "first", "last")
    ordered = hours.unionByName(heads).repartition(partitions(df.sparkSession), "id", "bucket").sortWithinPartitions("id", "bucket", "hour")
    out = ordered.mapInArrow(_regular, "id string, start_us bigint, value double, n_readings bigint, status string")
    return out.select(F.col("id").alias(source), F.timestamp_micros("start_us").alias("hour_start"), "value", "n_readings", "status")
