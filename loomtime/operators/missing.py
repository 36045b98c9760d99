"""Missing numbers and categories filled from records of the same group and the same time.

A field holds nothing if it is null, NaN, empty, blank or only a marker put in place of content. Each row is described by what its group's other days and
the other groups' same day say about it; these descriptions follow a mixture whose components have a Gaussian block (own value, interpolation of the
group's neighbouring days, the group's values a week off, the other groups' mean of that day; all on the group's own scale) and a categorical block
(whether the group's nearest known category and the one on the other side are known and equal, and which of them the own category is, if any). So the
model has the same size for any number of categories. Expectation-maximisation fits it with missing entries in any place: it begins with a bounded
sample, then goes on over all rows until the likelihood settles; executors add up sufficient statistics of a fixed size. Missing numbers become
conditional expectations, missing categories conditional modes; masks mark what was filled.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtime.operators.ranges import runs_of, streamed
from loomtime.runtime import checkpointed, nan_to_null, partitions

# What people and programs put in place of a number or a text that they don't have
NUMBER_MARKERS = (-1.0, -9.0, -99.0, -999.0, -9999.0, -99999.0, -999999.0, 9999.0, 99999.0, 999999.0, 9999999.0)
TEXT_MARKERS = ("na", "n/a", "#n/a", "n.a.", "nan", "null", "none", "nil", "missing", "unknown", "undefined", "unspecified", "not available",
                "not applicable", "no data", "empty", "blank", "tbd", "tba", "todo", "xxx", "(null)", "<null>", "(none)", "<na>", "[null]")

D = 4  # own value, interpolation, a week off, same day elsewhere


def text_holds_nothing(column):
    """Null, blank, without any letter or digit, or a marker (letter case and outer blanks aside)."""
    plain = F.lower(F.trim(F.regexp_replace(column, r"[\s ​﻿]+", " ")))
    return column.isNull() | ~F.coalesce(plain.rlike(r"[\p{L}\p{N}]"), F.lit(False)) | plain.isin(*TEXT_MARKERS)


class Mixture:
    """Parameters of the mixture and the two steps of its fitting.

    Rows come as x (numbers, NaN where missing), ``around`` (0: no known category in the group's other days, 1: one, 2: different ones before and
    after) and ``own`` (0: the nearest one, 1: the one on the other side, 2: another one, -1: missing).
    """

    def __init__(self, components: int):
        k = components
        width = np.geomspace(0.05, 4, k)  # from rows that follow their neighbours closely to rows that hardly do
        self.weight = np.full(k, 1 / k)
        self.table = np.full((k, 3, 3), 1 / 9)  # component, around, own
        self.mean = np.zeros((k, D))
        self.cov = width[:, None, None] * 0.5 * np.eye(D) + 0.5

    def posterior(self, x: np.ndarray, around: np.ndarray, own: np.ndarray):
        """(responsibilities, filled means k x n x D, conditional covariances by pattern, pattern of each row, log likelihood)."""
        n, k = len(x), len(self.weight)
        either = np.concatenate([self.table, self.table.sum(2, keepdims=True)], axis=2)  # the last one for a missing own category
        log = np.log(np.maximum(self.weight, 1e-12)) + np.log(either)[:, around, own].T
        seen = ~np.isnan(x)
        pattern = seen @ (1 << np.arange(D))
        full = np.repeat(np.where(seen, x, 0)[None], k, axis=0)
        spare = {}
        for p in np.flatnonzero(np.bincount(pattern, minlength=1 << D)):
            rows = np.flatnonzero(pattern == p)
            o = np.flatnonzero((p >> np.arange(D)) & 1)
            m = np.setdiff1d(np.arange(D), o)
            known = x[np.ix_(rows, o)]
            for c in range(k):
                s = self.cov[c]
                rest = s[np.ix_(m, m)]
                if len(o):
                    root = np.linalg.cholesky(s[np.ix_(o, o)])
                    inverse = np.linalg.inv(root)
                    d = known - self.mean[c, o]
                    log[rows, c] -= 0.5 * ((d @ inverse.T) ** 2).sum(1) + np.log(np.diag(root)).sum() + 0.9189385332046727 * len(o)
                    if len(m):
                        gain = s[np.ix_(m, o)] @ inverse.T @ inverse
                        rest = rest - gain @ s[np.ix_(o, m)]
                        full[c][np.ix_(rows, m)] = self.mean[c, m] + d @ gain.T
                else:
                    full[c][np.ix_(rows, m)] = self.mean[c, m]
                extra = np.zeros((D, D))
                extra[np.ix_(m, m)] = rest
                spare[p, c] = extra
        top = log.max(1, keepdims=True)
        r = np.exp(log - top)
        total = r.sum(1, keepdims=True)
        return r / total, full, spare, pattern, float((np.log(total) + top).sum())

    def statistics(self, x: np.ndarray, around: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Expected sufficient statistics of some rows as one flat vector; vectors of separate rows add up."""
        k = len(self.weight)
        count, first, second = np.zeros(k), np.zeros((k, D)), np.zeros((k, D, D))
        tables = np.zeros((k, 3, 4))
        likelihood = 0.0
        for a in range(0, len(x), 50_000):
            s = slice(a, a + 50_000)
            r, full, spare, pattern, ll = self.posterior(x[s], around[s], own[s])
            likelihood += ll
            count += r.sum(0)
            cell = around[s] * 4 + own[s] % 4
            for c in range(k):
                f = full[c]
                first[c] += r[:, c] @ f
                second[c] += (f * r[:, c, None]).T @ f
                by_pattern = np.bincount(pattern, r[:, c], minlength=1 << D)
                second[c] += sum(by_pattern[p] * spare[p, c] for p in np.flatnonzero(by_pattern))
                tables[c] += np.bincount(cell, r[:, c], minlength=12).reshape(3, 4)
        chance = self.table / self.table.sum(2, keepdims=True)
        tables = tables[:, :, :3] + tables[:, :, 3:] * chance
        return np.r_[likelihood, len(x), count, first.ravel(), second.ravel(), tables.ravel()]

    def improve(self, flat: np.ndarray) -> float:
        """New parameters from added-up statistics (a light prior keeps them proper); the log likelihood a row before."""
        k = len(self.weight)
        count, first, second, tables = np.split(flat[2:], np.cumsum([k, k * D, k * D * D]))
        first, second, tables = first.reshape(k, D), second.reshape(k, D, D), tables.reshape(k, 3, 3)
        self.weight = (count + 1) / (count.sum() + k)
        self.mean = first / (count + 1)[:, None]
        prior = 0.02 * np.eye(D)
        m = self.mean[:, :, None]
        cross = m * first[:, None, :]
        about = second - cross - cross.transpose(0, 2, 1) + count[:, None, None] * m * self.mean[:, None, :]
        self.cov = (about + prior * 5) / (count + 5)[:, None, None]
        self.cov = (self.cov + self.cov.transpose(0, 2, 1)) / 2 + 1e-4 * np.eye(D)
        self.table = (tables + 0.05) / (tables + 0.05).sum((1, 2), keepdims=True)
        return flat[0] / max(flat[1], 1)

    def likely(self, r: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Chances that the own category is the nearest one, the one on the other side, or another."""
        return np.einsum("nk,kno->no", r, self.table[:, around] / self.table[:, around].sum(2, keepdims=True))


def _rows(part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("x0", "x1", "x2", "x3")], axis=1).astype(float)
    return x, part.column("around").to_numpy(zero_copy_only=False).astype(np.int64), part.column("own").to_numpy(zero_copy_only=False).astype(np.int64)


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Days of whole groups in order of date (one without date first): what the group's other days say about each. A group has no more rows than days."""
    for t in streamed(batches, ["g"]):
        starts = runs_of(t["g"])
        size = np.diff(np.r_[starts, t.num_rows])
        src = np.repeat(np.arange(len(starts)), size)
        at, begin, end = np.arange(t.num_rows), starts[src], (starts + size)[src] - 1
        m, n = t["m"].to_numpy().astype(float), t["n"].to_numpy().astype(float)
        dated = ~np.isnan(n)
        has = ~np.isnan(m)
        count = np.bincount(src, has)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.bincount(src, np.where(has, m, 0)) / count
            sd = np.sqrt(np.bincount(src, np.where(has, (m - mean[src]) ** 2, 0)) / count)
        sd = np.where(sd > 0, sd, 1.0)
        own = (m - mean[src]) / sd[src]
        least, most = np.fmin.reduceat(t["lo"].to_numpy().astype(float), starts), np.fmax.reduceat(t["hi"].to_numpy().astype(float), starts)

        def beside(known):
            """Rows of the nearest known day before and after each, -1 where there is none."""
            last = np.maximum.accumulate(np.where(known, at, -1))
            before = np.r_[-1, last[:-1]]
            following = np.minimum.accumulate(np.where(known, at, len(at))[::-1])[::-1]
            after = np.r_[following[1:], len(at)]
            return np.where(before >= begin, before, -1), np.where(after <= end, after, -1)

        p, f = beside(has & dated)
        x1 = np.where(p < 0, own[f], own[p])
        both = (p >= 0) & (f >= 0)
        part = (n - n[p]) / np.maximum(n[f] - n[p], 1)
        x1 = np.where(both, own[p] + (own[f] - own[p]) * part, np.where((p < 0) & (f < 0), np.nan, x1))
        x1[~dated] = np.nan
        key = src * 1e8 + np.where(dated, n, -4e7)  # rising
        week = []
        for step in (-7, 7):
            there = np.minimum(np.searchsorted(key, key + step), len(at) - 1)
            week.append(np.where(dated & (key[there] == key + step), own[there], np.nan))
        x2 = np.where(np.isnan(week[0]), week[1], np.where(np.isnan(week[1]), week[0], (week[0] + week[1]) / 2))
        p, f = beside(~np.array(t["k"].combine_chunks().is_null()) & dated)
        with np.errstate(invalid="ignore"):
            nearer = (p >= 0) & ((f < 0) | ~(n - n[p] > n[f] - n))
        near, far = np.where(nearer, p, f), np.where(nearer, f, p)
        k = t["k"].combine_chunks()
        pick = lambda i: k.take(pa.array(i, mask=i < 0))
        number = lambda x: pa.array(x, mask=np.isnan(x))
        out = [t["g"].combine_chunks(), t["d"].combine_chunks(), number(mean[src]), pa.array(sd[src]), number(least[src]), number(most[src]), number(x1), number(x2), pick(near), pick(far), number(own)]
        names = ["fg", "fd", "mean", "sd", "least", "most", "x1", "x2", "near", "far", "own"]
        yield from pa.Table.from_arrays(out, names=names).to_batches(max_chunksize=50_000)


def describe(df: DataFrame, row: str, group: str, date: str, value: str, category: str, markers: Sequence[float]) -> DataFrame:
    """Each row with its content, its masks, its group's scale and the description the mixture works on."""
    v = nan_to_null(F.col(value).cast("double"))
    c = F.col(category).cast("string")
    rows = df.select(F.col(row).cast("bigint").alias("row"), F.col(group).cast("string").alias("g"), F.to_date(date).alias("d"), v.alias("v"),
                     F.when(~text_holds_nothing(c), c).alias("c"))
    odd = F.coalesce(F.col("v").isin(*[float(m) for m in markers]), F.lit(False))
    rows = rows.withColumn("odd", odd)
    daily = rows.groupBy("g", "d").agg(F.avg(F.when(~odd, F.col("v"))).alias("m"), F.min(F.when(~odd, F.col("v"))).alias("lo"),
                                       F.max(F.when(~odd, F.col("v"))).alias("hi"), F.min(F.when(F.col("c").isNotNull(), F.xxhash64("c"))).alias("k"))
    daily = daily.withColumn("n", F.datediff("d", F.lit("1970-01-01"))).repartition(partitions(df.sparkSession), "g").sortWithinPartitions("g", "n")
    facts = checkpointed(daily.mapInArrow(_neighbours, "fg string, fd date, mean double, sd double, least double, most double, x1 double, x2 double, near bigint, far bigint, own double"))
    day = facts.groupBy(F.col("fd").alias("d")).agg(F.avg("own").alias("sum_day"), F.count("own").alias("of_day"))
    facts = facts.join(day.withColumnRenamed("d", "dd"), F.col("fd").eqNullSafe(F.col("dd")), "left")
    others = F.when(F.col("of_day") - F.col("own").isNotNull().cast("int") > 0,
                    (F.col("sum_day") * F.col("of_day") - F.coalesce("own", F.lit(0.0))) / (F.col("of_day") - F.col("own").isNotNull().cast("int")))
    facts = facts.withColumn("x3", others)
    joined = rows.join(facts, F.col("g").eqNullSafe(F.col("fg")) & F.col("d").eqNullSafe(F.col("fd")), "left")
    # a marker-like number inside the range of the group's other numbers is a number
    marker = F.col("odd") & ~F.coalesce(F.col("v").between(F.col("least"), F.col("most")), F.lit(False))
    joined = joined.withColumn("v", F.when(~marker, F.col("v")))
    code = F.xxhash64("c")  # categories are told apart by 64 bits; their names come back where one is filled
    around = F.when(F.col("near").isNull(), 0).when(F.coalesce(F.col("far") != F.col("near"), F.lit(False)), 2).otherwise(1)
    own = F.when(F.col("c").isNull(), -1).when(F.coalesce(code == F.col("near"), F.lit(False)), 0).when(F.coalesce(code == F.col("far"), F.lit(False)), 1).otherwise(2)
    return joined.select("row", "g", "v", "c", "mean", "sd", ((F.col("v") - F.col("mean")) / F.col("sd")).alias("x0"), "x1", "x2", "x3", "near", "far", around.alias("around"), own.alias("own"))


def fill_missing(df: DataFrame, row: str = "row_no", group: str = "id", date: str = "date", value: str = "value", category: str = "category",
                 markers: Sequence[float] = NUMBER_MARKERS, components: int = 6, start_rows: int = 20_000, tolerance: float = 1e-3, safety: int = 200) -> DataFrame:
    """(row, group, value, category, value_filled, category_filled): every row of ``df`` with both fields filled, and marks on what was.

    Null, NaN, blank and marker fields are missing (a marker number within the range of its group's other numbers is a number). Rows with a null
    group or date form groups of their own; a group without any number is filled on the scale of all rows, one without any category with the commonest of
    all; repeated rows are filled alike; without any known number (category) at all the numbers (categories) stay null, still marked. Other columns are
    ignored. Fitting begins with about ``start_rows`` rows, picked by a hash, and goes on over all rows until the log likelihood a row changes by at most
    ``tolerance`` (``safety`` only guards against a loop without end).
    """
    spark = df.sparkSession
    table = checkpointed(describe(df, row, group, date, value, category, markers))
    # one pass: what each category adds to the totals, then these
    parts = checkpointed(table.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("k"), F.avg("v").alias("m"), F.var_pop("v").alias("q")))
    k, m = F.sum("k"), F.try_divide(F.sum(F.col("k") * F.col("m")), F.sum("k"))
    scale = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), m.alias("m"), (F.try_divide(F.sum(F.col("k") * (F.col("q") + F.col("m") * F.col("m"))), k) - m * m).alias("q"),
                      F.max_by(F.col("c"), F.struct(F.col("c").isNotNull(), F.col("n"), F.col("c"))).alias("c")).first()
    centre, spread, commonest = scale["m"], math.sqrt(max(scale["q"] or 0, 0)) or 1.0, scale["c"]
    model = Mixture(components)

    narrow = table.select("x0", "x1", "x2", "x3", "around", "own")
    share = max(1, scale["n"] // start_rows)
    some = narrow if share == 1 else table.where(F.pmod(F.xxhash64("row"), F.lit(share)) == 0).select(narrow.columns).limit(4 * start_rows)
    first = _rows(some.toArrow())
    before = None
    for _ in range(safety if len(first[0]) else 0):
        now = model.improve(model.statistics(*first))
        if before is not None and abs(now - before) <= tolerance / 10:
            break
        before = now

    before = None
    for _ in range(safety):
        sent = spark.sparkContext.broadcast(model)

        def expect(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    flat = sent.value.statistics(*_rows(b))
                    total = flat if total is None else total + flat
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "s"])

        sums = narrow.mapInArrow(expect, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toArrow()["s"].to_numpy()
        if not len(sums):
            break
        now = model.improve(sums)
        if before is not None and abs(now - before) <= tolerance:
            break
        before = now

    sent = spark.sparkContext.broadcast(model)

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = sent.value
            x, around, own = _rows(b)
            r, full, _, _, _ = m.posterior(x, around, own)
            expected = np.einsum("nk,kn->n", r, full[:, :, 0])
            own_mean, own_sd = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("mean", "sd"))
            if centre is not None:
                own_sd = np.where(np.isnan(own_mean), spread, own_sd)
                own_mean = np.where(np.isnan(own_mean), centre, own_mean)
            number = own_mean + own_sd * expected
            chance = m.likely(r, around)
            code = pc.if_else(pa.array((around == 2) & (chance[:, 1] > chance[:, 0])), b.column("far"), b.column("near"))
            kept = [b.column(c) for c in ("row", "g", "v", "c")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(number, mask=np.isnan(number)), code], names=["row", "g", "v", "c", "number", "code"])

    whole = F.col("v").isNotNull() & F.col("c").isNotNull()
    made = table.where(~whole).mapInArrow(fill, "row bigint, g string, v double, c string, number double, code bigint")
    names = parts.where("c IS NOT NULL").select(F.xxhash64("c").alias("code"), F.col("c").alias("name")).groupBy("code").agg(F.min("name").alias("name"))
    named = F.when(F.col("near_code").isNotNull(), F.col("name"))
    made = made.withColumnRenamed("code", "near_code").withColumn("code", F.coalesce("near_code", F.xxhash64("row")))  # rows without a code aren't all one key
    made = made.join(names, "code", "left").select("row", "g", F.coalesce("v", "number"), F.coalesce("c", named, F.lit(commonest)), F.col("v").isNull(), F.col("c").isNull())
    out = table.where(whole).select("row", "g", "v", "c", F.lit(False), F.lit(False)).union(made)
    return out.toDF(row, group, value, category, "value_filled", "category_filled")
