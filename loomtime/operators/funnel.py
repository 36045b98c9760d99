"""Correlation funnel: binary features and their correlation with a target."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtime.functions.select import Panel, unpack
from loomtime.operators.ranges import running_total, sorted_once, whole_partition
from loomtime.operators.rolling import correlation
from loomtime.runtime import checkpointed, is_temporal


def _q(name: str):
    return F.col(f"`{name}`")


def binarize(data: DataFrame | Panel, n_bins: int = 4, thresh_infreq: float = 0.01, name_infreq: str = "-OTHER", one_hot: bool = True, max_levels: int = 1000) -> DataFrame:
    """0/1 columns name__bin for each column.

    Numbers of more than n_bins + 3 values, and of more than two different quintiles, are cut at their quantiles (name__low_high with one decimal, a bin holds
    its upper border, the first also its lower); others and texts give one column a value, values rarer than ``thresh_infreq`` together in name_infreq. Null values, dates
    and an empty table raise ValueError; so do more than ``max_levels`` values of a text column that aren't rare.
    """
    df, _ = unpack(data)
    for f in df.schema:
        if is_temporal(f.dataType) or isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            raise ValueError(f"column {f.name!r} can't be made binary")
    df = df.withColumns({f.name: _q(f.name).cast("int") for f in df.schema if isinstance(f.dataType, T.BooleanType)})
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    shares = sorted({0.0, 0.2, 0.4, 0.6, 0.8, 1.0, *[i / n_bins for i in range(n_bins + 1)]})
    array = F.array(*[F.lit(s) for s in shares])
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count(_q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    aggs += [F.percentile(_q(c).cast("double"), array).alias(f"q{i}") for i, c in enumerate(numbers)]
    aggs += [F.approx_count_distinct(_q(c), 0.02).alias(f"d{i}") for i, c in enumerate(numbers)]
    seen = df.agg(*aggs).first()
    n = seen["__n"]
    if not n:
        raise ValueError("an empty table can't be made binary")
    holes = [c for i, c in enumerate(df.columns) if seen[f"c{i}"] != n]
    if holes:
        raise ValueError(f"columns with missing values: {holes}")
    few = [c for i, c in enumerate(numbers) if seen[f"d{i}"] <= 2 * (n_bins + 3) + 8]
    exact = df.agg(*[F.countDistinct(_q(c)).alias(f"e{i}") for i, c in enumerate(few)]).first() if few else ()
    low = {c for i, c in enumerate(few) if exact[i] <= n_bins + 3}
    cuts: dict[str, list[float]] = {}
    for i, c in enumerate(numbers):
        at = dict(zip(shares, seen[f"q{i}"]))
        if c not in low and len({at[s] for s in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)}) > 2:
            cuts[c] = list(dict.fromkeys(at[k / n_bins] for k in range(n_bins + 1)))
    # values of all other columns counted at once; those kept are at most 1 / thresh_infreq a column
    texts = {i: c for i, c in enumerate(df.columns) if c not in cuts}
    least = max(thresh_infreq, 1e-9)
    kept: dict[int, list[str]] = {i: [] for i in texts}
    rare: set[int] = set()
    if texts:
        cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("c"), _q(c).cast("string").alias("v")) for i, c in texts.items()])))
        counts = cells.groupBy("c", "v").agg(F.count(F.lit(1)).alias("k")).withColumn("often", F.col("k") / n >= least)
        place = F.row_number().over(Window.partitionBy("c").orderBy("v"))
        for r in counts.where("often").withColumn("at", place).where(F.col("at") <= max_levels + 1).orderBy("c", "v").collect():
            kept[r["c"]].append(r["v"])
        rare = {r["c"] for r in counts.where("NOT often").select("c").distinct().collect()}
    new = []
    for i, c in enumerate(df.columns):
        if c in cuts:
            b = cuts[c]
            for k, (a, z) in enumerate(zip(b, b[1:])):
                inside = (_q(c) <= z) & ((_q(c) >= a) if k == 0 else (_q(c) > a))
                new.append(inside.cast("int").alias(f"{c}__{round(a, 1)}_{round(z, 1)}"))
            continue
        if len(kept[i]) > max_levels:
            raise ValueError(f"{c!r} has more than max_levels={max_levels} values")
        text = _q(c).cast("string")
        new += [(text == v).cast("int").alias(f"{c}__{v}") for v in kept[i]]
        if i in rare:
            new.append((~text.isin(*kept[i]) if kept[i] else F.lit(True)).cast("int").alias(f"{c}__{name_infreq}"))
    return df.select(*new)


def correlate(data: DataFrame | Panel, target: str, method: str = "pearson") -> DataFrame:
    """(feature, bin, correlation) of every column with the target, strongest first; name__bin is split.

    Constant columns have a null correlation. Kendall's tau-b is exact and counted by sorting, not pair by pair.
    """
    df, _ = unpack(data)
    if target not in df.columns:
        raise ValueError(f"no column {target!r}")
    if method not in ("pearson", "spearman", "kendall"):
        raise ValueError("method is 'pearson', 'spearman' or 'kendall'")
    names = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    d = df.select(*[_q(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    t = names.index(target)
    if method == "spearman":
        d = average_ranks(d)
    if method == "kendall":
        found = [(c, kendall_tau(d, f"c{i}", f"c{t}")) for i, c in enumerate(names)]
    else:
        seen = d.agg(*[correlation(f"c{i}", f"c{t}").alias(f"r{i}") for i in range(len(names))]).first()
        found = [(c, None if seen[i] is None or seen[i] != seen[i] else float(seen[i])) for i, c in enumerate(names)]
    rows = [(c.split("__", 1)[0], c.split("__", 1)[1] if "__" in c else None, r) for c, r in found]
    rows.sort(key=lambda x: -1 if x[2] is None else abs(x[2]), reverse=True)
    return df.sparkSession.createDataFrame(rows, "feature string, bin string, correlation double")


def average_ranks(d: DataFrame) -> DataFrame:
    """Each column as ranks, ties sharing their mean rank; null stays null. Ranks come from the column's value counts, so ties are counted before they are
    sorted over the cluster."""
    out = d
    for c in d.columns:
        counts = d.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__k"))
        upto = running_total(counts, c, "__k", "__t")
        ranked = upto.select(F.col(c).alias("__v"), (F.col("__t") - (F.col("__k") - 1) / 2).alias("__r"))
        out = out.join(ranked, out[c] == F.col("__v"), "left").drop("__v", "__k", c).withColumnRenamed("__r", c)
    return out.select(*d.columns)


def inversions(y: np.ndarray, weight: np.ndarray) -> float:
    """Weighted number of pairs whose first has the greater y, by radix halves of the ranks: a level counts the pairs it tells apart."""
    _, r = np.unique(y, return_inverse=True)
    w = weight.astype(float)
    total = 0.0
    for b in range(int(r.max(initial=0)).bit_length() - 1, -1, -1):
        above = r >> (b + 1)
        one = (r >> b) & 1
        before = np.cumsum(w * one)
        start = np.flatnonzero(np.r_[True, np.diff(above) != 0])
        base = np.repeat(np.r_[0.0, before][start], np.diff(np.r_[start, len(r)]))
        total += float((w * (before - base))[one == 0].sum())
        order = np.argsort(r >> b, kind="stable")
        r, w = r[order], w[order]
    return total


def kendall_tau(d: DataFrame, a: str, b: str, part_rows: int = 1_000_000) -> float | None:
    """Tau-b of two columns, exact: distinct value pairs are sorted by (a, b) over the cluster and their discordant pairs counted within partitions, then
    between partitions by blocks of b, then within blocks. The driver gets the counts of a partition in a block, for parts of some ``part_rows`` rows."""
    from pyspark import TaskContext

    counts = d.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = checkpointed(counts)
    same = lambda *by: pairs.groupBy(*by).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0.0
    seen = pairs.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not seen[0]:
        return None
    total, x, y, both = seen[0] * (seen[0] - 1) / 2, same("x"), same("y"), same("x", "y")
    parts = max(1, -(-seen[1] // part_rows))
    ordered = sorted_once(pairs, "x", "y", parts=parts)
    edges = sorted({float(v) for v in pairs.agg(F.percentile_approx("y", [k / parts for k in range(1, parts)] or [0.5])).first()[0]}) if parts > 1 else []

    def within(batches):
        t = whole_partition(batches)
        if t is not None:
            y, n = t["y"].to_numpy(), t["n"].to_numpy()
            block = np.searchsorted(edges, y, "right")
            held, at = np.unique(block, return_inverse=True)
            sums = np.bincount(at, n)
            here = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([here] * (len(held) + 1), pa.int32()), pa.array(np.r_[-1, held].astype(np.int32)), pa.array(np.r_[inversions(y, n), sums])], names=["p", "block", "n"])

    found = ordered.mapInArrow(within, "p int, block int, n double").toPandas()
    discordant = found[found.block < 0].n.sum()
    if parts > 1:
        table = found[found.block >= 0].pivot_table(index="p", columns="block", values="n", fill_value=0.0).sort_index().sort_index(axis=1).to_numpy()
        later_below = np.cumsum(table[::-1], 0)[::-1] - table  # of later partitions
        lower = np.cumsum(later_below, 1) - later_below  # and lower blocks
        discordant += float((table * lower).sum())

        def number(batches):
            for t in batches:
                if t.num_rows:
                    y = t.column("y").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edges, y, "right").astype(np.int32)), pa.array(np.full(len(y), TaskContext.get().partitionId(), np.int32)), t.column("y"), t.column("n")], names=["block", "p", "y", "n"])

        def across(part: pa.Table) -> pa.Table:
            return pa.table({"n": [inversions(part["y"].to_numpy(), part["n"].to_numpy())]})

        marked = ordered.select("y", "n").mapInArrow(number, "block int, p int, y double, n double").groupBy("block", "p", "y").agg(F.sum("n").alias("n"))
        discordant += marked.groupBy("block").applyInArrow(lambda t: across(t.sort_by([("p", "ascending"), ("y", "ascending")])), "n double").agg(F.sum("n")).first()[0] or 0.0
    scale = np.sqrt((total - x) * (total - y))
    return float((total - x - y + both - 2 * discordant) / scale) if scale > 0 else None


def correlation_funnel(data: DataFrame, target: str, n_bins: int = 4, thresh_infreq: float = 0.01, method: str = "pearson") -> DataFrame:
    """``binarize`` and ``correlate`` in one."""
    return correlate(binarize(data, n_bins, thresh_infreq), target, method)
