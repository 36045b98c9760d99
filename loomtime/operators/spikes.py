"""Implausible readings: impossible in the unit, stuck, or far off what the source leads one to expect.

A source is one task's as long as it fits there; one of more than ``MOST`` rows is cut into slices over the cluster, and each slice gets ``HALO`` readings
of its neighbours by a shuffle (``pieces``). All sources of a batch are worked on at once. Course, scales and scatter of a source that lies in slices are
exact medians over all its readings in all slices (``_Cut``), found first, one after the other, so that the result doesn't depend on the cut:

1. the daily course (median by hour of day of what a running median leaves) is taken off;
2. an undecimated Haar wavelet decomposition over up to four scales gives detail coefficients; one beyond ``CANDIDATE`` times its source's robust scale
   (median absolute deviation at that scale) says that something jumps here, and only readings under such a coefficient can be spikes;
3. jumps that stay are told from spikes by the detail of the reading itself, what is left of it when the level is taken off. The level is the median of the
   readings round it and so follows a lasting change but not a few readings; a spike's detail is ``limit`` times its robust scale or more;
4. runs of readings with zero detail, i.e. equal successive values, are stuck; bounds of the unit tell the impossible ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtime.operators.ranges import EDGE, PIECE, group_medians, pieces, starts_of, streamed
from loomtime.runtime import checkpointed

# Spellings of units (lower case, without blanks, dots and degree signs) and the bounds of what can be measured in them
UNITS = {
    "percent": "percent", "%": "percent", "pct": "percent", "perc": "percent", "kelvin": "kelvin", "k": "kelvin", "kelvins": "kelvin",
    "celsius": "celsius", "c": "celsius", "degc": "celsius", "degcelsius": "celsius", "centigrade": "celsius",
    "count": "count", "cnt": "count", "counts": "count", "lux": "lux", "lx": "lux", "ph": "ph", "kwh": "kwh", "kilowatthour": "kwh",
    "kilowatthours": "kwh", "volt": "volt", "v": "volt", "volts": "volt",
}
BOUNDS = {"percent": (0.0, 100.0), "ph": (0.0, 14.0), "kelvin": (0.0, np.inf), "celsius": (-273.15, np.inf),
          "count": (0.0, np.inf), "lux": (0.0, np.inf), "kwh": (0.0, np.inf), "volt": (-np.inf, np.inf)}
CODES = {u: i for i, u in enumerate(BOUNDS)}
_LOW = np.array([b[0] for b in BOUNDS.values()] + [-np.inf])
_HIGH = np.array([b[1] for b in BOUNDS.values()] + [np.inf])

HALO = 192  # readings a slice gets of its neighbour
INSIDE = 48  # readings at either end of a stuck stretch that count for that; what lies further inside touches nothing outside
FEWEST = 8  # readings that a source's scatter can be taken from
CANDIDATE = 3.5
SCALES = (1, 2, 4, 8)
NEAR = 8  # neighbours to either side that make up the level


def unit_code(column):
    """Number of a unit's meaning, null if unknown."""
    plain = F.regexp_replace(F.lower(column), "[\\s.°_-]", "")
    pairs = [x for k, v in UNITS.items() for x in (F.lit(k), F.lit(CODES[v]))]
    return F.element_at(F.create_map(*pairs), plain)


def _medians(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Median of the values of each group, NaN for an empty group."""
    order = np.lexsort((values, group))
    count = np.bincount(group, minlength=groups)
    first = np.r_[0, np.cumsum(count)[:-1]]
    out = np.full(groups, np.nan)
    some = count > 0
    v = values[order]
    a, b = first[some] + (count[some] - 1) // 2, first[some] + count[some] // 2
    out[some] = (v[a] + v[b]) / 2
    return out


def _running_median(y: np.ndarray, start: np.ndarray, size: np.ndarray, half: int) -> np.ndarray:
    """Median of the 2*half+1 readings around each one; at a source's ends the window is moved inwards, a short source repeats."""
    width = 2 * half + 1
    out = np.empty(len(y))
    steps = np.arange(width)
    at = np.arange(len(y))
    low = np.clip(at - half - start, 0, np.maximum(0, size - width))
    for a in range(0, len(y), 65536):
        s = slice(a, a + 65536)
        inside = low[s, None] + steps
        inside %= size[s, None]
        out[s] = np.partition(y[start[s, None] + inside], half, axis=1)[:, half]
    return out


class _Wanted(Exception):
    """A median over readings of other partitions that isn't known yet."""


class _Cut:
    """What is known of the sources cut by a partition border. ``ids`` has their numbers here, ``own`` the readings that aren't a neighbour's,
    ``known`` the medians by id, name and sub-group (-1: number of readings) over all partitions; ``asked`` takes the values of those not yet known."""

    def __init__(self, ids: dict[int, str], own: np.ndarray, known: dict):
        self.ids, self.own, self.known, self.asked = ids, own, known, {}

    def of(self, keep: np.ndarray, numbers: np.ndarray) -> _Cut:
        at = {int(k): i for i, k in enumerate(numbers)}
        return _Cut({at[k]: name for k, name in self.ids.items() if k in at}, self.own[keep], self.known)

    def medians(self, name: str, values: np.ndarray, src: np.ndarray, sources: int, rows=slice(None), sub=0, subs: int = 1, only=None) -> np.ndarray:
        """Median of each source (``only``: those that need it) and sub-group: over what is here, for a cut source over all its readings."""
        out = _medians(values, src * subs + sub, sources * subs)
        for k, id in self.ids.items():
            if only is not None and not only[k]:
                continue
            if name in self.known.get(id, {}):
                found = self.known[id][name]
                out[k * subs : (k + 1) * subs] = [found.get(i, np.nan) for i in range(subs)]
            else:
                mine = (src == k) & self.own[rows]
                self.asked[name] = (np.broadcast_to(sub, src.shape)[mine], values[mine])
        return out

    def sizes(self, name: str, src: np.ndarray) -> np.ndarray:
        out = np.bincount(src)
        for k, id in self.ids.items():
            out[k] = self.known[id][name][-1]
        return out

    def ready(self) -> None:
        if self.asked:
            raise _Wanted


def _course(y: np.ndarray, src: np.ndarray, start: np.ndarray, size: np.ndarray, hour: np.ndarray, sources: int, cut: _Cut, chain: str, readings: np.ndarray) -> np.ndarray:
    """Daily course of each reading's source; 0 where a source has too few readings for one."""
    left = y - _running_median(y, start, size, 12)
    table = np.nan_to_num(cut.medians(chain + "course", left, src, sources, sub=hour.astype(np.int64), subs=24)).reshape(sources, 24)
    cut.ready()
    table = (np.roll(table, 1, 1) + 2 * table + np.roll(table, -1, 1)) / 4
    table[readings < 72] = 0
    at = hour - 0.5
    low = np.floor(at).astype(np.int64)
    part = at - low
    return table[src, low % 24] * (1 - part) + table[src, (low + 1) % 24] * part


def _candidates(y: np.ndarray, src: np.ndarray, start: np.ndarray, size: np.ndarray, sources: int, cut: _Cut, chain: str) -> np.ndarray:
    """Readings under a Haar detail coefficient far beyond its source's robust scale."""
    n = len(y)
    at = np.arange(n)
    marks = np.zeros(n + 1, np.int64)
    sums, width = y, 1  # of the readings from each one on; doubled, so that a sum never depends on what came long before
    for w in SCALES:
        while width < w:
            sums, width = sums[:-width] + sums[width:] if len(sums) > width else np.empty(0), 2 * width
        i = at[(at - start >= w) & (start + size - at >= w)]
        detail = np.abs(sums[i] - sums[i - w]) / w if len(i) else np.empty(0)
        scale = 1.4826 * cut.medians(f"{chain}haar{w}", detail, src[i], sources, i)[src[i]]
        hit = i[detail > CANDIDATE * scale]
        np.add.at(marks, hit - w, 1)
        np.add.at(marks, hit + w, -1)
    cut.ready()
    return np.cumsum(marks[:-1]) > 0


def _stuck(v: np.ndarray, src: np.ndarray, least: int) -> np.ndarray:
    new = np.r_[True, (np.diff(v) != 0) | (np.diff(src) != 0)] if len(v) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    return np.bincount(run, minlength=1)[run] >= least


def _spikes(src: np.ndarray, t: np.ndarray, v: np.ndarray, quiet: np.ndarray, limit: float, cut: _Cut, chain: str):
    """(spike, expected, scatter); readings under ``quiet`` say nothing about the scatter."""
    size_of = np.bincount(src)
    sources = len(size_of)
    start = np.r_[0, np.cumsum(size_of)[:-1]][src]
    size = size_of[src]
    centre = cut.medians(chain + "centre", v, src, sources)[src]
    cut.ready()
    readings = cut.sizes(chain + "centre", src)
    with np.errstate(invalid="ignore", over="ignore"):
        y = np.where(np.isfinite(v), v - centre, 0)
        course = _course(y, src, start, size, (t % 86_400_000_000) / 3.6e9, sources, cut, chain, readings)
        y = y - course
        candidate = _candidates(y, src, start, size, sources, cut, chain)
        calm, spike = y, np.zeros(len(y), bool)
        for turn in "12":  # the second time without the first time's spikes
            level = _running_median(calm, start, size, NEAR)
            off = np.abs(y - level)
            use = ~quiet & ~spike
            scatter = 1.4826 * cut.medians(f"{chain}scatter{turn}", off[use], src[use], sources, use)
            cut.ready()
            none = ~(scatter > 0)
            if none.any():
                use &= none[src] & (off > 0)
                scatter = np.where(none, 1.4826 * cut.medians(f"{chain}moving{turn}", off[use], src[use], sources, use, only=none), scatter)
                cut.ready()
            scatter = scatter[src]
            spike = candidate & (off >= limit * scatter) & (readings[src] >= FEWEST)
            calm = np.where(spike, level, y)
    return spike | ~np.isfinite(v), centre + course + level, scatter


def judge(src: np.ndarray, t: np.ndarray, v: np.ndarray, limit: float, stuck_run: int, cut: _Cut | None = None):
    """Distinct readings sorted by (source number, time): (stuck, spike, expected, scatter). What a stuck stretch leaves beside itself is a
    spike only if it is one without that stretch, too."""
    cut = cut or _Cut({}, np.ones(len(v), bool), {})
    stuck = _stuck(v, src, stuck_run)
    spike, expected, scatter = _spikes(src, t, v, stuck, limit, cut, "")
    held = np.bincount(src, stuck, minlength=1) > 0  # without a stuck stretch there is nothing to leave out
    held[list(cut.ids)] = True  # a source in slices may be stuck elsewhere
    free = ~stuck & held[src]
    if free.any():
        kept, own = np.unique(src[free], return_inverse=True)
        cut = cut.of(free, kept)
        again, _, _ = _spikes(own, t[free], v[free], np.zeros(len(own), bool), limit, cut, "free ")
        few = cut.sizes("free centre", own)[own] < FEWEST  # too few to say
        spike[free] &= again | few
    return stuck, spike, expected, scatter


def _asked(id: str, t: np.ndarray, v: np.ndarray, own: np.ndarray, limit: float, stuck_run: int, known: dict) -> dict:
    """Values of the next medians of a cut source that aren't known yet, by name: (sub-groups, values)."""
    src, free = np.zeros(len(v), np.int64), ~_stuck(v, np.zeros(len(v), np.int64), stuck_run)
    out: dict = {}
    for chain, keep, quiet in (("", np.ones(len(v), bool), ~free), ("free ", free, np.zeros(free.sum(), bool))):
        if keep.any():
            cut = _Cut({0: id}, own[keep], known)
            try:
                _spikes(src[keep], t[keep], v[keep], quiet, limit, cut, chain)
            except _Wanted:
                out |= cut.asked
    return out


def _fresh(src: np.ndarray, t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The first row of each distinct reading."""
    return np.r_[True, (np.diff(src) != 0) | (np.diff(t) != 0) | (np.diff(v) != 0)]


def _numbered(part: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    starts = starts_of(part, names)
    src = np.zeros(part.num_rows, np.int64)
    src[starts[1:]] = 1
    return starts, np.cumsum(src)


def _for_neighbours(part: pa.Table) -> np.ndarray:
    """Distinct readings, without the inside of stuck stretches."""
    _, src = _numbered(part, ["id"])
    t, v = part["t"].to_numpy(), part["v"].to_numpy()
    keep = np.flatnonzero(_fresh(src, t, v))
    run = np.cumsum(np.r_[True, (np.diff(v[keep]) != 0) | (np.diff(src[keep]) != 0)]) - 1
    size = np.bincount(run)
    place = np.arange(len(keep)) - np.r_[0, np.cumsum(size)[:-1]][run]
    out = np.zeros(part.num_rows, bool)
    out[keep[(place < INSIDE) | (size[run] - place <= INSIDE)]] = True
    return out


def flag_implausible(df: DataFrame, row: str = "row_no", source: str = "id", date: str = "date", value: str = "value", unit: str | None = "unit",
                     limit: float = 10.0, stuck_run: int = 8, most: int | None = None) -> DataFrame:
    """(row, impossible, stuck, spike, expected, scatter) for each row of ``df`` with a source, a date and a value.

    A repeated reading (same source, date and value) counts once and all its rows get its flags. Rows without source, date or value (null, NaN)
    are never a case and are left out. A missing unit is the source's most frequent one; an unknown unit has no bounds. A source
    of fewer than ``FEWEST`` readings has no spikes. Infinite values are spikes. An empty table gives no rows. The driver gets some 60 counts and medians of
    each source of more than ``most`` rows and a few numbers a slice of it, nothing of the others.
    """
    spark = df.sparkSession
    t, v = F.col(date).cast("timestamp"), F.col(value).cast("double")
    u = F.coalesce(unit_code(F.col(unit)) if unit else F.lit(None).cast("int"), F.lit(-1))
    rows = df.where(F.col(source).isNotNull() & t.isNotNull() & v.isNotNull() & ~F.isnan(v)).select(
        F.col(row).cast("bigint").alias("row"), F.col(source).cast("string").alias("id"), F.unix_micros(t).alias("t"), v.alias("v"), u.alias("u"))
    whole, slices = pieces(rows, "id", ("t", "v", "row"), HALO, HALO, _for_neighbours, most)
    known: dict[str, dict[str, dict[int, float]]] = {}
    units: dict[str, int] = {}

    if slices is not None:
        slices = checkpointed(slices)

        def values_asked(known: dict):
            """(id, name, sub-group) as one text, and a value: what the next medians are taken over; a row of sub-group -1 says that the name was asked for."""

            def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part in streamed(batches, ["id", PIECE], 1):
                    starts, src = _numbered(part, ["id", PIECE])
                    t, v, own = part["t"].to_numpy(), part["v"].to_numpy(), part[EDGE].to_numpy() == 0
                    fresh = _fresh(src, t, v)
                    for k, at in enumerate(starts):
                        id, mine = part["id"][int(at)].as_py(), fresh & (src == k)
                        for name, (sub, values) in _asked(id, t[mine], v[mine], own[mine], limit, stuck_run, known).items():
                            keys = pa.array([f"{name}\0{i}\0{id}" for i in range(-1, 24)])
                            yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.r_[0, sub + 1])), pa.array(np.r_[0.0, values])], names=["key", "x"])

            return ask

        while True:  # centre, course, Haar scales, scatter twice; a source's medians of one step rest on those before
            found = group_medians(slices.mapInArrow(values_asked(known), "key string, x double"), "key", "x")
            for key, (mid, n) in found.items():
                name, sub, id = key.split("\0", 2)
                facts = known.setdefault(id, {}).setdefault(name, {-1: 0})
                if sub != "-1":
                    facts[int(sub)] = mid
                    facts[-1] += n
            if not found:
                break
        votes = slices.where((F.col(EDGE) == 0) & (F.col("u") >= 0)).groupBy("id", "u").agg(F.count(F.lit(1)).alias("n"))
        units = {r["id"]: r["u"] for r in votes.groupBy("id").agg(F.max_by("u", F.struct("n", -F.col("u"))).alias("u")).collect()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in streamed(batches, ["id", PIECE]):
            starts, src = _numbered(part, ["id", PIECE])
            t, v, unit, own = part["t"].to_numpy(), part["v"].to_numpy(), part["u"].to_numpy().astype(np.int64), part[EDGE].to_numpy() == 0
            votes = np.bincount(src[unit >= 0] * len(CODES) + unit[unit >= 0], minlength=len(starts) * len(CODES)).reshape(-1, len(CODES))
            meant = np.where(votes.any(1), votes.argmax(1), -1)
            cut: dict[int, str] = {}
            if known:
                cut = {k: part["id"][int(at)].as_py() for k, at in enumerate(starts)}
                cut = {k: id for k, id in cut.items() if id in known}
                for k, id in cut.items():
                    meant[k] = units.get(id, -1)
            fresh = _fresh(src, t, v)
            reading = np.cumsum(fresh) - 1
            us, uv = src[fresh], v[fresh]
            # copies of a neighbour's reading aren't this slice's to count, though they get its flags
            stuck, spike, expected, scatter = judge(us, t[fresh], uv, limit, stuck_run, _Cut(cut, own[fresh], known))
            impossible = (uv < _LOW[meant[us]]) | (uv > _HIGH[meant[us]])
            out = [part["row"].combine_chunks(), *(pa.array(x[reading]) for x in (impossible, stuck, spike, expected, scatter))]
            yield from pa.Table.from_arrays(out, names=["row", "impossible", "stuck", "spike", "expected", "scatter"]).filter(pa.array(own)).to_batches(max_chunksize=100_000)

    kinds = "row bigint, impossible boolean, stuck boolean, spike boolean, expected double, scatter double"
    flagged = whole.mapInArrow(run, kinds)
    if slices is not None:
        flagged = flagged.unionByName(slices.mapInArrow(run, kinds))
    return flagged.withColumnRenamed("row", row)
