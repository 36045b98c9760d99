"""Column selectors, grouped handles and small frame verbs."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtime.functions.freq import add_duration
from loomtime.runtime import is_temporal, without_nan


@dataclass(frozen=True)
class Panel:
    """A frame of many series and the columns that tell them apart.

    Every public verb is also a method: ``group(df, "id").augment_lags("date", "value").augment_rolling("date", "value").data``. A method gives a Panel of
    the same keys as long as its frame has them, else what the verb gives.
    """

    data: DataFrame
    by: tuple[str, ...]

    def __getattr__(self, name: str):
        import loomtime

        if name.startswith("_") or name not in loomtime.__all__:
            raise AttributeError(name)
        verb = getattr(loomtime, name)
        first = next(iter(inspect.signature(verb).parameters.values()), None)
        if first is None or first.name != "data":
            raise AttributeError(f"{name!r} doesn't begin with a table")

        @wraps(verb)
        def call(*args, **settings):
            made = verb(self if "Panel" in str(first.annotation) else self.data, *args, **settings)
            return Panel(made, self.by) if isinstance(made, DataFrame) and set(self.by) <= set(made.columns) else made

        return call


def group(data: DataFrame, *by: str) -> Panel:
    """Handle for verbs that work series by series."""
    missing = [c for c in by if c not in data.columns]
    if missing:
        raise ValueError(f"no column {missing}")
    return Panel(data, tuple(by))


def unpack(data: DataFrame | Panel, by: str | Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    keys = [by] if isinstance(by, str) else list(by)
    if isinstance(data, Panel):
        return data.data, [*data.by, *keys]
    return data, keys


def check_date(data: DataFrame, name: str) -> None:
    if name not in data.columns:
        raise ValueError(f"no column {name!r}")
    if not is_temporal(data.schema[name].dataType):
        raise TypeError(f"{name!r} is no date or timestamp")


def check_values(data: DataFrame, names: Iterable[str]) -> None:
    for n in names:
        if n not in data.columns:
            raise ValueError(f"no column {n!r}")
        if not isinstance(data.schema[n].dataType, (T.NumericType, T.BooleanType)):
            raise TypeError(f"{n!r} is not numeric")


def _matcher(test: Callable[[str, str], bool], text: str, case: bool) -> Callable[[Sequence[str]], list[str]]:
    fix = (lambda s: s) if case else str.lower
    return lambda columns: [c for c in columns if test(fix(c), fix(text))]


def contains(text: str, case: bool = True, regex: bool = False, flags: int = 0):
    if regex:
        return matches(text, flags if case else flags | re.IGNORECASE)
    return _matcher(lambda c, t: t in c, text, case)


def starts_with(text: str, case: bool = True):
    return _matcher(str.startswith, text, case)


def ends_with(text: str, case: bool = True):
    return _matcher(str.endswith, text, case)


def matches(pattern: str, flags: int = 0):
    rx = re.compile(pattern, flags)
    return lambda columns: [c for c in columns if rx.search(c)]


def resolve_column_selection(data: DataFrame | Panel, selectors, *, allow_none: bool = False, require_match: bool = True, unique: bool = True) -> list[str]:
    """Names from a string, a list, a compiled pattern, a callable over the columns, or any nesting of these."""
    df, _ = unpack(data)
    if selectors is None:
        if allow_none:
            return []
        raise ValueError("no columns given")
    out: list[str] = []
    for s in selectors if isinstance(selectors, (list, tuple, set)) else [selectors]:
        if isinstance(s, (list, tuple, set)):
            found = resolve_column_selection(df, list(s), require_match=require_match)
        elif isinstance(s, re.Pattern):
            found = [c for c in df.columns if s.search(c)]
        elif callable(s):
            found = list(s(df.columns))
        elif isinstance(s, str):
            found = [s] if s in df.columns else []
        else:
            raise TypeError(f"can't select columns by {s!r}")
        if require_match and not found:
            raise ValueError(f"no column for {s!r}")
        out += found
    return list(dict.fromkeys(out)) if unique else out


def filter_by_time(data: DataFrame | Panel, date_column: str, start_date: str = "start", end_date: str = "end") -> DataFrame:
    """Rows from ``start_date`` to ``end_date``, both included. 'start' and 'end' keep all dates that side. An end of 4, 7, 10, 13 or 16 characters
    stands for the end of its day, hour or minute, one of 4 or 7 for midnight of the last day of its year or month. Rows without date are left out;
    NaN comes out as null, as in every verb."""
    df, _ = unpack(data)
    check_date(df, date_column)
    d = F.col(date_column)
    keep = d.isNotNull()
    whole = lambda s: s + {4: "-01-01", 7: "-01", 13: ":00:00", 16: ":00"}.get(len(s), "")
    if str(start_date) != "start":
        keep &= d >= F.lit(whole(str(start_date))).cast("timestamp")
    if str(end_date) != "end":
        s = str(end_date)
        t = F.lit(whole(s)).cast("timestamp")
        if len(s) == 4:
            t = F.make_date(F.year(t), F.lit(12), F.lit(31)).cast("timestamp")
        elif len(s) == 7:
            t = F.last_day(t).cast("timestamp")
        elif len(s) in (10, 13, 16):
            t = F.timestamp_micros(F.unix_micros(add_duration(t, {10: "1 day", 13: "1 hour", 16: "1 minute"}[len(s)])) - 1_000_000)
        keep &= d <= t
    return without_nan(df.where(keep))


def drop_zero_variance(data: DataFrame) -> DataFrame:
    """Without the columns that hold one value only (nulls aside); one pass of minima and maxima where the type has an order."""
    plain = [f.name for f in data.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    if not plain:
        return data
    q = lambda c: F.col(f"`{c}`")
    seen = data.agg(*[(F.min(q(c)).eqNullSafe(F.max(q(c))) & (F.count(q(c)) > 0)).alias(f"v{i}") for i, c in enumerate(plain)]).first()
    return data.drop(*[c for i, c in enumerate(plain) if seen[i]])


def transform_columns(data: DataFrame, columns: str | Sequence[str], f: Callable) -> DataFrame:
    """``f`` applied to each column whose whole name matches one of the patterns."""
    rx = [re.compile(p) for p in ([columns] if isinstance(columns, str) else columns)]
    return data.withColumns({c: f(F.col(f"`{c}`")) for c in data.columns if any(r.fullmatch(c) for r in rx)})


def sort_dataframe(data: DataFrame | Panel, date_column: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows in order of (groups, date), for presentation."""
    df, keys = unpack(data, by)
    return df.orderBy(*keys, date_column)


def flatten_multiindex_column_names(names: Sequence, sep: str = "_") -> list[str]:
    """Names of nested columns as one string each."""
    return [n if isinstance(n, str) else sep.join(str(x) for x in n if str(x)) for n in names]


def glimpse(data: DataFrame, max_width: int = 76, rows: int = 10) -> str:
    """Columns with types and first values, one a line; returned and printed."""
    head = data.limit(rows).collect()
    lines = [f"<{type(data).__name__}> {len(data.columns)} columns"]
    for f in data.schema:
        lines.append(f"{f.name}: {f.dataType.simpleString()} {[r[f.name] for r in head]}"[:max_width])
    text = "\n".join(lines)
    print(text)
    return text


def reduce_memory_usage(data: DataFrame) -> DataFrame:
    """Numeric columns in the smallest type that holds their range (doubles become floats only if they lose nothing)."""
    numbers = [f for f in data.schema if isinstance(f.dataType, (T.IntegralType, T.DoubleType))]
    if not numbers:
        return data
    q = lambda c: F.col(f"`{c}`")
    seen = data.agg(*[x for i, f in enumerate(numbers) for x in (
        F.min(q(f.name)).alias(f"a{i}"), F.max(q(f.name)).alias(f"b{i}"),
        F.bool_and(q(f.name).cast("float").cast("double").eqNullSafe(q(f.name).cast("double"))).alias(f"c{i}"))]).first()
    new = {}
    for i, f in enumerate(numbers):
        low, high, exact = seen[f"a{i}"], seen[f"b{i}"], seen[f"c{i}"]
        if low is None:
            continue
        if isinstance(f.dataType, T.IntegralType):
            kind = next((k for k, n in (("tinyint", 7), ("smallint", 15), ("int", 31)) if -(2**n) <= low and high < 2**n), "bigint")
            new[f.name] = q(f.name).cast(kind)
        elif exact:
            new[f.name] = q(f.name).cast("float")
    return data.withColumns(new)


def get_timeseries_cols(data: DataFrame) -> list[str]:
    """Columns that hold dates: by type, or texts whose first value reads as one."""
    typed = [f.name for f in data.schema if is_temporal(f.dataType)]
    texts = [f.name for f in data.schema if isinstance(f.dataType, T.StringType)]
    if texts:
        first = data.select(*[F.try_to_timestamp(f"`{c}`").isNotNull().alias(f"t{i}") for i, c in enumerate(texts)]).limit(1).collect()
        typed += [c for i, c in enumerate(texts) if first and first[0][i]]
    return [c for c in data.columns if c in typed]


def has_timeseries_col(data: DataFrame) -> bool:
    return bool(get_timeseries_cols(data))
