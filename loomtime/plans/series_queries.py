"""Queries of the time-series verbs and the SQL they are held against.

Each pair works on the same base tables: ``daily`` (m4_daily with one row for each source and day), ``stocks`` (stocks_daily with one row for each symbol and
day), and the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtime.functions.dates import ceil_date, floor_date, holiday_list, week_of_month
from loomtime.functions.select import drop_zero_variance, filter_by_time, group, transform_columns
from loomtime.operators import basis, calendar, decompose, finance, frequency, funnel, grid, plotdata, rolling, shift, timeagg, tsfeatures, validation
from loomtime.operators.apply import parallel_apply
from loomtime.operators.missing import NUMBER_MARKERS
from loomtime.runtime import read_table

_MARKERS = ", ".join(str(m) for m in NUMBER_MARKERS)

DAILY = f"daily AS (SELECT id, date, max(value) AS value, count(*) AS copies FROM m4_daily WHERE value IS NOT NULL AND NOT isnan(value) AND value NOT IN ({_MARKERS}) GROUP BY id, date)"
STOCKS = ("stocks AS (SELECT symbol, date, greatest(max(high), max(low)) AS high, least(max(high), max(low)) AS low, max(close) AS close, max(adjusted) AS adjusted "
          "FROM stocks_daily WHERE symbol IS NOT NULL AND date IS NOT NULL GROUP BY symbol, date)")


def daily(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "m4_daily").where(f"value IS NOT NULL AND NOT isnan(value) AND value NOT IN ({_MARKERS})")
    return rows.groupBy("id", "date").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("copies"))


def stocks(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "stocks_daily").where("symbol IS NOT NULL AND date IS NOT NULL")
    return rows.groupBy("symbol", "date").agg(F.greatest(F.max("high"), F.max("low")).alias("high"), F.least(F.max("high"), F.max("low")).alias("low"),
                                              F.max("close").alias("close"), F.max("adjusted").alias("adjusted"))


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 1e-9, digits) + F.lit(0.0) for c in (names or [n for n, t in df.dtypes if t == "double"])})


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(({expr}) + 1e-9::DOUBLE, {digits}) + 0.0 AS {name}"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- aggregation and grids


def _grid_sql(table: str, key: str, date: str, value: str, bucket: str, step: str, aggs: str, names: str, fix: str = "x") -> str:
    return f"""
WITH b AS (SELECT {key}, {bucket} AS x, {aggs} FROM {table} WHERE {key} IS NOT NULL AND {date} IS NOT NULL GROUP BY 1, 2),
g AS (SELECT {key}, unnest(generate_series(min(x), max(x), INTERVAL {step})) AS x FROM b GROUP BY 1)
SELECT g.{key}, CAST({fix} AS TIMESTAMP) AS {date}, {names} FROM (SELECT {key}, x FROM g) g LEFT JOIN b USING ({key}, x)"""


@query(_grid_sql("orders", "o_orderpriority", "o_orderdate", "o_totalprice", "date_trunc('month', o_orderdate)", "1 MONTH", "sum(o_totalprice) AS s", "round(coalesce(s, 0) + 1e-9::DOUBLE, 2) AS o_totalprice"))
def summarize_by_time_month(spark, folder):
    df = read_table(spark, folder, "orders")
    return _round(timeagg.summarize_by_time(group(df, "o_orderpriority"), "o_orderdate", "o_totalprice", "MS", "sum"), digits=2)


@query(_grid_sql("orders", "o_orderpriority", "o_orderdate", "o_totalprice", "CAST(date_trunc('week', o_orderdate) AS DATE) + 6", "7 DAY",
                 "avg(o_totalprice) AS m, median(o_totalprice) AS d, min(o_totalprice) AS i, max(o_totalprice) AS a, stddev_samp(o_totalprice) AS s, count(o_totalprice) AS c, count(DISTINCT o_totalprice) AS n",
                 "round(coalesce(m, 0) + 1e-9::DOUBLE, 4) AS o_totalprice_mean, round(coalesce(d, 0) + 1e-9::DOUBLE, 4) AS o_totalprice_median, round(coalesce(i, 0) + 1e-9::DOUBLE, 4) AS o_totalprice_min, round(coalesce(a, 0) + 1e-9::DOUBLE, 4) AS o_totalprice_max, "
                 "round(coalesce(s, 0) + 1e-9::DOUBLE, 4) AS o_totalprice_std, coalesce(c, 0) AS o_totalprice_count, coalesce(n, 0) AS o_totalprice_nunique"))
def summarize_by_time_week(spark, folder):
    df = read_table(spark, folder, "orders")
    return _round(timeagg.summarize_by_time(group(df, "o_orderpriority"), "o_orderdate", "o_totalprice", "W", ["mean", "median", "min", "max", "std", "count", "nunique"]), digits=4)


@query(_grid_sql("orders", "o_orderpriority", "o_orderdate", "o_totalprice", "date_trunc('quarter', o_orderdate)", "3 MONTH", "count(o_totalprice) AS c", "coalesce(c, 0) AS o_totalprice",
                 fix="last_day(CAST(x + INTERVAL 2 MONTH AS DATE))"))
def summarize_by_time_quarter_end(spark, folder):
    df = read_table(spark, folder, "orders")
    return timeagg.summarize_by_time(df, "o_orderdate", "o_totalprice", "QE", "count", by=["o_orderpriority"])


@query("""
WITH b AS (SELECT o_orderpriority AS k, date_trunc('month', o_orderdate) AS o_orderdate, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2)
SELECT o_orderdate, """ + ", ".join(f"round(coalesce(sum(s) FILTER (k = '{p}'), 0) + 1e-9::DOUBLE, 2) AS \"o_totalprice_{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM b GROUP BY 1")
def summarize_by_time_wide(spark, folder):
    df = read_table(spark, folder, "orders")
    return _round(timeagg.summarize_by_time(df, "o_orderdate", "o_totalprice", "MS", "sum", True, by=["o_orderpriority"]), digits=2)


@query(_grid_sql("events", "event_type", "ts", "value", "date_trunc('hour', ts)", "1 HOUR", "sum(value) AS s, max(value) AS m", "round(coalesce(s, 0) + 1e-9::DOUBLE, 4) AS value_sum, round(coalesce(m, 0) + 1e-9::DOUBLE, 4) AS value_max"))
def summarize_by_time_hour(spark, folder):
    return _round(timeagg.summarize_by_time(read_table(spark, folder, "events"), "ts", "value", "h", ["sum", "max"], by=["event_type"]), digits=4)


@query(_grid_sql("events", "event_type", "ts", "value", "date_trunc('day', ts)", "1 DAY", "max(value) - min(value) AS r, sum(value * user_id) AS w", "round(coalesce(r, 0) + 1e-9::DOUBLE, 4) AS spread, round(coalesce(w, 0) + 1e-9::DOUBLE, 2) AS weighted"))
def apply_by_time_day(spark, folder):
    out = timeagg.apply_by_time(read_table(spark, folder, "events"), "ts", "D", by=["event_type"], spread=F.max("value") - F.min("value"), weighted=F.sum(F.col("value") * F.col("user_id")))
    return _round(_round(out, "spread", digits=4), "weighted", digits=2)


@query("WITH " + DAILY + """, b AS (SELECT min(date) AS a, max(date) AS z FROM daily),
g AS (SELECT k.id, t.date FROM (SELECT DISTINCT id FROM daily) k, (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY)) AS date FROM b) t)
SELECT g.id, CAST(g.date AS TIMESTAMP) AS date, coalesce(value, 0) AS value, coalesce(copies, 0) AS copies FROM g LEFT JOIN daily d ON g.id = d.id AND g.date = d.date""")
def pad_by_time_day(spark, folder):
    return grid.pad_by_time(daily(spark, folder), "date", "D", fillna=0, by=["id"])


@query("WITH " + DAILY + """, l AS (SELECT id, max(date) AS z FROM daily GROUP BY id)
SELECT id, CAST(z + to_days(CAST(k AS INTEGER)) AS TIMESTAMP) AS date FROM l, range(1, 15) t(k)""")
def future_frame_day(spark, folder):
    return grid.future_frame(daily(spark, folder), "date", 14, "D", bind_data=False, by=["id"]).select("id", "date")


@query("WITH " + DAILY + """, l AS (SELECT id, max(date) AS z FROM daily GROUP BY id)
SELECT id, CAST(last_day(CAST(date_trunc('month', z) + to_months(CAST(k AS INTEGER)) AS DATE)) AS TIMESTAMP) AS date, CAST(NULL AS DOUBLE) AS value FROM l, range(1, 4) t(k)
UNION ALL SELECT id, date, value FROM daily""")
def future_frame_month_end(spark, folder):
    return grid.future_frame(daily(spark, folder), "date", 3, "ME", by=["id"]).select("id", "date", "value")


@query("SELECT CAST(d AS TIMESTAMP) AS date FROM unnest(generate_series(DATE '2023-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) t(d) WHERE isodow(d) < 6")
def weekday_sequence(spark, folder):
    return grid.make_weekday_sequence(spark, "2023-01-01", "2024-12-31").select(F.col("date").cast("timestamp").alias("date"))


@query("SELECT CAST(d AS TIMESTAMP) AS date FROM unnest(generate_series(DATE '2023-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) t(d) WHERE isodow(d) IN (5, 6)")
def weekend_sequence(spark, folder):
    return grid.make_weekend_sequence(spark, "2023-01-01", "2024-12-31", friday_saturday=True).select(F.col("date").cast("timestamp").alias("date"))


@query("SELECT CAST(max(date) + to_days(CAST(k AS INTEGER)) AS TIMESTAMP) AS date FROM m4_daily, range(1, 11) t(k) GROUP BY k")
def make_future_timeseries(spark, folder):
    return grid.make_future_timeseries(spark, read_table(spark, folder, "m4_daily").select("date"), 10, "D")


# ---- dates, filters, calendar


@query("""SELECT event_id, date_trunc('week', ts) AS week, make_timestamp(year(ts), CAST(floor((month(ts) - 1) / 2) AS INTEGER) * 2 + 1, 1, 0, 0, 0) AS two_months, date_trunc('year', ts) AS year_start,
to_timestamp(floor(epoch(ts) / 900) * 900)::TIMESTAMP AS quarter_hour, CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS TIMESTAMP) AS next_month, date_trunc('hour', ts) + INTERVAL 1 HOUR AS next_hour,
CAST(floor((day(ts) - 1) / 7) AS INTEGER) + 1 AS week_of_month FROM events""")
def date_functions(spark, folder):
    return read_table(spark, folder, "events").select("event_id", floor_date("ts", "W").alias("week"), floor_date("ts", "2M").alias("two_months"), floor_date("ts", "Y").alias("year_start"),
                                                      floor_date("ts", "15min").alias("quarter_hour"), ceil_date("ts", "M").alias("next_month"), ceil_date("ts", "h").alias("next_hour"),
                                                      week_of_month("ts").alias("week_of_month"))


@query("SELECT * REPLACE (CASE WHEN NOT isnan(value) THEN value END AS value) FROM m4_daily WHERE date >= TIMESTAMP '2022-03-01' AND date <= TIMESTAMP '2022-11-30'")
def filter_by_time_months(spark, folder):
    return filter_by_time(read_table(spark, folder, "m4_daily"), "date", "2022-03", "2022-11")


_SIG = {
    "index_num": "CAST(floor(epoch(ts)) AS BIGINT)", "year": "CAST(year(ts) AS INTEGER)", "year_iso": "CAST(isoyear(ts) AS INTEGER)", "yearstart": "CAST(dayofyear(ts) = 1 AS INTEGER)",
    "yearend": "CAST(month(ts) = 12 AND day(ts) = 31 AS INTEGER)", "leapyear": "CAST((year(ts) % 4 = 0 AND year(ts) % 100 <> 0) OR year(ts) % 400 = 0 AS INTEGER)",
    "half": "CASE WHEN month(ts) <= 6 THEN 1 ELSE 2 END", "quarter": "CAST(quarter(ts) AS INTEGER)", "quarteryear": "year(ts) || 'Q' || quarter(ts)",
    "quarterstart": "CAST(CAST(ts AS DATE) = CAST(date_trunc('quarter', ts) AS DATE) AS INTEGER)", "quarterend": "CAST(CAST(ts AS DATE) = last_day(CAST(date_trunc('quarter', ts) + INTERVAL 2 MONTH AS DATE)) AS INTEGER)",
    "month": "CAST(month(ts) AS INTEGER)", "month_lbl": "monthname(ts)", "monthstart": "CAST(day(ts) = 1 AS INTEGER)", "monthend": "CAST(CAST(ts AS DATE) = last_day(CAST(ts AS DATE)) AS INTEGER)",
    "yweek": "CAST(weekofyear(ts) AS INTEGER)", "mweek": "CAST(floor((day(ts) - 1) / 7) AS INTEGER) + 1", "wday": "CAST(isodow(ts) AS INTEGER)", "wday_lbl": "dayname(ts)", "mday": "CAST(day(ts) AS INTEGER)",
    "qday": "CAST(date_diff('day', CAST(date_trunc('quarter', ts) AS DATE), CAST(ts AS DATE)) AS INTEGER) + 1", "yday": "CAST(dayofyear(ts) AS INTEGER)", "weekend": "CAST(isodow(ts) = 7 AS INTEGER)",
    "hour": "CAST(hour(ts) AS INTEGER)", "minute": "CAST(minute(ts) AS INTEGER)", "second": "CAST(second(ts) AS INTEGER)", "msecond": "CAST(microsecond(ts) % 1000000 AS INTEGER)", "nsecond": "0",
    "am_pm": "CASE WHEN hour(ts) <= 12 THEN 'am' ELSE 'pm' END",
}


@query("SELECT event_id, ts, " + ", ".join(f"{e} AS ts_{n}" for n, e in _SIG.items()) + " FROM events")
def timeseries_signature(spark, folder):
    return calendar.augment_timeseries_signature(read_table(spark, folder, "events").select("event_id", "ts"), "ts")


def _holiday_sql() -> str:
    names: dict = {}
    for d, n in holiday_list("UnitedStates", 1990, 2030):
        names[d] = f"{names[d]}, {n}" if d in names else n
    rows = ", ".join("(DATE '{}', '{}')".format(d, n.replace("'", "''")) for d, n in sorted(names.items()))
    return f"""
WITH h(d, n) AS (VALUES {rows}), b AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS z FROM orders), k AS (SELECT h.* FROM h, b WHERE d BETWEEN a AND z)
SELECT o_orderkey, CAST(x.d IS NOT NULL AS INTEGER) AS is_holiday, CAST(y.d IS NOT NULL AS INTEGER) AS before_holiday, CAST(w.d IS NOT NULL AS INTEGER) AS after_holiday, coalesce(x.n, '') AS holiday_name
FROM orders LEFT JOIN k x ON CAST(o_orderdate AS DATE) = x.d LEFT JOIN k y ON CAST(o_orderdate AS DATE) + 1 = y.d LEFT JOIN k w ON CAST(o_orderdate AS DATE) - 1 = w.d"""


@query(_holiday_sql())
def holiday_signature(spark, folder):
    out = calendar.augment_holiday_signature(read_table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")
    return out.drop("o_orderdate")


# ---- shifts and windows

_W = "OVER (PARTITION BY id ORDER BY date)"


@query(f"WITH {DAILY} SELECT id, date, value, copies, " + ", ".join(f"lag(value, {k}) {_W} AS value_lag_{k}" for k in (1, 7, 28)) + " FROM daily")
def lags(spark, folder):
    return shift.augment_lags(group(daily(spark, folder), "id"), "date", "value", [1, 7, 28])


@query(f"WITH {DAILY} SELECT id, date, value, copies, " + ", ".join(f"lead(value, {k}) {_W} AS value_lead_{k}" for k in (1, 2, 3)) + " FROM daily")
def leads(spark, folder):
    return shift.augment_leads(group(daily(spark, folder), "id"), "date", "value", (1, 3))


@query(f"WITH {DAILY} SELECT id, date, {_r('value', 'value')}, copies, " + ", ".join(_r(f"value - lag(value, {k}) {_W}", f"value_diff_{k}") for k in (1, 7)) + " FROM daily")
def diffs(spark, folder):
    return _round(shift.augment_diffs(group(daily(spark, folder), "id"), "date", "value", [1, 7]))


@query(f"WITH {DAILY} SELECT id, date, {_r('value', 'value')}, copies, " + ", ".join(_r(f"value / nullif(lag(value, {k}) {_W}, 0) - 1", f"value_pctdiff_{k}") for k in (1, 7)) + " FROM daily")
def pct_change(spark, folder):
    return _round(shift.augment_pct_change(group(daily(spark, folder), "id"), "date", "value", [1, 7]))


def _win(n: int, key: str = "id") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _guard(expr: str, n: int, least: int, x: str = "value", key: str = "id") -> str:
    return f"CASE WHEN count({x}) {_win(n, key)} >= {least} THEN {expr} {_win(n, key)} END"


@query(f"WITH {DAILY} SELECT id, date, {_r('value', 'value')}, copies, " + ", ".join(
    _r(_guard(e, n, 7), f"value_rolling_{f}_win_{n}", 4) for n in (7, 30) for f, e in (("mean", "avg(value)"), ("sum", "sum(value)"), ("std", "stddev_samp(value)"), ("min", "min(value)"), ("max", "max(value)"), ("median", "quantile_cont(value, 0.5)"))) + " FROM daily")
def rolling_stats(spark, folder):
    out = rolling.augment_rolling(group(daily(spark, folder), "id"), "date", "value", ["mean", "sum", "std", "min", "max", "median"], [7, 30])
    return _round(_round(out, "value"), *[c for c in out.columns if "rolling" in c], digits=4)


@query(f"WITH {DAILY} SELECT id, date, {_r('value', 'value')}, copies, {_r(_guard('quantile_cont(value, 0.75)', 10, 1), 'value_rolling_quantile_75_win_10', 4)} FROM daily")
def rolling_quantile(spark, folder):
    out = rolling.augment_rolling(group(daily(spark, folder), "id"), "date", "value", [rolling.pd_quantile(0.75, "linear")], 10, 1)
    return _round(_round(out, "value"), "value_rolling_quantile_75_win_10", digits=4)


@query(f"WITH {DAILY} SELECT id, date, {_r('value', 'value')}, copies, {_r(_guard('max(value)', 5, 5) + ' - ' + _guard('min(value)', 5, 5), 'value_rolling_range_win_5', 4)} FROM daily")
def rolling_custom(spark, folder):
    out = rolling.augment_rolling(group(daily(spark, folder), "id"), "date", "value", [("range", lambda x: x.max() - x.min())], 5)
    return _round(_round(out, "value"), "value_rolling_range_win_5", digits=4)


_EXP = "OVER (PARTITION BY id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"WITH {DAILY} SELECT id, date, {_r('value', 'value')}, copies, " + ", ".join(_r(f"{e} {_EXP}", f"value_expanding_{f}", 4) for f, e in (("mean", "avg(value)"), ("sum", "sum(value)"), ("max", "max(value)"), ("std", "stddev_samp(value)"))) + " FROM daily")
def expanding_stats(spark, folder):
    out = rolling.augment_expanding(group(daily(spark, folder), "id"), "date", "value", ["mean", "sum", "max", "std"])
    return _round(_round(out, "value"), *[c for c in out.columns if "expanding" in c], digits=4)


@query(f"WITH {STOCKS} SELECT symbol, date, high, low, close, adjusted, {_r('CASE WHEN count(*) ' + _win(20, 'symbol') + ' >= 20 THEN corr(close, high) ' + _win(20, 'symbol') + ' END', 'rolling_corr_win_20', 5)} FROM stocks")
def rolling_apply(spark, folder):
    out = rolling.augment_rolling_apply(group(stocks(spark, folder), "symbol"), "date", ("corr", lambda w: rolling.correlation("close", "high", w)), 20)
    return _round(out, "rolling_corr_win_20", digits=5)


@query(f"WITH {STOCKS} SELECT symbol, date, high, low, close, adjusted, {_r('covar_samp(close, low) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)', 'expanding_cov', 3)} FROM stocks")
def expanding_apply(spark, folder):
    out = rolling.augment_expanding_apply(group(stocks(spark, folder), "symbol"), "date", ("cov", lambda w: F.covar_samp("close", "low").over(w)), 1)
    return _round(out, "expanding_cov", digits=3)


def _ema_sql(base: str, table: str, key: str, value: str, alphas: dict[str, float]) -> str:
    """Recursive averages of a column without gaps, one by name."""
    step = ", ".join(f"{1 - a!r}::DOUBLE * e.{n} + {a!r}::DOUBLE * r.v" for n, a in alphas.items())
    return f"""WITH RECURSIVE {base}, r AS (SELECT {key}, date, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY date) AS i FROM {table}),
e({key}, date, i, {', '.join(alphas)}) AS (SELECT {key}, date, i, {', '.join(f'CAST(v AS DOUBLE)' for _ in alphas)} FROM r WHERE i = 1
UNION ALL SELECT r.{key}, r.date, r.i, {step} FROM e JOIN r ON r.{key} = e.{key} AND r.i = e.i + 1)"""


@query(_ema_sql(DAILY, "daily", "id", "value", {"a": 0.1}) + f" SELECT e.id, e.date, {_r('d.value', 'value')}, copies, {_r('a', 'value_ewm_mean_alpha_0_1', 4)} FROM e JOIN daily d ON d.id = e.id AND d.date = e.date")
def ewm_mean(spark, folder):
    out = rolling.augment_ewm(group(daily(spark, folder), "id"), "date", "value", "mean", alpha=0.1, adjust=False)
    out = out.withColumnRenamed("value_ewm_mean_alpha_0.1", "value_ewm_mean_alpha_0_1")
    return _round(_round(out, "value"), "value_ewm_mean_alpha_0_1", digits=4)


# ---- finance

_S = "OVER (PARTITION BY symbol ORDER BY date)"
_STK = "symbol, date, high, low, close, adjusted"


def _sguard(expr: str, x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) {_win(n, 'symbol')} >= {least} THEN {expr} END"


_CH = f"{STOCKS}, c AS (SELECT *, close - lag(close) {_S} AS ch FROM stocks), g AS (SELECT *, greatest(coalesce(ch, 0), 0) AS gain, greatest(-coalesce(ch, 0), 0) AS loss, greatest(ch, 0) AS up, greatest(-ch, 0) AS down FROM c)"


@query(f"WITH {_CH}, a AS (SELECT *, avg(gain) {_win(14, 'symbol')} AS ag, avg(loss) {_win(14, 'symbol')} AS al, count(*) {_win(14, 'symbol')} AS n FROM g) SELECT {_STK}, "
       + _r("CASE WHEN n < 14 OR (ag = 0 AND al = 0) THEN NULL WHEN al = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / al) END", "close_rsi_14") + " FROM a")
def rsi(spark, folder):
    return _round(finance.augment_rsi(group(stocks(spark, folder), "symbol"), "date", "close", 14), "close_rsi_14")


@query(f"WITH {_CH} SELECT {_STK}, " + _r(_sguard(f"100 * (sum(up) {_win(14, 'symbol')} - sum(down) {_win(14, 'symbol')}) / nullif(sum(up) {_win(14, 'symbol')} + sum(down) {_win(14, 'symbol')}, 0)", "ch", 14, 14), "close_cmo_14") + " FROM g")
def cmo(spark, folder):
    return _round(finance.augment_cmo(group(stocks(spark, folder), "symbol"), "date", "close", 14), "close_cmo_14")


@query(f"WITH {STOCKS} SELECT {_STK}, " + _r(f"lag(close, 1) {_S} / nullif(lag(close, 10) {_S}, 0) - 1", "close_roc_1_10") + " FROM stocks")
def roc(spark, folder):
    return _round(finance.augment_roc(group(stocks(spark, folder), "symbol"), "date", "close", 10, 1), "close_roc_1_10")


@query(f"WITH {STOCKS}, b AS (SELECT *, avg(close) {_win(20, 'symbol')} AS m, stddev_samp(close) {_win(20, 'symbol')} AS s, count(close) {_win(20, 'symbol')} AS n FROM stocks) SELECT {_STK}, "
       + ", ".join(_r(f"CASE WHEN n >= 20 THEN {e} END", f'"close_bband_{p}_20_2.0"', 5) for p, e in (("middle", "m"), ("upper", "m + 2 * s"), ("lower", "m - 2 * s"))) + " FROM b")
def bbands(spark, folder):
    out = finance.augment_bbands(group(stocks(spark, folder), "symbol"), "date", "close", 20, 2)
    return out.withColumns({c: F.round(F.col(f"`{c}`") + 1e-9, 5) + F.lit(0.0) for c in out.columns if "bband" in c})


_TR = f"{STOCKS}, p AS (SELECT *, lag(close) {_S} AS pc FROM stocks), t AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM p)"


@query(f"WITH {_TR} SELECT {_STK}, " + _r(f"avg(tr) {_win(14, 'symbol')} / nullif(close, 0) * 100", "close_natr_14") + " FROM t")
def atr(spark, folder):
    return _round(finance.augment_atr(group(stocks(spark, folder), "symbol"), "date", "high", "low", "close", 14, True), "close_natr_14")


@query(f"WITH {STOCKS}, k AS (SELECT *, 100 * (close - min(low) {_win(14, 'symbol')}) / nullif(max(high) {_win(14, 'symbol')} - min(low) {_win(14, 'symbol')}, 0) AS k FROM stocks) SELECT {_STK}, "
       + _r("k", "close_stoch_k_14") + ", " + _r(f"avg(k) {_win(3, 'symbol')}", "close_stoch_d_14_3") + " FROM k")
def stochastic_oscillator(spark, folder):
    return _round(finance.augment_stochastic_oscillator(group(stocks(spark, folder), "symbol"), "date", "high", "low", "close"), "close_stoch_k_14", "close_stoch_d_14_3")


@query(f"WITH {STOCKS}, m AS (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS p FROM stocks) SELECT {_STK}, "
       + ", ".join((_r("p", "close_peak"), _r("close - p", "close_drawdown"), _r("(close - p) / nullif(p, 0)", "close_drawdown_pct"))) + " FROM m")
def drawdown(spark, folder):
    return _round(finance.augment_drawdown(group(stocks(spark, folder), "symbol"), "date", "close"), "close_peak", "close_drawdown", "close_drawdown_pct")


@query(f"WITH {STOCKS}, r AS (SELECT *, close / nullif(lag(close) {_S}, 0) - 1 AS ret, lag(close, 5) {_S} AS f, lag(close, 60) {_S} AS s FROM stocks) SELECT {_STK}, "
       + _r(f"CASE WHEN count(close) {_win(61, 'symbol')} = 61 AND stddev_pop(ret) {_win(30, 'symbol')} >= 1e-10 THEN ((f - s) / (s + 1e-10) - (close - f) / (f + 1e-10)) / (stddev_pop(ret) {_win(30, 'symbol')}) END", "close_qsmom_5_60_30", 5) + " FROM r")
def qsmomentum(spark, folder):
    return _round(finance.augment_qsmomentum(group(stocks(spark, folder), "symbol"), "date", "close", 5, 60, 30), "close_qsmom_5_60_30", digits=5)


@query(f"WITH {STOCKS}, r AS (SELECT *, close / nullif(lag(close) {_S}, 0) - 1 AS ret FROM stocks) SELECT {_STK}, "
       + _r(_sguard(f"(product(1 + ret) {_win(60, 'symbol')} - 1) * (avg(CAST(ret < 0 AS DOUBLE)) {_win(60, 'symbol')} - avg(CAST(ret > 0 AS DOUBLE)) {_win(60, 'symbol')})", "ret", 60, 60), "close_fip_momentum_60") + " FROM r")
def fip_momentum(spark, folder):
    return _round(finance.augment_fip_momentum(group(stocks(spark, folder), "symbol"), "date", "close", 60), "close_fip_momentum_60")


_RISK = f"{STOCKS}, r AS (SELECT *, ln(close / lag(close) {_S}) AS r, ln(adjusted / lag(adjusted) {_S}) AS b FROM stocks), q AS (SELECT *, CASE WHEN r IS NOT NULL THEN least(r, 0) END AS dn, CASE WHEN r IS NOT NULL THEN greatest(r, 0) END AS up, r * b AS rb, b * b AS bb FROM r)"
_A = "sqrt(252)"


def _risk(name: str, expr: str) -> str:
    return _r(_sguard(expr.replace("@", _win(60, "symbol")), "r", 60, 30), f"close_{name}_60", 4)


@query(f"WITH {_RISK} SELECT {_STK}, " + ", ".join((
    _risk("sharpe_ratio", f"avg(r) @ / nullif(stddev_samp(r) @, 0) * {_A}"), _risk("sortino_ratio", f"avg(r) @ / nullif(sqrt(avg(dn * dn) @), 0) * {_A}"),
    _risk("treynor_ratio", f"avg(r) @ / nullif((avg(rb) @ - avg(r) @ * avg(b) @) / nullif(avg(bb) @ - avg(b) @ * avg(b) @, 0), 0) * {_A}"),
    _risk("information_ratio", "(avg(r) @ - avg(b) @) / nullif(stddev_samp(r - b) @, 0)"), _risk("omega_ratio", "sum(up) @ / nullif(-sum(dn) @, 0)"), _risk("volatility_annualized", f"stddev_samp(r) @ * {_A}"))) + " FROM q")
def rolling_risk_metrics(spark, folder):
    out = finance.augment_rolling_risk_metrics(group(stocks(spark, folder), "symbol"), "date", "close", 60, benchmark_column="adjusted",
                                               metrics=["sharpe_ratio", "sortino_ratio", "treynor_ratio", "information_ratio", "omega_ratio", "volatility_annualized"])
    return _round(out, *[c for c in out.columns if c.endswith("_60")], digits=4)


@query(_ema_sql(STOCKS, "stocks", "symbol", "close", {"f": 2 / 13, "s": 2 / 27}) + f""", l AS (SELECT symbol, date, i, f - s AS line FROM e),
g(symbol, date, i, line, sig) AS (SELECT symbol, date, i, line, line FROM l WHERE i = 1 UNION ALL SELECT l.symbol, l.date, l.i, l.line, 0.8::DOUBLE * g.sig + 0.2::DOUBLE * l.line FROM g JOIN l ON l.symbol = g.symbol AND l.i = g.i + 1)
SELECT {', '.join('k.' + c.strip() for c in _STK.split(','))}, {_r('line', 'close_macd_line_12_26_9')}, {_r('sig', 'close_macd_signal_line_12_26_9')}, {_r('line - sig', 'close_macd_histogram_12_26_9')}
FROM g JOIN stocks k ON k.symbol = g.symbol AND k.date = g.date""")
def macd(spark, folder):
    out = finance.augment_macd(group(stocks(spark, folder), "symbol"), "date", "close")
    return _round(out, *[c for c in out.columns if "macd" in c])


@query(_ema_sql(STOCKS, "stocks", "symbol", "close", {"f": 2 / 13, "s": 2 / 27}) + f" SELECT {', '.join('k.' + c.strip() for c in _STK.split(','))}, {_r('(f - s) / nullif(s, 0) * 100', 'close_ppo_line_12_26')} FROM e JOIN stocks k ON k.symbol = e.symbol AND k.date = e.date")
def ppo(spark, folder):
    return _round(finance.augment_ppo(group(stocks(spark, folder), "symbol"), "date", "close"), "close_ppo_line_12_26")


_KEEP = ", ".join("k." + c.strip() for c in _STK.split(","))
_B = "13.0::DOUBLE / 14"


@query(f"""WITH RECURSIVE {_TR}, m AS (SELECT symbol, date, tr, row_number() {_S} AS i, high - lag(high) {_S} AS u, lag(low) {_S} - low AS d FROM t),
v AS (SELECT symbol, date, i, tr, CASE WHEN u > d THEN greatest(u, 0) ELSE 0 END AS p, CASE WHEN d > u THEN greatest(d, 0) ELSE 0 END AS q FROM m),
e(symbol, date, i, t, p, q) AS (SELECT symbol, date, i, CAST(tr AS DOUBLE), CAST(p AS DOUBLE), CAST(q AS DOUBLE) FROM v WHERE i = 1
UNION ALL SELECT v.symbol, v.date, v.i, {_B} * e.t + v.tr / 14, {_B} * e.p + v.p / 14, {_B} * e.q + v.q / 14 FROM e JOIN v ON v.symbol = e.symbol AND v.i = e.i + 1),
x AS (SELECT symbol, date, i, 100 * p / t AS pdi, 100 * q / t AS mdi, 100 * abs(p - q) / nullif(p + q, 0) AS dx FROM e WHERE i >= 14),
a(symbol, date, i, adx) AS (SELECT symbol, date, i, dx FROM x WHERE i = 14 UNION ALL SELECT x.symbol, x.date, x.i, {_B} * a.adx + x.dx / 14 FROM a JOIN x ON x.symbol = a.symbol AND x.i = a.i + 1)
SELECT {_KEEP}, {_r('pdi', 'close_plus_di_14', 5)}, {_r('mdi', 'close_minus_di_14', 5)}, {_r('CASE WHEN a.i >= 27 THEN adx END', 'close_adx_14', 5)}
FROM stocks k LEFT JOIN x ON x.symbol = k.symbol AND x.date = k.date LEFT JOIN a ON a.symbol = k.symbol AND a.date = k.date""")
def adx(spark, folder):
    return _round(finance.augment_adx(group(stocks(spark, folder), "symbol"), "date", "high", "low", "close"), "close_plus_di_14", "close_minus_di_14", "close_adx_14", digits=5)


@query(f"""WITH RECURSIVE {STOCKS}, q AS (SELECT symbol, date, power(ln(close / lag(close) {_S}), 2) AS v, row_number() {_S} AS i FROM stocks),
e(symbol, date, i, a) AS (SELECT symbol, date, i, v FROM q WHERE i = 2 UNION ALL SELECT q.symbol, q.date, q.i, 0.94::DOUBLE * e.a + 0.06::DOUBLE * q.v FROM e JOIN q ON q.symbol = e.symbol AND q.i = e.i + 1)
SELECT {_KEEP}, {_r('CASE WHEN e.i >= 21 THEN sqrt(a) END', 'close_ewma_vol', 7)} FROM stocks k LEFT JOIN e ON e.symbol = k.symbol AND e.date = k.date""")
def ewma_volatility(spark, folder):
    out = finance.augment_ewma_volatility(group(stocks(spark, folder), "symbol"), "date", "close").withColumnRenamed("close_ewma_vol_20_0.94", "close_ewma_vol")
    return _round(out, "close_ewma_vol", digits=7)


@query(f"""WITH {STOCKS}, r AS (SELECT symbol, date, close, row_number() {_S} AS i FROM stocks),
w AS (SELECT a.symbol, a.date, a.i, b.i AS j, b.close - avg(b.close) OVER (PARTITION BY a.symbol, a.i) AS d FROM r a JOIN r b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 59 AND a.i WHERE a.i >= 60),
c AS (SELECT symbol, date, d, sum(d) OVER (PARTITION BY symbol, i ORDER BY j) AS s FROM w),
h AS (SELECT symbol, date, ln((max(s) - min(s)) / sqrt(avg(d * d))) / ln(60) AS h FROM c GROUP BY symbol, date HAVING avg(d * d) > 0)
SELECT {_KEEP}, {_r('CASE WHEN h BETWEEN 0 AND 1 THEN h END', 'close_hurst_60')} FROM stocks k LEFT JOIN h ON h.symbol = k.symbol AND h.date = k.date""")
def hurst_exponent(spark, folder):
    return _round(finance.augment_hurst_exponent(group(stocks(spark, folder), "symbol"), "date", "close", 60), "close_hurst_60")


@query()
def regime_detection(spark, folder):
    return finance.augment_regime_detection(group(stocks(spark, folder), "symbol"), "date", "close", 60, 2)


# ---- transforms, summaries, decomposition


@query(f"""WITH {DAILY}, a AS (SELECT *, epoch(date) AS s, epoch(date) - lag(epoch(date)) {_W} AS st FROM daily), b AS (SELECT id, min(s) AS m, quantile_cont(st, 0.5) AS q FROM a GROUP BY id)
SELECT a.id, a.date, {_r('a.value', 'value')}, copies, {', '.join(_r(f'{f}(2 * pi() * {k} / {p} * (s - m) / nullif(q, 0))', f'date_{f}_{k}_{p}', 5) for p in (7, 30) for k in (1, 2) for f in ('sin', 'cos'))} FROM a JOIN b ON a.id = b.id""")
def fourier(spark, folder):
    out = basis.augment_fourier(group(daily(spark, folder), "id"), "date", [7, 30], 2)
    return _round(_round(out, "value"), *[c for c in out.columns if c.startswith("date_")], digits=5)


@query(f"""WITH {DAILY}, a AS (SELECT id, date, epoch(date) - lag(epoch(date)) {_W} AS st FROM daily)
SELECT id, count(*) AS date_n, min(date) AS date_start, max(date) AS date_end, quantile_cont(st, 0.0) AS diff_min_seconds, quantile_cont(st, 0.25) AS diff_q25_seconds, quantile_cont(st, 0.5) AS diff_median_seconds,
{_r('avg(st)', 'diff_mean_seconds', 3)}, quantile_cont(st, 0.75) AS diff_q75_seconds, quantile_cont(st, 1.0) AS diff_max_seconds FROM a GROUP BY id""")
def ts_summary(spark, folder):
    out = frequency.ts_summary(group(daily(spark, folder), "id"), "date", inferred=False)
    keep = ["id", "date_n", "date_start", "date_end", *[f"diff_{s}_seconds" for s in ("min", "q25", "median", "mean", "q75", "max")]]
    return _round(out.select(*keep), "diff_mean_seconds", digits=3)


@query(f"""WITH {DAILY}, s AS (SELECT epoch(date) - lag(epoch(date)) OVER (ORDER BY date) AS st FROM (SELECT DISTINCT date FROM daily)), m AS (SELECT median(st) AS m FROM s),
u AS (SELECT CASE WHEN m < 60 THEN 'S' WHEN m < 3600 THEN 'T' WHEN m < 86400 THEN 'H' WHEN m = 86400 THEN 'D' WHEN m < 604800 THEN 'M' WHEN m < 2419200 THEN 'W' WHEN m < 7776000 THEN 'M' WHEN m < 31536000 THEN 'Q' ELSE 'Y' END AS u FROM m)
SELECT s AS seasonal_period, t AS trend_period FROM u JOIN (VALUES ('S', '1H', '12H'), ('T', '1D', '14D'), ('H', '1D', '1M'), ('D', '1W', '1Q'), ('W', '1Q', '1Y'), ('M', '1Y', '5Y'), ('Q', '1Y', '10Y'), ('Y', '5Y', '30Y')) k(u, s, t) USING (u)""")
def seasonal_and_trend_frequency(spark, folder):
    rows = daily(spark, folder).select("date").distinct()
    return spark.createDataFrame([(frequency.get_seasonal_frequency(rows, "date"), frequency.get_trend_frequency(rows, "date"))], "seasonal_period string, trend_period string")


@query()
def anomalize_stl(spark, folder):
    return decompose.anomalize(group(daily(spark, folder), "id"), "date", "value", 7, 91)


_TWITTER = f"""WITH {DAILY}, r AS (SELECT id, date, value AS v, row_number() {_W} - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM daily),
t AS (SELECT *, CASE WHEN i >= 3 AND i < n - 3 THEN avg(v) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS tr FROM r WHERE n >= 14),
h AS (SELECT id, regr_slope(tr, i) FILTER (i < 10) AS hs, regr_intercept(tr, i) FILTER (i < 10) AS hi, regr_slope(tr, i) FILTER (i >= n - 10) AS ts, regr_intercept(tr, i) FILTER (i >= n - 10) AS ti FROM t GROUP BY id),
f AS (SELECT t.id, t.i, t.v - coalesce(tr, CASE WHEN i < 3 THEN hs * i + hi ELSE ts * i + ti END) AS free FROM t JOIN h ON t.id = h.id),
s AS (SELECT id, ph, a - avg(a) OVER (PARTITION BY id) AS season FROM (SELECT id, i % 7 AS ph, avg(free) AS a FROM f GROUP BY 1, 2)),
a AS (SELECT r.*, coalesce(season, 0) AS season, v - coalesce(season, 0) AS adj, CAST(greatest(1, round(n / 91)) AS BIGINT) AS k FROM r LEFT JOIN s ON r.id = s.id AND r.i % 7 = s.ph),
b AS (SELECT *, CASE WHEN i < (n % k) * (n // k + 1) THEN i // (n // k + 1) ELSE n % k + (i - (n % k) * (n // k + 1)) // (n // k) END AS block FROM a),
c AS (SELECT *, median(adj) OVER (PARTITION BY id, block) AS level FROM b), d AS (SELECT *, adj - level AS rest FROM c),
q AS (SELECT id, quantile_cont(rest, 0.25) AS q1, quantile_cont(rest, 0.75) AS q3 FROM d GROUP BY id),
l AS (SELECT d.*, -(q1 + 3 * (q3 - q1)) AS l1, q3 + 3 * (q3 - q1) AS l2 FROM d JOIN q ON d.id = q.id),
z AS (SELECT *, CASE WHEN rest > l2 THEN 1 WHEN rest < l1 THEN -1 ELSE 0 END AS way FROM l)
SELECT id, date, {_r('season', 'seasonal', 4)}, {_r('adj', 'seasadj', 4)}, {_r('level', 'trend', 4)}, {_r('rest', 'remainder', 4)}, CASE WHEN way <> 0 THEN 'Yes' ELSE 'No' END AS anomaly, {_r('abs(rest - (l1 + l2) / 2)', 'anomaly_score', 4)},
CAST(way AS INTEGER) AS anomaly_direction, {_r('season + level + l1', 'recomposed_l1', 4)}, {_r('season + level + l2', 'recomposed_l2', 4)},
{_r('CASE way WHEN 1 THEN season + level + l2 - 0.125 * (l2 - l1) WHEN -1 THEN season + level + l1 + 0.125 * (l2 - l1) ELSE v END', 'observed_clean', 4)} FROM z"""


@query(_TWITTER)
def anomalize_twitter(spark, folder):
    out = decompose.anomalize(group(daily(spark, folder), "id"), "date", "value", 7, 91, method="twitter", bind_data=False).drop("observed")
    return _round(out, digits=4)


@query()
def stl_diagnostics(spark, folder):
    return decompose.stl_diagnostics(group(daily(spark, folder), "id"), "date", "value", 7, 91)


@query(f"""WITH {DAILY}, a AS (SELECT id, value, row_number() {_W} AS i, count(*) OVER (PARTITION BY id) AS n, value - avg(value) OVER (PARTITION BY id) AS c FROM daily), v AS (SELECT id, sum(c * c) AS s FROM a GROUP BY id),
p AS (SELECT x.id, k.lag, sum(x.c * y.c) AS t, any_value(x.n) AS n FROM a x, range(0, 8) k(lag), a y WHERE x.id = y.id AND y.i = x.i - k.lag AND k.lag <= CASE WHEN x.n // 2 > 1 THEN x.n // 2 - 1 ELSE x.n - 1 END GROUP BY 1, 2)
SELECT p.id, CAST(p.lag AS INTEGER) AS lag, {_r('t / nullif(s, 0)', 'value', 5)}, {_r('2 / sqrt(n)', 'white_noise_upper')} FROM p JOIN v ON p.id = v.id WHERE n >= 2""")
def acf(spark, folder):
    out = decompose.acf_diagnostics(group(daily(spark, folder), "id"), "date", "value", lags=7).where("metric = 'ACF'")
    out = out.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    return _round(_round(out.select("id", "lag", "value", "white_noise_upper"), "value", digits=5), "white_noise_upper")


@query("SELECT event_type, ts, value, f.k AS seasonal_feature, CASE f.k WHEN 'hour' THEN CAST(hour(ts) AS VARCHAR) ELSE dayname(ts) END AS seasonal_value FROM events, (VALUES ('hour'), ('wday.lbl')) f(k)")
def seasonal_diagnostics(spark, folder):
    return decompose.seasonal_diagnostics(group(read_table(spark, folder, "events"), "event_type"), "ts", "value", ["hour", "wday.lbl"])


_AUTO = """WITH d AS (SELECT event_type, epoch(ts) AS s, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS step FROM events WHERE ts IS NOT NULL),
g AS (SELECT event_type, median(step) AS m, max(s) - min(s) AS span, count(*) AS n FROM d GROUP BY event_type),
f(k, unit, low, high) AS (VALUES ('second', 1, 0, 60), ('minute', 60, 0, 3600), ('hour', 3600, 0, 86400), ('wday.lbl', 86400, 0, 604800), ('week', 604800, 0, 2678400), ('month.lbl', 2629800, 0, 1e18), ('quarter', 7889400, 3600, 1e18), ('year', 31557600, 3600, 1e18)),
u AS (SELECT event_type, k FROM g LEFT JOIN f ON n >= 3 AND m >= low AND m < high AND span >= 2 * unit), c AS (SELECT DISTINCT coalesce(k, 'year') AS k FROM u)
SELECT event_type, ts, value, c.k AS seasonal_feature, CASE c.k WHEN 'second' THEN CAST(CAST(floor(second(ts)) AS INTEGER) AS VARCHAR) WHEN 'minute' THEN CAST(minute(ts) AS VARCHAR) WHEN 'hour' THEN CAST(hour(ts) AS VARCHAR) WHEN 'wday.lbl' THEN dayname(ts)
WHEN 'week' THEN CAST(weekofyear(ts) AS VARCHAR) WHEN 'month.lbl' THEN monthname(ts) WHEN 'quarter' THEN CAST(quarter(ts) AS VARCHAR) ELSE CAST(year(ts) AS VARCHAR) END AS seasonal_value FROM events, c"""


@query(_AUTO)
def seasonal_diagnostics_auto(spark, folder):
    return decompose.seasonal_diagnostics(group(read_table(spark, folder, "events"), "event_type"), "ts", "value")


@query(f"""WITH {DAILY}, m AS (SELECT *, value <= median(value) OVER (PARTITION BY id) AS above FROM daily), c AS (SELECT *, above <> lag(above) {_W} AS moved FROM m)
SELECT id, count(*)::DOUBLE AS series_length, coalesce(sum(CAST(moved AS INTEGER)), 0)::DOUBLE AS crossing_points FROM c GROUP BY id""")
def ts_features_counts(spark, folder):
    return tsfeatures.ts_features(group(daily(spark, folder), "id"), "date", "value", ["series_length", "crossing_points"], 7, scale=False)


@query()
def ts_features(spark, folder):
    return tsfeatures.ts_features(group(daily(spark, folder), "id"), "date", "value", freq=7)


# ---- funnel, validation, small verbs


@query("""SELECT CAST(c_mktsegment = 'AUTOMOBILE' AS INTEGER) AS "c_mktsegment__AUTOMOBILE", CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS "c_mktsegment__BUILDING", CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS "c_mktsegment__FURNITURE",
CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS "c_mktsegment__HOUSEHOLD", CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS "c_mktsegment__MACHINERY" FROM customer""")
def binarize_segments(spark, folder):
    return funnel.binarize(read_table(spark, folder, "customer").select("c_mktsegment"))


@query("""SELECT 'l_quantity' AS feature, CAST(NULL AS VARCHAR) AS bin, round(corr(l_quantity, l_extendedprice) + 1e-9::DOUBLE, 6) AS correlation FROM lineitem UNION ALL SELECT 'l_discount', NULL, round(corr(l_discount, l_extendedprice) + 1e-9::DOUBLE, 6) FROM lineitem
UNION ALL SELECT 'l_tax', NULL, round(corr(l_tax, l_extendedprice) + 1e-9::DOUBLE, 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', NULL, 1.0::DOUBLE""")
def correlate_pearson(spark, folder):
    return _round(funnel.correlate(read_table(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice"), "l_extendedprice"))


_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("l_quantity", "l_discount", "l_extendedprice"))


@query(f"""WITH r AS (SELECT {_RANKS} FROM lineitem) SELECT 'l_quantity' AS feature, CAST(NULL AS VARCHAR) AS bin, round(corr(l_quantity, l_extendedprice) + 1e-9::DOUBLE, 6) AS correlation FROM r
UNION ALL SELECT 'l_discount', NULL, round(corr(l_discount, l_extendedprice) + 1e-9::DOUBLE, 6) FROM r UNION ALL SELECT 'l_extendedprice', NULL, 1.0::DOUBLE""")
def correlate_spearman(spark, folder):
    return _round(funnel.correlate(read_table(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_extendedprice"), "l_extendedprice", "spearman"))


_CV = """WITH b AS (SELECT min(o_orderdate) AS a, max(o_orderdate) + INTERVAL 1 DAY AS z FROM orders),
s AS (SELECT CAST(k + 1 AS INTEGER) AS split, z - to_days(CAST(28 * k AS INTEGER)) AS fe, a FROM b, range(0, 1000) t(k)),
c AS (SELECT split, fe - INTERVAL 128 DAY AS train_start, fe - INTERVAL 28 DAY AS train_end, fe - INTERVAL 28 DAY AS forecast_start, fe AS forecast_end FROM s WHERE fe - INTERVAL 128 DAY >= a)"""


@query(_CV + " SELECT split, CAST(train_start AS TIMESTAMP) AS train_start, CAST(train_end AS TIMESTAMP) AS train_end, CAST(forecast_start AS TIMESTAMP) AS forecast_start, CAST(forecast_end AS TIMESTAMP) AS forecast_end FROM c")
def cv_splits(spark, folder):
    return validation.TimeSeriesCV("days", 100, 28).splits(read_table(spark, folder, "orders"), "o_orderdate")


@query(_CV + """, m AS (SELECT o_orderkey, split, 'train' AS role FROM orders JOIN c ON o_orderdate >= train_start AND o_orderdate < train_end
UNION ALL SELECT o_orderkey, split, 'forecast' FROM orders JOIN c ON o_orderdate >= forecast_start AND o_orderdate < forecast_end) SELECT split, role, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM m GROUP BY 1, 2""")
def cv_rows(spark, folder):
    marked = validation.TimeSeriesCV("days", 100, 28).mark(read_table(spark, folder, "orders"), "o_orderdate")
    return marked.groupBy("split", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"))


@query("SELECT o_orderpriority, max(o_totalprice) - min(o_totalprice) AS value FROM orders GROUP BY 1")
def group_apply(spark, folder):
    return parallel_apply(read_table(spark, folder, "orders").select("o_orderpriority", "o_totalprice"), lambda p: p["o_totalprice"].max() - p["o_totalprice"].min(), by=["o_orderpriority"])


@query("SELECT r_regionkey, upper(r_name) AS r_name FROM region")
def column_verbs(spark, folder):
    df = read_table(spark, folder, "region").select("r_regionkey", "r_name", F.lit(1).alias("one"))
    return transform_columns(drop_zero_variance(df), ["r_name"], F.upper)


@query("""SELECT o_orderpriority, date_trunc('month', o_orderdate) AS o_orderdate, count(*) AS n, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25) + 1e-9::DOUBLE, 4) AS q1, round(quantile_cont(o_totalprice, 0.5) + 1e-9::DOUBLE, 4) AS median,
round(quantile_cont(o_totalprice, 0.75) + 1e-9::DOUBLE, 4) AS q3, max(o_totalprice) AS max, round(avg(o_totalprice) + 1e-9::DOUBLE, 4) AS smooth FROM orders GROUP BY 1, 2""")
def boxplot_data(spark, folder):
    return _round(plotdata.boxplot_data(group(read_table(spark, folder, "orders"), "o_orderpriority"), "o_orderdate", "o_totalprice", "1MS"), "q1", "median", "q3", "smooth", digits=4)


@query(f"""WITH {DAILY}, x AS (SELECT *, epoch(date) / 86400 AS t FROM daily), f AS (SELECT id, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM x GROUP BY id)
SELECT x.id, date, {_r('value', 'observed')}, {_r('a + b * t', 'fitted', 3)} FROM x JOIN f ON x.id = f.id""")
def regression_data(spark, folder):
    out = plotdata.regression_data(group(daily(spark, folder), "id"), "date", "value")
    return _round(_round(out, "observed"), "fitted", digits=3)


@query()
def timeseries_plot_data(spark, folder):
    return plotdata.timeseries_data(group(daily(spark, folder), "id"), "date", "value")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
