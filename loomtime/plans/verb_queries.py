"""More queries of the time-series verbs, for what ``series_queries`` leaves out: selectors, scalars, summaries, transforms, the feature store.

Those of ``raw`` tables read them as they are, with their null and NaN values.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtime.functions import dates, freq, select
from loomtime.functions.select import group
from loomtime.operators import basis, calendar, decompose, frequency, funnel, grid, plotdata, rolling, shift, timeagg, tsfeatures, validation
from loomtime.operators.apply import progress_apply
from loomtime.plans.series_queries import _TWITTER, _W, DAILY, STOCKS, _guard, _holiday_sql, _r, _round, _SIG, _win, daily, stocks
from loomtime.runtime import ensure_checkpoint_dir, read_table
from loomtime.sources.datasets import get_available_datasets, load_dataset
from loomtime.sources.feature_store import FeatureStore

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _texts(values) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'" for v in row) + ")" for row in values)


# ---- sources and the feature store


@query("SELECT * FROM nation")
def load_dataset_nation(spark, folder):
    return load_dataset(spark, "nation", folder)


@query("SELECT unnest(['bike_sales_sample', 'customer', 'documents', 'events', 'lineitem', 'm4_daily', 'm4_hourly', 'nation', 'orders', 'part', 'region', 'stocks_daily', 'supplier']) AS name")
def available_datasets(spark, folder):
    wanted = {"bike_sales_sample", "customer", "documents", "events", "lineitem", "m4_daily", "m4_hourly", "nation", "orders", "part", "region", "stocks_daily", "supplier"}
    return spark.createDataFrame([(n,) for n in get_available_datasets(spark, folder) if n in wanted], "name string")


def _store(spark: SparkSession) -> FeatureStore:
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    store = FeatureStore(spark, f"{shared}/feature-store-{uuid.uuid4().hex}")
    by_customer = lambda o, least=0.0: o.where(F.col("o_totalprice") > least).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    urgent = lambda o: o.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("urgent"))
    return store.register("orders_of", by_customer, {"least": 1000.0}, "orders of each customer", ["sales"], ["o_custkey"]).register("urgent_of", urgent)


@query("SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_totalprice > 50000 GROUP BY o_custkey")
def feature_store_build(spark, folder):
    """Built, then loaded by name and version from what was written."""
    store, orders = _store(spark), read_table(spark, folder, "orders")
    made = store.build("orders_of", orders, {"least": 50000.0})
    return store.load("orders_of", made.metadata.version).data


@query("""SELECT a.o_custkey, a.n, a.top, b.urgent FROM (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey) a
JOIN (SELECT o_custkey, count(*) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) b ON a.o_custkey = b.o_custkey""")
def feature_store_assemble(spark, folder):
    store, orders = _store(spark), read_table(spark, folder, "orders")
    store.build("orders_of", orders)
    store.build("urgent_of", orders, storage_format="orc")
    return store.assemble(["orders_of", "urgent_of"], ["o_custkey"], "inner")


@query("""SELECT 'orders_of' AS name, count(DISTINCT o_custkey) AS row_count, 'parquet' AS storage_format, true AS again_from_cache, 'orders of each customer' AS description FROM orders WHERE o_totalprice > 1000""")
def feature_store_list(spark, folder):
    """What is left in the catalog after a second build (from the cache) and the drop of another set."""
    store, orders = _store(spark), read_table(spark, folder, "orders")
    store.build("orders_of", orders)
    store.build("urgent_of", orders)
    again = store.build("orders_of", orders).from_cache
    store.drop("urgent_of")
    said = store.describe("orders_of").description
    return store.list_feature_sets().select("name", "row_count", "storage_format", F.lit(again).alias("again_from_cache"), F.lit(said).alias("description"))


# ---- selectors and small frame verbs


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_tax, l_linenumber FROM lineitem")
def selectors(spark, folder):
    df = read_table(spark, folder, "lineitem")
    names = select.resolve_column_selection(df, [select.ends_with("KEY", case=False), select.starts_with("l_ship"), select.contains("price"), re.compile("^l_tax$"), select.matches("number$"), "l_tax"])
    return df.select(*[n for n in names if n in ("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_tax", "l_linenumber")])


@query("SELECT o_orderpriority, o_orderdate, count(*) AS o_totalprice_count, round(sum(o_totalprice) + 1e-9::DOUBLE, 2) AS o_totalprice_sum FROM orders GROUP BY 1, 2")
def flattened_and_sorted(spark, folder):
    df = read_table(spark, folder, "orders").groupBy("o_orderpriority", "o_orderdate").agg(F.count("o_totalprice").alias("a"), F.sum("o_totalprice").alias("b"))
    names = select.flatten_multiindex_column_names(["o_orderpriority", "o_orderdate", ("o_totalprice", "count"), ("o_totalprice", "sum")])
    return _round(select.sort_dataframe(group(df.toDF(*names), "o_orderpriority"), "o_orderdate"), "o_totalprice_sum", digits=2)


@query("SELECT CAST(n_nationkey AS TINYINT) AS n_nationkey, n_name, CAST(n_regionkey AS TINYINT) AS n_regionkey FROM nation")
def smallest_types(spark, folder):
    return select.reduce_memory_usage(read_table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("SELECT unnest(['<DataFrame> 2 columns', 'r_regionkey: int [0, 1, 2, 3, 4]', 'big: boolean [False, False, False, True, True]']) AS line")
def glimpse_lines(spark, folder):
    df = read_table(spark, folder, "region").orderBy("r_regionkey").select(F.col("r_regionkey").cast("int").alias("r_regionkey"), (F.col("r_regionkey") > 2).alias("big"))
    return spark.createDataFrame([(line,) for line in select.glimpse(df).split("\n")], "line string")


@query("SELECT table_name AS name, column_name FROM information_schema.columns WHERE table_name IN ('orders', 'm4_daily', 'stocks_daily', 'customer') AND (data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE')")
def date_columns(spark, folder):
    names = ("orders", "m4_daily", "stocks_daily", "customer")
    tables = {n: read_table(spark, folder, n) for n in names}
    return spark.createDataFrame([(n, c) for n, t in tables.items() if select.has_timeseries_col(t) for c in select.get_timeseries_cols(t)], "name string, column_name string")


@query("SELECT CAST(n AS VARCHAR) AS text, n % 2 = 0 AS is_date FROM range(0, 0) t(n) UNION ALL SELECT * FROM (VALUES ('2024-01-31', true), ('2024-02-30', false), ('2024-01-31 10:20:30', true), ('hello', false), ('12 apples', false))")
def datetime_strings(spark, folder):
    rows = [(t,) for t in ("2024-01-31", "2024-02-30", "2024-01-31 10:20:30", "hello", "12 apples")]
    return spark.createDataFrame(rows, "text string").select("text", dates.is_datetime_string("text").alias("is_date"))


# ---- scalars, frequencies, durations

_DURATIONS = [("3 days", 0, 3 * 86_400_000_000), ("2 weeks", 0, 14 * 86_400_000_000), ("90 minutes", 0, 90 * 60_000_000), ("1.5 hours", 0, 5_400_000_000), ("2 months", 2, 0), ("1 year", 12, 0), ("3 quarters", 9, 0), ("45", 0, 45_000_000)]


@query("SELECT * FROM (VALUES " + _texts(_DURATIONS) + ") t(text, months, micros)")
def human_durations(spark, folder):
    return spark.createDataFrame([(t, *freq.parse_human_duration(t)) for t, _, _ in _DURATIONS], "text string, months int, micros bigint")


_ALIASES = [("M", "ME"), ("Q", "QE"), ("Y", "YE"), ("A", "YE"), ("H", "h"), ("T", "min"), ("D", "D"), ("MS", "MS"), ("W", "W")]
_PARTS = [("2W", 2, "W"), ("15min", 15, "min"), ("MS", 1, "MS"), ("3D", 3, "D"), ("6h", 6, "h")]


@query("SELECT * FROM (VALUES " + _texts(_ALIASES) + ") t(alias, name)")
def frequency_aliases(spark, folder):
    return spark.createDataFrame([(a, freq.normalize_frequency_alias(a)) for a, _ in _ALIASES], "alias string, name string")


@query("SELECT * FROM (VALUES " + _texts(_PARTS) + ") t(text, n, unit)")
def frequency_parts(spark, folder):
    return spark.createDataFrame([(t, *freq.parse_freq_str(t)[:2]) for t, _, _ in _PARTS], "text string, n int, unit string")


@query("SELECT CAST(k AS INTEGER) AS lag FROM (SELECT count(*) AS n FROM m4_daily WHERE date <= (SELECT min(date) FROM m4_daily) + INTERVAL 3 DAY) c, range(0, 100000) t(k) WHERE k < n")
def lag_sequence_of_a_phrase(spark, folder):
    return spark.createDataFrame([(k,) for k in shift.resolve_lag_sequence(read_table(spark, folder, "m4_daily"), "date", "3 days")], "lag int")


@query("SELECT * FROM (VALUES ('sec', 0, 0, 0), ('min', 60, 60, 60), ('hour', 3600, 3600, 3600), ('day', 86400, 86400, 86400), ('week', 604800, 604800, 604800), ('month', 31 * 86400, 28 * 86400, 31 * 86400), "
       "('quarter', 92 * 86400, 90 * 86400, 92 * 86400), ('year', 366 * 86400, 365 * 86400, 366 * 86400)) t(unit, freq, freq_min, freq_max)")
def unit_table(spark, folder):
    return frequency.timeseries_unit_frequency_table(spark)


_SCALES = [("S", "1H", "12H"), ("T", "1D", "14D"), ("H", "1D", "1M"), ("D", "1W", "1Q"), ("W", "1Q", "1Y"), ("M", "1Y", "5Y"), ("Q", "1Y", "10Y"), ("Y", "5Y", "30Y")]


@query("SELECT * FROM (VALUES " + _texts(_SCALES) + ") t(median_unit, seasonal_period, trend_period)")
def scale_template(spark, folder):
    return frequency.time_scale_template(spark)


def _days_sql() -> str:
    """United States holidays by their rules, worked out in SQL: (d) from 2000 on."""
    nth = lambda m, dow, n: f"make_date(y, {m}, 1) + CAST(({dow} - isodow(make_date(y, {m}, 1)) + 7) % 7 + {7 * (n - 1)} AS INTEGER)"
    fixed = "SELECT make_date(y, 1, 1) AS d FROM years UNION SELECT make_date(y, 7, 4) FROM years UNION SELECT make_date(y, 11, 11) FROM years UNION SELECT make_date(y, 12, 25) FROM years UNION SELECT make_date(y, 6, 19) FROM years WHERE y >= 2021"
    moving = " UNION ".join(f"SELECT {e} FROM years" for e in (nth(1, 1, 3), nth(2, 1, 3), nth(9, 1, 1), nth(10, 1, 2), nth(11, 4, 4)))
    memorial = "SELECT make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INTEGER) FROM years"
    return (f"years AS (SELECT CAST(y AS INTEGER) AS y FROM range(1990, 2031) t(y)), fixed AS ({fixed}), "
            f"hol AS (SELECT CAST(d AS DATE) AS d FROM (SELECT d FROM fixed UNION SELECT d - 1 FROM fixed WHERE isodow(d) = 6 UNION SELECT d + 1 FROM fixed WHERE isodow(d) = 7 UNION {moving} UNION {memorial}))")


@query(f"WITH {_days_sql()} SELECT o_orderkey, CAST(o_orderdate AS DATE) IN (SELECT d FROM hol) AS holiday FROM orders")
def holiday_test(spark, folder):
    return read_table(spark, folder, "orders").select("o_orderkey", dates.is_holiday("o_orderdate").alias("holiday"))


@query(f"WITH {_days_sql()} SELECT CAST(d AS TIMESTAMP) AS date FROM unnest(generate_series(DATE '2019-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) t(d) WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (SELECT d FROM hol)")
def working_days(spark, folder):
    return grid.make_weekday_sequence(spark, "2019-01-01", "2024-12-31", remove_holidays=True).select(F.col("date").cast("timestamp").alias("date"))


@query("SELECT o_orderdate, is_holiday, before_holiday, after_holiday, holiday_name FROM (" + _holiday_sql() + ") s JOIN orders USING (o_orderkey)")
def holiday_signature_of_dates(spark, folder):
    return calendar.get_holiday_signature(read_table(spark, folder, "orders"), "o_orderdate")


@query("SELECT ts, " + ", ".join(f"{e} AS ts_{n}" for n, e in _SIG.items()) + " FROM events")
def timeseries_signature_of_dates(spark, folder):
    return calendar.get_timeseries_signature(read_table(spark, folder, "events"), "ts")


# ---- raw tables: null and NaN values as they come

_RAW = "raw AS (SELECT row_no, id, date, CASE WHEN NOT isnan(value) THEN value END AS value FROM m4_daily)"
_TIE = "PARTITION BY id ORDER BY date, row_no"


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "m4_daily").select("row_no", "id", "date", "value")


@query(f"WITH {_RAW} SELECT row_no, " + ", ".join(_r(f"CASE WHEN count(value) OVER w >= {least} THEN {e} OVER w END", f"value_rolling_{f}_win_5", 4) for f, e, least in
       (("mean", "avg(value)", 2), ("max", "max(value)", 2), ("std", "stddev_samp(value)", 2))) + f" FROM raw WINDOW w AS ({_TIE} ROWS 4 PRECEDING)")
def rolling_over_raw_rows(spark, folder):
    out = rolling.augment_rolling(group(_raw(spark, folder), "id"), "date", "value", ["mean", "max", "std"], 5, 2, order_by="row_no")
    return _round(out.drop("id", "date", "value"), digits=4)


@query(f"WITH {_RAW} SELECT row_no, " + _r(f"CASE WHEN count(value) OVER ({_TIE} ROWS UNBOUNDED PRECEDING) >= 1 THEN sum(value) OVER ({_TIE} ROWS UNBOUNDED PRECEDING) END", "value_expanding_sum", 3) + " FROM raw")
def expanding_over_raw_rows(spark, folder):
    return _round(rolling.augment_expanding(group(_raw(spark, folder), "id"), "date", "value", "sum", order_by="row_no").select("row_no", "value_expanding_sum"), digits=3)


@query("""WITH m AS (SELECT id, date_trunc('month', date) AS date, count(value) FILTER (NOT isnan(value)) AS c, max(value) FILTER (NOT isnan(value)) AS m FROM m4_daily WHERE id IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2),
g AS (SELECT id, unnest(generate_series(min(date), max(date), INTERVAL 1 MONTH)) AS date FROM m GROUP BY id)
SELECT g.id, CAST(g.date AS TIMESTAMP) AS date, coalesce(c, 0) AS value_count, m AS value_max FROM g LEFT JOIN m ON g.id = m.id AND g.date = m.date""")
def summarize_raw_rows(spark, folder):
    return timeagg.summarize_by_time(group(_raw(spark, folder), "id"), "date", "value", "MS", ["count", "max"], fillna=None)


@query(f"WITH {DAILY}" + """, b AS (SELECT min(date) AS a, max(date) AS z FROM daily), o AS (SELECT id, date, value, 'of ' || id AS label FROM daily),
g AS (SELECT k.id, t.date FROM (SELECT DISTINCT id FROM daily) k, (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY)) AS date FROM b) t), f AS (SELECT id, min(date) AS first FROM daily GROUP BY id)
SELECT g.id, CAST(g.date AS TIMESTAMP) AS date, o.value, CASE WHEN g.date >= f.first THEN 'of ' || g.id END AS label FROM g LEFT JOIN o ON g.id = o.id AND g.date = o.date JOIN f ON g.id = f.id
WHERE (SELECT min(n) FROM (SELECT count(DISTINCT value) AS n FROM daily GROUP BY id)) > 1""")
def pad_with_constant_columns(spark, folder):
    rows = daily(spark, folder).select("id", "date", "value", F.concat(F.lit("of "), "id").alias("label"))
    return grid.pad_by_time(rows, "date", "D", by=["id"])


@query("""WITH b AS (SELECT event_type, date_trunc('day', ts) AS ts, max(value) - min(value) AS spread, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2),
g AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM b GROUP BY event_type)
SELECT g.event_type, CAST(g.ts AS TIMESTAMP) AS ts, round(coalesce(spread, 0) + 1e-9::DOUBLE, 6) AS spread, coalesce(n, 0) AS n FROM g LEFT JOIN b ON g.event_type = b.event_type AND g.ts = b.ts""")
def apply_functions_by_time(spark, folder):
    """Functions over the bins' pandas frames."""
    rows = read_table(spark, folder, "events").select("event_type", "ts", "value")
    out = timeagg.apply_by_time(rows, "ts", "D", by=["event_type"], spread=lambda p: p["value"].max() - p["value"].min(), n=len)
    return _round(out, "spread")


@query("SELECT o_orderpriority, round(avg(o_totalprice) + 1e-9::DOUBLE, 4) AS mean, count(*) AS n FROM orders GROUP BY 1")
def progress_apply_frames(spark, folder):
    rows = read_table(spark, folder, "orders").select("o_orderpriority", "o_totalprice")
    out = progress_apply(group(rows, "o_orderpriority"), lambda p: p["o_totalprice"].agg(["mean", "size"]).to_frame().T.set_axis(["mean", "n"], axis=1).astype({"n": "int64"}), "mean double, n bigint")
    return _round(out, "mean", digits=4)


# ---- windows

_M = f"""moments AS (SELECT *, count(value) {_win(20)} AS n, avg(value) {_win(20)} AS m, stddev_samp(value) {_win(20)} AS s FROM daily),
around AS (SELECT a.id, a.date, any_value(a.value) AS value, any_value(a.copies) AS copies, any_value(a.n) AS n, any_value(a.s) AS s, sum(power(b.value - a.m, 2)) AS s2, sum(power(b.value - a.m, 3)) AS s3, sum(power(b.value - a.m, 4)) AS s4
  FROM (SELECT *, row_number() {_W} AS i FROM moments) a JOIN (SELECT *, row_number() {_W} AS i FROM moments) b ON a.id = b.id AND b.i BETWEEN a.i - 19 AND a.i GROUP BY a.id, a.date)"""


@query(f"""WITH {DAILY}, {_M} SELECT id, date, {_r('value', 'value')}, copies,
{_r('CASE WHEN n >= 20 AND s2 > 0 THEN n * sqrt(n - 1) / (n - 2) * s3 / power(s2, 1.5) END', 'value_rolling_skew_win_20', 4)},
{_r('CASE WHEN n >= 20 AND s2 > 0 THEN n * (n + 1) * (n - 1) / ((n - 2) * (n - 3)) * s4 / (s2 * s2) - 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)) END', 'value_rolling_kurt_win_20', 3)},
{_r('CASE WHEN n >= 20 THEN s / sqrt(n - 1) END', 'value_rolling_sem_win_20', 4)} FROM around""")
def rolling_moments(spark, folder):
    out = rolling.augment_rolling(group(daily(spark, folder), "id"), "date", "value", ["skew", "kurt", "sem"], 20)
    out = _round(_round(out, "value"), "value_rolling_skew_win_20", "value_rolling_sem_win_20", digits=4)
    return _round(out, "value_rolling_kurt_win_20", digits=3)


@query(f"""WITH {DAILY}, r AS (SELECT *, row_number() {_W} AS i FROM daily), k AS (SELECT a.id, a.date, count(*) AS n, count(*) FILTER (b.value < a.value) + (count(*) FILTER (b.value = a.value) + 1) / 2.0 AS k FROM r a JOIN r b ON a.id = b.id AND b.i BETWEEN a.i - 9 AND a.i GROUP BY a.id, a.date)
SELECT d.id, d.date, {_r('d.value', 'value')}, copies, CASE WHEN n >= 10 THEN k END::DOUBLE AS value_rolling_rank_win_10 FROM daily d JOIN k ON d.id = k.id AND d.date = k.date""")
def rolling_rank(spark, folder):
    return _round(rolling.augment_rolling(group(daily(spark, folder), "id"), "date", "value", "rank", 10), "value")


@query(f"WITH {DAILY} SELECT id, date, {_r('value', 'value')}, copies, " + _r(f"CASE WHEN count(*) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) >= 7 THEN avg(value) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END", "value_rolling_mean_win_7", 4) + " FROM daily")
def rolling_centred(spark, folder):
    return _round(_round(rolling.augment_rolling(group(daily(spark, folder), "id"), "date", "value", "mean", 7, center=True), "value"), "value_rolling_mean_win_7", digits=4)


@query(f"WITH {STOCKS} SELECT symbol, date, high, low, close, adjusted, " + _r(_guard("max(close - low)", 6, 6, "close", "symbol"), "rolling_reach_win_6", 5) + " FROM stocks")
def rolling_apply_frames(spark, folder):
    """A function over the pandas frame of the window's rows."""
    out = rolling.augment_rolling_apply(group(stocks(spark, folder), "symbol"), "date", ("reach", lambda p: (p["close"] - p["low"]).max()), 6)
    return _round(out, "rolling_reach_win_6", digits=5)


@query(f"WITH {STOCKS} SELECT symbol, date, high, low, close, adjusted, " + _r(_guard("corr(close, high)", 20, 20, "close", "symbol"), "close_rolling_corr_high_win_20", 5) + ", " + _r(_guard("covar_samp(close, low)", 20, 20, "close", "symbol"), "close_rolling_cov_low_win_20", 3) + " FROM stocks")
def rolling_pairs(spark, folder):
    out = rolling.augment_rolling(group(stocks(spark, folder), "symbol"), "date", "close", [rolling.pair("corr", "high"), rolling.pair("cov", "low")], 20)
    return _round(_round(out, "close_rolling_corr_high_win_20", digits=5), "close_rolling_cov_low_win_20", digits=3)


@query(f"WITH RECURSIVE {DAILY}, r AS (SELECT id, date, value AS v, row_number() {_W} AS i FROM daily), " + """e(id, date, i, n, d) AS (SELECT id, date, i, CAST(v AS DOUBLE), 1.0::DOUBLE FROM r WHERE i = 1
UNION ALL SELECT r.id, r.date, r.i, 0.9::DOUBLE * e.n + r.v, 0.9::DOUBLE * e.d + 1 FROM e JOIN r ON r.id = e.id AND r.i = e.i + 1)""" + f"""
SELECT e.id, e.date, {_r('v.value', 'value')}, copies, {_r('n / d', 'value_ewm_mean_span_19', 4)}, {_r('n', 'value_ewm_sum_span_19', 3)} FROM e JOIN daily v ON v.id = e.id AND v.date = e.date""")
def ewm_adjusted(spark, folder):
    out = rolling.augment_ewm(group(daily(spark, folder), "id"), "date", "value", ["mean", "sum"], span=19)
    return _round(_round(_round(out, "value"), "value_ewm_mean_span_19", digits=4), "value_ewm_sum_span_19", digits=3)


# ---- transforms

_N = f"numbered AS (SELECT id, date, value, copies, row_number() {_W} - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM daily)"


@query(f"""WITH {DAILY}, {_N}, h AS (SELECT a.id, a.date, sum(b.value * CASE WHEN a.i = b.i THEN 0 WHEN a.n % 2 = 0 THEN CASE WHEN abs(a.i - b.i) % 2 = 1 THEN 2.0 / a.n / tan(pi() * (a.i - b.i) / a.n) ELSE 0 END
  ELSE (1 / tan(pi() * (a.i - b.i) / a.n) - (CASE WHEN abs(a.i - b.i) % 2 = 0 THEN 1 ELSE -1 END) / sin(pi() * (a.i - b.i) / a.n)) / a.n END) AS im FROM numbered a JOIN numbered b ON a.id = b.id GROUP BY a.id, a.date)
SELECT d.id, d.date, {_r('value', 'value')}, copies, {_r('value', 'value_hilbert_real', 4)}, {_r('im', 'value_hilbert_imag', 4)} FROM daily d JOIN h ON d.id = h.id AND d.date = h.date""")
def hilbert(spark, folder):
    """The SQL convolves each series with the discrete Hilbert kernel."""
    out = basis.augment_hilbert(group(daily(spark, folder), "id"), "date", "value")
    return _round(_round(out, "value"), "value_hilbert_real", "value_hilbert_imag", digits=4)


def _wavelet_sql(scale: int) -> str:
    t = f"((a.i + (a.n - 1) // 2 - b.i + CAST(floor(-a.n / 2.0) AS BIGINT))::DOUBLE / {scale})"
    inside = "a.i + (a.n - 1) // 2 - b.i BETWEEN 0 AND a.n - 1"
    part = lambda f: f"coalesce(sum(b.value * {f}(pi() * {t}) * exp(-{t} * {t} / 2)) FILTER ({inside}), 0) / sqrt({scale})"
    return f"{part('cos')} AS re{scale}, -{part('sin')} AS im{scale}"


@query(f"""WITH {DAILY}, {_N}, w AS (SELECT a.id, a.date, {_wavelet_sql(2)}, {_wavelet_sql(7)} FROM numbered a JOIN numbered b ON a.id = b.id GROUP BY a.id, a.date)
SELECT d.id, d.date, {_r('value', 'value')}, copies, """ + ", ".join(_r(f"{p[:2]}{s}", f"morlet_scale_{s}_{p}", 4) for s in (2, 7) for p in ("real", "imag")) + " FROM daily d JOIN w ON d.id = w.id AND d.date = w.date")
def wavelet(spark, folder):
    out = basis.augment_wavelet(group(daily(spark, folder), "id"), "date", "value", "morlet", 1.0, [2, 7])
    return _round(_round(out, "value"), *[c for c in out.columns if c.startswith("morlet")], digits=4)


def _spline_sql(degree: int, inner: int) -> str:
    """Basis splines by their recursion, a column an interval and a step a degree."""
    knots = ["lo"] * (degree + 1) + [f"k{i + 1}" for i in range(inner)] + ["hi"] * (degree + 1)
    last = degree + inner  # the last interval with any length holds its upper end, too
    steps = ["b0 AS (SELECT *, " + ", ".join(f"CASE WHEN {a} < {z} AND value >= {a} AND (value < {z}{' OR value = hi' if i == last else ''}) THEN 1.0::DOUBLE ELSE 0 END AS s0_{i}" for i, (a, z) in enumerate(zip(knots, knots[1:]))) + " FROM q)"]
    for d in range(1, degree + 1):
        one = []
        for i in range(len(knots) - 1 - d):
            left = f"coalesce((value - {knots[i]}) / nullif({knots[i + d]} - {knots[i]}, 0), 0) * s{d - 1}_{i}"
            right = f"coalesce(({knots[i + d + 1]} - value) / nullif({knots[i + d + 1]} - {knots[i + 1]}, 0), 0) * s{d - 1}_{i + 1}"
            one.append(f"{left} + {right} AS s{d}_{i}")
        steps.append(f"b{d} AS (SELECT *, {', '.join(one)} FROM b{d - 1})")
    return ", ".join(steps)


@query(f"""WITH {DAILY}, k AS (SELECT id, min(value) AS lo, max(value) AS hi, quantile_cont(value, 1 / 3.0) AS k1, quantile_cont(value, 2 / 3.0) AS k2 FROM daily GROUP BY id), q AS (SELECT d.*, lo, hi, k1, k2 FROM daily d JOIN k ON d.id = k.id),
{_spline_sql(3, 2)} SELECT id, date, {_r('value', 'value')}, copies, {', '.join(_r(f'CASE WHEN hi > lo THEN s3_{i} ELSE 0 END', f'value_bspline_degree_3_{i}', 4) for i in range(1, 6))} FROM b3""")
def spline(spark, folder):
    out = basis.augment_spline(group(daily(spark, folder), "id"), "date", "value", "bs", 5, 3)
    return _round(_round(out, "value"), *[c for c in out.columns if "bspline" in c], digits=4)


# ---- summaries


@query(f"WITH {DAILY} SELECT id, count(date) AS date_n, 'UTC' AS date_tz, min(date) AS date_start, max(date) AS date_end FROM daily GROUP BY id")
def date_summary(spark, folder):
    return frequency.get_date_summary(group(daily(spark, folder), "id"), "date")


_STEP = f"steps AS (SELECT id, epoch(date) - lag(epoch(date)) {_W} AS st FROM daily)"


@query(f"WITH {DAILY}, {_STEP} SELECT id, min(st) AS diff_min_seconds, quantile_cont(st, 0.25) AS diff_q25_seconds, median(st) AS diff_median_seconds, {_r('avg(st)', 'diff_mean_seconds', 3)}, quantile_cont(st, 0.75) AS diff_q75_seconds, max(st) AS diff_max_seconds FROM steps GROUP BY id")
def diff_summary(spark, folder):
    return _round(frequency.get_diff_summary(group(daily(spark, folder), "id"), "date"), "diff_mean_seconds", digits=3)


_UNIT = "CASE WHEN m < 60 THEN 'S' WHEN m < 3600 THEN 'T' WHEN m < 86400 THEN 'H' WHEN m < 604800 THEN 'D' WHEN m < 2419200 THEN 'W' WHEN m < 7776000 THEN 'M' WHEN m < 31536000 THEN 'Q' ELSE 'Y' END"


@query("WITH k AS (SELECT event_type AS id, date_trunc('hour', ts) AS date FROM events GROUP BY 1, 2), s AS (SELECT id, epoch(date) - lag(epoch(date)) OVER (PARTITION BY id ORDER BY date) AS st FROM k), "
       f"m AS (SELECT id, median(st) AS m FROM s GROUP BY id) SELECT id, m AS freq_median_seconds, {_UNIT} AS freq_median_unit, m / CASE {_UNIT} WHEN 'S' THEN 1 WHEN 'T' THEN 60 WHEN 'H' THEN 3600 ELSE 86400 END AS freq_median_scale FROM m")
def median_units(spark, folder):
    hours = read_table(spark, folder, "events").select(F.col("event_type").alias("id"), F.date_trunc("hour", "ts").alias("date")).distinct()
    return frequency.ts_summary(group(hours, "id"), "date").select("id", "freq_median_seconds", "freq_median_unit", "freq_median_scale")


_CADENCE = "d AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS d FROM orders), s AS (SELECT d, epoch(d) - lag(epoch(d)) OVER (ORDER BY d) AS st FROM d), m AS (SELECT median(st) AS m, count(*) AS n FROM s)"


@query(f"WITH {_CADENCE} SELECT m AS freq_median_seconds, {_UNIT} AS freq_median_unit, round_even(m / 2678400, 1) AS freq_median_scale, 'MS' AS freq_inferred_unit, 'MS' AS frequency, "
       "CASE " + _UNIT + " WHEN 'M' THEN '1Y' ELSE '?' END AS seasonal_period, CASE " + _UNIT + " WHEN 'M' THEN '5Y' ELSE '?' END AS trend_period, "
       "(SELECT median(n) FROM (SELECT count(*) AS n FROM d GROUP BY year(d))) AS seasonal_rows FROM m")
def cadence_of_months(spark, folder):
    """Order months: inferred and median frequency, periods, and rows in a season."""
    months = read_table(spark, folder, "orders").select(F.date_trunc("month", "o_orderdate").alias("d")).distinct()
    s = frequency.get_frequency_summary(months, "d")
    row = (s["freq_median_seconds"], s["freq_median_unit"], s["freq_median_scale"], s["freq_inferred_unit"], frequency.get_frequency(months, "d"), frequency.get_seasonal_frequency(months, "d"),
           frequency.get_trend_frequency(months, "d"), float(frequency.get_seasonal_frequency(months, "d", numeric=True)))
    return spark.createDataFrame([row], "freq_median_seconds double, freq_median_unit string, freq_median_scale double, freq_inferred_unit string, frequency string, seasonal_period string, trend_period string, seasonal_rows double")


_TILE = f"{_N}, tiles AS (SELECT id, i // 7 AS t, avg(value) AS m, var_samp(value) AS v FROM numbered WHERE i // 7 < n // 7 GROUP BY 1, 2)"


@query(f"WITH {DAILY}, {_TILE}, z AS (SELECT id, var_samp(m) AS stability, var_samp(v) AS lumpiness FROM tiles GROUP BY id HAVING count(*) > 1) "
       f"SELECT s.id, {_r('coalesce(stability, 0)', 'stability', 2)}, log10(1 + coalesce(lumpiness, 0)) IS NOT NULL AS any, n::DOUBLE AS series_length FROM (SELECT id, count(*) AS n FROM daily GROUP BY id) s LEFT JOIN z ON s.id = z.id")
def ts_features_tiles(spark, folder):
    out = tsfeatures.ts_features(group(daily(spark, folder), "id"), "date", "value", ["stability", "lumpiness", "series_length"], 7, scale=False)
    return _round(out, "stability", digits=2).select("id", "stability", F.col("lumpiness").isNotNull().alias("any"), "series_length")


@query(f"""WITH {STOCKS}, z AS (SELECT symbol, date, (close - avg(close) OVER (PARTITION BY symbol)) / stddev_samp(close) OVER (PARTITION BY symbol) AS x FROM stocks),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM z),
f AS (SELECT *, x - lag(x) OVER (PARTITION BY symbol ORDER BY i) AS d FROM r), g AS (SELECT *, d - avg(d) OVER (PARTITION BY symbol) AS e, sum(x) OVER (PARTITION BY symbol ORDER BY i) AS c FROM f),
k AS (SELECT a.symbol, l.lag, sum(a.x * b.x) AS xx, sum(a.e * b.e) AS ee, any_value(a.n) AS n FROM g a, range(0, 25) l(lag), g b WHERE a.symbol = b.symbol AND b.i = a.i - l.lag GROUP BY 1, 2),
v AS (SELECT symbol, xx AS vx, ee AS ve FROM k WHERE lag = 0),
a AS (SELECT k.symbol, max(xx / vx) FILTER (lag = 1) AS a1, sum(power(xx / vx, 2)) FILTER (lag BETWEEN 1 AND 10) AS a10, max(ee / ve) FILTER (lag = 1) AS d1, sum(power(ee / ve, 2)) FILTER (lag BETWEEN 1 AND 10) AS d10, max(xx / vx) FILTER (lag = 5) AS s1,
  max(xx) FILTER (lag = 0) / any_value(n) + 2 * coalesce(sum((1 - lag / (trunc(4 * power(n / 100, 0.25)) + 1)) * xx / n) FILTER (lag BETWEEN 1 AND trunc(4 * power(n / 100, 0.25))), 0) AS long FROM k JOIN v ON k.symbol = v.symbol GROUP BY k.symbol),
p AS (SELECT symbol, sum(c * c) / power(count(*), 2) AS s FROM g GROUP BY symbol), t AS (SELECT symbol, i // 5 AS t, avg(x) AS m, var_samp(x) AS v FROM r WHERE i // 5 < n // 5 GROUP BY 1, 2),
u AS (SELECT symbol, var_samp(m) AS stability, var_samp(v) AS lumpiness FROM t GROUP BY symbol)
SELECT a.symbol, {_r('a1', 'x_acf1', 5)}, {_r('a10', 'x_acf10', 5)}, {_r('d1', 'diff1_acf1', 5)}, {_r('d10', 'diff1_acf10', 5)}, {_r('s1', 'seas_acf1', 5)}, {_r('s / long', 'unitroot_kpss', 5)}, {_r('stability', 'stability', 5)}, {_r('lumpiness', 'lumpiness', 5)}
FROM a JOIN p ON a.symbol = p.symbol JOIN u ON a.symbol = u.symbol""")
def ts_features_of_stocks(spark, folder):
    out = tsfeatures.ts_features(group(stocks(spark, folder), "symbol"), "date", "close", ["acf_features", "unitroot_kpss", "stability", "lumpiness"], 5)
    return _round(out.drop("diff2_acf1", "diff2_acf10"), digits=5)


# ---- diagnostics

_CENTRED = f"centred AS (SELECT symbol, close, adjusted, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, count(*) OVER (PARTITION BY symbol) AS n, close - avg(close) OVER (PARTITION BY symbol) AS c, adjusted - avg(adjusted) OVER (PARTITION BY symbol) AS a FROM stocks)"


@query(f"""WITH RECURSIVE {STOCKS}, {_CENTRED}, v AS (SELECT symbol, sum(c * c) AS s, any_value(n) AS n FROM centred GROUP BY symbol),
p AS (SELECT x.symbol, k.lag, sum(x.c * y.c) AS t FROM centred x, range(0, 6) k(lag), centred y WHERE x.symbol = y.symbol AND y.i = x.i - k.lag GROUP BY 1, 2),
r AS (SELECT p.symbol, list(t / s ORDER BY lag) AS r FROM p JOIN v ON p.symbol = v.symbol GROUP BY p.symbol),
l(symbol, k, phi, val, r) AS (SELECT symbol, CAST(1 AS BIGINT), [r[2]], r[2], r FROM r UNION ALL
SELECT symbol, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - q * phi[k + 1 - j]), q), q, r FROM (SELECT symbol, k, phi, r,
  (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j]))) / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1]))) AS q FROM l WHERE k < 5))
SELECT symbol, CAST(k AS INTEGER) AS lag, {_r('val', 'value', 5)} FROM l""")
def pacf(spark, folder):
    """Partial autocorrelations at lags 1 to 5; the SQL runs the Durbin-Levinson recursion."""
    out = decompose.acf_diagnostics(group(stocks(spark, folder), "symbol"), "date", "close", lags=5).where("metric = 'PACF' AND lag > 0")
    return _round(out.select("symbol", "lag", "value"), "value", digits=5)


@query(f"""WITH {STOCKS}, {_CENTRED}, v AS (SELECT symbol, sqrt(sum(c * c) * sum(a * a)) AS s FROM centred GROUP BY symbol)
SELECT p.symbol, CAST(p.lag AS INTEGER) AS lag, {_r('t / s', 'value', 5)} FROM (SELECT x.symbol, k.lag, sum(x.c * y.a) AS t FROM centred x, range(0, 6) k(lag), centred y WHERE x.symbol = y.symbol AND y.i = x.i - k.lag GROUP BY 1, 2) p JOIN v ON p.symbol = v.symbol""")
def ccf(spark, folder):
    out = decompose.acf_diagnostics(group(stocks(spark, folder), "symbol"), "date", "close", "adjusted", lags=5).where("metric = 'CCF_adjusted'")
    return _round(out.select("symbol", "lag", "value"), "value", digits=5)


_PARTS_OF = ("observed", "seasonal", "trend", "remainder")


@query(_TWITTER.split("\nSELECT id, date, round((season)")[0] + """, parts AS (SELECT id, date, unnest(['observed', 'seasonal', 'trend', 'remainder']) AS component, unnest([v, season, level, rest]) AS value FROM z)
SELECT id, date, component, """ + _r("value", "value", 4) + " FROM parts")
def anomalies_plot_data(spark, folder):
    a = decompose.anomalize(group(daily(spark, folder), "id"), "date", "value", 7, 91, method="twitter")
    return _round(plotdata.anomalies_decomp_data(a, "date", ["id"]), "value", digits=4)


@query(_TWITTER.split("\nSELECT id, date, round((season)")[0] + f"\nSELECT id, date, {_r('v', 'observed', 4)}, {_r('CASE way WHEN 1 THEN season + level + l2 - 0.125 * (l2 - l1) WHEN -1 THEN season + level + l1 + 0.125 * (l2 - l1) ELSE v END', 'observed_clean', 4)} FROM z")
def anomalies_cleaned(spark, folder):
    a = decompose.anomalize(group(daily(spark, folder), "id"), "date", "value", 7, 91, method="twitter")
    return _round(plotdata.anomalies_cleaned_data(a, "date", ["id"]), digits=4)


@query(_TWITTER.split("\nSELECT id, date, round((season)")[0] + f"""\nSELECT id, date, {_r('v', 'observed', 4)}, {_r('season + level + l1', 'recomposed_l1', 4)}, {_r('season + level + l2', 'recomposed_l2', 4)}, CASE WHEN way <> 0 THEN 'Yes' ELSE 'No' END AS anomaly,
CAST(way AS INTEGER) AS anomaly_direction, {_r('abs(rest - (l1 + l2) / 2)', 'anomaly_score', 4)} FROM z""")
def anomalies_marked(spark, folder):
    a = decompose.anomalize(group(daily(spark, folder), "id"), "date", "value", 7, 91, method="twitter")
    return _round(plotdata.anomalies_data(a, "date", ["id"]), digits=4)


# ---- funnel

_EDGES = "e AS (SELECT list_distinct([quantile_cont(c_acctbal, 0.0), quantile_cont(c_acctbal, 0.25), quantile_cont(c_acctbal, 0.5), quantile_cont(c_acctbal, 0.75), quantile_cont(c_acctbal, 1.0)]) AS u FROM customer), b AS (SELECT list_sort(u) AS b FROM e), " \
         "bins AS (SELECT i, b[i] AS lo, b[i + 1] AS hi, printf('%.1f_%.1f', round_even(b[i], 1), round_even(b[i + 1], 1)) AS bin FROM b, range(1, 5) t(i) WHERE b[i + 1] IS NOT NULL)"


@query(f"WITH {_EDGES} SELECT bin, count(*) AS n FROM customer JOIN bins ON c_acctbal <= hi AND (c_acctbal > lo OR (i = 1 AND c_acctbal >= lo)) GROUP BY bin")
def binarize_numbers(spark, folder):
    """How many rows each bin of a number holds."""
    made = funnel.binarize(read_table(spark, folder, "customer").select("c_acctbal"))
    return made.select(F.inline(F.array(*[F.struct(F.lit(c.split("__", 1)[1]).alias("bin"), F.col(f"`{c}`").alias("x")) for c in made.columns]))).groupBy("bin").agg(F.sum("x").alias("n"))


@query(f"WITH {_EDGES}" + """, f AS (SELECT 'c_acctbal' AS feature, bin, CAST(c_acctbal <= hi AND (c_acctbal > lo OR (i = 1 AND c_acctbal >= lo)) AS INTEGER) AS x, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS t FROM customer, bins
UNION ALL SELECT 'c_mktsegment', s, CAST(c_mktsegment = s AS INTEGER), CAST(c_mktsegment = 'BUILDING' AS INTEGER) FROM customer, (SELECT DISTINCT c_mktsegment AS s FROM customer))
SELECT feature, bin, round(corr(x, t) + 1e-9::DOUBLE, 6) AS correlation FROM f GROUP BY 1, 2""")
def correlation_funnel(spark, folder):
    return _round(funnel.correlation_funnel(read_table(spark, folder, "customer").select("c_mktsegment", "c_acctbal"), "c_mktsegment__BUILDING"), "correlation")


@query("""WITH p AS (SELECT l_quantity AS x, l_discount AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y) * a.n * b.n) AS k, sum(abs(sign(a.x - b.x)) * a.n * b.n) AS u, sum(abs(sign(a.y - b.y)) * a.n * b.n) AS v FROM p a, p b)
SELECT 'l_quantity' AS feature, CAST(NULL AS VARCHAR) AS bin, round(k / sqrt(u * v) + 1e-9::DOUBLE, 6) AS correlation FROM s UNION ALL SELECT 'l_discount', NULL, 1.0::DOUBLE""")
def correlate_kendall(spark, folder):
    return _round(funnel.correlate(read_table(spark, folder, "lineitem").select("l_quantity", "l_discount"), "l_discount", "kendall"), "correlation")


# ---- validation

_SPLITS = """WITH b AS (SELECT min(o_orderdate) AS a, max(o_orderdate) + INTERVAL 1 DAY AS z FROM orders),
s AS (SELECT CAST(k + 1 AS INTEGER) AS split, z - to_days(CAST(90 * k AS INTEGER)) AS fe, a FROM b, range(0, 1000) t(k))
SELECT split, CAST(fe - INTERVAL 455 DAY AS TIMESTAMP) AS train_start, CAST(fe - INTERVAL 90 DAY AS TIMESTAMP) AS train_end, CAST(fe - INTERVAL 90 DAY AS TIMESTAMP) AS forecast_start, CAST(fe AS TIMESTAMP) AS forecast_end FROM s WHERE fe - INTERVAL 455 DAY >= a"""


@query(_SPLITS)
def splitter_table(spark, folder):
    return validation.TimeSeriesCVSplitter(read_table(spark, folder, "orders"), "o_orderdate", frequency="days", train_size=365, forecast_horizon=90)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
