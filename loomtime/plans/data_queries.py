"""Queries of the core's data-preparation operators and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtime.operators import gridfill, missing, spikes, trailing
from loomtime.runtime import read_table


def p2_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of m4_daily with both fields filled and marked."""
    return missing.fill_missing(read_table(spark, folder, "m4_daily"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    marks = F.array_compact(F.array(F.when(F.col("value_filled"), "value"), F.when(F.col("category_filled"), "category")))
    return p2_filled(spark, folder).select("row_no", F.explode(marks).alias("field"))


def p2_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What was there comes through the filling unchanged; null here stands for what was filled."""
    kept = lambda c: F.when(~F.col(f"{c}_filled"), F.col(c)).alias(c)
    return p2_filled(spark, folder).select("row_no", "id", kept("value"), kept("category"))


def p3_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every source and hour with its value, observed or filled."""
    return gridfill.regularize(read_table(spark, folder, "m4_hourly"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    gaps = p3_grid(spark, folder).where("status <> 'observed'")
    return gaps.select("id", F.date_format("hour_start", "yyyy-MM-dd HH:mm:ss").alias("hour_start"))


def p3_hours(spark: SparkSession, folder: str) -> DataFrame:
    """The observed hours alone."""
    kept = p3_grid(spark, folder).where("status = 'observed'")
    return kept.select("id", F.date_format("hour_start", "yyyy-MM-dd HH:mm:ss").alias("hour_start"), "n_readings", F.round(F.col("value") + 1e-9, 6).alias("value"))


def p4_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Every reading with its flags, the expected level and the source's scatter."""
    rows = read_table(spark, folder, "m4_hourly").select("row_no", "id", "date", "value", "unit")
    return spikes.flag_implausible(rows)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_flags(spark, folder).where("impossible OR stuck OR spike").select("row_no")


def p4_stuck(spark: SparkSession, folder: str) -> DataFrame:
    return p4_flags(spark, folder).where("stuck").select("row_no")


def p4_impossible(spark: SparkSession, folder: str) -> DataFrame:
    return p4_flags(spark, folder).where("impossible").select("row_no")


def _sales(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "bike_sales_sample").withColumn("category_1", F.lower(F.trim("category_1")))
    return trailing.distinct_lines(lines, ("order_id", "order_line"), "loaded_at", ("order_date", "category_1", "total_price"))


def p5_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Sum and average of the last 7 and 30 days for each category and day."""
    out = trailing.trailing_totals(_sales(spark, folder), "category_1", "order_date", "total_price", (7, 30))
    return out.select("category_1", F.date_format("day", "yyyy-MM-dd").alias("day"), "lines", *(
        F.round(f"{what}_{w}", 2).alias(f"{what}_{w}") for w in (7, 30) for what in ("total", "average")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    quiet = trailing.trailing_totals(_sales(spark, folder), "category_1", "order_date", "total_price", (7, 30)).where("lines = 0")
    return quiet.select("category_1", F.date_format("day", "yyyy-MM-dd").alias("quiet_day"))


def queries() -> dict:
    own = (p2_filled, p2_found, p2_kept, p3_grid, p3_found, p3_hours, p4_flags, p4_found, p4_stuck, p4_impossible, p5_totals, p5_found)
    return {f.__name__: f for f in own}


_TEXT = ", ".join(f"'{m}'" for m in missing.TEXT_MARKERS)
_NUMBERS = ", ".join(str(m) for m in missing.NUMBER_MARKERS)

_P2 = f"""
WITH t AS (SELECT row_no, id, CASE WHEN isnan(value) THEN NULL ELSE value END AS v, category FROM m4_daily),
r AS (SELECT id, min(v) AS lo, max(v) AS hi FROM t WHERE v NOT IN ({_NUMBERS}) GROUP BY id)
SELECT row_no, 'value' AS field FROM t LEFT JOIN r ON t.id IS NOT DISTINCT FROM r.id WHERE v IS NULL OR (v IN ({_NUMBERS}) AND NOT coalesce(v BETWEEN lo AND hi, false))
UNION ALL
SELECT row_no, 'category' FROM t WHERE category IS NULL OR NOT regexp_matches(category, '[\\p{{L}}\\p{{N}}]') OR lower(trim(category)) IN ({_TEXT})"""

_P2_KEPT = f"""
WITH t AS (SELECT row_no, id, CASE WHEN NOT isnan(value) THEN value END AS v, category FROM m4_daily),
r AS (SELECT id, min(v) AS lo, max(v) AS hi FROM t WHERE v NOT IN ({_NUMBERS}) GROUP BY id)
SELECT row_no, t.id, CASE WHEN v NOT IN ({_NUMBERS}) OR v BETWEEN lo AND hi THEN v END AS value,
CASE WHEN regexp_matches(category, '[\\p{{L}}\\p{{N}}]') AND lower(trim(category)) NOT IN ({_TEXT}) THEN category END AS category FROM t LEFT JOIN r ON t.id IS NOT DISTINCT FROM r.id"""

_P3 = """
WITH r AS (SELECT DISTINCT id, date, value, date_trunc('hour', date) AS h FROM m4_hourly WHERE id IS NOT NULL AND date IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
o AS (SELECT id, h, count(*) AS n, avg(value) AS v FROM r GROUP BY id, h)"""

_P3_FOUND = _P3 + """,
g AS (SELECT id, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM o GROUP BY id)
SELECT g.id, strftime(g.h, '%Y-%m-%d %H:%M:%S') AS hour_start FROM g ANTI JOIN o ON g.id = o.id AND g.h = o.h"""

_P4_STUCK = """
WITH r AS (SELECT DISTINCT id, date, value FROM m4_hourly WHERE id IS NOT NULL AND date IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
s AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY id ORDER BY date, value) THEN 0 ELSE 1 END AS fresh FROM r),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY date, value) AS run FROM s),
c AS (SELECT *, count(*) OVER (PARTITION BY id, run) AS long FROM k)
SELECT row_no FROM m4_hourly m JOIN c ON m.id = c.id AND m.date = c.date AND m.value = c.value WHERE long >= 8"""

_UNITS = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in spikes.UNITS.items()) + ") u(name, unit)"

_P4_IMPOSSIBLE = f"""
WITH r AS (SELECT row_no, id, value, u.unit FROM m4_hourly LEFT JOIN {_UNITS} ON regexp_replace(lower(m4_hourly.unit), '[\\s.°_-]', '', 'g') = u.name WHERE id IS NOT NULL AND date IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
k AS (SELECT id, unit, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC) AS k FROM r WHERE unit IS NOT NULL GROUP BY id, unit)
SELECT row_no FROM r LEFT JOIN k ON r.id = k.id AND k.k = 1 WHERE (k.unit = 'percent' AND (value < 0 OR value > 100)) OR (k.unit = 'ph' AND (value < 0 OR value > 14)) OR (k.unit = 'celsius' AND value < -273.15)
OR (k.unit IN ('kelvin', 'count', 'lux', 'kwh') AND value < 0)"""

_P5 = """
WITH l AS (SELECT order_id, order_line, loaded_at, CAST(order_date AS DATE) AS d, lower(trim(category_1)) AS category_1, total_price AS v FROM bike_sales_sample),
u AS (SELECT category_1, d, v FROM (SELECT *, row_number() OVER (PARTITION BY order_id, order_line ORDER BY loaded_at DESC, d DESC NULLS LAST, category_1 DESC NULLS LAST, v DESC NULLS LAST) AS k FROM l) WHERE k = 1),
y AS (SELECT category_1, d, count(*) AS lines, coalesce(sum(v), 0) AS s, count(v) AS n FROM u WHERE category_1 IS NOT NULL AND d IS NOT NULL GROUP BY category_1, d),
g AS (SELECT category_1, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM y GROUP BY category_1),
f AS (SELECT g.category_1, g.d, coalesce(lines, 0) AS lines, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM g LEFT JOIN y ON g.category_1 = y.category_1 AND g.d = y.d),
w AS (SELECT category_1, d, lines, sum(s) OVER a AS s7, sum(n) OVER a AS n7, sum(s) OVER b AS s30, sum(n) OVER b AS n30 FROM f
      WINDOW a AS (PARTITION BY category_1 ORDER BY d ROWS 6 PRECEDING), b AS (PARTITION BY category_1 ORDER BY d ROWS 29 PRECEDING))"""

_P5_TOTALS = _P5 + """
SELECT category_1, strftime(d, '%Y-%m-%d') AS day, lines, round(s7, 2) AS total_7, round(s7 / nullif(n7, 0), 2) AS average_7,
       round(s30, 2) AS total_30, round(s30 / nullif(n30, 0), 2) AS average_30 FROM w"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2,
        "p2_kept": _P2_KEPT,
        "p4_impossible": _P4_IMPOSSIBLE,
        "p3_found": _P3_FOUND,
        "p3_hours": _P3 + " SELECT id, strftime(h, '%Y-%m-%d %H:%M:%S') AS hour_start, n AS n_readings, round(v + 1e-9, 6) AS value FROM o",
        "p4_stuck": _P4_STUCK,
        "p5_totals": _P5_TOTALS,
        "p5_found": _P5 + " SELECT category_1, strftime(d, '%Y-%m-%d') AS quiet_day FROM w WHERE lines = 0",
    }
