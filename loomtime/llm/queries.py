"""Queries of the corpus operators and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtime.llm import leakage, percentiles, pii, tokens
from loomtime.runtime import read_table

PROBABILITIES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
NAMES = ("p01", "p05", "p25", "median", "p75", "p95", "p99")


def _readings(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "m4_hourly").select("id", "date", "value").where("id IS NOT NULL")


def _rounded(df: DataFrame, names=NAMES) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact percentiles of all readings of each source."""
    return _rounded(percentiles.percentiles(_readings(spark, folder), "id", "value", PROBABILITIES, NAMES))


def p1_merged(spark: SparkSession, folder: str) -> DataFrame:
    """The same from summaries of two separate spans of days put together."""
    rows = _readings(spark, folder)
    late = F.coalesce(F.dayofmonth("date") > 15, F.lit(False))
    runs = percentiles.merge_runs(percentiles.value_runs(rows.where(~late), "id", "value"), percentiles.value_runs(rows.where(late), "id", "value"))
    return _rounded(percentiles.percentiles_of_runs(runs, PROBABILITIES, NAMES)).withColumnRenamed("by", "id")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(read_table(spark, folder, "documents"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Each leaked run with its place in the original text."""
    return _leaks(spark, folder)


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Each piece of personal information with its place."""
    return pii.find_personal(read_table(spark, folder, "documents"), read_table(spark, folder, "contributors"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_spans(spark, folder).select("doc_id", "kind", "value").distinct()


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Each text with placeholders instead of personal information."""
    return pii.redact(read_table(spark, folder, "documents"), read_table(spark, folder, "contributors"))


def queries() -> dict:
    own = (p1_percentiles, p1_merged, p6_ids, p7_found, p7_spans, p8_spans, p8_found, p8_redacted)
    return {f.__name__: f for f in own}


_P1 = "SELECT id, count(*) AS n, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS {n}" for p, n in zip(PROBABILITIES, NAMES)) + (
    " FROM m4_hourly WHERE id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY id")

_P7 = """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, array_to_string(ws[i:i + 11], ' ') AS gram
      FROM w, unnest(range(1, greatest(len(ws) - 10, 1))) AS t(i)),
f AS (SELECT item_id, regexp_extract_all(lower(prompt), '[\\p{L}\\p{N}]+') AS ws FROM eval_items
      UNION ALL SELECT item_id, regexp_extract_all(lower(answer), '[\\p{L}\\p{N}]+') FROM eval_items),
g AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 11], ' ') AS gram FROM f, unnest(range(1, greatest(len(ws) - 10, 1))) AS t(i))
SELECT DISTINCT doc_id, item_id FROM d JOIN g USING (gram)"""


def oracle_sql() -> dict[str, str]:
    return {"p1_percentiles": _P1, "p1_merged": _P1, "p7_found": _P7}
