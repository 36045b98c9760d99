"""Runs queries against their SQL: python tests/compare.py [--sf DIR] [NAME...]"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402


def session():
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str):
    d = duckdb.connect()
    d.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        d.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return d


def normal(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        rows.append(tuple("~" if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x) else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r))
    return sorted(rows)


def compare(spark, db, name: str, folder: str) -> str:
    t = time.time()
    table = entry.queries()[name](spark, folder).toArrow()
    took = time.time() - t
    got = table.to_pandas()
    for c in got.select_dtypes("datetimetz"):
        got[c] = got[c].dt.tz_localize(None)
    nan = [c for c in table.column_names if pa.types.is_floating(table[c].type) and pc.any(pc.is_nan(table[c])).as_py()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"{name}: {len(got)} rows, {took:.1f} s, no SQL"
    want = db.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"{name}: COLUMNS DIFFER {sorted(got.columns)} {sorted(want.columns)}"
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got if str(got[c].dtype).split('[')[0] != str(want[c].dtype).split('[')[0]}
    g, w = normal(got), normal(want)
    if nan:
        return f"{name}: NaN IN {nan}, which equals nothing"
    if g != w:
        only = [x for x in g if x not in set(w)][:3], [x for x in w if x not in set(g)][:3]
        return f"{name}: VALUES DIFFER {len(g)} {len(w)} {only} {sorted(got.columns)}"
    return f"{name}: equal, {len(got)} rows, {took:.1f} s" + (f", kinds {kinds}" if kinds else "")


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args[1] if args[:1] == ["--sf"] else "/root/testdata/sf0.01"
    args = args[2:] if args[:1] == ["--sf"] else args
    spark, db = session(), database(folder)
    names = [n for n in entry.queries() if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    for n in names:
        try:
            print(compare(spark, db, n, folder), flush=True)
        except Exception as e:
            print(f"{n}: ERROR {str(e)[:900]}", flush=True)
