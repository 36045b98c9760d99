"""Sources, feature store and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomtime.operators.timeagg import summarize_by_time
from loomtime.sources import datasets
from loomtime.sources.feature_store import FeatureStore, FileLockManager, data_fingerprint, feature_store, log_feature_set
from loomtime.streaming import streams


def test_datasets(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    for kind in ("parquet", "csv", "json", "orc"):
        datasets.write_dataset(df, f"{tmp_path}/t_{kind}.{kind}", kind)
    assert datasets.get_available_datasets(spark, str(tmp_path)) == ["t_csv", "t_json", "t_orc", "t_parquet"]
    for kind in ("parquet", "csv", "json", "orc"):
        assert datasets.load_dataset(spark, f"t_{kind}", str(tmp_path)).count() == 2
    assert datasets.load_dataset(spark, "t_csv", str(tmp_path), schema="id string, name string").dtypes[0][1] == "string"
    with pytest.raises(ValueError):
        datasets.load_dataset(spark, "nope", str(tmp_path))
    with pytest.raises(ValueError):
        datasets.write_dataset(df, f"{tmp_path}/x", "xml")
    assert datasets.get_available_datasets(spark, f"{tmp_path}/none") == []


def double(df, by: int = 2):
    return df.withColumn("value2", F.col("value") * by)


def test_feature_store(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path)).register("double", double, {"by": 2}, "twice", ["t"], ["id"])
    df = spark.createDataFrame([(1, 10), (2, 12), (3, 14)], "id bigint, value bigint")
    first = store.build("double", df)
    again = store.build("double", df.orderBy(F.desc("id")).repartition(3))
    assert not first.from_cache and again.from_cache and first.metadata.version == again.metadata.version and first.metadata.row_count == 3
    other = store.build("double", df, {"by": 3})
    assert other.metadata.version != first.metadata.version and not store.build("double", df, refresh=True).from_cache
    assert store.list_feature_sets().count() == 2 and store.describe("double", other.metadata.version).params == {"by": "3"}
    both = store.assemble([("double", first.metadata.version), ("double", other.metadata.version)], ["id"])
    assert both.count() == 3 and f"value2_{other.metadata.version}" in both.columns
    seen = {}
    log_feature_set(first, seen.__setitem__)
    assert seen["name"] == "double" and feature_store(df, store).build("double").from_cache
    store.drop("double", other.metadata.version)
    assert store.list_feature_sets().count() == 1 and store.load("double").from_cache
    with pytest.raises(KeyError):
        store.load("double", other.metadata.version)
    with pytest.raises(KeyError):
        store.build("nope", df)


def test_fingerprint_sees_repeats(spark):
    a = spark.createDataFrame([(1,), (1,)], "x int")
    assert data_fingerprint(a) != data_fingerprint(a.limit(0)) and data_fingerprint(a) != data_fingerprint(a.union(a))


def test_lock(tmp_path):
    locks = FileLockManager(str(tmp_path), 0.2, 0.05)
    with locks.acquire("a"):
        with pytest.raises(TimeoutError):
            with locks.acquire("a"):
                pass
    with locks.acquire("a"):
        pass


def run(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        return q.sparkSession.table(name) if hasattr(q, "sparkSession") else None
    finally:
        q.stop()


@pytest.fixture()
def folder(spark, tmp_path):
    rows = [("a", dt.datetime(2023, 1, 1, h, m), float(h * 10 + m)) for h in range(5) for m in (0, 30)] + [("z", dt.datetime(2023, 1, 3), 1.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in/x.parquet")
    return df, f"{tmp_path}/in/x.parquet"


def test_stream_equals_batch(spark, folder):
    df, path = folder
    stream = spark.readStream.schema(df.schema).parquet(path)
    run(streams.summarize_stream(stream, "ts", "v", "h", ["sum", "count"], ["k"]), "bins")
    got = spark.table("bins").where("k = 'a'").orderBy("ts").collect()
    want = summarize_by_time(df.where("k = 'a'"), "ts", "v", "h", ["sum", "count"], by=["k"]).orderBy("ts").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    with pytest.raises(ValueError):
        streams.summarize_stream(stream, "ts", "v", "MS")
    with pytest.raises(ValueError):
        streams.summarize_stream(stream, "ts", "v", "h", "median")


def test_stateful_streams(spark, folder):
    df, path = folder
    stream = spark.readStream.schema(df.schema).parquet(path)
    run(streams.ewm_stream(stream, "ts", "v", 0.5, ["k"]), "ewm")
    pdf = df.where("k = 'a'").toPandas().sort_values("ts")
    got = spark.table("ewm").where("k = 'a'").orderBy("ts").toPandas()
    assert list(got.iloc[:, -1]) == pytest.approx(list(pdf.v.ewm(alpha=0.5, adjust=False).mean()))
    run(streams.drawdown_stream(stream, "ts", "v", ["k"]), "down")
    down = spark.table("down").where("k = 'a'").orderBy("ts").toPandas()
    assert list(down.v_drawdown) == list(pdf.v - pdf.v.cummax())
    run(streams.session_stream(stream, "ts", "40 minutes", ["k"]), "sessions")
    assert spark.table("sessions").where("k = 'a'").first()["n"] == 10
