"""Named datasets of a folder: one file or folder a name, read by its format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = (".parquet", ".csv", ".json", ".orc")


def _list(spark: SparkSession, folder: str) -> dict[str, str]:
    """Names to paths, listed through the file system of the folder's URI (local, HDFS or object store)."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for s in fs.listStatus(path) if fs.exists(path) else []:
        name = s.getPath().getName()
        for ext in FORMATS:
            if name.endswith(ext):
                out.setdefault(name[: -len(ext)], f"{folder.rstrip('/')}/{name}")
    return out


def get_available_datasets(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names of the datasets in a folder."""
    return sorted(_list(spark, folder))


def load_dataset(spark: SparkSession, name: str, folder: str, schema: str | None = None, **options) -> DataFrame:
    """Dataset ``name`` of a folder; an unknown name raises ValueError. CSV has a header; without ``schema`` its types are inferred."""
    known = _list(spark, folder)
    if name not in known:
        raise ValueError(f"no dataset {name!r}; there are {sorted(known)}")
    path = known[name]
    reader = spark.read.options(**options)
    reader = reader.schema(schema) if schema else reader
    if path.endswith(".csv"):
        return reader.csv(path, header=options.get("header", True), inferSchema=schema is None)
    return {"parquet": reader.parquet, "json": reader.json, "orc": reader.orc}[path.rpartition(".")[2]](path)


def write_dataset(df: DataFrame, path: str, storage: str = "parquet", partition_by: list[str] | None = None, mode: str = "error") -> None:
    """``df`` to a path in parquet, orc, csv or json."""
    if storage not in ("parquet", "orc", "csv", "json"):
        raise ValueError(f"unknown format {storage!r}")
    w = df.write.mode(mode).format(storage)
    if storage == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
