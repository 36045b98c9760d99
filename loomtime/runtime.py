"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; on a local master without one make a private folder. A cluster without one raises ValueError, as a
    folder of one machine would lose data there."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster see")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomtime-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, lineage cut, partitions and their order kept."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of a frame's size; nothing runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def range_partitions(df: DataFrame, each: int = 32_000_000) -> int:
    """Partitions for a global sort whose tasks hold a partition in memory: the session's number, or more where partitions would pass ``each`` bytes of
    estimated size. The planner takes a join for the product of its sides, so its estimate counts up to 64 times the session's number."""
    asked = partitions(df.sparkSession)
    return max(asked, min(estimated_bytes(df) // each, 64 * asked))


def spread(df: DataFrame) -> DataFrame:
    """``df`` for a costly Python stage: an input of less than one full split a core is dealt out evenly first, as a few row groups would keep most
    cores idle; larger ones already have tasks enough and aren't moved. Only the planner's size estimate is read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    return df.repartition(4 * cores) if estimated_bytes(df) < cores * split else df


def nan_to_null(column):
    """Floating column with NaN read as missing."""
    return F.when(F.isnan(column), None).otherwise(column)


def numeric(df: DataFrame, name: str):
    """Column ``name`` as double with NaN read as null."""
    return nan_to_null(F.col(name).cast("double"))


def without_nan(df: DataFrame) -> DataFrame:
    """``df`` with NaN read as null in its floating columns."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in floating}) if floating else df


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def free_name(df: DataFrame, stem: str) -> str:
    """A helper column name that clashes with no column of ``df``."""
    name = f"__{stem}"
    while name in df.columns:
        name += "_"
    return name


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application; Spark's own file server hands it out."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="loomtime-code-")) / "loomtime.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
