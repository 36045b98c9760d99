"""Versioned feature sets: built once for a data state, a transform and its settings, then read."""

from __future__ import annotations

import contextlib
import datetime as dt
import hashlib
import inspect
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FeatureSetMetadata:
    name: str
    version: str
    cache_key: str
    data_fingerprint: str
    transform_fingerprint: str
    storage_format: str
    artifact_path: str
    created_at: str
    row_count: int
    column_names: list[str]
    column_types: list[str]
    key_columns: list[str]
    description: str = ""
    tags: list[str] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    duration_seconds: float = 0.0
    extra: dict = field(default_factory=dict)


@dataclass(frozen=True)
class FeatureSetResult:
    data: DataFrame
    metadata: FeatureSetMetadata
    from_cache: bool


@dataclass(frozen=True)
class _Registered:
    transform: Callable[..., DataFrame]
    defaults: dict
    description: str
    tags: list[str]
    keys: list[str]


def data_fingerprint(df: DataFrame) -> str:
    """Digest of a table's columns, number of rows and values, whatever the order of its rows; one aggregate."""
    cols = [F.col(f"`{c}`").cast("string") if t.startswith("map") else F.col(f"`{c}`") for c, t in df.dtypes]
    h = F.xxhash64(*cols) if cols else F.lit(0)
    r = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return hashlib.sha256(json.dumps([df.dtypes, r["n"], str(r["s"]), r["x"]]).encode()).hexdigest()


def transform_fingerprint(transform: Callable, params: dict) -> str:
    try:
        body = inspect.getsource(transform)
    except (OSError, TypeError):
        body = getattr(transform, "__qualname__", repr(transform))
    return hashlib.sha256(json.dumps([body, params], sort_keys=True, default=str).encode()).hexdigest()


class Folder:
    """Small files of a folder of any file system the session knows."""

    def __init__(self, spark: SparkSession, uri: str):
        self.jvm, self.uri = spark._jvm, uri.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}" if name else self.uri)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole file or nothing: written beside it, then renamed."""
        part = self._path(f".{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.delete(self._path(name), False)
        if not self.fs.rename(part, self._path(name)):
            raise OSError(f"can't write {self._path(name)}")

    def take(self, name: str) -> bool:
        """Make a file that must not be there yet."""
        self.fs.mkdirs(self._path(name).getParent())
        try:
            return bool(self.fs.createNewFile(self._path(name)))
        except Py4JJavaError:
            return False

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class FileLockManager:
    """Lock files of a folder."""

    def __init__(self, folder: Folder | str, timeout: float = 60.0, poll: float = 0.1):
        self.folder = folder if isinstance(folder, Folder) else Folder(SparkSession.active(), folder)
        self.timeout, self.poll = timeout, poll

    @contextlib.contextmanager
    def acquire(self, name: str) -> Iterator[None]:
        end = time.monotonic() + self.timeout
        while not self.folder.take(f"{name}.lock"):
            if time.monotonic() > end:
                raise TimeoutError(f"{name}.lock in {self.folder.uri} is held")
            time.sleep(self.poll)
        try:
            yield
        finally:
            self.folder.remove(f"{name}.lock")


class FeatureStore:
    """Catalog (a JSON file), locks and artifacts (under ``artifact_uri``, default: the root), in any file system Spark can write. Without ``root_path`` and
    the variable LOOMTIME_FEATURE_STORE it lies in the driver's home folder, which does for a local master only."""

    def __init__(self, spark: SparkSession, root_path: str | None = None, catalog_filename: str = "catalog.json", default_storage_format: str = "parquet",
                 artifact_uri: str | None = None, locking: bool = True, lock_timeout: float = 60.0):
        self.spark = spark
        self.root = str(root_path or os.environ.get("LOOMTIME_FEATURE_STORE") or "")
        if not self.root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("a cluster's feature store needs a root_path that all machines see")
            self.root = os.path.join(os.path.expanduser("~"), ".loomtime_features")
        self.folder, self.catalog = Folder(spark, self.root), catalog_filename
        if default_storage_format not in ("parquet", "orc"):
            raise ValueError("storage is 'parquet' or 'orc'")
        self.storage, self.artifacts = default_storage_format, artifact_uri or self.root
        self.locks = FileLockManager(Folder(spark, f"{self.root}/locks"), lock_timeout) if locking else None
        self.registry: dict[str, _Registered] = {}

    def register(self, name: str, transform: Callable[..., DataFrame], default_kwargs: dict | None = None, description: str = "", tags: Sequence[str] = (),
                 default_key_columns: Sequence[str] = ()) -> FeatureStore:
        self.registry[name] = _Registered(transform, dict(default_kwargs or {}), description, list(tags), list(default_key_columns))
        return self

    def _entries(self) -> list[FeatureSetMetadata]:
        text = self.folder.read(self.catalog)
        return [FeatureSetMetadata(**e) for e in json.loads(text)] if text else []

    def _save(self, entries: list[FeatureSetMetadata]) -> None:
        self.folder.write(self.catalog, json.dumps([asdict(e) for e in entries], indent=1, default=str))

    def _find(self, name: str, version: str | None = None) -> FeatureSetMetadata:
        found = [e for e in self._entries() if e.name == name and version in (None, e.version)]
        if not found:
            raise KeyError(f"no feature set {name!r}" + (f" of version {version!r}" if version else ""))
        return found[-1]

    def _read(self, e: FeatureSetMetadata) -> DataFrame:
        return self.spark.read.format(e.storage_format).load(e.artifact_path)

    def build(self, name: str, data: DataFrame, params: dict | None = None, refresh: bool = False, version: str | None = None, key_columns: Sequence[str] | None = None,
              storage_format: str | None = None) -> FeatureSetResult:
        """The feature set for this data state and these settings, from the store if it is there, else computed, written and read again."""
        if name not in self.registry:
            raise KeyError(f"no transform {name!r}")
        reg = self.registry[name]
        settings = reg.defaults | dict(params or {})
        marks = data_fingerprint(data), transform_fingerprint(reg.transform, settings)
        key = hashlib.sha256("|".join([name, *marks]).encode()).hexdigest()
        wanted = version or key[:12]

        def stored() -> FeatureSetResult | None:
            hit = [e for e in self._entries() if e.name == name and e.cache_key == key and e.version == wanted]
            return FeatureSetResult(self._read(hit[-1]), hit[-1], True) if hit and not refresh else None

        got = stored()
        if got:
            return got
        with self.locks.acquire(f"{name}-{wanted}") if self.locks else contextlib.nullcontext():
            got = stored()
            if got:
                return got
            began = time.time()
            storage = storage_format or self.storage
            path = f"{self.artifacts.rstrip('/')}/{name}/{wanted}-{uuid.uuid4().hex[:8]}"
            made = reg.transform(data, **settings)
            made.write.format(storage).save(path)
            back = self.spark.read.format(storage).load(path)
            meta = FeatureSetMetadata(name, wanted, key, *marks, storage, path, dt.datetime.now(dt.UTC).isoformat(), back.count(), back.columns, [t for _, t in back.dtypes],
                                      list(key_columns or reg.keys), reg.description, reg.tags, {k: str(v) for k, v in settings.items()}, time.time() - began)
            with self.locks.acquire("catalog") if self.locks else contextlib.nullcontext():
                self._save([*[e for e in self._entries() if not (e.name == name and e.version == wanted)], meta])
        return FeatureSetResult(back, meta, False)

    def load(self, name: str, version: str | None = None) -> FeatureSetResult:
        e = self._find(name, version)
        return FeatureSetResult(self._read(e), e, True)

    def list_feature_sets(self) -> DataFrame:
        rows = [(e.name, e.version, e.created_at, e.row_count, e.storage_format, e.artifact_path, e.tags) for e in self._entries()]
        return self.spark.createDataFrame(rows, "name string, version string, created_at string, row_count bigint, storage_format string, artifact_path string, tags array<string>")

    def describe(self, name: str, version: str | None = None) -> FeatureSetMetadata:
        return self._find(name, version)

    def drop(self, name: str, version: str | None = None, delete_artifact: bool = True) -> None:
        e = self._find(name, version)
        if delete_artifact:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(e.artifact_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        with self.locks.acquire("catalog") if self.locks else contextlib.nullcontext():
            self._save([x for x in self._entries() if x != e])

    def assemble(self, specs: Sequence[str | tuple[str, str]], join_keys: Sequence[str], how: str = "left") -> DataFrame:
        """Feature sets joined on keys; columns that clash get the suffix _version."""
        parts = []
        for s in specs:
            name, version = (s, None) if isinstance(s, str) else s
            r = self.load(name, version)
            parts.append((r.data, r.metadata.version))

        def add(left: DataFrame, right: tuple[DataFrame, str]) -> DataFrame:
            df, version = right
            clash = [c for c in df.columns if c in left.columns and c not in join_keys]
            return left.join(df.withColumnsRenamed({c: f"{c}_{version}" for c in clash}), list(join_keys), how)

        return reduce(add, parts[1:], parts[0][0])


class FeatureStoreAccessor:
    """A table with a store: ``feature_store(df, store).build('name')``."""

    def __init__(self, data: DataFrame, store: FeatureStore):
        self.data, self.store = data, store

    def build(self, name: str, **settings) -> FeatureSetResult:
        return self.store.build(name, self.data, **settings)


def feature_store(data: DataFrame, store: FeatureStore) -> FeatureStoreAccessor:
    return FeatureStoreAccessor(data, store)


def log_feature_set(result: FeatureSetResult, log: Callable[[str, object], None]) -> None:
    """A feature set's metadata handed to a tracking client's log function, entry by entry."""
    for k, v in asdict(result.metadata).items():
        log(k, v)


def load_feature_set(store: FeatureStore, tracked: dict[str, object]) -> FeatureSetResult:
    """The feature set that a tracking client's entries (as ``log_feature_set`` wrote them) name, if the store still has that state of it."""
    found = store.load(str(tracked["name"]), str(tracked["version"]))
    if found.metadata.cache_key != tracked.get("cache_key", found.metadata.cache_key):
        raise KeyError(f"the store's {tracked['name']!r} of version {tracked['version']!r} is not the one that was tracked")
    return found
