"""Scratch tables in the shared folder, and versioned snapshots of a topology's tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where none is configured (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="planar_spark_")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: One list of written tables for each ``scratch_tables`` that is open.
OPEN: list[list[DataFrame]] = []


@contextmanager
def scratch_tables() -> Iterator[list[DataFrame]]:
    """The tables written inside the block, so that they can be discarded when their readers are written."""
    made: list[DataFrame] = []
    OPEN.append(made)
    try:
        yield made
    finally:
        OPEN[:] = [m for m in OPEN if m is not made]


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    for made in OPEN:
        made.append(out)
    return out


WRITERS = 4  # tables of a commit that are written at a time

#: Bytes of a stored table from which joins with it are no broadcasts. Spark takes the size of compressed files for that of the rows, and sorted numbers
#: shrink a hundredfold: 10 MB of files would pass through the driver as 1 GB.
LEAST_MERGED = 1 << 18


def stored(df: DataFrame, label: str) -> DataFrame:
    """``written``, and where the table is large its joins are merges."""
    out = written(df, label)
    spark, path = df.sparkSession, out._scratch_path
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength() > LEAST_MERGED:
        out = out.hint("merge")
        out._scratch_path = path
    return out


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly over all cores, before work that takes long for each: a small file is one split, and a small shuffle is read by few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def spread_in_order(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt over all cores by ranges of ``key``."""
    spark = rows.sparkSession
    return rows.repartitionByRange(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that everything which reads them has been written after."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Conflict(RuntimeError):
    """Another writer has committed since the version that this commit builds on."""


class Store:
    """Snapshots: each commit writes folders of changed tables and a manifest that points to every table's folders. Rolling back is reading an older
    manifest; nothing is updated in place.

    A manifest is created, never replaced: of two writers that build on one version the second gets ``Conflict``, and both tables' folders have names of
    their own. It also says which batches of which streams are applied, in the same step as their rows.

    A table can be dealt to buckets by a key (``schema.BUCKETED``). Then a commit may replace some buckets, and the others' files stay as they are.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/manifests")
        if not fs.exists(p):
            return []
        return sorted(int(x.getPath().getName().split(".")[0]) for x in fs.listStatus(p) if x.getPath().getName().endswith(".json"))

    def latest(self) -> int:
        return (self.versions() or [-1])[-1]

    def text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _state(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        return json.loads(self.text(f"{self.root}/manifests/{version}.json")) if version >= 0 else {"tables": {}, "applied": {}, "facts": {}}

    def manifest(self, version: int | None = None) -> dict[str, str | dict[str, str]]:
        return self._state(version)["tables"]

    def applied(self, stream: str) -> int:
        """The last batch of a stream whose rows the store holds, or -1."""
        return self._state()["applied"].get(stream, -1)

    def facts(self) -> dict:
        """What the last commit with facts said of its tables as a whole."""
        return self._state()["facts"]

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(schema.BUCKETED[name])), F.lit(self.buckets)).cast("int")

    def commit(self, tables: dict[str, DataFrame], base: int | None = None, applied: dict[str, int] | None = None, replaced: dict[str, list[int]] | None = None, facts: dict | None = None) -> int:
        """A version with these tables in place of theirs, built on version ``base`` (the latest). ``replaced``: the only buckets that a table's rows are of; the others stay.
        ``applied``: batches of streams that the rows come from. ``facts`` take the place of those with their names."""
        base = self.latest() if base is None else base
        state = self._state(base)

        def write(item: tuple[str, DataFrame]) -> str | dict[str, str]:
            name, df = item
            folder = f"{self.root}/tables/{name}/{base + 1}-{uuid.uuid4().hex[:12]}"
            if name in schema.BUCKETED:
                df = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.of(name)])
                # Rebalanced, so that a bucket's rows are few files but a large bucket is several tasks'.
                df.withColumn("_bucket", self.bucket(name)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(folder)
                fs, p = self._fs(folder)
                own = {x.getPath().getName().split("=")[1]: f"{folder}/{x.getPath().getName()}" for x in fs.listStatus(p) if "=" in x.getPath().getName()}
                old = state["tables"].get(name, {}) if replaced and name in replaced else {}
                return {k: f for k, f in old.items() if int(k) not in (replaced or {}).get(name, ())} | own
            df.write.parquet(folder)
            return folder

        # Side by side: most tables are small, and planning takes longer than their tasks.
        with ThreadPoolExecutor(WRITERS) as pool:
            pointers = list(pool.map(inheritable_thread_target(self.spark)(write), tables.items()))
        state["tables"] = state["tables"] | dict(zip(tables, pointers, strict=True))
        return self._point(base + 1, state | {"applied": state["applied"] | (applied or {}), "facts": state["facts"] | (facts or {})})

    def drop(self, names: list[str]) -> int:
        """A version without these tables; older versions still hold them."""
        base = self.latest()
        state = self._state(base)
        return self._point(base + 1, state | {"tables": {n: p for n, p in state["tables"].items() if n not in names}})

    def _point(self, version: int, state: dict) -> int:
        fs, p = self._fs(f"{self.root}/manifests/{version}.json")
        try:
            stream = fs.create(p, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version} exists already") from e
            raise
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        return version

    def exists(self, name: str) -> bool:
        return name in self.manifest()

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some buckets of it."""
        pointer = self.manifest(version).get(name)
        if isinstance(pointer, dict):
            pointer = [f for k, f in pointer.items() if buckets is None or int(k) in buckets]
        if not pointer:
            return self.spark.createDataFrame([], schema.of(name))
        return self.spark.read.schema(schema.of(name)).parquet(*pointer) if isinstance(pointer, list) else self.spark.read.parquet(pointer)

    def rollback(self, version: int) -> None:
        """Forget the manifests after ``version``."""
        for v in self.versions():
            if v > version:
                fs, p = self._fs(f"{self.root}/manifests/{v}.json")
                fs.delete(p, False)

    def create_empty(self) -> int:
        """A version with every table that is not there yet, empty: no folder is needed for that."""
        base = self.latest()
        state = self._state(base)
        return self._point(base + 1, state | {"tables": {n: [] for n in schema.SOURCES | schema.DERIVED} | state["tables"]})
