"""Shared plumbing: columns, the shared scratch folder, written tables, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..store import discard, scratch_path, shared_dir, written

__all__ = ["components", "discard", "scratch_path", "shared_dir", "written"]

# The white space and word patterns of the result contracts.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, so that any store works."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


CACHES: list[dict] = []


def claim(own: dict | None = None) -> None:
    """At the start of a Python task: forget what other operators' tasks cached in this worker, so that one cache at most is held."""
    held = [cache for cache in CACHES if cache is not own and cache]
    for cache in held:
        cache.clear()
    if held:
        give_back()


def give_back() -> None:
    """Return what Arrow and the C library keep of freed memory (70 MB a worker after n-gram joins) while the idle worker waits for its next task."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)


Batches = Iterator[pa.RecordBatch]


def alone(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` as a Python task that starts without other operators' caches and gives unused memory back at its end."""

    def task(batches: Batches) -> Batches:
        claim()
        yield from run(batches)
        give_back()

    return task


#: Bits of the largest bitmap that spares rows a shuffle (16 MB).
BITMAP = 1 << 27


def flags(rows: DataFrame, key: str) -> np.ndarray:
    """A bitmap in which the bit of every ``key`` is set, folded until one bit in 32 is, but of at most ``BITMAP`` bits whatever the
    input. It only spares rows a shuffle; an exact join follows. Beyond some tens of millions of keys it spares little."""
    bit = F.pmod(F.col(key), F.lit(BITMAP))
    words = rows.select(F.floor(bit / 64).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod(`{key}`, {BITMAP}), 64) as int))").alias("v"))
    got = words.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(BITMAP // 64, np.uint64)
    out[got.column("w").to_numpy()] = got.column("v").to_numpy().view(np.uint64)
    least = 32 * int(np.bitwise_count(out).sum())
    while 32 * len(out) >= max(least, 1 << 16):
        out = out[: len(out) // 2] | out[len(out) // 2 :]
    return out


def flagged(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = np.mod(keys, 64 * len(bitmap)).astype(np.uint64)
    return (bitmap[bit // np.uint64(64)] >> (bit % np.uint64(64))) & np.uint64(1) > 0
