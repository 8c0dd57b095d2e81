"""Cut points for range-partitioned sweeps and merges."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_points(df: DataFrame, keys: list[str], ranges: int, per_range: int = 24) -> list[tuple]:
    """At most ``ranges - 1`` cut points from ``ranges * per_range`` rows: those least by a hash of their keys.

    The sample's size depends on the number of ranges only. It steers balance, never results.
    """
    rows = df.select(*keys).orderBy(F.xxhash64(*keys)).limit(ranges * per_range).collect()
    rows = sorted({tuple(r) for r in rows})
    step = max(1, len(rows) // ranges)
    return rows[step::step][: ranges - 1]


def range_of(cuts: list[tuple], key: tuple) -> int:
    return bisect_right(cuts, key)
