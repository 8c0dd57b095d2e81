"""Lines: which are pending, to which topology they belong, and what an edit means."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernel import planar, wkb


def topological(layers: DataFrame) -> DataFrame:
    return layers.where("topological").select(F.col("id").alias("_layer"))


def line_topology(rows: DataFrame, layers: DataFrame) -> DataFrame:
    """Adds ``topology``: the row's layer if that is topological, else null."""
    top = topological(layers)
    return rows.join(top, rows["map_layer"] == top["_layer"], "left").withColumnRenamed("_layer", "topology")


def pending(lines: DataFrame, layers: DataFrame) -> DataFrame:
    """Lines of topological layers with neither hash nor error: they wait to be noded."""
    waiting = lines.where("geometry_hash is null and topology_error is null")
    return waiting.join(topological(layers), waiting["map_layer"] == F.col("_layer"), "left_semi")


def measured(lines: DataFrame, keys: str = "id long") -> DataFrame:
    """``keys`` (a schema) and ``length``: of lines, or of the borders of areas; null where the geometry can't be read."""
    names = [k.strip().split()[0] for k in keys.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths: list[float | None] = []
            for data in b.column(len(names)).to_pylist():
                try:
                    lengths.append(planar.length(wkb.decode(data)[0]))
                except (ValueError, TypeError):
                    lengths.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lengths, pa.float64())], names=[*names, "length"])

    kinds = [F.col(k.strip().split()[0]).cast(k.strip().split()[1]) for k in keys.split(",")]
    return lines.select(*kinds, "geometry").mapInArrow(run, f"{keys}, length double")


def shortest(lines: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` shortest lines, of equal ones the least ids."""
    return measured(lines).where("length is not null").orderBy("length", "id").limit(n)


def with_errors(lines: DataFrame) -> DataFrame:
    return lines.where("topology_error is not null")


def without_errors(lines: DataFrame) -> DataFrame:
    """Forget errors, so that the lines are tried again."""
    return lines.withColumn("topology_error", F.lit(None).cast("string"))


def changed(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Lines whose geometry's hash is not the known one: only these are noded again."""
    hashed = lines.withColumn("geometry_hash", F.md5("geometry"))
    return hashed.join(known.select(F.col("line_id").alias("id"), "geometry_hash"), ["id", "geometry_hash"], "left_anti")


def classify(op: Column, had_topology: Column, layer_before: Column, layer_after: Column, geometry_changed: Column) -> Column:
    """What an edit of a line asks for; ``layer_*`` are null for layers that are not topological."""
    return (
        F.when(op == "DELETE", "mark_old")
        .when(layer_after.isNull() & layer_before.isNotNull(), "unlink_mark_old")
        .when(layer_after.isNull(), "unlink")
        .when((op == "INSERT") & had_topology, "mark_new")
        .when(geometry_changed, "rehash_mark_old")
        .when(layer_before.eqNullSafe(layer_after), "ignore")
        .otherwise("relink_mark_both")
    )
