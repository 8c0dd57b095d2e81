"""Labels: the polygon type that covers most of a face, of the polygons that the face contains."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernel import bulk, planar, wkb
from ..store import spread
from .faces import best_unit

BOX = "struct<xmin: double, ymin: double, xmax: double, ymax: double>"


def boxed(rows: DataFrame, keys: str) -> DataFrame:
    """Adds the bounding box of ``geometry``; unreadable geometries have none. ``keys`` is the schema of the columns before it."""
    names = [k.strip().split()[0] for k in keys.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            boxes, none = bulk.bounds(b.column(len(names)))
            box = pa.StructArray.from_arrays([pa.array(c) for c in boxes.T], names=["xmin", "ymin", "xmax", "ymax"], mask=pa.array(none))
            yield pa.RecordBatch.from_arrays([*b.columns, box], names=[*b.schema.names, "box"])

    return rows.select(*names, "geometry").mapInArrow(run, f"{keys}, geometry binary, box {BOX}")


def in_window(rows: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Rows, ``boxed``, whose boxes meet a window, borders included."""
    return rows.where((F.col("box.xmin") <= xmax) & (F.col("box.xmax") >= xmin) & (F.col("box.ymin") <= ymax) & (F.col("box.ymax") >= ymin))


LEVELS = range(-30, 41)  # of cells: powers of two
LEAST_MERGED = 20_000  # boxes on both sides from which their join is no broadcast; a few large boxes that meet everything would be one task's in a merge


def level_of(box: str, margin: float) -> Column:
    """The least level whose cells are as long as the box's longer side: there a box meets four cells at most."""
    side = F.greatest(F.col(f"{box}.xmax") - F.col(f"{box}.xmin"), F.col(f"{box}.ymax") - F.col(f"{box}.ymin")) + margin
    return F.when(side > 0, F.greatest(F.lit(LEVELS[0]), F.least(F.lit(LEVELS[-1]), F.ceil(F.log2(side))))).otherwise(LEVELS[0]).cast("int")


def box_join(a: DataFrame, b: DataFrame, on: list[str], margin: float = 0.0) -> DataFrame:
    """Pairs of rows of equal ``on`` whose boxes overlap or touch, a's column ``box`` and b's ``b_box``, up to ``margin`` apart.

    Cells form a pyramid. Each box stands in the cells of the level of its own size, and asks at every coarser level at which the other side has
    boxes; two boxes meet at the coarser of their levels, so a large box is never cut into small cells. A pair is kept in the cell of the overlap's lower left
    corner alone.
    """
    levels = lambda df, box: df.where(F.col(box).isNotNull()).groupBy(level_of(box, margin).alias("_l")).count()
    counts = {side: {r["_l"]: r["count"] for r in levels(df, box).collect()} for side, df, box in (("a", a, "box"), ("b", b, "b_box"))}  # 71 at most
    held = {side: sorted(n) for side, n in counts.items()}

    def cells(df: DataFrame, box: str, other: list[int]) -> DataFrame:
        df = df.where(F.col(box).isNotNull()).withColumn("_own", level_of(box, margin))
        wanted = F.array(*[F.lit(k) for k in other]) if other else F.array().cast("array<int>")
        df = df.withColumn("_l", F.explode(F.array_distinct(F.concat(F.array("_own"), F.filter(wanted, lambda k: k > F.col("_own"))))))
        size = F.pow(F.lit(2.0), "_l")
        span = lambda k: F.sequence(F.floor((F.col(f"{box}.{k}min") - margin / 2) / size), F.floor((F.col(f"{box}.{k}max") + margin / 2) / size))
        return df.withColumn("_cx", F.explode(span("x"))).withColumn("_cy", F.explode(span("y")))

    left, right = cells(a, "box", held["b"]), cells(b, "b_box", held["a"]).withColumnRenamed("_own", "_b_own")
    if min(sum(n.values()) for n in counts.values()) > LEAST_MERGED:
        right = right.hint("merge")  # Spark estimates geometries by the small file that they were made from, and would broadcast them
    pairs = left.join(right, [*on, "_l", "_cx", "_cy"]).where(F.col("_l") == F.greatest("_own", "_b_own"))
    low = lambda k: F.greatest(F.col(f"box.{k}min"), F.col(f"b_box.{k}min")) - margin / 2
    pairs = pairs.where((low("x") <= F.least("box.xmax", "b_box.xmax") + margin / 2) & (low("y") <= F.least("box.ymax", "b_box.ymax") + margin / 2))
    size = F.pow(F.lit(2.0), "_l")
    return pairs.where((F.floor(low("x") / size) == F.col("_cx")) & (F.floor(low("y") / size) == F.col("_cy"))).drop("_l", "_cx", "_cy", "_own", "_b_own")


def spatial_join(a: DataFrame, b: DataFrame, on: list[str], how: str = "contains") -> DataFrame:
    """Pairs of rows of equal ``on`` where a's geometry contains (or intersects) b's. Both are ``boxed``; columns of b get a prefix."""
    pairs = box_join(a, b.select(*[F.col(c).alias(c if c in on else f"b_{c}") for c in b.columns]), on)
    if how == "contains":
        pairs = pairs.where(reduce(Column.__and__, [F.col(f"box.{k}min") <= F.col(f"b_box.{k}min") for k in "xy"] + [F.col(f"box.{k}max") >= F.col(f"b_box.{k}max") for k in "xy"]))
    pairs = spread(pairs)
    at = pairs.columns.index("geometry"), pairs.columns.index("b_geometry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bulk.tested(batch.column(at[0]), batch.column(at[1]), how == "contains")))

    return pairs.mapInArrow(run, pairs.schema)


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id): geometries of ``a`` and ``b`` (id, geometry) that are the same set of points, however written. Their canonical forms are joined by hash, and compared."""

    def forms(rows: DataFrame, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [None if g is None else wkb.encode(planar.canonical(wkb.decode(g)[0])) for g in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=[name, "form"])

        return rows.select(F.col("id").cast("long"), "geometry").mapInArrow(run, f"{name} long, form binary").withColumn("h", F.md5("form"))

    return forms(a, "a_id").join(forms(b, "b_id"), ["h", "form"]).select("a_id", "b_id")


def on_surface(rows: DataFrame, keys: str) -> DataFrame:
    """``keys`` and a point inside each ``geometry``, as WKB."""
    names = [k.strip().split()[0] for k in keys.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = bulk.points_on_surface(b.column(len(names)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(data, pa.binary())], names=[*names, "geometry"])

    return rows.select(*names, "geometry").mapInArrow(run, f"{keys}, geometry binary")


def face_at(points: DataFrame, map_faces: DataFrame, layers: DataFrame) -> DataFrame:
    """(id, map_layer, comp): for each point (id, geometry) and layer the map face (map_layer, comp, geometry) that it lies in, or null: one row
    each. On a border the least ``comp`` of those beside it."""
    every = points.select(F.col("id").cast("long").alias("id"), "geometry").crossJoin(F.broadcast(layers))  # a dimension of a few layers
    hit = spatial_join(boxed(map_faces, "map_layer int, comp long"), boxed(every, "map_layer int, id long"), ["map_layer"], "intersects")
    hit = hit.groupBy(F.col("b_id").alias("id"), "map_layer").agg(F.min("comp").alias("comp"))
    return every.select("id", "map_layer").join(hit, ["id", "map_layer"], "left")


def relabelled(map_faces: DataFrame, edited: DataFrame) -> DataFrame:
    """(map_layer, comp, id): map faces that an edited polygon (id, map_layer, geometry) meets, borders included: their label is open again."""
    hit = spatial_join(boxed(map_faces, "map_layer int, comp long"), boxed(edited, "map_layer int, id long"), ["map_layer"], "intersects")
    return hit.select("map_layer", "comp", F.col("b_id").alias("id"))


def covered_areas(map_faces: DataFrame, polygons: DataFrame) -> DataFrame:
    """(map_layer, comp, unit_id, area): area of the union of each type's polygons that a map face contains."""
    inside = spatial_join(boxed(map_faces, "map_layer int, comp long"), boxed(polygons, "map_layer int, type string"), ["map_layer"])
    shapes = inside.groupBy("map_layer", "comp", F.col("b_type").alias("unit_id")).agg(F.collect_list("b_geometry").alias("shapes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            areas = bulk.union_areas(b.column(3))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(areas, pa.float64())], names=["map_layer", "comp", "unit_id", "area"])

    return spread(shapes).mapInArrow(run, "map_layer int, comp long, unit_id string, area double")


def units(map_faces: DataFrame, polygons: DataFrame) -> DataFrame:
    """(map_layer, comp, unit_id): ``map_faces`` (map_layer, comp, geometry), ``polygons`` (map_layer, type, geometry)."""
    return best_unit(covered_areas(map_faces, polygons), ["map_layer", "comp"])
