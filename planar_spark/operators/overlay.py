"""Overlay of polygons through the noder: unions as geometry, over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TopoConfig
from ..kernel import planar, wkb
from ..store import stored as written
from . import noding
from .units import boxed, on_surface, relabelled, spatial_join, units


def outlines(polygons: DataFrame, cfg: TopoConfig) -> DataFrame:
    """Distinct (line_id, x1, y1, x2, y2): sides of the polygons' rings in grid numbers, the lesser end first; what is no readable polygon has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for data in b.column(0).to_pylist():
                try:
                    geometry, _ = wkb.decode(data)
                except (ValueError, TypeError):
                    continue
                sides = np.rint(planar.segments(planar.rings_of(geometry)) / cfg.tolerance) if "POLYGON" in geometry[0] else np.empty((0, 4))
                found.append(sides[np.isfinite(sides).all(axis=1)].astype(np.int64))
            sides = np.concatenate(found) if found else np.empty((0, 4), np.int64)
            turned = (sides[:, 0] > sides[:, 2]) | ((sides[:, 0] == sides[:, 2]) & (sides[:, 1] > sides[:, 3]))
            sides[turned] = sides[turned][:, [2, 3, 0, 1]]
            sides = sides[(sides[:, :2] != sides[:, 2:]).any(axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sides), np.int64)), *(pa.array(c) for c in sides.T)], names=noding.SEGMENT)

    return polygons.select("geometry").mapInArrow(run, "line_id long, x1 long, y1 long, x2 long, y2 long").distinct()


def union(polygons: DataFrame, keys: list[str], cfg: TopoConfig) -> DataFrame:
    """(keys, geometry, area): the union of the polygons of each group as a MultiPolygon, by ``keys``; nulls are a group too. A group in which nothing is a readable
    polygon has no geometry, and area 0.

    All outlines are noded together. A face of that graph belongs to the groups of the polygons that hold a point inside it, and what has such a face on one
    side only is the union's border. Points of the result are at most a few grid steps off, as crossings are moved to the grid.
    """
    if not keys:
        return union(polygons.withColumn("_all", F.lit(0)), ["_all"], cfg).drop("_all")
    groups = written(noding.numbered(polygons.select(*keys).distinct(), keys, "_group"), "union_groups")
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    shapes = written(boxed(polygons.alias("p").join(groups.alias("g"), same).select("_group", "p.geometry"), "_group long").where("box is not null"), "union_parts")
    edges, _ = noding.cut_pieces(outlines(shapes, cfg))
    edges, _ = noding.faced(edges)
    edges = written(edges, "union_edges")
    faces = edges.select(F.explode(F.array("left_face", "right_face")).alias("face_id")).where("face_id <> 0").distinct()
    cells = noding.polygons(edges, faces.select(F.lit(0).alias("map_layer"), "face_id", F.col("face_id").alias("comp"), F.lit(False).alias("is_open")), cfg)
    points = boxed(on_surface(cells.select(F.col("comp").alias("face_id"), "geometry"), "face_id long"), "face_id long")
    held = spatial_join(shapes, points, [], "intersects").select(F.col("_group").alias("comp"), F.col("b_face_id").alias("face_id")).distinct()
    # Both sides of every edge, as they run with their face on the left.
    way = lambda face, a, b, c, d: F.struct(F.col(face).alias("face_id"), F.col(a).alias("x"), F.col(b).alias("y"), F.col(c).alias("tx"), F.col(d).alias("ty"))
    sides = edges.select("edge_id", F.explode(F.array(way("left_face", "x1", "y1", "x2", "y2"), way("right_face", "x2", "y2", "x1", "y1"))).alias("s")).select("edge_id", "s.*")
    border = sides.join(held, "face_id").groupBy("comp", "edge_id").agg(F.count("*").alias("n"), F.first(F.struct("x", "y", "tx", "ty")).alias("s")).where("n = 1")
    made = noding.traced(border.select(F.lit(0).alias("map_layer"), "comp", "s.*"), cfg)
    return groups.join(made.select(F.col("comp").alias("_group"), "geometry", "area"), "_group", "left").select(*keys, "geometry", F.coalesce("area", F.lit(0.0)).alias("area"))


def changed_areas(old: DataFrame, new: DataFrame, cfg: TopoConfig) -> DataFrame:
    """(id, map_layer, geometry): of each polygon (id, map_layer, type, geometry) that came, went or changed, what it covered before or covers now."""
    columns = ["id", "map_layer", "type", "geometry"]
    both = old.select(*columns, F.lit(-1).alias("n")).union(new.select(*columns, F.lit(1).alias("n")))
    edited = both.groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0").drop("n")
    return union(written(edited, "edited_polygons"), ["id", "map_layer"], cfg).select("id", "map_layer", "geometry").where("geometry is not null")


def relabel(map_faces: DataFrame, old: DataFrame, new: DataFrame, cfg: TopoConfig) -> DataFrame:
    """``map_faces`` (map_layer, comp, unit_id, geometry) after an edit of the polygons from ``old`` to ``new``: those that meet what a changed polygon covered before
    or covers now, borders included, are labelled again by ``new``; the others keep their label."""
    map_faces = written(map_faces.select("map_layer", "comp", "unit_id", "geometry"), "labelled_faces")
    met = relabelled(map_faces, changed_areas(old, new, cfg)).select("map_layer", "comp").distinct()
    met = written(met, "met_faces")
    again = map_faces.join(met, ["map_layer", "comp"], "left_semi")
    named = units(again.select("map_layer", "comp", "geometry"), new).withColumnRenamed("unit_id", "_new")
    kept = map_faces.join(met, ["map_layer", "comp"], "left_anti").select("map_layer", "comp", "unit_id", "geometry")
    return kept.union(again.join(named, ["map_layer", "comp"], "left").select("map_layer", "comp", F.col("_new").alias("unit_id"), "geometry"))
