"""Map faces: registering, labelling, dirty sets, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dml import last_wins, upsert


def surrounding(line_edge: DataFrame, edges: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, map_layer): the faces beside the edges of lines with a topology, as dirty rows."""
    touched = lines.where("topology is not null").select(F.col("id").alias("line_id"), F.col("topology").alias("map_layer"))
    sides = line_edge.join(touched, "line_id").join(edges.select("edge_id", "left_face", "right_face"), "edge_id")
    return sides.select(F.explode(F.array("left_face", "right_face")).alias("id"), "map_layer").distinct()


def link_edges(line_edge: DataFrame, lines: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """(edge_id, map_layer, line_id, type) of topological lines; of several lines of a layer on one edge the largest id is shown."""
    named = lines.where("topology is not null").select(F.col("id").alias("line_id"), F.col("topology").alias("map_layer"), "type")
    new = last_wins(line_edge.join(named, "line_id").select("edge_id", "map_layer", "line_id", "type"), ["edge_id", "map_layer"], ["line_id"])
    return new if old is None else upsert(old, new, ["edge_id", "map_layer"])


def register(map_faces: DataFrame, members: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """face_type rows (face_id, map_face, map_layer, unit_id); of several map faces over one face the largest id is shown."""
    rows = members.join(map_faces.select(F.col("id").alias("map_face"), "map_layer", "unit_id"), ["map_face", "map_layer"])
    new = last_wins(rows.select("face_id", "map_face", "map_layer", "unit_id"), ["face_id", "map_layer"], ["map_face"])
    return new if old is None else upsert(old, new, ["face_id", "map_layer"])


def containing(map_faces: DataFrame, members: DataFrame, asked: DataFrame) -> DataFrame:
    """The map faces, with their columns, over each of ``asked`` (face_id, map_layer); faces that none covers have no row."""
    over = asked.select("face_id", "map_layer").join(members, ["face_id", "map_layer"])
    return over.join(map_faces.withColumnRenamed("id", "map_face"), ["map_face", "map_layer"])


def edge_units(edges: DataFrame, face_type: DataFrame) -> DataFrame:
    """(edge_id, map_layer, units): the units on the sides of an edge, sorted; sides without one are left out."""
    side = edges.select("edge_id", F.explode(F.array_distinct(F.array("left_face", "right_face"))).alias("face_id"))
    named = side.join(face_type.where("unit_id is not null").select("face_id", "map_layer", "unit_id"), "face_id")
    return named.groupBy("edge_id", "map_layer").agg(F.sort_array(F.collect_list("unit_id")).alias("units"))  # two at most for each layer's cover


def contact_units(units_of: DataFrame, relation: DataFrame, kind: str) -> DataFrame:
    """Lines of type ``kind`` along edges with a unit on both sides: (edge_id, map_layer, line_id, type, units)."""
    lines = relation.where(F.col("type") == kind).select("edge_id", "map_layer", "line_id", "type")
    return units_of.where(F.size("units") > 1).join(lines, ["edge_id", "map_layer"])


def mapped_faces(map_faces: DataFrame, types: DataFrame, without: str = "surficial-none") -> DataFrame:
    """Labelled map faces with their type's colour, those of the type ``without`` left out."""
    t = types.select(F.col("id").alias("unit_id"), "color")
    return map_faces.where(F.col("unit_id") != without).join(t, "unit_id")


def covered_twice(members: DataFrame) -> DataFrame:
    """(face_id, map_layer, covers, n): faces that several map faces of one layer cover."""
    rows = members.groupBy("face_id", "map_layer").agg(F.sort_array(F.collect_list("map_face")).alias("covers"), F.count("*").alias("n"))
    return rows.where("n > 1")


def unlinked(members: DataFrame, edges: DataFrame, relation: DataFrame) -> DataFrame:
    """(map_face, map_layer) of map faces with a boundary edge that is not linked in their own layer."""
    side = edges.select("edge_id", F.explode(F.array("left_face", "right_face")).alias("face_id"))
    cover = side.join(members, "face_id").groupBy("edge_id", "map_face", "map_layer").agg(F.count("*").alias("sides"))
    return cover.where("sides = 1").join(relation.select("edge_id", "map_layer"), ["edge_id", "map_layer"], "left_anti").select("map_face", "map_layer").distinct()


def holes(faces: DataFrame, layers: DataFrame, face_type: DataFrame) -> DataFrame:
    """(id, map_layer): faces without a registered type in a topological layer."""
    every = faces.where("face_id <> 0").select("face_id").crossJoin(F.broadcast(layers))
    return every.join(face_type.select("face_id", "map_layer"), ["face_id", "map_layer"], "left_anti").select(F.col("face_id").alias("id"), "map_layer")


def all_dirty(faces: DataFrame, layers: DataFrame) -> DataFrame:
    return faces.where("face_id <> 0").select(F.col("face_id").alias("id")).crossJoin(F.broadcast(layers))


def best_unit(candidates: DataFrame, keys: list[str], unit: str = "unit_id", area: str = "area") -> DataFrame:
    """The unit of the greatest area for each key; of equal areas the least unit."""
    ranked = candidates.groupBy(*keys).agg(F.min(F.struct((-F.col(area)).alias("_a"), F.col(unit).alias("_u"))).alias("_b"))
    return ranked.select(*keys, F.col("_b._u").alias(unit))


def difference(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """One payload row: envelope of what went and came, and how many rows did. Boxes are xmin, ymin, xmax, ymax columns."""
    gone = old.join(new.select(*key), key, "left_anti").withColumn("_gone", F.lit(1))
    came = new.join(old.select(*key), key, "left_anti").withColumn("_gone", F.lit(0))
    box = ["xmin", "ymin", "xmax", "ymax"]
    both = gone.select(*box, "_gone").unionByName(came.select(*box, "_gone"))
    counts = both.agg(
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
        F.coalesce(F.sum("_gone"), F.lit(0)).cast("long").alias("n_deleted"), F.coalesce(F.sum(1 - F.col("_gone")), F.lit(0)).cast("long").alias("n_created"),
    )
    return counts.crossJoin(new.agg(F.count("*").alias("n_faces")))


def payload(counts: DataFrame, table: str) -> DataFrame:
    """The notification of a difference as JSON, its envelope as GeoJSON."""
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("xmin", "ymin"), ("xmin", "ymax"), ("xmax", "ymax"), ("xmax", "ymin"), ("xmin", "ymin"))])
    envelope = F.when(F.col("xmin").isNotNull(), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    return counts.select(F.to_json(F.struct(F.lit(table).alias("table"), envelope.alias("envelope"), "n_deleted", "n_created", "n_faces")).alias("payload"))


def face_display(map_faces: DataFrame, types: DataFrame, layers: DataFrame) -> DataFrame:
    """Map faces of topological layers with their type's name and colour."""
    t = types.select(F.col("id").alias("_t"), "color", F.col("name").alias("name"))
    l = layers.where("topological").select(F.col("id").alias("_l"))  # noqa: E741
    return map_faces.join(t, map_faces["unit_id"] == t["_t"], "left").join(F.broadcast(l), map_faces["map_layer"] == l["_l"], "left_semi").drop("_t")
