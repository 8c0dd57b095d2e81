"""Views of the planar graph, and cleaning it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import stored as written
from .components import SMALL, components

SHIFT = 1 << 40  # separates layers in the ids of (layer, face) pairs


def nodes(edges: DataFrame) -> DataFrame:
    """(node_id, x, y) of the ends of edges, and their region where edges have one."""
    more = ["region"] if "region" in edges.columns else []
    one = lambda n, x, y: F.struct(F.col(n).alias("node_id"), F.col(x).alias("x"), F.col(y).alias("y"), *more)
    return edges.select(F.explode(F.array(one("start_node", "x1", "y1"), one("end_node", "x2", "y2"))).alias("n")).select("n.*").distinct()


def node_edge(edges: DataFrame) -> DataFrame:
    """(node_id, edges sorted, n_edges): an edge that begins and ends at a node counts twice."""
    ends = edges.select("edge_id", F.explode(F.array("start_node", "end_node")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.sort_array(F.collect_list("edge_id")).alias("edges"), F.count("*").alias("n_edges"))


def edge_face(edges: DataFrame) -> DataFrame:
    """(edge_id, face_id), distinct."""
    return edges.select("edge_id", F.explode(F.array("left_face", "right_face")).alias("face_id")).distinct()


def node_multiplicity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(node_edge(edges), "node_id").select(*nodes.columns, "n_edges")


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(node_edge(edges), "node_id", "left_anti")


def unused_edges(edges: DataFrame, line_edge: DataFrame) -> DataFrame:
    return edges.join(line_edge.select("edge_id").distinct(), "edge_id", "left_anti")


def without_unused_edges(edges: DataFrame, line_edge: DataFrame) -> DataFrame:
    """Edges in no line go, and the faces on their sides become one: the least id of each joined set stays."""
    names = merged_names(edges, line_edge)
    out = edges.join(line_edge.select("edge_id").distinct(), "edge_id", "left_semi")
    return renamed(renamed(out, names, "left_face"), names, "right_face")


def merged_names(edges: DataFrame, line_edge: DataFrame) -> DataFrame:
    """(node, component): the faces that become one when edges in no line go, and the least of them."""
    return components(unused_edges(edges, line_edge).select(F.col("left_face").alias("a"), F.col("right_face").alias("b")), "merged_faces", SMALL, near=True)


def renamed(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """``column`` by the name of its component, where it has one."""
    n = names.select(F.col("node").alias("_f"), F.col("component").alias("_c"))
    return rows.join(n, rows[column] == n["_f"], "left").withColumn(column, F.coalesce("_c", column)).drop("_f", "_c")


def cleaned(tables: dict[str, DataFrame], lines: DataFrame) -> dict[str, DataFrame]:
    """The clean-up as one step over ``edge``, ``line_edge``, ``edge_relation``, ``face``, ``map_face``, ``map_face_face``, ``face_type``, ``linework_topo`` and
    ``dirty_face``, as far as they are given.

    Relations of lines that are gone go first, then edges in no line, whose faces join, then nodes at no edge. Map faces over faces
    that joined go with their rows in ``face_type``, whose keys so stay unique; what is left of those faces is dirty in the layers that they had map
    faces in. Edges are straight pieces, so those that healing makes one keep their rows; ``edge_chain`` (edge_id, chain) names what each is part of.
    """
    held = lines.select(F.col("id").alias("line_id")).distinct()
    line_edge = written(tables["line_edge"].join(held, "line_id", "left_semi"), "held_edges")
    names = written(merged_names(tables["edge"], line_edge), "merged_names")
    edges = tables["edge"].join(line_edge.select("edge_id").distinct(), "edge_id", "left_semi")
    edges = written(renamed(renamed(edges, names, "left_face"), names, "right_face").select(*tables["edge"].columns), "held")
    out = {"edge": edges, "line_edge": line_edge.select(*tables["line_edge"].columns), "edge_chain": heal_chains(edges, line_edge)}
    if {"x1", "y1", "x2", "y2"} <= set(edges.columns):
        out["node"] = nodes(edges)
    if "edge_relation" in tables:
        out["edge_relation"] = tables["edge_relation"].join(held, "line_id", "left_semi").join(edges.select("edge_id"), "edge_id", "left_semi").select(*tables["edge_relation"].columns)
    if "linework_topo" in tables:
        out["linework_topo"] = tables["linework_topo"].join(held, "line_id", "left_semi").select(*tables["linework_topo"].columns)
    if "face" in tables:
        more = [F.min(c).alias(c) for c in tables["face"].columns if c not in ("face_id", "area")]
        joined = renamed(tables["face"], names, "face_id").groupBy("face_id").agg(F.sum("area").alias("area"), *more)
        out["face"] = joined.withColumn("area", F.when(F.col("face_id") == 0, 0.0).otherwise(F.col("area"))).select(*tables["face"].columns)
        if "region" in tables["face"].columns:
            out["face"] = out["face"].withColumn("region", F.when(F.col("face_id") == 0, F.lit(0)).otherwise(F.col("region")).cast("long"))
    if "map_face_face" in tables:
        members = tables["map_face_face"]
        joined = names.select(F.col("node").alias("face_id"), F.col("component").alias("into"))
        open_ = written(members.join(joined, "face_id"), "open_map_faces")
        gone = open_.select("map_face", "map_layer").distinct()
        out["map_face_face"] = members.join(gone, ["map_face", "map_layer"], "left_anti").select(*members.columns)
        if "face_type" in tables:
            out["face_type"] = tables["face_type"].join(gone, ["map_face", "map_layer"], "left_anti").select(*tables["face_type"].columns)
        if "map_face" in tables:
            out["map_face"] = tables["map_face"].join(gone.withColumnRenamed("map_face", "id"), ["id", "map_layer"], "left_anti").select(*tables["map_face"].columns)
        if "dirty_face" in tables:
            # A map face that went may cover faces that did not join: these are open too.
            left = renamed(members.join(gone, ["map_face", "map_layer"], "left_semi"), names, "face_id").where("face_id <> 0")
            out["dirty_face"] = tables["dirty_face"].unionByName(left.select(F.col("face_id").alias("id"), "map_layer")).distinct()
    return out


def other_face(face: Column, left: Column, right: Column) -> Column:
    """The face on the other side of an edge, or null if ``face`` is on neither."""
    return F.when(left == face, right).when(right == face, left)


def orphan_relations(line_edge: DataFrame, lines: DataFrame) -> DataFrame:
    return line_edge.join(lines.select(F.col("id").alias("line_id")).distinct(), "line_id", "left_anti")


def passable(edges: DataFrame, relation: DataFrame, layers: DataFrame, literal: bool = False) -> DataFrame:
    """(map_layer, edge_id, left_face, right_face) of edges that are no boundary in a layer.

    ``literal``: an edge that carries several layers passes in each of them by way of its other layers' rows.
    """
    if literal:
        linked = edges.join(relation.select("edge_id", F.col("map_layer").alias("_of")), "edge_id", "left")
        out = linked.crossJoin(F.broadcast(layers)).where(~F.col("_of").eqNullSafe(F.col("map_layer")))
        return out.select("map_layer", "edge_id", "left_face", "right_face").distinct()
    every = edges.crossJoin(F.broadcast(layers))  # a dimension of a few layers
    return every.join(relation.select("edge_id", "map_layer"), ["edge_id", "map_layer"], "left_anti").select("map_layer", "edge_id", "left_face", "right_face")


def adjacent(edges: DataFrame, relation: DataFrame, layers: DataFrame, literal: bool = False) -> DataFrame:
    """(map_layer, face_id, adjacent): both directions, distinct, without loops."""
    ways = passable(edges, relation, layers, literal).where("left_face <> right_face")
    pairs = F.array(F.struct(F.col("left_face").alias("face_id"), F.col("right_face").alias("adjacent")), F.struct(F.col("right_face").alias("face_id"), F.col("left_face").alias("adjacent")))
    return ways.select("map_layer", F.explode(pairs).alias("p")).select("map_layer", "p.*").distinct()


def dissolved(faces: DataFrame, edges: DataFrame, relation: DataFrame, layers: DataFrame, literal: bool = False) -> DataFrame:
    """(map_layer, face_id, comp, is_open): faces joined across passable edges, per layer; comp is the least face.

    Face 0, the outside, joins nothing: it only marks as open the components that it touches.
    """
    near = adjacent(edges, relation, layers, literal)
    inner = near.where("face_id > adjacent and adjacent <> 0")
    found = components(inner.select((F.col("map_layer") * SHIFT + F.col("face_id")).alias("a"), (F.col("map_layer") * SHIFT + F.col("adjacent")).alias("b")), "dissolved", SMALL, near=True)
    found = found.select(F.floor(F.col("node") / SHIFT).cast("int").alias("map_layer"), (F.col("node") % SHIFT).alias("face_id"), (F.col("component") % SHIFT).alias("comp"))
    every = faces.where("face_id <> 0").select("face_id").crossJoin(F.broadcast(layers))
    every = every.join(found, ["map_layer", "face_id"], "left").withColumn("comp", F.coalesce("comp", "face_id"))
    outside = near.where("adjacent = 0").select("map_layer", "face_id").distinct().withColumn("touches", F.lit(True))
    every = every.join(outside, ["map_layer", "face_id"], "left")
    is_open = every.groupBy("map_layer", "comp").agg(F.max(F.coalesce("touches", F.lit(False))).alias("is_open"))
    return every.select("map_layer", "face_id", "comp").join(is_open, ["map_layer", "comp"]).select("map_layer", "face_id", "comp", "is_open")


def heal_candidates(edges: DataFrame, line_edge: DataFrame, literal: bool = False) -> DataFrame:
    """(node_id, edge_1, edge_2): nodes where two edges of the same lines meet and nothing else does.

    ``literal`` asks for nodes with two line references and fewer than two at once, which is never true.
    """
    star = node_edge(edges).where("n_edges = 2").select("node_id", F.col("edges")[0].alias("edge_1"), F.col("edges")[1].alias("edge_2"))
    lines = line_edge.groupBy("edge_id").agg(F.sort_array(F.collect_set("line_id")).alias("lines"))
    one, two = lines.select(F.col("edge_id").alias("edge_1"), F.col("lines").alias("lines_1")), lines.select(F.col("edge_id").alias("edge_2"), F.col("lines").alias("lines_2"))
    met = star.where("edge_1 <> edge_2").join(one, "edge_1").join(two, "edge_2")
    if literal:
        met = met.where(F.size(F.array("edge_1", "edge_2")) < 2)
    return met.where("lines_1 = lines_2").select("node_id", "edge_1", "edge_2")


def heal_chains(edges: DataFrame, line_edge: DataFrame) -> DataFrame:
    """(edge_id, chain): edges that healing makes one; chain is the least edge of each."""
    pairs = heal_candidates(edges, line_edge).select(F.col("edge_1").alias("a"), F.col("edge_2").alias("b"))
    found = components(pairs, "chains", SMALL, near=True)
    return edges.select("edge_id").join(found, edges["edge_id"] == found["node"], "left").select("edge_id", F.coalesce("component", "edge_id").alias("chain"))
