"""Units within units, and what the units on both sides of a contact share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import stored as written


def unit_tree(types: DataFrame) -> DataFrame:
    """(id, ancestors, n_levels): ancestors from the unit itself to its root. Units on a cycle are left out.

    The walk advances all units by one level at once, as long as any has a parent left: as many rounds as the tree is deep.
    """
    parent = types.select(F.col("id").alias("_id"), F.col("member_of").alias("_up"))
    now = types.select("id", F.array("id").alias("ancestors"), F.col("member_of").alias("up"))
    done = now.where("up is null").select("id", "ancestors")
    now = now.where("up is not null")
    while not now.isEmpty():
        now = now.join(parent, now["up"] == parent["_id"]).where(~F.expr("array_contains(ancestors, up)"))
        now = written(now.select("id", F.array_append("ancestors", F.col("up")).alias("ancestors"), F.col("_up").alias("up")), "unit_level")
        done = done.union(now.where("up is null").select("id", "ancestors"))
        now = now.where("up is not null")
    return done.withColumn("n_levels", F.size("ancestors"))


def shared_levels(a: Column, b: Column) -> Column:
    """Number of ancestors that two units share."""
    return F.size(F.array_intersect(a, b))


def subunits(tree: DataFrame) -> DataFrame:
    """(id, subunits): all units under each, itself included, sorted."""
    up = tree.select(F.explode("ancestors").alias("of"), F.col("id").alias("sub"))
    return up.groupBy(F.col("of").alias("id")).agg(F.sort_array(F.collect_set("sub")).alias("subunits"))


def contacts(relation: DataFrame, edges: DataFrame, face_type: DataFrame, tree: DataFrame) -> DataFrame:
    """(edge_id, map_layer, type, unit_1, unit_2, commonality, strength) of linked edges with faces of known layers on both sides."""
    side = face_type.select("face_id", F.col("map_layer"), "unit_id")
    left = side.select(F.col("face_id").alias("left_face"), "map_layer", F.col("unit_id").alias("unit_1"))
    right = side.select(F.col("face_id").alias("right_face"), "map_layer", F.col("unit_id").alias("unit_2"))
    rows = relation.select("edge_id", "map_layer", "type").join(edges.select("edge_id", "left_face", "right_face"), "edge_id")
    rows = rows.join(left, ["left_face", "map_layer"]).join(right, ["right_face", "map_layer"])
    one, two = tree.select(F.col("id").alias("unit_1"), F.col("ancestors").alias("_1")), tree.select(F.col("id").alias("unit_2"), F.col("ancestors").alias("_2"))
    rows = rows.join(one, "unit_1", "left").join(two, "unit_2", "left")
    common = F.coalesce(shared_levels(F.col("_1"), F.col("_2")), F.lit(0))
    return rows.select("edge_id", "map_layer", "type", "unit_1", "unit_2", common.alias("commonality"), ((2 - common) * 0.5).alias("strength"))
