"""Topological inputs on an integer lattice, derived from the shared tables; each with the SQL of the same relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

WIDTH = 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layers(spark: SparkSession) -> DataFrame:
    rows = [(0, "Default", None, True), (1, "surficial", None, True), (2, "bedrock", None, True), (3, "other", None, False)]
    return spark.createDataFrame(rows, "id int, name string, parent int, topological boolean")


def two_layers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1,), (2,)], "map_layer int")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines by order: layer, type, and the state of their topology."""
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(
        k.alias("id"), (k % 4).cast("int").alias("map_layer"), F.col("o_orderpriority").alias("type"),
        F.when(k % 5 != 0, F.md5(k.cast("string"))).alias("geometry_hash"), F.when(k % 25 == 0, F.lit("bad geometry")).alias("topology_error"),
        (k % 97).alias("x1"), (F.floor(k / 97) % 89).alias("y1"), (1 + k % 11).alias("length"),
    )


def line_shapes(spark: SparkSession, d: str, longer: int = 0) -> DataFrame:
    """The lines as geometries, read from their text: (id, geometry). ``longer`` is added to the length of every third."""
    n = F.col("length") + F.when(F.col("id") % 3 == 0, longer).otherwise(0)
    rows = lines(spark, d).select("id", F.format_string("LINESTRING(%1$d %2$d,%3$d %2$d)", "x1", "y1", F.col("x1") + n).alias("wkt"))
    return files.parse_geometry(rows, "wkt").select("id", "geometry")


def cells(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return read(spark, d, "part").select(
        p.alias("p"), F.col("p_size").alias("t"), (p + 1).alias("face_id"), (p % WIDTH).alias("cx"), F.floor(p / WIDTH).alias("cy"), F.col("p_brand").alias("brand")
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the lattice: right and upper side of every cell, left and lower side of the outer ones."""
    c = cells(spark, d)
    n = c.agg(F.count("*").alias("n"))
    node = lambda x, y: x + y * (WIDTH + 1) + 1
    x, y, p = F.col("cx"), F.col("cy"), F.col("p")
    s = lambda direction, right, a, b: F.struct(F.lit(direction).alias("dir"), right.cast("long").alias("right_face"), a.cast("long").alias("start_node"), b.cast("long").alias("end_node"))
    sides = F.array(
        s(0, F.when(x < WIDTH - 1, p + 2).otherwise(0), node(x + 1, y), node(x + 1, y + 1)),
        s(1, F.when(p + WIDTH < F.col("n"), p + WIDTH + 1).otherwise(0), node(x + 1, y + 1), node(x, y + 1)),
        s(2, F.when(x == 0, 0).otherwise(-1), node(x, y + 1), node(x, y)),
        s(3, F.when(y == 0, 0).otherwise(-1), node(x, y), node(x + 1, y)),
    )
    rows = c.crossJoin(F.broadcast(n)).select("p", "t", F.col("face_id").alias("left_face"), F.explode(sides).alias("e")).select("p", "t", "left_face", "e.*").where("right_face >= 0")
    return rows.withColumn("edge_id", F.col("p") * 4 + F.col("dir")).hint("merge")  # Spark estimates the rows by the small file that they come from, and would broadcast them


def placed_edges(spark: SparkSession, d: str) -> DataFrame:
    """The lattice's edges with the coordinates of their ends."""
    at = lambda node: ((F.col(node) - 1) % (WIDTH + 1), F.floor((F.col(node) - 1) / (WIDTH + 1)))
    (x1, y1), (x2, y2) = at("start_node"), at("end_node")
    return edges(spark, d).select("edge_id", "start_node", "end_node", "left_face", "right_face", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def wall_lines(spark: SparkSession, d: str) -> DataFrame:
    """Walls as lines: (id, map_layer, type, geometry), read from their text."""
    rows = walls(spark, d).join(placed_edges(spark, d), "edge_id")
    text = F.format_string("LINESTRING(%d %d,%d %d)", "x1", "y1", "x2", "y2")
    rows = rows.select((F.col("edge_id") * 4 + F.col("map_layer")).alias("id"), "map_layer", "type", text.alias("wkt"))
    return files.parse_geometry(rows, "wkt").select("id", "map_layer", "type", "geometry")


def walls(spark: SparkSession, d: str, closed: bool = True) -> DataFrame:
    """(edge_id, map_layer, line_id, type): which edges are boundaries in layers 1 and 2. ``closed``: all outer edges are."""
    e = edges(spark, d).crossJoin(F.broadcast(two_layers(spark)))
    up = (F.col("p") * 31 + F.col("t") * 17 + F.col("dir") * 11 + F.col("map_layer") * 7) % 10 < 7
    rows = e.where(up | (F.col("right_face") == 0)) if closed else e.where(up)
    return rows.select("edge_id", "map_layer", (F.floor(F.col("p") / 3) * 10 + F.col("map_layer")).alias("line_id"), F.concat(F.lit("type-"), F.col("p") % 5).alias("type")).hint("merge")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Identifying polygons: boxes of whole cells, (id, x, y, w, h, type, map_layer)."""
    p, t = F.col("p_partkey"), F.col("p_size")
    return read(spark, d, "part").select(
        p.alias("id"), (p % WIDTH).alias("x"), F.floor(p / WIDTH).alias("y"), (1 + t % 3).alias("w"), (1 + p % 2).alias("h"), F.col("p_brand").alias("type"), (1 + p % 2).cast("int").alias("map_layer")
    )


def box_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The boxes as polygons: (id, map_layer, type, geometry), read from their text."""
    x, y = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    rows = boxes(spark, d).select("id", "map_layer", "type", "x", "y", x.alias("u"), y.alias("v"))
    rows = rows.withColumn("wkt", F.format_string("POLYGON((%1$d %2$d,%3$d %2$d,%3$d %4$d,%1$d %4$d,%1$d %2$d))", "x", "y", "u", "v"))
    return files.parse_geometry(rows.select("id", "map_layer", "type", "wkt"), "wkt").select("id", "map_layer", "type", "geometry")


def types(spark: SparkSession, d: str) -> DataFrame:
    """Polygon types: brands, and the makers that they belong to."""
    brands = read(spark, d, "part").select(F.col("p_brand").alias("id")).distinct()
    brands = brands.select("id", F.concat(F.lit("unit "), "id").alias("name"), F.concat(F.lit("#"), F.substring(F.md5("id"), 1, 6)).alias("color"), F.concat(F.lit("maker-"), F.ascii(F.substring("id", -1, 1)) % 3).alias("member_of"))
    makers = brands.select(F.col("member_of").alias("id")).distinct()
    makers = makers.select("id", F.concat(F.lit("unit "), "id").alias("name"), F.lit(None).cast("string").alias("color"), F.lit("root").alias("member_of"))
    root = brands.limit(1).select(F.lit("root").alias("id"), F.lit("unit root").alias("name"), F.lit(None).cast("string").alias("color"), F.lit(None).cast("string").alias("member_of"))
    return brands.unionByName(makers).unionByName(root)


def edits(spark: SparkSession, d: str) -> DataFrame:
    """An edit log of lines by event: (seq, id, op, layer_before, layer_after, geometry_changed)."""
    e = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.col("event_type").alias("kind"))
    kind = F.col("kind")
    op = F.when(kind == "signup", "INSERT").when(kind == "error", "DELETE").otherwise("UPDATE")
    top = lambda v: F.when(v < 3, v).cast("int")
    return e.select(
        "seq", "id", op.alias("op"), top(F.col("id") % 4).alias("layer_before"),
        F.when(kind == "purchase", top(F.col("seq") % 4)).otherwise(top(F.col("id") % 4)).alias("layer_after"), kind.isin("click", "view").alias("geometry_changed"),
    )


SQL = {
    "layers": "layers(id, name, topological) AS (VALUES (0, 'Default', true), (1, 'surficial', true), (2, 'bedrock', true), (3, 'other', false))",
    "two": "two(map_layer) AS (VALUES (1), (2))",
    "lines": """lines AS (SELECT o_orderkey AS id, (o_orderkey % 4)::INT AS map_layer, o_orderpriority AS type,
  CASE WHEN o_orderkey % 5 <> 0 THEN md5(o_orderkey::VARCHAR) END AS geometry_hash, CASE WHEN o_orderkey % 25 = 0 THEN 'bad geometry' END AS topology_error,
  o_orderkey % 97 AS x1, (o_orderkey // 97) % 89 AS y1, 1 + o_orderkey % 11 AS length FROM orders)""",
    "cells": "cells AS (SELECT p_partkey AS p, p_size AS t, p_partkey + 1 AS face_id, p_partkey % 20 AS cx, p_partkey // 20 AS cy, p_brand AS brand FROM part)",
    "edges": """edges AS (
  SELECT p * 4 + dir AS edge_id, p, t, dir, left_face, right_face, start_node, end_node FROM (
    SELECT p, t, 0 AS dir, face_id AS left_face, CASE WHEN cx < 19 THEN p + 2 ELSE 0 END AS right_face, (cx + 1) + cy * 21 + 1 AS start_node, (cx + 1) + (cy + 1) * 21 + 1 AS end_node FROM cells
    UNION ALL SELECT p, t, 1, face_id, CASE WHEN p + 20 < (SELECT count(*) FROM cells) THEN p + 21 ELSE 0 END, (cx + 1) + (cy + 1) * 21 + 1, cx + (cy + 1) * 21 + 1 FROM cells
    UNION ALL SELECT p, t, 2, face_id, 0, cx + (cy + 1) * 21 + 1, cx + cy * 21 + 1 FROM cells WHERE cx = 0
    UNION ALL SELECT p, t, 3, face_id, 0, cx + cy * 21 + 1, (cx + 1) + cy * 21 + 1 FROM cells WHERE cy = 0))""",
    "walls": """walls AS (SELECT edge_id, map_layer, (p // 3) * 10 + map_layer AS line_id, 'type-' || (p % 5) AS type FROM edges CROSS JOIN two
  WHERE (p * 31 + t * 17 + dir * 11 + map_layer * 7) % 10 < 7 OR right_face = 0)""",
    "open_walls": """walls AS (SELECT edge_id, map_layer, (p // 3) * 10 + map_layer AS line_id, 'type-' || (p % 5) AS type FROM edges CROSS JOIN two
  WHERE (p * 31 + t * 17 + dir * 11 + map_layer * 7) % 10 < 7)""",
    "boxes": "boxes AS (SELECT p_partkey AS id, p_partkey % 20 AS x, p_partkey // 20 AS y, 1 + p_size % 3 AS w, 1 + p_partkey % 2 AS h, p_brand AS type, (1 + p_partkey % 2)::INT AS map_layer FROM part)",
    "types": """brands AS (SELECT DISTINCT p_brand AS id, 'maker-' || (ascii(right(p_brand, 1)) % 3) AS member_of FROM part),
types AS (SELECT id, 'unit ' || id AS name, '#' || left(md5(id), 6) AS color, member_of FROM brands
  UNION ALL SELECT DISTINCT member_of, 'unit ' || member_of, NULL, 'root' FROM brands UNION ALL SELECT 'root', 'unit root', NULL, NULL)""",
    "edits": """edits AS (SELECT event_id AS seq, user_id AS id, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op,
  CASE WHEN user_id % 4 < 3 THEN (user_id % 4)::INT END AS layer_before,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 4 < 3 THEN (event_id % 4)::INT END ELSE CASE WHEN user_id % 4 < 3 THEN (user_id % 4)::INT END END AS layer_after,
  event_type IN ('click', 'view') AS geometry_changed FROM events)""",
    # Dissolving: closure with set semantics, labelled by the least face. Face 0 is reached but not passed through.
    "reach": """near AS (SELECT DISTINCT map_layer, a, b FROM (
    SELECT map_layer, left_face AS a, right_face AS b FROM edges CROSS JOIN two ANTI JOIN walls USING (edge_id, map_layer)
    UNION ALL SELECT map_layer, right_face, left_face FROM edges CROSS JOIN two ANTI JOIN walls USING (edge_id, map_layer)) WHERE a <> b),
reach(map_layer, a, b) AS (
    SELECT map_layer, face_id, face_id FROM cells CROSS JOIN two
    UNION SELECT r.map_layer, r.a, n.b FROM reach r JOIN near n ON n.map_layer = r.map_layer AND n.a = r.b WHERE r.b <> 0),
comps AS (SELECT map_layer, a AS face_id, min(b) FILTER (b <> 0) AS comp, bool_or(b = 0) AS is_open FROM reach GROUP BY ALL)""",
}


def with_ctes(names: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body
