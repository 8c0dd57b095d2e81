"""Registered queries: one or more per operator, over lattice inputs, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TopoConfig
from ..functions import colors, tiles
from ..kernel import generalise, wkb
from ..operators import chains, dml, faces, graph, hierarchy, linework, noding, overlay, units, vector_tiles
from ..operators.components import SMALL, components
from ..sources import files
from ..store import scratch_path, stored as written
from . import inputs as I  # noqa: E741
from .inputs import with_ctes
from .solve import TopoSession, solve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(ctes: str | None = None, sql: str | None = None):
    """Register the function under its name, with SQL over the named input relations."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_ctes(ctes, sql) if ctes else sql
        return f

    return add


# Lines.


@query("layers lines", "SELECT count(*)::INT AS n FROM lines JOIN layers l ON l.id = map_layer WHERE topological AND geometry_hash IS NULL AND topology_error IS NULL")
def count_contacts(spark, d):
    return linework.pending(I.lines(spark, d), I.layers(spark)).agg(F.count("*").cast("int").alias("n"))


@query("layers lines", "SELECT lines.id FROM lines JOIN layers l ON l.id = map_layer WHERE topological AND geometry_hash IS NULL AND topology_error IS NULL")
def pending_contacts(spark, d):
    return linework.pending(I.lines(spark, d), I.layers(spark)).select("id")


@query("lines", "SELECT id, topology_error FROM lines WHERE topology_error IS NOT NULL")
def contact_errors(spark, d):
    return linework.with_errors(I.lines(spark, d)).select("id", "topology_error")


@query("lines", "SELECT id, geometry_hash, NULL::VARCHAR AS topology_error FROM lines")
def reset_errors(spark, d):
    return linework.without_errors(I.lines(spark, d)).select("id", "geometry_hash", "topology_error")


@query("layers lines", "SELECT lines.id, map_layer, CASE WHEN topological THEN map_layer END AS topology FROM lines LEFT JOIN layers l ON l.id = map_layer")
def line_topology(spark, d):
    return linework.line_topology(I.lines(spark, d), I.layers(spark)).select("id", "map_layer", "topology")


@query("lines", "SELECT id, length::DOUBLE AS length FROM lines ORDER BY length, id LIMIT 10")
def line_length_topk(spark, d):
    """The shortest batch of lines, as measured from their geometry."""
    return linework.shortest(I.line_shapes(spark, d), 10)


@query("lines", "SELECT id, count(*) OVER (PARTITION BY x1, y1, length) AS n_same FROM lines")
def geometry_hash(spark, d):
    """With how many lines each shares its geometry, by the hashes of the geometries."""
    rows = I.line_shapes(spark, d).select("id", F.md5("geometry").alias("h"))
    return rows.join(rows.groupBy("h").agg(F.count("*").alias("n_same")), "h").select("id", "n_same")


@query("lines", "SELECT id FROM lines WHERE id % 3 = 0")
def changed_lines(spark, d):
    """Lines whose geometry is not the one that was noded: every third has grown since."""
    known = I.line_shapes(spark, d).select(F.col("id").alias("line_id"), F.md5("geometry").alias("geometry_hash"))
    return linework.changed(I.line_shapes(spark, d, longer=1), known).select("id")


@query("lines", "SELECT id, x1::DOUBLE AS xmin, y1::DOUBLE AS ymin, (x1 + length)::DOUBLE AS xmax, y1::DOUBLE AS ymax FROM lines WHERE x1 <= 40 AND x1 + length >= 30 AND y1 BETWEEN 10 AND 25")
def bbox_filter(spark, d):
    return units.in_window(units.boxed(I.line_shapes(spark, d), "id long"), 30, 10, 40, 25).select("id", "box.*")


# The planar graph.


@query("cells edges", """SELECT node_id, string_agg(edge_id, ',' ORDER BY edge_id) AS edges, count(*) AS n_edges
FROM (SELECT edge_id, start_node AS node_id FROM edges UNION ALL SELECT edge_id, end_node FROM edges) GROUP BY node_id""")
def node_edge(spark, d):
    rows = graph.node_edge(I.edges(spark, d))
    return rows.withColumn("edges", F.array_join(F.transform("edges", lambda x: x.cast("string")), ","))


@query("cells edges", "SELECT DISTINCT edge_id, face_id FROM (SELECT edge_id, left_face AS face_id FROM edges UNION ALL SELECT edge_id, right_face FROM edges)")
def edge_face(spark, d):
    return graph.edge_face(I.edges(spark, d))


def _nodes(spark, d):
    top = I.cells(spark, d).agg(F.max("cy").alias("top"))
    return top.select(F.explode(F.sequence(F.lit(1).cast("long"), 2 * (21 * (F.col("top") + 2)))).alias("node_id"))


NODES = ", nodes AS (SELECT unnest(range(1, 2 * (21 * ((SELECT max(cy) FROM cells) + 2)) + 1)) AS node_id), ne AS (SELECT node_id, count(*) AS n_edges FROM (SELECT start_node AS node_id FROM edges UNION ALL SELECT end_node FROM edges) GROUP BY ALL)\n"


@query("cells edges", NODES + "SELECT node_id, n_edges FROM nodes JOIN ne USING (node_id)")
def node_multiplicity(spark, d):
    return graph.node_multiplicity(_nodes(spark, d), I.edges(spark, d))


@query("cells edges", NODES + "SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT node_id FROM ne)")
def isolated_nodes(spark, d):
    return graph.isolated_nodes(_nodes(spark, d), I.edges(spark, d))


@query("two cells edges walls", "SELECT edge_id, left_face, right_face FROM edges WHERE edge_id NOT IN (SELECT edge_id FROM walls WHERE map_layer = 1)")
def edges_to_delete(spark, d):
    return graph.unused_edges(I.edges(spark, d), I.walls(spark, d).where("map_layer = 1")).select("edge_id", "left_face", "right_face")


@query("two cells edges walls", """, one AS (SELECT edge_id FROM walls WHERE map_layer = 1), near AS (SELECT left_face AS a, right_face AS b FROM edges ANTI JOIN one USING (edge_id) UNION SELECT right_face, left_face FROM edges ANTI JOIN one USING (edge_id)),
reach(a, b) AS (SELECT face_id, face_id FROM cells UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
name AS (SELECT a, min(b) AS m FROM reach GROUP BY a UNION ALL SELECT 0, 0)
SELECT edge_id, l.m AS left_face, r.m AS right_face FROM edges JOIN name l ON l.a = left_face JOIN name r ON r.a = right_face WHERE edge_id IN (SELECT edge_id FROM one)""")
def merged_faces(spark, d):
    """Edges after those in no line are removed and the faces beside them joined."""
    return graph.without_unused_edges(I.edges(spark, d), I.walls(spark, d).where("map_layer = 1")).select("edge_id", "left_face", "right_face")


@query("two cells edges walls", "SELECT line_id, edge_id FROM walls WHERE line_id // 10 NOT IN (SELECT p FROM cells WHERE t < 25)")
def orphan_relations(spark, d):
    held = I.cells(spark, d).where("t < 25").crossJoin(F.broadcast(I.two_layers(spark))).select((F.col("p") * 10 + F.col("map_layer")).alias("id"))
    return graph.orphan_relations(I.walls(spark, d).select("line_id", "edge_id"), held)


HEAL = """, le AS (SELECT edge_id, list_sort(list_distinct(list(line_id))) AS lines FROM walls GROUP BY edge_id),
star AS (SELECT node_id, min(edge_id) AS edge_1, max(edge_id) AS edge_2 FROM (SELECT edge_id, start_node AS node_id FROM used UNION ALL SELECT edge_id, end_node FROM used) GROUP BY node_id HAVING count(*) = 2)
"""
USED = ", used AS (SELECT * FROM edges WHERE edge_id IN (SELECT edge_id FROM walls WHERE map_layer = 1))"


def _used(spark, d):
    return I.edges(spark, d).join(I.walls(spark, d).where("map_layer = 1").select("edge_id").distinct(), "edge_id", "left_semi")


@query("two cells edges walls", USED + HEAL + "SELECT node_id, edge_1, edge_2 FROM star JOIN le a ON a.edge_id = edge_1 JOIN le b ON b.edge_id = edge_2 WHERE edge_1 <> edge_2 AND a.lines = b.lines")
def edges_to_heal(spark, d):
    return graph.heal_candidates(_used(spark, d), I.walls(spark, d).select("line_id", "edge_id"))


@query("two cells edges walls", USED + HEAL + "SELECT node_id, edge_1, edge_2 FROM star WHERE false")
def edges_to_heal_literal(spark, d):
    return graph.heal_candidates(_used(spark, d), I.walls(spark, d).select("line_id", "edge_id"), literal=True)


@query("two cells edges walls", USED + HEAL + """, pairs AS (SELECT edge_1, edge_2 FROM star JOIN le a ON a.edge_id = edge_1 JOIN le b ON b.edge_id = edge_2 WHERE edge_1 <> edge_2 AND a.lines = b.lines),
both_ways AS (SELECT edge_1 AS a, edge_2 AS b FROM pairs UNION SELECT edge_2, edge_1 FROM pairs),
reach(a, b) AS (SELECT edge_id, edge_id FROM used UNION SELECT r.a, n.b FROM reach r JOIN both_ways n ON n.a = r.b)
SELECT a AS edge_id, min(b) AS chain FROM reach GROUP BY a""")
def healed_chains(spark, d):
    return graph.heal_chains(_used(spark, d), I.walls(spark, d).select("line_id", "edge_id"))


@query("two cells edges walls", USED + HEAL + """, pairs AS (SELECT node_id, edge_1, edge_2 FROM star JOIN le a ON a.edge_id = edge_1 JOIN le b ON b.edge_id = edge_2 WHERE edge_1 <> edge_2 AND a.lines = b.lines),
both_ways AS (SELECT node_id, edge_1 AS a, edge_2 AS b FROM pairs UNION SELECT node_id, edge_2, edge_1 FROM pairs),
reach(a, b) AS (SELECT edge_id, edge_id FROM used UNION SELECT r.a, n.b FROM reach r JOIN both_ways n ON n.a = r.b),
half AS (SELECT edge_id * 2 AS he, start_node AS o, end_node AS t FROM used UNION ALL SELECT edge_id * 2 + 1, end_node, start_node FROM used),
link AS MATERIALIZED (SELECT x.he AS item, y.he AS nxt FROM both_ways JOIN half x ON x.he // 2 = a AND x.t = node_id JOIN half y ON y.he // 2 = b AND y.o = node_id),
heads AS (SELECT DISTINCT chain FROM (SELECT a, min(b) AS chain FROM reach GROUP BY a)),
ahead(chain, he, i) AS (SELECT chain, chain * 2, 0 FROM heads UNION ALL SELECT chain, nxt, i + 1 FROM ahead JOIN link ON item = he WHERE nxt <> chain * 2),
back(chain, he, i) AS (SELECT chain, chain * 2, 0 FROM heads UNION ALL SELECT chain, item, i - 1 FROM back JOIN link ON nxt = he WHERE item <> chain * 2),
shut AS (SELECT chain FROM ahead JOIN link ON item = he WHERE nxt = chain * 2),
walk AS (SELECT * FROM ahead UNION ALL SELECT * FROM back WHERE i < 0 AND chain NOT IN (SELECT chain FROM shut)),
placed AS (SELECT chain, i, (o - 1) % 21 || ' ' || (o - 1) // 21 AS o, (t - 1) % 21 || ' ' || (t - 1) // 21 AS t FROM walk JOIN half USING (he))
SELECT chain, count(*) AS n_edges, chain IN (SELECT chain FROM shut) AS closed, string_agg(o, ',' ORDER BY i) || ',' || arg_max(t, i) AS path FROM placed GROUP BY chain""")
def healed_edges(spark, d):
    """The edges of a layer's walls healed to polylines: their points in order."""
    used = _used(spark, d).select("edge_id").join(I.placed_edges(spark, d), "edge_id")
    points = chains.healed_points(used, I.walls(spark, d).select("line_id", "edge_id"))
    text = F.concat_ws(" ", F.col("x").cast("long").cast("string"), F.col("y").cast("long").cast("string"))
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", text.alias("t")))), lambda p: p["t"]), ",")
    return points.groupBy("chain", "closed").agg((F.count("*") - 1).alias("n_edges"), path.alias("path")).select("chain", "n_edges", "closed", "path")


@query("two cells edges walls", """, held AS (SELECT edge_id, line_id FROM walls WHERE line_id // 10 IN (SELECT p FROM cells WHERE t < 45)), kept AS (SELECT * FROM edges SEMI JOIN held USING (edge_id)),
near AS (SELECT left_face AS a, right_face AS b FROM edges ANTI JOIN held USING (edge_id) UNION SELECT right_face, left_face FROM edges ANTI JOIN held USING (edge_id)),
reach(a, b) AS (SELECT face_id, face_id FROM cells UNION SELECT 0, 0 UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b), name AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
le AS (SELECT edge_id, list_sort(list_distinct(list(line_id))) AS lines FROM held GROUP BY edge_id),
star AS (SELECT node_id, min(edge_id) AS edge_1, max(edge_id) AS edge_2 FROM (SELECT edge_id, start_node AS node_id FROM kept UNION ALL SELECT edge_id, end_node FROM kept) GROUP BY node_id HAVING count(*) = 2),
pairs AS (SELECT edge_1, edge_2 FROM star JOIN le a ON a.edge_id = edge_1 JOIN le b ON b.edge_id = edge_2 WHERE edge_1 <> edge_2 AND a.lines = b.lines),
both_ways AS (SELECT edge_1 AS a, edge_2 AS b FROM pairs UNION SELECT edge_2, edge_1 FROM pairs),
healed(a, b) AS (SELECT edge_id, edge_id FROM kept UNION SELECT r.a, n.b FROM healed r JOIN both_ways n ON n.a = r.b)
SELECT edge_id, l.m AS left_face, r.m AS right_face, (SELECT min(b) FROM healed WHERE a = edge_id) AS chain FROM kept JOIN name l ON l.a = left_face JOIN name r ON r.a = right_face""")
def clean_topology(spark, d):
    """The clean-up as one step, after some lines are gone."""
    held = I.cells(spark, d).where("t < 45").crossJoin(F.broadcast(I.two_layers(spark))).select((F.col("p") * 10 + F.col("map_layer")).alias("id"))
    out = graph.cleaned({"edge": I.edges(spark, d), "line_edge": I.walls(spark, d).select("line_id", "edge_id")}, held)
    return out["edge"].join(out["edge_chain"], "edge_id").select("edge_id", "left_face", "right_face", "chain")


@query("cells edges", "SELECT edge_id, left_face AS face_id, CASE WHEN left_face = face THEN right_face WHEN right_face = face THEN left_face END AS other FROM (SELECT *, left_face + edge_id % 2 AS face FROM edges)")
def other_face(spark, d):
    e = I.edges(spark, d)
    face = F.col("left_face") + F.col("edge_id") % 2
    return e.select("edge_id", F.col("left_face").alias("face_id"), graph.other_face(face, F.col("left_face"), F.col("right_face")).alias("other"))


# Dissolving.


@query("two cells edges walls reach", "SELECT DISTINCT map_layer, a AS face_id, b AS adjacent FROM near")
def adjacent_faces(spark, d):
    return graph.adjacent(I.edges(spark, d), I.walls(spark, d), I.two_layers(spark))


@query("two cells edges walls", """, pass AS (SELECT two.map_layer, left_face, right_face FROM edges CROSS JOIN two LEFT JOIN walls w USING (edge_id) WHERE w.map_layer IS DISTINCT FROM two.map_layer)
SELECT DISTINCT map_layer, face_id, adjacent FROM (SELECT map_layer, left_face AS face_id, right_face AS adjacent FROM pass UNION ALL SELECT map_layer, right_face, left_face FROM pass) WHERE face_id <> adjacent""")
def adjacent_faces_literal(spark, d):
    return graph.adjacent(I.edges(spark, d), I.walls(spark, d), I.two_layers(spark), literal=True)


def _dissolved(spark, d, closed=True):
    return graph.dissolved(I.cells(spark, d), I.edges(spark, d), I.walls(spark, d, closed), I.two_layers(spark))


@query("two cells edges walls reach", "SELECT map_layer, face_id, comp FROM comps")
def dissolved_components(spark, d):
    return _dissolved(spark, d).select("map_layer", "face_id", "comp")


@query("two cells edges open_walls reach", "SELECT map_layer, face_id, comp, is_open FROM comps")
def open_components(spark, d):
    return _dissolved(spark, d, closed=False)


@query("two cells edges open_walls reach", "SELECT map_layer, comp AS id, count(*)::DOUBLE AS area, count(*) AS n_faces FROM comps WHERE NOT is_open GROUP BY map_layer, comp")
def map_face_area(spark, d):
    """The flagship: bounded map faces of two layers, traced, with their polygon's area and the number of their primitive faces."""
    comps = written(_dissolved(spark, d, closed=False), "map_face_members")
    members = comps.where("not is_open").groupBy("map_layer", "comp").agg(F.count("*").alias("n_faces"))
    shapes = noding.polygons(I.placed_edges(spark, d), comps, UNIT)
    return members.join(shapes, ["map_layer", "comp"]).select("map_layer", F.col("comp").alias("id"), "area", "n_faces")


UNIT = TopoConfig(tolerance=1.0)  # the lattice's own size


def _shapes(spark, d):
    """(map_layer, comp, geometry): the dissolved components of the lattice as polygons."""
    comps = written(_dissolved(spark, d), "shape_members")
    return written(noding.polygons(I.placed_edges(spark, d), comps, UNIT).drop("area"), "shapes")


BOX_CELLS = """, spots AS (SELECT b.id, type, map_layer, w * h AS n, x + i AS cx, y + j AS cy FROM boxes b, (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1]) AS j) WHERE i < w AND j < h AND x + i < 20),
inside AS (SELECT s.id, s.type, s.map_layer, comp, cx, cy, count(*) OVER (PARTITION BY s.id, s.map_layer, comp) = n AS whole FROM spots s JOIN cells USING (cx, cy) JOIN comps c ON c.face_id = cells.face_id AND c.map_layer = s.map_layer),
areas AS (SELECT map_layer, comp, type, count(DISTINCT cx * 1000000 + cy) AS area FROM inside WHERE whole GROUP BY ALL)
"""


def _box_areas(spark, d):
    """(map_layer, comp, type, area): area of the union of the boxes of each type that lie wholly in a component."""
    areas = units.covered_areas(_shapes(spark, d), I.box_shapes(spark, d))
    return areas.select("map_layer", "comp", F.col("unit_id").alias("type"), F.round("area").cast("long").alias("area"))


@query("two cells edges walls reach boxes", BOX_CELLS + "SELECT map_layer, comp, type, area FROM areas")
def unit_union_area(spark, d):
    return _box_areas(spark, d)


@query("two cells edges walls reach boxes", BOX_CELLS + """SELECT DISTINCT c.map_layer, c.comp, u.unit_id FROM comps c
LEFT JOIN (SELECT map_layer, comp, arg_min(type, (-area, type)) AS unit_id FROM areas GROUP BY ALL) u USING (map_layer, comp)""")
def unit_for_area(spark, d):
    shapes = _shapes(spark, d)
    return shapes.select("map_layer", "comp").join(units.units(shapes, I.box_shapes(spark, d)), ["map_layer", "comp"], "left")


@query("two cells edges walls reach boxes", BOX_CELLS + """, best AS (SELECT map_layer, comp, arg_min(type, (-area, type)) AS unit_id FROM areas GROUP BY ALL)
SELECT map_layer, unit_id, area, count(*) AS n FROM (SELECT map_layer, comp, count(*)::DOUBLE AS area FROM comps GROUP BY ALL) LEFT JOIN best USING (map_layer, comp) GROUP BY ALL""")
def solved_faces(spark, d):
    """The whole solve, from lines and polygons to labelled map faces: how many there are of each layer, unit and area."""
    found = solve(I.wall_lines(spark, d), I.box_shapes(spark, d), I.two_layers(spark).select(F.col("map_layer").alias("id"), F.lit(True).alias("topological")), UNIT)
    return found["map_face"].groupBy("map_layer", "unit_id", "area").agg(F.count("*").alias("n"))


@query("cells", "SELECT face_id, 1.0::DOUBLE AS area FROM cells")
def face_data(spark, d):
    """Primitive faces as polygons, and the area of each."""
    return noding.face_data(I.placed_edges(spark, d), UNIT).select("face_id", "area")


@query("two cells edges walls reach", "SELECT face_id AS id, map_layer, comp FROM comps")
def face_at_point(spark, d):
    """The map face of each layer that holds a point inside each primitive face."""
    cell = noding.face_data(I.placed_edges(spark, d), UNIT).select(F.col("face_id").alias("id"), "geometry")
    return units.face_at(units.on_surface(cell, "id long"), _shapes(spark, d), I.two_layers(spark))


UNIT_CELLS = """, u AS (SELECT DISTINCT map_layer, type, x + i AS cx, y + j AS cy FROM boxes, (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1]) AS j) WHERE i < w AND j < h),
beside AS (SELECT a.map_layer, a.type, count(*) AS n FROM u a JOIN u b ON a.map_layer = b.map_layer AND a.type = b.type AND ((b.cx = a.cx + 1 AND b.cy = a.cy) OR (b.cx = a.cx AND b.cy = a.cy + 1)) GROUP BY ALL)
"""


@query("boxes", UNIT_CELLS + "SELECT map_layer, type, count(*)::DOUBLE AS area, (4 * count(*) - 2 * coalesce(any_value(n), 0))::DOUBLE AS border FROM u LEFT JOIN beside USING (map_layer, type) GROUP BY ALL")
def union_geometry(spark, d):
    """The union of each type's boxes as one geometry: its area, and the length of its border."""
    shapes = overlay.union(I.box_shapes(spark, d), ["map_layer", "type"], UNIT)
    lengths = linework.measured(shapes, "map_layer int, type string, area double")
    return lengths.select("map_layer", "type", "area", F.col("length").alias("border"))


@query("two cells edges walls reach boxes", ", edited AS (SELECT id, x, y, w, h, CASE WHEN id % 10 = 1 THEN 'edited' ELSE type END AS type, map_layer FROM boxes WHERE id % 10 <> 0)" + BOX_CELLS.replace("FROM boxes b", "FROM edited b") + """SELECT DISTINCT c.map_layer, c.comp, u.unit_id FROM comps c
LEFT JOIN (SELECT map_layer, comp, arg_min(type, (-area, type)) AS unit_id FROM areas GROUP BY ALL) u USING (map_layer, comp)""")
def labels_after_edit(spark, d):
    """Labels of map faces after boxes went and others changed their type: only faces that the changed boxes meet are labelled again."""
    old, shapes = written(I.box_shapes(spark, d), "boxes"), written(_shapes(spark, d), "shapes")
    new = old.where("id % 10 <> 0").withColumn("type", F.when(F.col("id") % 10 == 1, "edited").otherwise(F.col("type")))
    labelled = shapes.join(units.units(shapes, old), ["map_layer", "comp"], "left")
    return overlay.relabel(labelled, old, new, UNIT).select("map_layer", "comp", "unit_id")


ISLANDS = """WITH top AS (SELECT max(c_custkey) // 64 + 1 AS n FROM customer),
isle AS (SELECT c_custkey AS k, c_custkey % 5 = 0 AS hollow FROM customer),
lake AS (SELECT (6 * 64 + 2) * (6 * n + 2) - 16 * (SELECT count(*) FROM isle) AS area FROM top)
SELECT -1::BIGINT AS id, 0.0::DOUBLE AS low, area::DOUBLE AS high FROM lake
UNION ALL SELECT 2 * k, CASE WHEN hollow THEN 12 ELSE 16 END, area FROM isle, lake UNION ALL SELECT 2 * k + 1, 4, 12 FROM isle WHERE hollow"""


@query(None, ISLANDS)
def island_faces(spark, d):
    """A lake with an island for each customer, some with a pond: the areas of the faces on both sides of every shore."""
    square = lambda i, x, y, side: F.struct(i.cast("long").alias("id"), x.cast("long").alias("x"), y.cast("long").alias("y"), (x + side).cast("long").alias("u"), (y + side).cast("long").alias("v"))
    k = F.col("c_custkey")
    x, y, customers = k % 64 * 6, F.floor(k / 64) * 6, I.read(spark, d, "customer")
    shores = customers.select(F.explode(F.array_compact(F.array(square(k * 2, x, y, 4), F.when(k % 5 == 0, square(k * 2 + 1, x + 1, y + 1, 2))))).alias("s")).select("s.*")
    n = F.floor(F.max("c_custkey") / 64) + 1
    lake = customers.agg(F.lit(-1).cast("long").alias("id"), F.lit(-2).cast("long").alias("x"), F.lit(-2).cast("long").alias("y"), F.lit(6 * 64).cast("long").alias("u"), (6 * n).cast("long").alias("v"))
    rows = shores.union(lake).withColumn("wkt", F.format_string("LINESTRING(%1$d %2$d,%3$d %2$d,%3$d %4$d,%1$d %4$d,%1$d %2$d)", "x", "y", "u", "v"))
    edges, along, _ = noding.noded(files.parse_geometry(rows.select("id", "wkt"), "wkt").select("id", "geometry"), UNIT)
    edges, primitive = noding.faced(edges)
    sides = along.join(edges.select("edge_id", F.explode(F.array("left_face", "right_face")).alias("face_id")), "edge_id").select(F.col("line_id").alias("id"), "face_id").distinct()
    return sides.join(primitive, "face_id").groupBy("id").agg(F.min("area").alias("low"), F.max("area").alias("high"))


def _utm_sql() -> str:
    """Krüger's series as SQL, from the same coefficients."""
    e = 2 * generalise.THIRD**0.5 / (1 + generalise.THIRD)
    sums = lambda f, g: " + ".join(f"{c!r}::DOUBLE * {f}({2 * j} * u) * {g}({2 * j} * v)" for j, c in enumerate(generalise.series(generalise.FORWARD), 1))
    k = generalise.SCALE * generalise.MEAN
    return f"""WITH p AS (SELECT c_custkey AS id, radians((c_custkey % 601 - 300) / 100.0::DOUBLE) AS lon, radians((c_custkey * 7 % 1600) / 20.0::DOUBLE) AS lat FROM customer),
t AS (SELECT *, sinh(atanh(sin(lat)) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(lat))) AS t FROM p),
q AS (SELECT id, atan2(t, cos(lon)) AS u, atanh(sin(lon) / sqrt(1 + t * t)) AS v FROM t)
SELECT id, round(500000 + {k!r}::DOUBLE * (v + {sums('cos', 'sinh')}), 3) AS east, round({k!r}::DOUBLE * (u + {sums('sin', 'cosh')}), 3) AS north FROM q"""


@query(None, _utm_sql())
def utm_points(spark, d):
    """Points of customers, within 3 degrees of the middle of zone 12, in metres of that zone."""
    k = F.col("c_custkey")
    rows = I.read(spark, d, "customer").select(k.alias("id"), F.format_string("POINT(%.2f %.2f)", -111 + (k % 601 - 300) / 100, (k * 7 % 1600) / 20).alias("wkt"))
    flat = vector_tiles.projected(files.parse_geometry(rows, "wkt").select(F.col("id").cast("long").alias("id"), "geometry"), "id long", 4326, 32612)
    return units.boxed(flat, "id long").select("id", F.round("box.xmin", 3).alias("east"), F.round("box.ymin", 3).alias("north"))


# Relations, dirty sets, registration.


def _named_lines(spark, d, column="type"):
    rows = I.walls(spark, d).select(F.col("line_id").alias("id"), F.col("map_layer").alias("topology")).distinct()
    return rows.withColumn("type", F.concat(F.lit("line-"), F.col("id") % 7))


def _shared_line_edge(spark, d):
    """Lines along edges, some edges twice: every line also runs along the edge four ids on."""
    w = I.walls(spark, d).select("line_id", "edge_id")
    return w.union(w.select("line_id", (F.col("edge_id") + 4).alias("edge_id"))).distinct()


SHARED = ", ln AS (SELECT DISTINCT line_id AS id, map_layer AS topology, 'line-' || (line_id % 7) AS type FROM walls), le AS (SELECT line_id, edge_id FROM walls UNION SELECT line_id, edge_id + 4 FROM walls)"


@query("two cells edges walls", SHARED + " SELECT edge_id, topology AS map_layer, max(line_id) AS line_id, arg_max(type, line_id) AS type FROM le JOIN ln ON ln.id = line_id GROUP BY edge_id, topology")
def edge_relation_upsert(spark, d):
    lines, along = _named_lines(spark, d), _shared_line_edge(spark, d)
    old = faces.link_edges(along, lines.where("id % 3 = 0"))
    return faces.link_edges(along, lines, old)


@query("two cells edges walls", SHARED + " SELECT DISTINCT face AS id, topology AS map_layer FROM le JOIN ln ON ln.id = line_id JOIN (SELECT edge_id, left_face AS face FROM edges UNION ALL SELECT edge_id, right_face FROM edges) USING (edge_id)")
def mark_surrounding_faces(spark, d):
    return faces.surrounding(_shared_line_edge(spark, d), I.edges(spark, d), _named_lines(spark, d))


def _members(spark, d):
    """(map_face, map_layer, face_id): a face each, and a second cover of some."""
    c = I.cells(spark, d).crossJoin(F.broadcast(I.two_layers(spark)))
    one = c.select(F.col("face_id").alias("map_face"), "map_layer", "face_id")
    return one.union(c.where("t % 10 = 0").select((F.col("face_id") + 1).alias("map_face"), "map_layer", "face_id"))


MEMBERS = ", members AS (SELECT face_id AS map_face, map_layer, face_id FROM cells CROSS JOIN two UNION ALL SELECT face_id + 1, map_layer, face_id FROM cells CROSS JOIN two WHERE t % 10 = 0)"


def _map_faces(spark, d):
    return I.cells(spark, d).crossJoin(F.broadcast(I.two_layers(spark))).where("t % 7 <> 0").select(F.col("face_id").alias("id"), "map_layer", F.when(F.col("t") % 3 != 0, F.col("brand")).alias("unit_id"))


MAP_FACES = ", map_faces AS (SELECT face_id AS id, map_layer, CASE WHEN t % 3 <> 0 THEN brand END AS unit_id FROM cells CROSS JOIN two WHERE t % 7 <> 0)"


@query("two cells", MEMBERS + MAP_FACES + """ SELECT face_id, m.map_layer, max(map_face) AS map_face, arg_max(coalesce(unit_id, '-'), map_face) AS unit_id
FROM members m JOIN map_faces f ON f.id = map_face AND f.map_layer = m.map_layer GROUP BY face_id, m.map_layer""")
def face_type_upsert(spark, d):
    old = faces.register(_map_faces(spark, d).where("id % 2 = 0"), _members(spark, d))
    return faces.register(_map_faces(spark, d), _members(spark, d), old).withColumn("unit_id", F.coalesce("unit_id", F.lit("-")))


@query("two cells", MEMBERS + MAP_FACES + " SELECT m.face_id, m.map_layer, m.map_face, unit_id FROM members m JOIN map_faces f ON f.id = map_face AND f.map_layer = m.map_layer WHERE face_id % 4 = 0")
def containing_face(spark, d):
    """The map faces, and their units, over every fourth face."""
    asked = I.cells(spark, d).where("face_id % 4 = 0").select("face_id").crossJoin(F.broadcast(I.two_layers(spark)))
    return faces.containing(_map_faces(spark, d), _members(spark, d), asked).select("face_id", "map_layer", "map_face", "unit_id")


EDGE_UNITS = """, eu AS (SELECT edge_id, map_layer, list_sort(list(unit_id)) AS units FROM (SELECT edge_id, left_face AS face_id FROM edges UNION SELECT edge_id, right_face FROM edges) JOIN map_faces f ON f.id = face_id WHERE unit_id IS NOT NULL GROUP BY edge_id, map_layer)
"""


def _edge_units(spark, d):
    return faces.edge_units(I.edges(spark, d), _map_faces(spark, d).withColumnRenamed("id", "face_id"))


@query("two cells edges", MAP_FACES + EDGE_UNITS + "SELECT edge_id, map_layer, array_to_string(units, ',') AS units FROM eu")
def edge_units(spark, d):
    return _edge_units(spark, d).withColumn("units", F.array_join("units", ","))


@query("two cells edges walls", MAP_FACES + EDGE_UNITS + "SELECT edge_id, eu.map_layer, line_id, type, array_to_string(units, ',') AS units FROM eu JOIN walls USING (edge_id, map_layer) WHERE len(units) > 1 AND type = 'type-1'")
def contact_units(spark, d):
    """Lines of one type between two labelled faces."""
    return faces.contact_units(_edge_units(spark, d), I.walls(spark, d), "type-1").withColumn("units", F.array_join("units", ","))


@query("two cells types", MAP_FACES + " SELECT f.id, map_layer, unit_id, color FROM map_faces f JOIN types t ON t.id = unit_id WHERE unit_id <> 'Brand#11'")
def mapped_faces(spark, d):
    return faces.mapped_faces(_map_faces(spark, d), I.types(spark, d), without="Brand#11").select("id", "map_layer", "unit_id", "color")


@query("two cells", MEMBERS + " SELECT face_id, map_layer, string_agg(map_face, ',' ORDER BY map_face) AS covers, count(*) AS n FROM members GROUP BY face_id, map_layer HAVING count(*) > 1")
def multi_cover_faces(spark, d):
    return faces.covered_twice(_members(spark, d)).withColumn("covers", F.array_join(F.transform("covers", lambda x: x.cast("string")), ","))


@query("two cells edges walls reach", """SELECT DISTINCT c.comp AS map_face, c.map_layer FROM comps c JOIN edges e ON c.face_id IN (e.left_face, e.right_face)
JOIN comps o ON o.map_layer = c.map_layer AND o.face_id = CASE WHEN e.left_face = c.face_id THEN e.right_face ELSE e.left_face END
WHERE o.comp <> c.comp AND (e.edge_id, c.map_layer) NOT IN (SELECT (edge_id, map_layer) FROM walls WHERE edge_id % 9 <> 0)
UNION SELECT DISTINCT c.comp, c.map_layer FROM comps c JOIN edges e ON e.left_face = c.face_id AND e.right_face = 0
WHERE (e.edge_id, c.map_layer) NOT IN (SELECT (edge_id, map_layer) FROM walls WHERE edge_id % 9 <> 0)""")
def prune_unlinked_faces(spark, d):
    """Map faces that lost the link of a boundary edge (every ninth is taken away)."""
    members = written(_dissolved(spark, d).select(F.col("comp").alias("map_face"), "map_layer", "face_id"), "members")
    return faces.unlinked(members, I.edges(spark, d), I.walls(spark, d).where("edge_id % 9 <> 0"))


@query("two cells", MAP_FACES + " SELECT face_id AS id, map_layer FROM cells CROSS JOIN two WHERE (face_id, map_layer) NOT IN (SELECT (id, map_layer) FROM map_faces)")
def holes_dirty(spark, d):
    registered = _map_faces(spark, d).select(F.col("id").alias("face_id"), "map_layer")
    return faces.holes(I.cells(spark, d), I.two_layers(spark), registered)


@query("two cells", "SELECT face_id AS id, map_layer FROM cells CROSS JOIN two")
def reset_dirty(spark, d):
    return faces.all_dirty(I.cells(spark, d), I.two_layers(spark))


@query("two cells types", MAP_FACES + " SELECT f.id, f.map_layer, f.unit_id, t.color, t.name FROM map_faces f JOIN (VALUES (1), (2)) l(id) ON l.id = f.map_layer LEFT JOIN types t ON t.id = f.unit_id")
def face_display(spark, d):
    return faces.face_display(_map_faces(spark, d), I.types(spark, d), I.layers(spark)).select("id", "map_layer", "unit_id", "color", "name")


@query("two cells edges walls reach boxes", """SELECT DISTINCT c.map_layer, c.comp, b.id AS box FROM comps c JOIN cells USING (face_id) JOIN boxes b ON b.map_layer = c.map_layer AND b.id % 10 = 0
AND cx BETWEEN b.x - 1 AND b.x + b.w AND cy BETWEEN b.y - 1 AND b.y + b.h""")
def polygon_relabel(spark, d):
    """Map faces that an edited box meets, borders included: they get a new label."""
    edited = I.box_shapes(spark, d).where("id % 10 = 0")  # the edit batch
    return units.relabelled(_shapes(spark, d), edited).withColumnRenamed("id", "box")


@query("two cells edges walls reach", "SELECT DISTINCT map_layer, comp FROM comps JOIN cells USING (face_id) WHERE cx BETWEEN 2 AND 3 AND cy BETWEEN 2 AND 3")
def point_in_faces(spark, d):
    """Map faces that the point (3, 3) lies in, borders included."""
    point = I.two_layers(spark).select("map_layer", F.lit(0).cast("long").alias("id"), F.lit(bytearray(wkb.encode(wkb.parse("POINT(3 3)")[0]))).alias("geometry"))
    return units.relabelled(_shapes(spark, d), point).select("map_layer", "comp")


# Edits.

CLASSES = """CASE WHEN op = 'DELETE' THEN 'mark_old' WHEN layer_after IS NULL AND layer_before IS NOT NULL THEN 'unlink_mark_old' WHEN layer_after IS NULL THEN 'unlink'
WHEN op = 'INSERT' THEN 'mark_new' WHEN geometry_changed THEN 'rehash_mark_old' WHEN layer_before IS NOT DISTINCT FROM layer_after THEN 'ignore' ELSE 'relink_mark_both' END"""


@query("edits", f"SELECT seq, id, {CLASSES} AS action FROM edits")
def classify_edits(spark, d):
    action = linework.classify(F.col("op"), F.lit(True), F.col("layer_before"), F.col("layer_after"), F.col("geometry_changed"))
    return I.edits(spark, d).select("seq", "id", action.alias("action"))


@query("edits", "SELECT id, max(seq) AS seq, arg_max(op, seq) AS op FROM edits GROUP BY id")
def last_edit_wins(spark, d):
    return dml.last_wins(I.edits(spark, d).select("seq", "id", "op"), ["id"], ["seq"])


DIFF = """, old AS (SELECT face_id, cx AS xmin, cy AS ymin, cx + 1 AS xmax, cy + 1 AS ymax FROM cells WHERE t % 5 <> 0), new AS (SELECT face_id, cx AS xmin, cy AS ymin, cx + 1 AS xmax, cy + 1 AS ymax FROM cells WHERE t % 7 <> 0),
d AS (SELECT *, 1 AS gone FROM old WHERE face_id NOT IN (SELECT face_id FROM new) UNION ALL SELECT *, 0 FROM new WHERE face_id NOT IN (SELECT face_id FROM old)),
c AS (SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, sum(gone)::BIGINT AS n_deleted, sum(1 - gone)::BIGINT AS n_created, (SELECT count(*) FROM new) AS n_faces FROM d)
"""


def _difference(spark, d):
    c = I.cells(spark, d).select("face_id", "t", F.col("cx").alias("xmin"), F.col("cy").alias("ymin"), (F.col("cx") + 1).alias("xmax"), (F.col("cy") + 1).alias("ymax"))
    return faces.difference(c.where("t % 5 <> 0"), c.where("t % 7 <> 0"), ["face_id"])


@query("cells", DIFF + "SELECT * FROM c")
def face_diff(spark, d):
    return _difference(spark, d)


@query("cells", DIFF + """SELECT '{"table":"map_face","envelope":{"type":"Polygon","coordinates":[[' || concat_ws(',', '[' || xmin || ',' || ymin || ']', '[' || xmin || ',' || ymax || ']', '[' || xmax || ',' || ymax || ']', '[' || xmax || ',' || ymin || ']', '[' || xmin || ',' || ymin || ']')
|| ']]},"n_deleted":' || n_deleted || ',"n_created":' || n_created || ',"n_faces":' || n_faces || '}' AS payload FROM c""")
def face_diff_payload(spark, d):
    return faces.payload(_difference(spark, d), "map_face")


# Row-level changes.


@query("types", """SELECT id, name, CASE WHEN id LIKE 'maker%' OR id = 'root' THEN color ELSE '#000000' END AS color FROM types WHERE id <> 'root'
UNION ALL SELECT 'default', 'Default', '#888888'""")
def type_upsert(spark, d):
    """Load a type file over the known types: upsert, then delete what the file does not name."""
    known = I.types(spark, d).select("id", "name", "color")
    file = known.where("id <> 'root'").withColumn("color", F.when(F.col("id").like("maker%"), F.col("color")).otherwise("#000000"))
    file = file.unionByName(spark.createDataFrame([("default", "Default", "#888888")], "id string, name string, color string"))
    merged = dml.upsert(known, file, ["id"])
    return merged.join(file.select("id"), "id", "left_semi").select("id", "name", "color")


@query("two cells", "SELECT face_id AS id, map_layer, t AS seq FROM cells CROSS JOIN two WHERE map_layer = 1 OR t % 2 = 0")
def insert_ignore(spark, d):
    c = I.cells(spark, d).select(F.col("face_id").alias("id"), F.col("t").alias("seq"))
    old = c.withColumn("map_layer", F.lit(1))
    new = c.withColumn("map_layer", F.lit(1)).unionByName(c.where("seq % 2 = 0").withColumn("map_layer", F.lit(2))).withColumn("seq", F.col("seq") + F.when(F.col("map_layer") == 1, 100).otherwise(0))
    return dml.insert_ignore(old, new, ["id", "map_layer"], ["seq"]).select("id", "map_layer", "seq")


@query("lines", "SELECT id, map_layer, type FROM lines WHERE map_layer <> 3 AND type IS DISTINCT FROM '1-URGENT'")
def cascade_delete(spark, d):
    """A layer and a type go, and their lines with them."""
    rows = I.lines(spark, d).select("id", "map_layer", "type")
    kept = dml.cascade(rows, I.layers(spark).where("id <> 3"), "map_layer", "id")
    types = rows.select(F.col("type").alias("name")).where("name <> '1-URGENT'").distinct()
    return dml.cascade(kept, types, "type", "name")


@query("lines", "SELECT id, map_layer, CASE WHEN type = '2-HIGH' THEN 'high' ELSE type END AS type FROM lines")
def rename_type(spark, d):
    rows = I.lines(spark, d).select("id", "map_layer", "type")
    return dml.rename_key(rows, spark.createDataFrame([("2-HIGH", "high")], "old string, new string"), "type").select("id", "map_layer", "type")


@query("types", "SELECT id, CASE WHEN id LIKE 'maker%' THEN '#111111' ELSE color END AS color FROM types")
def keyed_update(spark, d):
    known = I.types(spark, d).select("id", "color")
    change = known.where("id like 'maker%'").withColumn("color", F.lit("#111111")).unionByName(known.limit(0))
    return dml.update_by_key(known, change, "id", ["color"])


@query("lines", "SELECT id, topology_error FROM lines WHERE NOT coalesce(topology_error = 'bad geometry', false)")
def predicate_delete(spark, d):
    return dml.delete_where(I.lines(spark, d).select("id", "topology_error"), F.col("topology_error") == "bad geometry")


@query("lines", "SELECT id FROM lines WHERE geometry_hash NOT IN (SELECT geometry_hash FROM lines WHERE id % 3 = 0 AND geometry_hash IS NOT NULL)")
def not_in_null_aware(spark, d):
    rows = I.lines(spark, d)
    held = rows.where("id % 3 = 0 and geometry_hash is not null").select("geometry_hash")
    return dml.not_in(rows.select("id", "geometry_hash"), "geometry_hash", held, "geometry_hash").select("id")


@query("lines", "SELECT coalesce(max(id), 0) + 1 AS next_id FROM lines")
def next_id(spark, d):
    return I.lines(spark, d).agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


# Hierarchy and display.

TREE = """, tree(id, ancestors, up) AS (SELECT id, [id], member_of FROM types UNION ALL SELECT tree.id, list_append(ancestors, up), t.member_of FROM tree JOIN types t ON t.id = up),
full_tree AS (SELECT id, ancestors, len(ancestors)::INT AS n_levels FROM tree WHERE up IS NULL)
"""


@query("types", TREE + "SELECT id, array_to_string(ancestors, '/') AS ancestors, n_levels FROM full_tree")
def unit_tree(spark, d):
    return hierarchy.unit_tree(I.types(spark, d)).select("id", F.array_join("ancestors", "/").alias("ancestors"), "n_levels")


@query("types", TREE + "SELECT a.id AS unit_1, b.id AS unit_2, len(list_intersect(a.ancestors, b.ancestors))::INT AS commonality FROM full_tree a JOIN full_tree b ON a.id < b.id")
def unit_commonality(spark, d):
    tree = hierarchy.unit_tree(I.types(spark, d))  # a dimension: one row per unit
    a, b = tree.select(F.col("id").alias("unit_1"), F.col("ancestors").alias("a1")), tree.select(F.col("id").alias("unit_2"), F.col("ancestors").alias("a2"))
    return a.join(b, F.col("unit_1") < F.col("unit_2")).select("unit_1", "unit_2", hierarchy.shared_levels(F.col("a1"), F.col("a2")).alias("commonality"))


@query("types", TREE + "SELECT up AS id, string_agg(id, ',' ORDER BY id) AS subunits FROM (SELECT id, unnest(ancestors) AS up FROM full_tree) GROUP BY up")
def subunits(spark, d):
    return hierarchy.subunits(hierarchy.unit_tree(I.types(spark, d))).select("id", F.array_join("subunits", ",").alias("subunits"))


@query("two cells edges walls types", MAP_FACES + TREE + """SELECT w.edge_id, w.map_layer, w.type, a.unit_id AS unit_1, b.unit_id AS unit_2,
coalesce(len(list_intersect(x.ancestors, y.ancestors)), 0)::INT AS commonality, (2 - coalesce(len(list_intersect(x.ancestors, y.ancestors)), 0)) * 0.5::DOUBLE AS strength
FROM walls w JOIN edges e USING (edge_id) JOIN map_faces a ON a.id = left_face AND a.map_layer = w.map_layer JOIN map_faces b ON b.id = right_face AND b.map_layer = w.map_layer
LEFT JOIN full_tree x ON x.id = a.unit_id LEFT JOIN full_tree y ON y.id = b.unit_id""")
def contact_display(spark, d):
    tree = written(hierarchy.unit_tree(I.types(spark, d)), "unit_tree")
    face_type = _map_faces(spark, d).withColumnRenamed("id", "face_id")
    return hierarchy.contacts(I.walls(spark, d), I.edges(spark, d), face_type, tree).withColumn("strength", F.col("strength").cast("double"))


# Tiles and colours.

TILE_ROWS = ", q AS (SELECT id, (x1 - 48) * 400000.0::DOUBLE AS xmin, (y1 - 44) * 420000.0::DOUBLE AS ymin, (x1 - 48) * 400000.0::DOUBLE + length * 90000.0::DOUBLE AS xmax, (y1 - 44) * 420000.0::DOUBLE + 250000.0 AS ymax, (id % 5)::INT AS z FROM lines)\n"
IX = "floor(({0} / 40075016.6855785::DOUBLE + 0.5) * pow(2.0, {1}))::INT"


def _tile_rows(spark, d):
    x, y = (F.col("x1") - 48) * 400000.0, (F.col("y1") - 44) * 420000.0
    return I.lines(spark, d).select("id", x.alias("xmin"), y.alias("ymin"), (x + F.col("length") * 90000.0).alias("xmax"), (y + 250000.0).alias("ymax"), (F.col("id") % 5).cast("int").alias("z"))


@query("lines", TILE_ROWS + f"SELECT id, {IX.format('xmin', 'z')} AS x, {IX.format('-ymax', 'z')} AS y FROM q")
def tile_index(spark, d):
    return _tile_rows(spark, d).select("id", tiles.tile_index(F.col("xmin"), F.col("z")).alias("x"), tiles.tile_row(F.col("ymax"), F.col("z")).alias("y"))


@query("lines", TILE_ROWS + f"SELECT id, x, unnest(range({IX.format('-ymax', 'z')}, {IX.format('-ymin', 'z')} + 1))::INT AS y, z FROM (SELECT *, unnest(range({IX.format('xmin', 'z')}, {IX.format('xmax', 'z')} + 1))::INT AS x FROM q)")
def covering_tiles(spark, d):
    c = tiles.covering_tiles(*[F.col(k) for k in ("xmin", "ymin", "xmax", "ymax", "z")])
    return _tile_rows(spark, d).select("id", F.explode(c).alias("t")).select("id", "t.x", "t.y", "t.z")


@query("lines", TILE_ROWS + f", s AS (SELECT q.*, unnest(range(0, 25)) AS level FROM q) SELECT id, {IX.format('arg_max(xmin, level)', 'max(level)')} AS x, {IX.format('-arg_max(ymax, level)', 'max(level)')} AS y, max(level)::INT AS z FROM s WHERE {IX.format('xmin', 'level')} = {IX.format('xmax', 'level')} AND {IX.format('-ymin', 'level')} = {IX.format('-ymax', 'level')} GROUP BY id")
def largest_tile(spark, d):
    t = tiles.largest_tile(*[F.col(k) for k in ("xmin", "ymin", "xmax", "ymax")])
    return _tile_rows(spark, d).select("id", t.alias("t")).select("id", "t.x", "t.y", "t.z").where("z is not null")


@query("lines", """SELECT id, z2 >= z1 AND x2 >= x * 2 ** (z2 - z1) AND x2 < (x + 1) * 2 ** (z2 - z1) AND y2 >= y * 2 ** (z2 - z1) AND y2 < (y + 1) * 2 ** (z2 - z1) AS inside,
z2 >= z1 AND x2 >= x * 2 ** (z2 - z1) AND x2 <= (x + 1) * 2 ** (z2 - z1) AND y2 >= y * 2 ** (z2 - z1) AND y2 <= (y + 1) * 2 ** (z2 - z1) AS inside_literal
FROM (SELECT id, id % 2 AS x, id % 3 AS y, 2 AS z1, id % 7 AS x2, id % 8 AS y2, 1 + id % 4 AS z2 FROM lines)""")
def tile_contains(spark, d):
    k = F.col("id")
    args = [k % 2, k % 3, F.lit(2), k % 7, k % 8, 1 + k % 4]
    return I.lines(spark, d).select("id", tiles.tile_contains(*args).alias("inside"), tiles.tile_contains(*args, literal=True).alias("inside_literal"))


@query("lines", """SELECT id, arg_max(stamp, seq) AS stamp FROM (SELECT id % 300 AS id, id AS seq, 'tile ' || id AS stamp FROM lines) GROUP BY id""")
def tile_cache_upsert(spark, d):
    """Tiles written to a cache in two batches; the later one replaces."""
    rows = I.lines(spark, d).select((F.col("id") % 300).alias("id"), F.col("id").alias("seq"), F.concat(F.lit("tile "), "id").alias("stamp"))
    batch = lambda rows: dml.last_wins(rows, ["id"], ["seq"])
    half = rows.agg(F.max("seq") / 2).first()[0] or 0
    return dml.upsert(batch(rows.where(F.col("seq") <= half)), batch(rows.where(F.col("seq") > half)), ["id"]).select("id", "stamp")


# Boxes in metres, 100 km a cell, a third of a cell off the origin so that no side lies on a tile's border.
def _tile_features(spark, d, edited=False):
    rows = I.boxes(spark, d)
    if edited:
        rows = rows.where("id % 10 <> 0").withColumn("x", F.when(F.col("id") % 10 == 1, F.col("x") + 7).otherwise(F.col("x")))
    metres = lambda v: v * 100_000 + 33_333
    x, y = metres(F.col("x")), metres(F.col("y") % 150)
    rows = rows.select("id", "type", x.alias("x"), y.alias("y"), (x + F.col("w") * 100_000).alias("u"), (y + F.col("h") * 100_000).alias("v"))
    rows = rows.withColumn("wkt", F.format_string("POLYGON((%1$d %2$d,%3$d %2$d,%3$d %4$d,%1$d %4$d,%1$d %2$d))", "x", "y", "u", "v"))
    return files.parse_geometry(rows, "wkt").select(F.lit("box").alias("layer"), "id", "type", "geometry", F.struct(*[F.col(c).cast("double").alias(n) for c, n in (("x", "xmin"), ("y", "ymin"), ("u", "xmax"), ("v", "ymax"))]).alias("box"))


def _tile_sql(boxes: str, body: str) -> str:
    """Each box's overlap with each tile's square and its buffer, on the tile's grid."""
    world = tiles.WORLD
    grid = lambda v, low: f"round(({v} - {low}) / side * 4096)"
    return f""", placed AS (SELECT id, x * 100000 + 33333 AS x0, y % 150 * 100000 + 33333 AS y0, (x + w) * 100000 + 33333 AS x1, (y % 150 + h) * 100000 + 33333 AS y1 FROM {boxes}),
zoomed AS (SELECT *, {world} / 2 ** z AS side FROM placed, (VALUES (0), (2), (5)) zooms(z)),
spots AS (SELECT *, unnest(range(greatest(0, floor((x0 + {world / 2}) / side)::BIGINT - 1), least(2 ** z - 1, floor((x1 + {world / 2}) / side) + 1)::BIGINT + 1)) AS x FROM zoomed),
squares AS (SELECT *, unnest(range(greatest(0, floor(({world / 2} - y1) / side)::BIGINT - 1), least(2 ** z - 1, floor(({world / 2} - y0) / side) + 1)::BIGINT + 1)) AS y FROM spots),
seen AS (SELECT id, z, x, y FROM (SELECT *, x * side - {world / 2} AS l, {world / 2} - (y + 1) * side AS b, side / 64 AS s FROM squares)
  WHERE {grid('least(x1, l + side + s)', 'l')} > {grid('greatest(x0, l - s)', 'l')} AND {grid('least(y1, b + side + s)', 'b')} > {grid('greatest(y0, b - s)', 'b')})
{body}"""


EDITED = ", edited AS (SELECT id, CASE WHEN id % 10 = 1 THEN x + 7 ELSE x END AS x, y, w, h FROM boxes WHERE id % 10 <> 0)"
TILE_COUNTS = "SELECT z, x::INT AS x, y::INT AS y, count(*) AS n, sum(id)::BIGINT AS ids FROM seen GROUP BY ALL"


@query("boxes", _tile_sql("boxes", TILE_COUNTS))
def tile_pyramid(spark, d):
    """Boxes as vector tiles of three zooms, read back from their bytes: how many features each tile shows, and the sum of their ids."""
    shown = vector_tiles.contents(vector_tiles.build_tiles(_tile_features(spark, d), [0, 2, 5]))
    return shown.groupBy("z", "x", "y").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("boxes", EDITED + _tile_sql("edited", TILE_COUNTS))
def tile_refresh(spark, d):
    """The same after some boxes went and others moved: only tiles that the boxes met before or meet now are built again."""
    old, new = _tile_features(spark, d), _tile_features(spark, d, edited=True)
    cache = written(vector_tiles.build_tiles(old, [0, 2, 5]), "tile_cache")
    place = F.struct("id", "box")
    gone = old.select(place.alias("p")).exceptAll(new.select(place.alias("p"))).union(new.select(place.alias("p")).exceptAll(old.select(place.alias("p"))))
    now = vector_tiles.refreshed(cache, new, gone.select("p.box.*"), [0, 2, 5])
    return vector_tiles.contents(now).groupBy("z", "x", "y").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


HEX = "lpad(lower(to_hex((255 * (100 - {0}) * (100 - k) // 10000)::BIGINT)), 2, '0')"


@query("lines", ", m(c, v) AS (VALUES ('0', 0), ('A', 8), ('1', 13), ('2', 20), ('3', 30), ('4', 40), ('5', 50), ('6', 60), ('7', 70), ('X', 100)), codes AS (SELECT id, substr('0A1234567X', (id % 10)::INT + 1, 1) || substr('0A1234567X', (id // 10 % 10)::INT + 1, 1) || substr('0A1234567X', (id // 100 % 10)::INT + 1, 1) || CASE WHEN id % 2 = 0 THEN 'A' ELSE '' END AS code FROM lines) "
       f"SELECT id, code, '#' || {HEX.format('c')} || {HEX.format('m')} || {HEX.format('y')} AS color FROM (SELECT id, code, a.v AS c, b.v AS m, e.v AS y, coalesce(f.v, 0) AS k FROM codes JOIN m a ON a.c = code[1] JOIN m b ON b.c = code[2] JOIN m e ON e.c = code[3] LEFT JOIN m f ON f.c = code[4])")
def colour_cmyk(spark, d):
    k, marks = F.col("id"), F.lit("0A1234567X")
    one = lambda n: F.substring(marks, n.cast("int") + 1, F.lit(1))
    code = F.concat(one(k % 10), one(F.floor(k / 10) % 10), one(F.floor(k / 100) % 10), F.when(k % 2 == 0, "A").otherwise(""))
    return I.lines(spark, d).select("id", code.alias("code"), colors.cmyk_hex(code).alias("color"))


# Noding axis-aligned lines.

CUT = """WITH RECURSIVE g AS (SELECT o_orderkey AS id, (o_orderkey * 13) % 997 AS x, (o_orderkey * 7) % 983 AS y, 5 + o_orderkey % 41 AS n, o_orderkey % 2 AS up FROM orders),
h AS (SELECT id, x AS a, x + n AS b, y AS c FROM g WHERE up = 0), v AS (SELECT id, y AS a, y + n AS b, x AS c FROM g WHERE up = 1),
hs AS (SELECT id, c, a AS p FROM h UNION SELECT id, c, b FROM h UNION SELECT h.id, h.c, v.c FROM h JOIN v ON v.c BETWEEN h.a AND h.b AND h.c BETWEEN v.a AND v.b
  UNION SELECT h.id, h.c, unnest([o.a, o.b]) FROM h JOIN h o ON o.c = h.c AND o.id <> h.id),
vs AS (SELECT id, c, a AS p FROM v UNION SELECT id, c, b FROM v UNION SELECT v.id, v.c, h.c FROM v JOIN h ON h.c BETWEEN v.a AND v.b AND v.c BETWEEN h.a AND h.b
  UNION SELECT v.id, v.c, unnest([o.a, o.b]) FROM v JOIN v o ON o.c = v.c AND o.id <> v.id),
hp AS (SELECT id, s.c, p, lead(p) OVER (PARTITION BY id ORDER BY p) AS q FROM hs s JOIN h USING (id) WHERE p BETWEEN a AND b),
vp AS (SELECT id, s.c, p, lead(p) OVER (PARTITION BY id ORDER BY p) AS q FROM vs s JOIN v USING (id) WHERE p BETWEEN a AND b),
pieces AS (SELECT id AS line_id, p AS x1, c AS y1, q AS x2, c AS y2 FROM hp WHERE q IS NOT NULL UNION ALL SELECT id, c, p, c, q FROM vp WHERE q IS NOT NULL),
edge AS (SELECT DISTINCT x1, y1, x2, y2 FROM pieces), node AS (SELECT x1 AS x, y1 AS y FROM edge UNION SELECT x2, y2 FROM edge)
"""


def _noded(spark, d):
    k = F.col("o_orderkey")
    x, y, n, up = (k * 13) % 997, (k * 7) % 983, 5 + k % 41, k % 2 == 1
    rows = I.read(spark, d, "orders").select(k.alias("line_id"), x.alias("x1"), y.alias("y1"), F.when(up, x).otherwise(x + n).alias("x2"), F.when(up, y + n).otherwise(y).alias("y2"))
    return noding.cut_pieces(rows)


@query(None, CUT + "SELECT x1, y1, x2, y2, count(DISTINCT line_id) AS n_lines FROM pieces GROUP BY ALL")
def edge_table(spark, d):
    edges, along = _noded(spark, d)
    return edges.join(along, "edge_id").groupBy("x1", "y1", "x2", "y2").agg(F.count("*").alias("n_lines"))


@query(None, CUT + "SELECT x, y, count(*) AS n_edges FROM (SELECT x1 AS x, y1 AS y FROM edge UNION ALL SELECT x2, y2 FROM edge) GROUP BY ALL")
def node_table(spark, d):
    edges, _ = _noded(spark, d)
    ends = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    return edges.select(F.explode(ends).alias("p")).select("p.*").groupBy("x", "y").agg(F.count("*").alias("n_edges"))


@query(None, CUT + "SELECT (SELECT count(*) FROM node) AS n_nodes, (SELECT count(*) FROM edge) AS n_edges, 1 AS euler")
def euler_check(spark, d):
    """Nodes and edges of the graph, and nodes - edges + faces - parts, the outside counting as a face: by Euler's formula 1."""
    edges, _ = _noded(spark, d)
    _, found = noding.faced(edges)
    parts = components(edges.select(F.col("start_node").alias("a"), F.col("end_node").alias("b")), "parts", SMALL, near=True)
    n = parts.agg(F.count("*").alias("n_nodes"), F.count_distinct("component").alias("n_parts"))
    return n.crossJoin(edges.agg(F.count("*").alias("n_edges"))).crossJoin(found.agg(F.count("*").alias("n_faces"))).select("n_nodes", "n_edges", (F.col("n_nodes") - F.col("n_edges") + F.col("n_faces") - F.col("n_parts")).cast("int").alias("euler"))


# Field data.


@query(None, "SELECT event_id AS id, json_extract_string(props, '$.k') AS k, CASE WHEN json_extract_string(props, '$.k')::BIGINT > 50 THEN 'big ' || json_extract_string(props, '$.k') ELSE json_extract_string(props, '$.k') END AS label FROM events")
def strabo_flatten(spark, d):
    k = F.get_json_object("props", "$.k")
    return I.read(spark, d, "events").select(F.col("event_id").alias("id"), k.alias("k"), F.when(k.cast("long") > 50, F.concat(F.lit("big "), k)).otherwise(k).alias("label"))


@query(None, """WITH spots AS (SELECT event_id AS spot_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events), spot_tags AS (SELECT spot_id, unnest(CASE WHEN k % 3 = 0 THEN [k % 5, k % 7] ELSE [k % 5] END) AS tag_id FROM spots), st AS (SELECT DISTINCT * FROM spot_tags), tags AS (SELECT tag_id, 'tag ' || tag_id AS name FROM (SELECT unnest(range(0, 6)) AS tag_id))
SELECT spot_id, st.tag_id, name FROM spots LEFT JOIN st USING (spot_id) LEFT JOIN tags ON tags.tag_id = st.tag_id""")
def strabo_tags(spark, d):
    """Spots with their tags: a row per tag."""
    spots = I.read(spark, d, "events").select(F.col("event_id").alias("spot_id"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    tagged = spots.select("spot_id", F.explode(F.when(F.col("k") % 3 == 0, F.array(F.col("k") % 5, F.col("k") % 7)).otherwise(F.array(F.col("k") % 5))).alias("tag_id")).distinct()
    tags = spark.range(6).select(F.col("id").alias("tag_id"), F.concat(F.lit("tag "), "id").alias("name"))
    return spots.join(tagged, "spot_id", "left").join(F.broadcast(tags), "tag_id", "left").select("spot_id", "tag_id", "name")



@query("boxes", "SELECT a.id AS a_id, b.id AS b_id FROM boxes a JOIN (SELECT *, w + (id % 3 = 2)::INT AS v FROM boxes) b ON a.x = b.x AND a.y = b.y AND a.w = b.v AND a.h = b.h")
def geometry_equals(spark, d):
    """Boxes against the same ones written otherwise: another start and direction, a point more in line, or wider by one."""
    k, x, y = F.col("id") % 3, F.col("x") + F.col("w") + F.when(F.col("id") % 3 == 2, 1).otherwise(0), F.col("y") + F.col("h")
    other = I.boxes(spark, d).select("id", "x", "y", x.alias("u"), y.alias("v"), k.alias("k"))
    turned, longer = "MULTIPOLYGON(((%3$d %4$d,%3$d %2$d,%1$d %2$d,%1$d %4$d,%3$d %4$d)))", "POLYGON((%1$d %2$d,%1$d.5 %2$d,%3$d %2$d,%3$d %4$d,%1$d %4$d,%1$d %2$d))"
    corners = ("x", "y", "u", "v")
    text = F.when(F.col("k") == 0, F.format_string(turned, *corners)).otherwise(F.format_string(longer, *corners))
    return units.equal(I.box_shapes(spark, d), I.files.parse_geometry(other.select("id", text.alias("wkt")), "wkt"))


# Updates of regions.

PLOTS = "plots AS (SELECT p_partkey AS p, (p_partkey % 100) * 20 AS x, (p_partkey // 100) * 20 AS y, 2 + 2 * (p_size % 4) AS s, p_brand AS kind FROM part)"


def _plots(spark, d):
    """Squares apart from one another, some with a divider, as lines; and polygons that name them."""
    p = F.col("p_partkey")
    return I.read(spark, d, "part").select(p.cast("int").alias("p"), (p % 100 * 20).alias("x"), (F.floor(p / 100) * 20).alias("y"), (2 + 2 * (F.col("p_size") % 4)).alias("s"), F.col("p_brand").alias("kind"))


def _plot_tables(plots, divided):
    ring, divider = "LINESTRING(%1$d %2$d,%3$d %2$d,%3$d %4$d,%1$d %4$d,%1$d %2$d)", "LINESTRING(%1$d %2$d,%1$d %3$d)"
    x, y, s = F.col("x"), F.col("y"), F.col("s")
    one = lambda rows, k, wkt: rows.select((F.col("p") * 2 + k).alias("id"), wkt.alias("wkt"), F.lit("contact").alias("type"), F.lit(2).alias("map_layer"))
    lines = one(plots, 0, F.format_string(ring, x, y, x + s, y + s)).union(one(plots.where(divided), 1, F.format_string(divider, x + 1, y, y + s)))
    box = "POLYGON((%1$d.25 %2$d.25,%1$d.75 %2$d.25,%1$d.75 %2$d.75,%1$d.25 %2$d.75,%1$d.25 %2$d.25))"
    named = plots.where("p % 3 = 0").select(F.col("p").alias("id"), F.format_string(box, "x", "y").alias("wkt"), F.col("kind").alias("type"), F.lit(2).alias("map_layer"))
    return {n: I.files.parse_geometry(t, "wkt").select("id", "geometry", "type", "map_layer") for n, t in (("linework", lines), ("polygon", named))}


@query(None, f"""WITH {PLOTS}, now AS (SELECT p, CASE WHEN p % 50 = 0 THEN s + 2 ELSE s END AS s, CASE WHEN p % 50 = 12 THEN 'changed' ELSE kind END AS kind, (p % 2 = 0 AND p % 50 <> 0) OR p % 50 = 9 AS divided FROM plots WHERE p % 50 <> 7)
SELECT p, 0 AS side, (CASE WHEN divided THEN s ELSE s * s END)::DOUBLE AS area, CASE WHEN p % 3 = 0 THEN kind END AS unit_id FROM now
UNION ALL SELECT p, 1, ((s - 1) * s)::DOUBLE, NULL FROM now WHERE divided""")
def incremental_solve(spark, d):
    """Map faces after edits of some plots: only their regions are solved again."""
    p = F.col("p") % 50
    before = _plots(spark, d)
    after = before.where(p != 7).withColumn("s", F.when(p == 0, F.col("s") + 2).otherwise(F.col("s"))).withColumn("kind", F.when(p == 12, "changed").otherwise(F.col("kind")))
    session = TopoSession(spark, scratch_path(spark, "plots"), UNIT)
    session.create(I.layers(spark))
    session.update(_plot_tables(before, F.col("p") % 2 == 0))
    session.update(_plot_tables(after, ((F.col("p") % 2 == 0) & (p != 0)) | (p == 9)))
    box = units.boxed(session.map_faces(), "area double, unit_id string")
    x, y = F.col("box.xmin").cast("long"), F.col("box.ymin").cast("long")
    return box.select((F.floor(y / 20) * 100 + F.floor(x / 20)).alias("p"), (x % 20).cast("int").alias("side"), "area", "unit_id")
