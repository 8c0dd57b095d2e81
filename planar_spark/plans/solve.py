"""The solve: lines and identifying polygons to labelled map faces, and a session that keeps them current, region by region."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..config import TopoConfig
from ..operators import dml, faces, graph, linework, noding, units
from ..store import Store, stored as written

BOX = ["xmin", "ymin", "xmax", "ymax"]
MARGIN = 4  # steps of the grid between regions that are solved apart: rounding moves a point by less than one a round


def _top(layers: DataFrame) -> DataFrame:
    return layers.where("topological").select(F.col("id").alias("map_layer"))


def contacts(lines: DataFrame, layers: DataFrame, cfg: TopoConfig) -> dict[str, DataFrame]:
    """The graph of the lines, its primitive faces, its regions, and which lines are boundaries: written tables, in coordinates."""
    top = _top(layers)
    mapped = lines.join(F.broadcast(top), "map_layer", "left_semi")
    edges, line_edge, errors = noding.noded(mapped, cfg)
    edges, primitive = noding.faced(edges)
    edges = written(edges, "faced")
    region_of = written(noding.regions(edges), "part_regions")
    at = {c: (F.col(c) * cfg.tolerance).alias(c) for c in ("x1", "y1", "x2", "y2")}
    edges = written(edges.join(region_of, "part").select("edge_id", "start_node", "end_node", "left_face", "right_face", *at.values(), "region"), "edge")
    of_face = edges.select(F.explode(F.array("left_face", "right_face")).alias("face_id"), "region").where("face_id <> 0").distinct()
    primitive = primitive.withColumn("area", F.col("area") * cfg.tolerance**2).join(of_face, "face_id", "left")
    primitive = written(primitive.select("face_id", "area", F.coalesce("region", F.lit(0)).alias("region")), "face")
    of_edge = edges.select("edge_id", "region")
    line_edge = written(line_edge.join(of_edge, "edge_id").select("line_id", "edge_id", "region"), "line_edge")
    relation = faces.link_edges(line_edge, mapped.withColumn("topology", F.col("map_layer")))
    relation = written(relation.join(of_edge, "edge_id"), "edge_relation")
    box = [F.min(F.least("x1", "x2")).alias("xmin"), F.min(F.least("y1", "y2")).alias("ymin"), F.max(F.greatest("x1", "x2")).alias("xmax"), F.max(F.greatest("y1", "y2")).alias("ymax")]
    state = lines.join(errors.groupBy("line_id").agg(F.first("error").alias("topology_error")), lines["id"] == F.col("line_id"), "left").drop("line_id")
    of_line = line_edge.groupBy("line_id").agg(F.min("region").alias("region"))
    state = state.join(of_line, state["id"] == of_line["line_id"], "left")
    state = state.select(F.col("id").alias("line_id"), F.when(F.col("topology_error").isNull(), F.md5("geometry")).alias("geometry_hash"), "topology_error", "map_layer", "type", "region")
    return {
        "node": graph.nodes(edges), "edge": edges, "line_edge": line_edge, "face": primitive, "edge_relation": relation, "linework_topo": state,
        "region": written(edges.groupBy("region").agg(*box), "region"),
    }


def map_faces(graph_of: dict[str, DataFrame], polygons: DataFrame, layers: DataFrame, cfg: TopoConfig, literal: bool = False) -> dict[str, DataFrame]:
    """Map faces of a graph (``edge``, ``face``, ``edge_relation`` of ``contacts``), labelled by ``polygons``."""
    grid = graph_of["edge"]
    for c in ("x1", "y1", "x2", "y2"):
        grid = grid.withColumn(c, F.round(F.col(c) / cfg.tolerance).cast("long"))
    comps = written(graph.dissolved(graph_of["face"], grid, graph_of["edge_relation"], _top(layers), literal), "components")
    shapes = written(noding.polygons(grid, comps, cfg), "shapes")
    named = shapes.join(units.units(shapes, polygons), ["map_layer", "comp"], "left")
    named = named.join(graph_of["face"].select(F.col("face_id").alias("comp"), "region"), "comp")  # a component is named by one of its faces
    found = noding.numbered(named.select("unit_id", "map_layer", "geometry", "area", "comp", "region"), ["map_layer", "comp"], "id")
    members = comps.join(found.select("map_layer", "comp", F.col("id").alias("map_face"), "region"), ["map_layer", "comp"]).select("map_face", "map_layer", "face_id", "region")
    return {"map_face": found.select("id", "unit_id", "map_layer", "geometry", "area", "region"), "map_face_face": members, "face_type": registered(found, members)}


def registered(found: DataFrame, members: DataFrame) -> DataFrame:
    return faces.register(found, members.drop("region")).join(members.select("face_id", "map_layer", "map_face", "region"), ["face_id", "map_layer", "map_face"]).select("face_id", "map_face", "map_layer", "unit_id", "region")


def polygon_state(polygons: DataFrame) -> DataFrame:
    """(polygon_id, digest, map_layer, box): what labels depend on."""
    rows = polygons.select("id", "map_layer", F.md5(F.concat(F.hex("geometry"), F.lit("/"), F.coalesce("type", F.lit("")))).alias("digest"), "geometry")
    return units.boxed(rows, "id int, map_layer int, digest string").select(F.col("id").alias("polygon_id"), "digest", "map_layer", "box")


def solve(lines: DataFrame, polygons: DataFrame, layers: DataFrame, cfg: TopoConfig, literal: bool = False) -> dict[str, DataFrame]:
    """All derived tables. ``lines`` (id, geometry, type, map_layer), ``polygons`` (id, geometry, type, map_layer), ``layers`` (id, topological)."""
    found = contacts(lines, layers, cfg)
    return found | map_faces(found, polygons, layers, cfg, literal)


#: Columns with ids, by which of the ids they hold. Face 0 is everyone's.
IDS = {"edge_id": "edge", "start_node": "node", "end_node": "node", "node_id": "node", "left_face": "face", "right_face": "face", "face_id": "face", "map_face": "map_face", "region": "region"}


def shifted(tables: dict[str, DataFrame], highest: dict[str, int]) -> dict[str, DataFrame]:
    """Tables whose ids begin after the highest ones given so far."""

    def moved(name: str, c: str) -> Column:
        kind = "map_face" if (name, c) == ("map_face", "id") else IDS.get(c)
        if kind is None:
            return F.col(c)
        return (F.when(F.col(c) > 0, F.col(c) + highest[kind]).otherwise(F.col(c)) if kind == "face" else F.col(c) + highest[kind]).alias(c)

    return {n: df.select(*[moved(n, c) for c in df.columns]) for n, df in tables.items()}


class TopoSession:
    """Source tables and the topology derived from them, in one store.

    ``update`` solves only regions that an edit may touch. A region is all that lies within one outline, so its faces, map faces and labels depend on nothing
    outside it. Touched are the regions of lines that changed or went, and those whose boxes meet new lines' boxes; their lines are
    solved together, and if the new regions come near others, these join in. Changed polygons only label anew the map faces of regions under them. Other
    regions keep their ids, and buckets of files without touched regions are not rewritten.
    """

    def __init__(self, spark: SparkSession, root: str, cfg: TopoConfig | None = None):
        self.spark, self.store, self.cfg = spark, Store(spark, root), cfg or TopoConfig()

    def create(self, layers: DataFrame) -> int:
        self.store.create_empty()
        return self.store.commit({"map_layer": layers})

    def seed(self) -> int:
        """The rows that a new topology begins with: a default layer, and a default type of lines and of polygons where there is none."""
        kinds = self.spark.createDataFrame([("default", "Default", "#000000")], "id string, name string, color string")
        layer = self.spark.createDataFrame([(0, "Default", True)], "id int, name string, topological boolean")
        out = {"map_layer": dml.insert_ignore(self.store.read("map_layer"), self.store.read("map_layer").limit(0).unionByName(layer, allowMissingColumns=True), ["id"])}
        for name in ("linework_type", "polygon_type"):
            old = self.store.read(name)
            if old.isEmpty():
                out[name] = old.unionByName(kinds, allowMissingColumns=True)
        return self.store.commit(out)

    def fill_holes(self) -> int:
        """Faces without a map face in a topological layer become dirty: the next update solves their regions again."""
        read = self.store.read
        open_ = faces.holes(read("face"), _top(read("map_layer")), read("face_type"))
        return self.store.commit({"dirty_face": read("dirty_face").unionByName(open_.select("id", "map_layer")).distinct()})

    def insert(self, table: str, rows: DataFrame) -> int:
        if "created" in schema.of(table).names:
            rows = rows.withColumn("created", F.coalesce(F.col("created") if "created" in rows.columns else F.lit(None), F.current_timestamp().cast("timestamp_ntz")))
        return self.store.commit({table: self.store.read(table).unionByName(rows, allowMissingColumns=True)})

    def delete(self, table: str, condition: str) -> int:
        return self.store.commit({table: dml.delete_where(self.store.read(table), F.expr(condition))})

    def set(self, table: str, condition: str, **values) -> int:
        old = self.store.read(table)
        hit = F.coalesce(F.expr(condition), F.lit(False))
        return self.store.commit({table: old.select(*[F.when(hit, F.lit(values[c])).otherwise(F.col(c)).cast(old.schema[c].dataType).alias(c) if c in values else F.col(c) for c in old.columns])})

    def pending(self) -> DataFrame:
        """Lines that the topology does not hold yet, or holds with another geometry."""
        known = self.store.read("linework_topo").select(F.col("line_id").alias("id"), "geometry_hash", "topology_error")
        lines = self.store.read("linework").join(known, "id", "left")
        same = F.col("geometry_hash") == F.md5("geometry")
        return linework.pending(lines.withColumn("geometry_hash", F.when(same, F.col("geometry_hash"))), self.store.read("map_layer"))

    def update_contacts(self) -> int:
        """Only the graph: faces beside new and changed lines become dirty, and map faces wait for ``update_faces``."""
        read = self.store.read
        changed = written(self.pending().withColumn("topology", F.col("map_layer")), "pending")
        tables = contacts(read("linework"), read("map_layer"), self.cfg)
        dirty = faces.surrounding(tables["line_edge"], tables["edge"], changed).where("id <> 0")
        return self.store.commit(tables | {"dirty_face": dirty.union(read("dirty_face")).distinct()}, facts={"solved": None})

    def update_faces(self) -> int:
        """Only the map faces of the graph as it stands."""
        read = self.store.read
        tables = map_faces({t: read(t) for t in ("edge", "face", "edge_relation")}, read("polygon"), read("map_layer"), self.cfg)
        return self._commit({n: read(n) for n in ("node", "edge", "face", "region")} | tables, tables | {"polygon_topo": polygon_state(read("polygon"))}, {})

    def update(self, sources: dict[str, DataFrame] | None = None, applied: dict[str, int] | None = None, whole: bool = False) -> int:
        """Solve what changed, and commit the new tables with the notification of what changed, as one version.

        ``sources``: new source tables, committed with what is derived from them; ``applied``: the stream's batch that they come from. ``whole`` solves everything.
        """
        base, read = self.store.latest(), self.store.read
        sources = {n: written(df, n) for n, df in (sources or {}).items()}
        lines, polygons, layers = (sources[n] if n in sources else read(n) for n in ("linework", "polygon", "map_layer"))
        if whole or self.store.facts().get("solved") != self._setting(layers):
            tables = solve(lines, polygons, layers, self.cfg)
            return self._commit(tables, tables | sources | {"polygon_topo": polygon_state(polygons)}, {}, base, applied)
        return self._update_regions(base, sources, lines, polygons, layers, applied)

    def _setting(self, layers: DataFrame) -> str:
        """What a solve of single regions can't change: the grid and which layers are topological."""
        top = sorted(r["map_layer"] for r in _top(layers).collect())  # a dimension
        return hashlib.md5(f"{self.cfg.tolerance} {top}".encode()).hexdigest()

    def _update_regions(self, base: int, sources: dict[str, DataFrame], lines: DataFrame, polygons: DataFrame, layers: DataFrame, applied: dict[str, int] | None) -> int:
        read, margin = self.store.read, MARGIN * self.cfg.tolerance
        known = read("linework_topo")
        now = lines.select("id", F.md5("geometry").alias("h"), F.col("map_layer").alias("layer"), F.col("type").alias("kind"))
        both = known.join(now, known["line_id"] == now["id"], "full_outer")
        same = F.col("topology_error").isNull() & F.col("geometry_hash").eqNullSafe(F.col("h")) & F.col("map_layer").eqNullSafe(F.col("layer")) & F.col("type").eqNullSafe(F.col("kind"))
        changed = written(both.where(~same | F.col("id").isNull() | F.col("line_id").isNull()).select(F.coalesce("id", "line_id").alias("line_id"), "region"), "changed_lines")
        # Regions of dirty faces are solved again too: a clean-up leaves them without map faces.
        dirty = read("dirty_face").select(F.col("id").alias("face_id")).distinct().join(read("face"), "face_id").where("region <> 0").select("region")
        boxes = units.boxed(lines.join(changed, lines["id"] == changed["line_id"], "left_semi").join(F.broadcast(_top(layers)), "map_layer", "left_semi"), "id int")
        held = read("region").select("region", F.struct(*BOX).alias("b_box"))
        near = units.box_join(boxes.select("box"), held, [], margin).select("region")
        touched = written(changed.select("region").where("region is not null").union(dirty).union(near).distinct(), "touched")
        while True:
            mine = known.join(F.broadcast(touched) if touched.count() < 100_000 else touched, "region", "left_semi").select("line_id").union(changed.select("line_id")).distinct()
            new = contacts(lines.join(mine, lines["id"] == mine["line_id"], "left_semi"), layers, self.cfg)
            others = held.join(touched, "region", "left_anti")
            met = written(units.box_join(new["region"].select(F.struct(*BOX).alias("box")), others, [], margin).select("region").distinct(), "met")
            if met.isEmpty():
                break
            touched = written(touched.union(met), "touched")
        # Polygons that changed, and those that lie where labels are open.
        was = read("polygon_topo")
        will = written(polygon_state(polygons), "polygon_state")
        keys = ["polygon_id", "digest", "map_layer"]
        open_ = was.join(will.select(*keys), keys, "left_anti").union(will.join(was.select(*keys), keys, "left_anti"))
        open_ = written(open_.select("polygon_id", "box"), "changed_polygons")
        under = written(units.box_join(open_.select("box"), held.join(touched, "region", "left_anti"), []).select("region").distinct(), "relabelled")
        where = new["region"].select(F.struct(*BOX).alias("b_box")).union(held.join(under, "region", "left_semi").select("b_box"))
        asked = written(units.box_join(will.select("polygon_id", "box"), where, []).select("polygon_id").distinct(), "asked_polygons")
        asked = written(polygons.join(asked, polygons["id"] == asked["polygon_id"], "left_semi"), "near_polygons")
        new |= map_faces(new, asked, layers, self.cfg)
        facts = self.store.facts()
        new = shifted(new, facts["highest"])
        state = new.pop("linework_topo")
        new["face"] = new["face"].where("face_id <> 0")
        gone = written(touched.union(new["region"].select("region")).distinct(), "replaced_regions")
        replaced = {n: self._buckets(n, gone) for n in (*schema.REGIONAL, "region")}
        out = {n: read(n, buckets=replaced[n]).join(touched, "region", "left_anti").unionByName(new[n]) for n in new}
        # Labels of map faces whose lines stand as they were.
        old_faces = read("map_face", buckets=self._buckets("map_face", touched.union(under)))
        again = old_faces.join(under, "region", "left_semi").withColumn("comp", F.col("id")).drop("unit_id")
        again = again.join(units.units(again.select("map_layer", "comp", "geometry"), asked), ["map_layer", "comp"], "left")
        again = written(again.select("id", "unit_id", "map_layer", "geometry", "area", "region"), "relabelled_faces")
        if not again.isEmpty():
            more = {n: sorted({*replaced[n], *self._buckets(n, under)}) for n in ("map_face", "face_type")}
            kept = lambda n: read(n, buckets=more[n]).join(touched.union(under), "region", "left_anti")
            label = again.select(F.col("id").alias("map_face"), "map_layer", "unit_id")
            types = read("face_type", buckets=more["face_type"]).join(under, "region", "left_semi").drop("unit_id").join(label, ["map_face", "map_layer"])
            out |= {"map_face": kept("map_face").unionByName(new["map_face"]).unionByName(again), "face_type": kept("face_type").unionByName(new["face_type"]).unionByName(types)}
            replaced |= more
        rows = state.select("line_id").union(changed.select("line_id")).distinct()
        replaced["linework_topo"] = self._buckets("linework_topo", rows)
        out["linework_topo"] = read("linework_topo", buckets=replaced["linework_topo"]).join(rows, "line_id", "left_anti").unionByName(state)
        rows = open_.select("polygon_id").distinct()
        replaced["polygon_topo"] = self._buckets("polygon_topo", rows)
        out["polygon_topo"] = read("polygon_topo", buckets=replaced["polygon_topo"]).join(rows, "polygon_id", "left_anti").unionByName(will.join(rows, "polygon_id", "left_semi"))
        old = old_faces.join(touched.union(under), "region", "left_semi")
        return self._commit(new, out | sources, replaced, base, applied, old, new["map_face"].unionByName(again))

    def _buckets(self, name: str, rows: DataFrame) -> list[int]:
        key = self.store.bucket(name)
        return sorted(r["k"] for r in rows.select(key.alias("k")).distinct().collect())  # as many as there are buckets at most

    def clean(self) -> int:
        """Relations of lines that are gone, edges in no line, and nodes at no edge go; map faces over faces that became one go too and wait, dirty,
        for the next update; one version."""
        read = self.store.read
        names = ("edge", "line_edge", "edge_relation", "face", "map_face", "map_face_face", "face_type", "linework_topo", "dirty_face")
        return self.store.commit(graph.cleaned({n: read(n) for n in names}, read("linework")))

    def unit_for_face(self, asked: DataFrame) -> DataFrame:
        """The map faces over ``asked`` (face_id, map_layer)."""
        return faces.containing(self.store.read("map_face"), self.store.read("map_face_face"), asked)

    def face_data(self) -> DataFrame:
        """(face_id, geometry, area) of the primitive faces."""
        return noding.face_data(self.store.read("edge"), self.cfg)

    def _commit(self, solved: dict[str, DataFrame], tables: dict[str, DataFrame], replaced: dict[str, list[int]], base: int | None = None, applied: dict[str, int] | None = None, old: DataFrame | None = None, new: DataFrame | None = None) -> int:
        """Commit ``tables`` with a notification. ``solved`` has the newest ids; ``old`` and ``new`` are the map faces that may differ (all, if not given)."""
        read, layers = self.store.read, tables.get("map_layer", self.store.read("map_layer"))
        part = old is not None
        old, new = (old, new) if part else (read("map_face"), tables["map_face"])
        boxed = lambda df: units.boxed(df.withColumn("unit_id", F.coalesce("unit_id", F.lit(""))), "id long, unit_id string, map_layer int")
        flat = lambda df: boxed(df).select(F.md5("geometry").alias("shape"), "map_layer", "unit_id", "box.*")
        facts = self.store.facts()
        was, now = old.count(), new.count()
        rest = facts["map_faces"] - was if part else 0
        counts = faces.difference(flat(old), flat(new), ["shape", "map_layer", "unit_id"]).withColumn("n_faces", F.col("n_faces") + rest)
        said = faces.payload(counts, "map_face")
        seq = read("notification").agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).first()[0]
        said = read("notification").unionByName(said.select(F.lit(seq).cast("long").alias("seq"), F.lit("topology").alias("channel"), "payload"))
        ids = {"edge": "edge_id", "node": "node_id", "face": "face_id", "map_face": "id", "region": "region"}
        last = facts.get("highest", {}) if part else {}
        highest = {n: max(last.get(n, 0), solved[n].agg(F.max(c)).first()[0] or 0) for n, c in ids.items()}
        done = tables | {"notification": said, "dirty_face": read("dirty_face").limit(0)}
        return self.store.commit(done, base, applied, replaced, {"solved": self._setting(layers), "highest": highest, "map_faces": rest + now})

    def map_faces(self) -> DataFrame:
        return self.store.read("map_face")

    def reset(self) -> int:
        """Forget everything derived."""
        return self.store.commit({n: self.spark.createDataFrame([], schema.of(n)) for n in schema.DERIVED}, facts={"solved": None})

    def forget(self) -> int:
        """Drop the derived tables themselves, their notifications included."""
        self.store.commit({}, facts={"solved": None})
        return self.store.drop(list(schema.DERIVED))
