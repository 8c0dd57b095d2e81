"""The golden scenarios of FIXTURES.md, end to end."""

import pytest

from planar_spark.config import TopoConfig
from planar_spark.kernel import planar, wkb
from planar_spark.plans.solve import TopoSession

LAYERS = [(0, "Default", None, None, True), (1, "surficial", None, None, True), (2, "bedrock", None, None, True), (3, "other", None, None, False)]
SURFICIAL, BEDROCK, OTHER = 1, 2, 3


def line(text):
    return wkb.encode(wkb.multi(wkb.parse(text)[0]))


def ring(size, x, y):
    h = size / 2
    return f"({x - h} {y - h},{x + h} {y - h},{x + h} {y + h},{x - h} {y + h},{x - h} {y - h})"


@pytest.fixture
def topo(spark, tmp_path):
    s = TopoSession(spark, f"file://{tmp_path}/store", TopoConfig(32612, 0.1))
    s.create(spark.createDataFrame(LAYERS, "id int, name string, description string, parent int, topological boolean"))
    s.count = 0

    def add(table, text, kind, layer):
        s.count += 1
        s.insert(table, spark.createDataFrame([(s.count, bytearray(line(text)), kind, layer)], "id int, geometry binary, type string, map_layer int"))

    s.add = add
    return s


def solved(topo):
    topo.update()
    return sorted((r["map_layer"], round(r["area"], 6), r["unit_id"]) for r in topo.map_faces().collect())


def test_triangle(topo):
    topo.add("linework", "LINESTRING(16.17 -24.364, 16.182 -24.348)", "contact", BEDROCK)
    topo.add("linework", "LINESTRING(0 0, 5 0)", "contact", BEDROCK)
    topo.add("linework", "LINESTRING(5 0, 3 4, 0 0)", "contact", BEDROCK)
    topo.add("polygon", "POLYGON((2 0.5, 3 0.5, 3 1, 2 0.5))", "upper-omkyk", BEDROCK)
    assert solved(topo) == [(BEDROCK, 10.0, "upper-omkyk")]
    topo.set("linework", "id = 3", type="anticline-hinge")
    assert solved(topo) == [(BEDROCK, 10.0, "upper-omkyk")]
    topo.set("linework", "id = 3", map_layer=OTHER)
    assert solved(topo) == []


def test_two_layers(topo):
    topo.add("linework", "LINESTRING" + ring(6, 3, 3), "contact", BEDROCK)
    topo.add("linework", "LINESTRING" + ring(2, 3, 3), "contact", SURFICIAL)
    topo.add("polygon", f"POLYGON({ring(1, 3, 3)})", "upper-omkyk", BEDROCK)
    topo.add("polygon", f"POLYGON({ring(1, 3, 3)})", "terrace", SURFICIAL)
    assert solved(topo) == [(SURFICIAL, 4.0, "terrace"), (BEDROCK, 36.0, "upper-omkyk")]
    version = topo.store.versions()[-1]
    topo.delete("linework", f"map_layer = {SURFICIAL}")
    assert solved(topo) == [(BEDROCK, 36.0, "upper-omkyk")]
    topo.store.rollback(version)
    topo.delete("linework", f"map_layer = {BEDROCK}")
    assert solved(topo) == [(SURFICIAL, 4.0, "terrace")]


def test_nested_squares(topo):
    topo.add("linework", "LINESTRING" + ring(6, 3, 3), "contact", BEDROCK)
    topo.add("linework", "LINESTRING" + ring(2, 3, 3), "contact", BEDROCK)
    assert solved(topo) == [(BEDROCK, 4.0, None), (BEDROCK, 32.0, None)]
    topo.add("polygon", f"POLYGON({ring(1, 1, 1)})", "upper-omkyk", BEDROCK)
    topo.add("polygon", f"POLYGON({ring(1, 3, 3)})", "terrace", SURFICIAL)
    topo.add("polygon", f"POLYGON({ring(0.5, 3, 3)})", "lower-omkyk", BEDROCK)
    assert solved(topo) == [(BEDROCK, 4.0, "lower-omkyk"), (BEDROCK, 32.0, "upper-omkyk")]
    point = wkb.parse("POINT(3 3)")[0]
    assert sum(planar.intersects(wkb.decode(bytes(r["geometry"]))[0], point) for r in topo.map_faces().collect()) == 1
    topo.delete("polygon", "type = 'lower-omkyk'")
    topo.delete("linework", "id = 2")
    assert solved(topo) == [(BEDROCK, 36.0, "upper-omkyk")]


def test_crossing_lines_and_bad_geometry(topo, spark):
    topo.add("linework", "LINESTRING" + ring(4, 2, 2), "contact", BEDROCK)
    topo.add("linework", "LINESTRING(-1 2, 5 2)", "contact", BEDROCK)
    topo.add("linework", "LINESTRING(2 -1, 2 5)", "contact", BEDROCK)
    topo.insert("linework", spark.createDataFrame([(99, bytearray(b"\x01\x02"), "contact", BEDROCK)], "id int, geometry binary, type string, map_layer int"))
    assert solved(topo) == [(BEDROCK, 4.0, None)] * 4
    assert [r["line_id"] for r in topo.store.read("linework_topo").where("topology_error is not null").collect()] == [99]
    n = {k: topo.store.read(k).count() for k in ("edge", "face")}
    ends = topo.store.read("edge")
    nodes = ends.select("start_node").union(ends.select("end_node")).distinct().count()
    assert nodes - n["edge"] + n["face"] == 1 + 1
