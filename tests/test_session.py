"""The steps of an update on their own, lookups, and the clean-up."""

from test_scenarios import BEDROCK, line, ring, topo  # noqa: F401


def test_steps_lookups_and_clean_up(spark, topo):  # noqa: F811
    topo.add("linework", "LINESTRING" + ring(4, 3, 3), "contact", BEDROCK)
    topo.add("polygon", f"POLYGON({ring(1, 3, 3)})", "terrace", BEDROCK)
    assert topo.pending().count() == 1
    topo.update_contacts()
    read = topo.store.read
    assert [tuple(r) for r in read("dirty_face").collect()] == [(1, BEDROCK)] and topo.pending().count() == 0 and read("map_face").count() == 0
    assert {(r["x"], r["y"]) for r in read("node").collect()} == {(1.0, 1.0), (1.0, 5.0), (5.0, 1.0), (5.0, 5.0)}
    topo.update_faces()
    asked = spark.createDataFrame([(1, BEDROCK), (9, BEDROCK)], "face_id long, map_layer int")
    assert [(r["face_id"], r["unit_id"]) for r in topo.unit_for_face(asked).collect()] == [(1, "terrace")]
    assert [(r["face_id"], r["area"]) for r in topo.face_data().collect()] == [(1, 16.0)] and read("dirty_face").count() == 0
    topo.set("linework", "id = 1", geometry=bytearray(line("LINESTRING" + ring(2, 3, 3))))
    assert topo.pending().count() == 1
    topo.delete("linework", "id = 1")
    topo.clean()
    assert [read(t).count() for t in ("edge", "node", "edge_relation", "face_type")] == [0, 0, 0, 0]
    assert [tuple(r) for r in read("face").select("face_id", "area").collect()] == [(0, 0.0)]
    topo.forget()
    assert not topo.store.exists("edge") and topo.store.exists("linework")


def test_seeds_and_holes(spark, tmp_path):
    from planar_spark.config import TopoConfig
    from planar_spark.plans.solve import TopoSession

    s = TopoSession(spark, f"file://{tmp_path}/store", TopoConfig(32612, 0.1))
    s.store.create_empty()
    s.seed()
    s.seed()  # nothing comes twice
    read = s.store.read
    assert [(r["id"], r["name"], r["topological"]) for r in read("map_layer").collect()] == [(0, "Default", True)]
    assert [tuple(r) for n in ("linework_type", "polygon_type") for r in read(n).select("id", "name", "color").collect()] == [("default", "Default", "#000000")] * 2
    s.insert("linework", spark.createDataFrame([(1, bytearray(line("LINESTRING" + ring(4, 3, 3))), "default", 0)], "id int, geometry binary, type string, map_layer int"))
    assert read("linework").where("created is not null").count() == 1
    s.update()
    assert s.map_faces().count() == 1
    s.store.commit({n: read(n).limit(0) for n in ("map_face", "map_face_face", "face_type")})
    s.fill_holes()
    assert read("dirty_face").count() == 1
    s.update()
    assert s.map_faces().count() == 1 and read("dirty_face").count() == 0
