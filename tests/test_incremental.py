"""Updates of single regions against the solve of everything, and what they leave alone."""

import random

import pytest
from test_scenarios import BEDROCK, OTHER, SURFICIAL, line, ring, topo  # noqa: F401

from planar_spark.plans.solve import solve
from planar_spark.store import Conflict
from planar_spark.streaming import watch as w

COLUMNS = "id int, geometry binary, type string, map_layer int"


def shapes(tables, read=None):
    """What a topology says, whatever its ids."""
    get = tables.__getitem__ if read is None else read
    edge = {r["edge_id"]: (r["x1"], r["y1"], r["x2"], r["y2"]) for r in get("edge").collect()}
    area = {r["face_id"]: round(r["area"], 6) for r in get("face").collect()}
    face = {r["id"]: (r["map_layer"], bytes(r["geometry"]), round(r["area"], 6), r["unit_id"]) for r in get("map_face").collect()}
    assert len(face) == get("map_face").count() and len(edge) == get("edge").count() and len(area) == get("face").count()
    return {
        "edge": sorted(edge.values()), "face": sorted(area.values()), "map_face": sorted(face.values(), key=str),
        "sides": sorted((edge[r["edge_id"]], area[r["left_face"]], area[r["right_face"]]) for r in get("edge").collect()),
        "line_edge": sorted((r["line_id"], edge[r["edge_id"]]) for r in get("line_edge").collect()),
        "relation": sorted((edge[r["edge_id"]], r["map_layer"], r["line_id"], r["type"]) for r in get("edge_relation").collect()),
        "node": sorted((r["x"], r["y"]) for r in get("node").collect()),
        "cover": sorted(((face[r["map_face"]], area[r["face_id"]], r["unit_id"] == face[r["map_face"]][3]) for r in get("face_type").collect()), key=str),
        "topo": sorted((r["line_id"], r["geometry_hash"], r["map_layer"], r["type"]) for r in get("linework_topo").collect()),
    }


@pytest.mark.parametrize("seed", [2])
def test_updates_equal_the_solve_of_everything(spark, topo, seed):  # noqa: F811
    rng = random.Random(seed)
    place = lambda: (rng.randrange(0, 40, 2), rng.randrange(0, 40, 2))

    def new_line(i):
        x, y = place()
        kind = rng.random()
        if kind < 0.55:
            return i, "LINESTRING" + ring(rng.choice([2, 4, 6]), x, y)
        if kind < 0.65:  # around much of it
            return i, "LINESTRING" + ring(24, 20, 20)
        u, v = place()
        return i, f"LINESTRING({x} {y},{x + u % 9 + 1} {y + v % 7})"

    rows = lambda made, kind: spark.createDataFrame([(i, bytearray(line(t)), rng.choice("abc") if kind == "linework" else rng.choice(["u1", "u2"]), rng.choice([SURFICIAL, BEDROCK, BEDROCK, OTHER])) for i, t in made], COLUMNS)
    topo.insert("linework", rows([new_line(i) for i in range(14)], "linework"))
    topo.insert("polygon", rows([(i, f"POLYGON({ring(1, *place())})") for i in range(10)], "polygon"))
    topo.update()
    kept = 14
    for _ in range(1):
        some = ",".join(str(rng.randrange(kept)) for _ in range(2))
        topo.delete("linework", f"id in ({some})")
        topo.set("linework", f"id = {rng.randrange(kept)}", map_layer=rng.choice([SURFICIAL, BEDROCK, OTHER]), type="moved")
        topo.insert("linework", rows([new_line(i) for i in range(kept, kept + 3)], "linework"))
        topo.delete("polygon", f"id = {rng.randrange(10)}")
        topo.insert("polygon", rows([(kept + 100, f"POLYGON({ring(1, *place())})")], "polygon"))
        kept += 3
        topo.update()
        read = topo.store.read
        assert shapes(None, read) == shapes(solve(read("linework"), read("polygon"), read("map_layer"), topo.cfg))
        assert topo.store.facts()["map_faces"] == read("map_face").count()


def test_regions_apart_keep_their_ids_and_files(spark, topo):  # noqa: F811
    topo.store.buckets = 256
    made = [(i, bytearray(line("LINESTRING" + ring(2, 10 * i, 0))), "contact", BEDROCK) for i in range(6)]
    topo.insert("linework", spark.createDataFrame(made, COLUMNS))
    topo.insert("polygon", spark.createDataFrame([(1, bytearray(line(f"POLYGON({ring(1, 50, 0)})")), "terrace", BEDROCK)], COLUMNS))
    topo.update()
    before, rows = topo.store.manifest(), {r["id"]: bytes(r["geometry"]) for r in topo.map_faces().collect()}
    topo.set("linework", "id = 2", geometry=bytearray(line("LINESTRING" + ring(4, 20, 0))))
    topo.update()
    after, now = topo.store.manifest(), {r["id"]: bytes(r["geometry"]) for r in topo.map_faces().collect()}
    for name in ("edge", "face", "map_face", "face_type"):
        same = sum(before[name].get(k) == f for k, f in after[name].items())
        assert same >= len(before[name]) - 1 and same >= 4
    assert len(rows.keys() & now.keys()) == 5 and all(rows[k] == now[k] for k in rows.keys() & now.keys())
    # A polygon alone labels anew, and solves nothing.
    topo.set("polygon", "id = 1", type="dune")
    topo.update()
    assert topo.store.manifest()["edge"] == after["edge"]
    assert [r["unit_id"] for r in topo.map_faces().where("unit_id is not null").collect()] == ["dune"]
    assert [r["unit_id"] for r in topo.store.read("face_type").where("unit_id is not null").collect()] == ["dune"]


def test_clean_up_of_a_divider(spark, topo):  # noqa: F811
    """Faces that join leave no map face behind, and the next update labels what they became."""
    topo.add("linework", "LINESTRING" + ring(10, 5, 5), "contact", BEDROCK)
    topo.add("linework", "LINESTRING(4 0,4 10)", "contact", BEDROCK)
    topo.add("polygon", f"POLYGON({ring(1, 2, 2)})", "u1", BEDROCK)
    topo.add("polygon", f"POLYGON({ring(2, 7, 7)})", "u2", BEDROCK)
    topo.update()
    assert sorted((r["area"], r["unit_id"]) for r in topo.map_faces().collect()) == [(40.0, "u1"), (60.0, "u2")]
    topo.delete("linework", "id = 2")
    topo.clean()
    read = topo.store.read
    assert topo.map_faces().count() == 0 and read("face_type").count() == 0 and [r["line_id"] for r in read("linework_topo").collect()] == [1]
    assert read("face").where("face_id <> 0").count() == 1 and read("dirty_face").count() == 1
    topo.update()
    assert [(r["area"], r["unit_id"]) for r in topo.map_faces().collect()] == [(100.0, "u2")]
    assert read("face_type").count() == 1 and read("dirty_face").count() == 0


def test_a_batch_counts_once(spark, topo, monkeypatch):  # noqa: F811
    edit = spark.createDataFrame([(1, "linework", "INSERT", 1, bytearray(line("LINESTRING" + ring(2, 3, 3))), "contact", BEDROCK)], w.EDIT)
    other = spark.createDataFrame([(1, "linework", "INSERT", 2, bytearray(line("LINESTRING" + ring(4, 30, 3))), "contact", BEDROCK)], w.EDIT)
    commit, calls = topo.store.commit, []

    def failing(*a, **k):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost between working out and committing")
        return commit(*a, **k)

    monkeypatch.setattr(topo.store, "commit", failing)
    with pytest.raises(RuntimeError, match="lost"):
        w.apply_edits(topo, edit, "s", 0)
    assert topo.store.read("linework").count() == 0 and topo.store.applied("s") == -1  # sources and faces alike are as before
    w.apply_edits(topo, edit, "s", 0)
    version = topo.store.latest()
    assert w.apply_edits(topo, edit, "s", 0) == version == topo.store.latest() and topo.map_faces().count() == 1
    # Another writer commits while this batch is worked out: the batch is worked out again on top of it.
    raced = []

    def racing(tables, base=None, *a, **k):
        if not raced:
            raced.append(commit({"polygon": topo.store.read("polygon")}))
        return commit(tables, base, *a, **k)

    monkeypatch.setattr(topo.store, "commit", racing)
    w.apply_edits(topo, other, "s", 1)
    assert topo.store.applied("s") == 1 and topo.map_faces().count() == 2 and raced
    with pytest.raises(Conflict):
        commit({"polygon": topo.store.read("polygon")}, base=topo.store.latest() - 1)
