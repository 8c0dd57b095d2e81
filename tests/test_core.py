"""Kernel, sources, tiles, hierarchy and row changes on small inputs; every registered query against its SQL is verify.py's work."""

import json
import sqlite3

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from planar_spark.config import TopoConfig
from planar_spark.kernel import generalise, mvt, planar, wkb
from planar_spark.operators import dml, noding, vector_tiles
from planar_spark.operators.components import components
from planar_spark.sources import fielddata, files

SQUARE = lambda z, x, y: wkb.parse(f"POLYGON(({x - z / 2} {y - z / 2},{x + z / 2} {y - z / 2},{x + z / 2} {y + z / 2},{x - z / 2} {y + z / 2},{x - z / 2} {y - z / 2}))")[0]


def test_wkb_round_trips_and_refuses():
    for text in ("POINT(1 2)", "LINESTRING(0 0,1 1.5)", "MULTIPOLYGON(((0 0,4 0,4 4,0 0),(1 1,2 1,2 2,1 1)),((9 9,10 9,10 10,9 9)))", "MULTILINESTRING((0 0,1 1),(2 2,3 3))"):
        g, srid = wkb.parse("SRID=32612;" + text)
        assert srid == 32612 and wkb.text_of(wkb.parse(wkb.encode(g).hex())[0]) == wkb.text_of(g) == text
    for bad in ("LINE(0 0)", "POINT(a b)", "", "POLYGON((0 0"):
        with pytest.raises(ValueError):
            wkb.parse(bad)
    with pytest.raises(ValueError):
        wkb.decode(b"\x01\x02")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=6))
def test_union_area_counts_cells(boxes):
    cells = {(2 * x + i, 2 * y + j) for z, x, y in boxes for i in range(-z, z) for j in range(-z, z)}
    assert planar.union_area([SQUARE(z, x, y) for z, x, y in boxes]) == pytest.approx(len(cells) / 4)


def test_predicates():
    ring = wkb.parse("POLYGON((0 0,6 0,6 6,0 6,0 0),(2 2,4 2,4 4,2 4,2 2))")[0]
    assert planar.area(ring) == 32 and planar.contains(ring, SQUARE(1, 1, 1)) and planar.contains(SQUARE(6, 3, 3), SQUARE(6, 3, 3))
    assert not planar.contains(ring, SQUARE(1, 3, 3)) and not planar.contains(ring, SQUARE(4, 3, 3)) and not planar.intersects(ring, SQUARE(1, 3, 3))
    assert planar.intersects(SQUARE(2, 0, 0), SQUARE(2, 2, 0)) and planar.locate(np.array([planar.point_on_surface(ring)]), planar.rings_of(ring))[0] == 1


def test_what_fills_a_hole_is_not_contained():
    hollow = wkb.parse("MULTIPOLYGON(((0 0,6 0,6 6,0 6,0 0),(2 2,4 2,4 4,2 4,2 2)))")[0]
    plug, both = SQUARE(2, 3, 3), ("MULTIPOLYGON", [SQUARE(1, 1, 1)[1], SQUARE(2, 3, 3)[1]])
    assert not planar.contains(hollow, plug) and not planar.contains(hollow, both) and planar.contains(hollow, SQUARE(2, 1, 1))
    assert planar.contains(plug, plug) and planar.contains(plug, ("POLYGON", [np.array([[2, 2], [4, 2], [2, 2]])]))


def test_generalise_and_tiles(spark):
    a = np.array([[0, 0], [1, 0.01], [2, 0], [2, 2]])
    assert len(generalise.simplify(a, 0.1)) == 3 and len(generalise.segmentize(a[2:], 0.5)) == 5 and len(generalise.chaikin(a)) == 6
    p = np.array([[15.9, -24.3]])
    assert np.allclose(generalise.project(generalise.project(p, 4326, 3857), 3857, 4326), p)
    assert mvt.layer("l", [(SQUARE(10, 0, 0), {"id": 1, "type": "a", "on": True, "w": 0.5})], (-8, -8, 8, 8)).startswith(b"\x1a")
    rows = [("bedrock", 1, "a", bytearray(wkb.encode(SQUARE(1e6, 5e5, 5e5)))), ("line", 2, "b", bytearray(wkb.encode(wkb.parse("LINESTRING(0 0,900000 900000)")[0])))]
    got = vector_tiles.build_tiles(spark.createDataFrame(rows, "layer string, id int, type string, geometry binary"), [0, 1, 5]).collect()
    assert {r["z"] for r in got} == {0, 1, 5} and all(b"bedrock" in r["tile"] or b"line" in r["tile"] for r in got)


def test_sources(spark, tmp_path):
    (tmp_path / "types.csv").write_text("id,name,color,topology\na,Büllsport,#fff,\nb,B,#000,bedrock\n")
    assert [tuple(r) for r in files.read_types(spark, f"file://{tmp_path}/types.csv").orderBy("id").collect()] == [("a", "Büllsport", "#fff", None), ("b", "B", "#000", "bedrock")]
    (tmp_path / "colors.txt").write_text("# c\n\na  #fff 607 transparent 45\nb transparent\n")
    assert [tuple(r) for r in files.read_colors(spark, f"file://{tmp_path}/colors.txt").orderBy("id").collect()] == [("a", "#fff", "607", None, 45.0), ("b", None, None, None, None)]
    with sqlite3.connect(tmp_path / "m.gpkg") as db:
        db.execute("CREATE TABLE line (id INTEGER PRIMARY KEY, geometry BLOB)")
        db.executemany("INSERT INTO line VALUES (?, ?)", [(i, b"GP\0\1" + b"\0" * 4 + wkb.encode(wkb.parse("POINT(1 2)")[0])) for i in range(9)] + [(9, None)])
    rows = files.cleaned(files.read_sqlite(spark, f"{tmp_path}/m.gpkg", "line", "id int, geometry binary"), {"id": "long"}).collect()
    assert sorted(r["id"] for r in rows) == list(range(9)) and wkb.text_of(wkb.decode(bytes(rows[0]["geometry"]))[0]) == "POINT(1 2)"
    parsed = files.parse_geometry(spark.createDataFrame([("SRID=1;POINT(1 2)",), ("bad",), (None,)], "g string"), "g").collect()
    assert [(r["srid"], r["geometry_error"] is None) for r in parsed] == [(1, True), (None, False), (None, True)]
    n = files.write_mbtiles(spark.createDataFrame([(1, 0, 0, bytearray(b"t"))], "z int, x int, y int, tile binary"), f"{tmp_path}/t.mbtiles", {"format": "pbf"})
    with sqlite3.connect(tmp_path / "t.mbtiles") as db:
        assert n == 1 and db.execute("SELECT zoom_level, tile_column, tile_row FROM tiles").fetchall() == [(1, 0, 1)]
    spot = {"properties": {"id": "s", "orientation_data": [{"id": "o1", "strike": 5.0, "associated_orientation": [{"id": "o2"}]}, {"id": "o3"}]}}
    (tmp_path / "p.json").write_text(json.dumps({"spotsDb": {"s": spot}, "project": {"tags": [{"id": "t", "name": "T", "spots": ["s", "gone"]}]}}))
    spots, tags, pairs = fielddata.read_project(spark, f"file://{tmp_path}/p.json")
    assert [tuple(r) for r in pairs.collect()] == [("s", "t")] and tags.count() == 1
    assert [(r["spot_index"], r["n"], r["orientation"]["id"]) for r in fielddata.measurements(spots).orderBy("n").collect()] == [(0, 1, "o1"), (0, 2, "o2"), (1, 3, "o3")]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert components(edges.limit(0)).count() == 0


def test_row_changes_with_nulls(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (None, "n")], "id int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c")], "id int, v string")
    assert sorted(map(str, dml.upsert(old, new, ["id"]).collect())) == sorted(map(str, spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "n")], "id int, v string").collect()))
    assert dml.not_in(new, "id", old, "id").count() == 0
    assert dml.delete_where(old, old["v"] == "a").count() == 2


def test_noding_ends_with_no_cut_left_or_raises(spark, monkeypatch):
    import random

    from planar_spark.operators import noding

    rng = random.Random(3)
    rows = [(i, *sum(sorted([(rng.randrange(25), rng.randrange(25)), (30 + rng.randrange(25), rng.randrange(25))]), ())) for i in range(12)]
    lines = spark.createDataFrame(rows, "line_id long, x1 long, y1 long, x2 long, y2 long")
    edges, _ = noding.cut_pieces(lines)
    left = noding.crossings(edges.select("x1", "y1", "x2", "y2")).where("(px, py) <> (x1, y1) and (px, py) <> (x2, y2)")
    assert edges.count() > 12 and left.count() == 0
    monkeypatch.setattr(noding, "ROUNDS", 1)
    with pytest.raises(RuntimeError):
        noding.cut_pieces(lines)


@pytest.mark.parametrize("side", [600, 40_000])
def test_noding_in_utm_at_the_default_tolerance(spark, side):
    """Grid numbers of 4e11, whose products pass 64 bits; pieces over 10 km are tested in decimals."""
    square = lambda x, y: wkb.encode(wkb.multi(wkb.parse(f"LINESTRING ({x} {y},{x + side} {y},{x + side} {y + side},{x} {y + side},{x} {y})")[0]))
    rows = [(1, bytearray(square(500_000, 4_000_000))), (2, bytearray(square(500_000 + side // 2, 4_000_000 + side // 2)))]
    edges, _, errors = noding.noded(spark.createDataFrame(rows, "id long, geometry binary"), TopoConfig(32612))
    _, faces = noding.faced(edges)
    quarter = side * side / 4
    assert errors.count() == 0
    assert sorted(round(r["area"] * 1e-10, 3) for r in faces.where("face_id <> 0").collect()) == [quarter, 3 * quarter, 3 * quarter]


def test_lines_over_one_another_are_cut_once(spark, monkeypatch):
    """Many lines on few places: what is tested for crossings is the places, not the lines; every line keeps its edges."""
    lines = [(i, i * 7 % 30, 0, i * 7 % 30 + 1 + i % 9, 0) for i in range(300)] + [(300 + i, i % 8 * 3, -4, i % 8 * 3 + 2 * (2 + i % 3), 2 * (2 + i % 3) - 4) for i in range(90)] + [(0, 0, 0, 2, 0), (0, 1, 0, 9, 0)]
    tested, plain = [], noding.crossings
    monkeypatch.setattr(noding, "crossings", lambda pieces: tested.append(pieces.count()) or plain(pieces))
    edges, along = noding.cut_pieces(spark.createDataFrame(lines, "line_id long, x1 long, y1 long, x2 long, y2 long"))
    assert max(tested) <= 40 + 8 * 4
    edge = {r["edge_id"]: (r["x1"], r["y1"], r["x2"], r["y2"]) for r in edges.collect()}
    got = [(r["line_id"], edge[r["edge_id"]]) for r in along.collect()]
    assert len(got) == len(set(got))
    on = lambda p, a: (a[2] - a[0]) * (p[1] - a[1]) == (a[3] - a[1]) * (p[0] - a[0]) and a[0] <= p[0] <= a[2] and a[1] <= p[1] <= a[3]
    assert set(got) == {(i, e) for i, *a in lines for e in edge.values() if on(e[:2], a) and on(e[2:], a)}
    ends = {p for e in edge.values() for p in (e[:2], e[2:])}
    assert not any(on(p, e) and p not in (e[:2], e[2:]) for p in ends for e in edge.values())


def test_large_faces_are_traced_like_small_ones(spark, monkeypatch):
    """Nested and touching rings, by a walk in one task and by ranking lists."""
    import random

    from planar_spark.operators import noding

    rng = random.Random(6)
    boxes = [(rng.randrange(0, 24), rng.randrange(0, 24), rng.randrange(1, 7), rng.randrange(1, 7)) for _ in range(14)] + [(-2, -2, 40, 40), (10, 10, 2, 2), (12, 12, 2, 2)]
    rows = [(i, *s) for i, (x, y, w, h) in enumerate(boxes) for s in ((x, y, x + w, y), (x + w, y, x + w, y + h), (x, y + h, x + w, y + h), (x, y, x, y + h))]
    edges, _ = noding.cut_pieces(spark.createDataFrame(rows, "line_id long, x1 long, y1 long, x2 long, y2 long"))
    edges, faces = noding.faced(edges)
    edges = noding.written(edges, "faced")
    comps = faces.where("face_id <> 0").selectExpr("1 as map_layer", "face_id", "face_id as comp", "false as is_open")
    want = {r["comp"]: (bytes(r["geometry"]), r["area"]) for r in noding.polygons(edges, comps, TopoConfig(tolerance=1.0)).collect()}
    monkeypatch.setattr(noding, "LARGE_FACE", 5)
    got = {r["comp"]: (bytes(r["geometry"]), r["area"]) for r in noding.polygons(edges, comps, TopoConfig(tolerance=1.0)).collect()}
    area = {r["face_id"]: r["area"] for r in faces.collect()}
    assert {k: a for k, (_, a) in got.items()} == {k: a for k, (_, a) in want.items()} and all(abs(a - area[k]) < 1e-9 for k, (_, a) in got.items())
    rings = lambda g: sorted(sorted(map(tuple, r.tolist())) for p in wkb.decode(g)[0][1] for r in p)
    assert all(rings(got[k][0]) == rings(want[k][0]) for k in want)


def test_healed_lines_against_walks(spark):
    """Open and closed chains of edges in any direction, a ring of one line beside a crossing, and a long chain."""
    import random

    from planar_spark.operators import chains

    rng = random.Random(1)
    paths = [list(range(100, 131)), [*range(200, 212), 200], [300, 301], [400, 401, 402, 400], [500, 501, 502], [502, 503], [502, 504, 505, 502]]
    rows, lines, want = [], [], set()
    for k, path in enumerate(paths):
        first = len(rows) + 1
        for a, b in zip(path, path[1:], strict=False):
            e = len(rows) + 1
            a, b = (a, b) if rng.random() < 0.5 else (b, a)
            rows.append((e, a, b, float(a), 0.0, float(b), 0.0))
            lines.append((k, e))
        turned = rows[first - 1][1] != path[0]
        want.add((first, tuple(reversed(path)) if turned else tuple(path), k in (1, 3)))
    order = list(range(len(rows)))
    rng.shuffle(order)
    edges = spark.createDataFrame([rows[i] for i in order], "edge_id long, start_node long, end_node long, x1 double, y1 double, x2 double, y2 double")
    got = chains.healed(edges, spark.createDataFrame(lines, "line_id long, edge_id long")).collect()
    found = {(r["chain"], tuple(int(x) for x in wkb.decode(bytes(r["geometry"]))[0][1][0][:, 0]), r["closed"]) for r in got}
    # A closed chain begins with its least edge, whichever way that runs.
    canon = lambda t: (t[0], tuple(sorted(t[1][:-1])) if t[2] else t[1], t[2])
    assert set(map(canon, found)) == set(map(canon, want)) and {r["chain"]: r["n_edges"] for r in got} == {c: len(p) - 1 for c, p, _ in want}


def test_near_components_of_a_long_ring(spark, monkeypatch):
    """A ring that passes through every task, and islands of three: in one contraction and a few passes, not in one pass for each stretch of the ring."""
    n = 3000
    ring = [(i, (i + 2) if i % 2 == 0 and i < n - 2 else (i - 2) if i % 2 and i > 1 else (n - 1 if i == n - 2 else 0)) for i in range(n)]
    isles = [(n + 3 * k + a, n + 3 * k + b) for k in range(50) for a, b in ((0, 1), (2, 1))]
    pairs = spark.createDataFrame(ring + isles, "a long, b long")
    want = {i: 0 for i in range(n)} | {n + 3 * k + a: n + 3 * k for k in range(50) for a in range(3)}
    monkeypatch.setattr("planar_spark.operators.components.PIECE", 64)
    made = []
    write = components.__globals__["written"]
    monkeypatch.setitem(components.__globals__, "written", lambda df, label, *a: made.append(label) or write(df, label, *a))
    assert {r["node"]: r["component"] for r in components(pairs, "ring", 10, near=True).collect()} == want
    assert components(pairs.limit(0), "none", 10, near=True).count() == 0 and len(made) < 20
