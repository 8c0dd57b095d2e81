"""Unions, islands and UTM against closed forms and brute force."""

import random

import numpy as np
import pytest

from planar_spark.config import TopoConfig
from planar_spark.kernel import generalise, planar, wkb
from planar_spark.operators import noding, overlay, vector_tiles

FINE = TopoConfig(tolerance=1e-3)
SHAPES = "id long, map_layer int, type string, geometry binary"


def shape(text: str) -> bytearray:
    return bytearray(wkb.encode(wkb.multi(wkb.parse(text)[0])))


def turned(rng: random.Random) -> str:
    """A triangle anywhere in a square of 10."""
    while True:
        p = [(round(rng.uniform(0, 10), 3), round(rng.uniform(0, 10), 3)) for _ in range(3)]
        if abs(planar.signed_area(np.array([*p, p[0]]))) > 1:
            return "POLYGON((" + ",".join(f"{x} {y}" for x, y in [*p, p[0]]) + "))"


def test_unions_against_the_kernel(spark):
    rng = random.Random(7)
    rows = [(i, 1, "abc"[i % 3] if i % 4 else None, shape(turned(rng))) for i in range(24)]
    rows += [rows[0], (90, 1, "ring", shape("POLYGON((0 0,9 0,9 9,0 9,0 0),(3 3,6 3,6 6,3 6,3 3))")), (91, 1, "ring", shape("POLYGON((4 4,5 4,5 5,4 5,4 4))"))]
    rows += [(92, 1, "none", None), (93, 1, "none", bytearray(b"\x01\x02")), (94, 1, "line", shape("LINESTRING(0 0,5 5)"))]
    got = {r["type"]: r for r in overlay.union(spark.createDataFrame(rows, SHAPES), ["type"], FINE).collect()}
    assert set(got) == {"a", "b", "c", None, "ring", "none", "line"}
    for kind in ("a", "b", "c", None):
        want = planar.union_area([wkb.decode(r[3])[0] for r in rows if r[2] == kind])
        assert got[kind]["area"] == pytest.approx(want, abs=0.05)
        geometry = wkb.decode(got[kind]["geometry"])[0]
        assert planar.area(geometry) == pytest.approx(got[kind]["area"])
        assert all(planar.signed_area(p[0]) > 0 for p in geometry[1])
    assert got["ring"]["area"] == pytest.approx(81 - 9 + 1) and len(wkb.decode(got["ring"]["geometry"])[0][1]) == 2
    assert got["none"]["geometry"] is None and got["none"]["area"] == 0 and got["line"]["geometry"] is None


def test_union_of_nothing(spark):
    assert overlay.union(spark.createDataFrame([], SHAPES), ["type"], FINE).count() == 0
    assert overlay.union(spark.createDataFrame([(1, 1, "a", None)], SHAPES), [], FINE).collect()[0]["area"] == 0


def test_islands_with_many_rounds(spark, monkeypatch):
    """Every point's nearest edge below, whichever window it is found in."""
    rng, rows = random.Random(5), []
    for part in range(300):  # triangles of every size; parts may overlap, as only what is below counts here
        x, y, side = rng.randrange(5000), rng.randrange(50_000), rng.choice([3, 10, 200])
        p = [(x, y), (x + side, y + rng.randrange(side)), (x + rng.randrange(1, side), y + side)]
        rows += [(part, part, *a, *b) for a, b in zip(p, p[1:] + p[:1], strict=True)]
    half = spark.createDataFrame(rows, "ring long, part long, x long, y long, tx long, ty long")
    points = [(r, min(t[2:4] for t in rows if t[0] == r), r) for r in range(300)]
    asked = spark.createDataFrame([(r, *p, own) for r, p, own in points], "ring long, px long, py long, own long")
    want = {}
    for r, (px, py), own in points:
        under = [(y + (ty - y) * (px - x) / (tx - x), (ty - y) / (tx - x), ring) for ring, part, x, y, tx, ty in rows if part != own and x <= px < tx]
        under = [u for u in under if u[0] < py - 1e-9]
        if under:
            want[r] = max(under)[2]
    for few in (noding.FEW, 0):
        monkeypatch.setattr(noding, "FEW", few)
        assert {r["ring"]: r["under"] for r in noding.nearest_below(asked, half).collect()} == want


def test_relabelling_looks_at_old_and_new(spark):
    square = lambda x, side=1: shape(f"POLYGON(({x} 0,{x + side} 0,{x + side} 1,{x} 1,{x} 0))")
    faces = spark.createDataFrame([(1, k, "stale", square(3 * k)) for k in range(4)], "map_layer int, comp long, unit_id string, geometry binary")
    inner = lambda k: shape(f"POLYGON(({3 * k + 0.25} 0.25,{3 * k + 0.75} 0.25,{3 * k + 0.75} 0.75,{3 * k + 0.25} 0.75,{3 * k + 0.25} 0.25))")
    old = spark.createDataFrame([(1, 1, "a", inner(0)), (2, 1, "b", inner(1)), (3, 1, "c", inner(3))], SHAPES)
    new = spark.createDataFrame([(1, 1, "a", inner(2)), (2, 1, "b2", inner(1)), (3, 1, "c", inner(3))], SHAPES)
    got = {r["comp"]: r["unit_id"] for r in overlay.relabel(faces, old, new, FINE).collect()}
    assert got == {0: None, 1: "b2", 2: "a", 3: "stale"}  # left, renamed, moved to, and not touched by the edit


def test_utm(spark):
    rng = np.random.default_rng(1)
    p = np.stack([rng.uniform(-114, -108, 500), rng.uniform(-80, 84, 500)], axis=1)
    for srid in (32612, 32712):
        there = generalise.project(p, 4326, srid)
        back = generalise.project(there, srid, 4326)
        assert np.abs((back - p) * 111_000).max() < 1e-3  # a millimetre
    # Closed forms: on the middle meridian the northing is the scaled length of the meridian, and the false origin lies on the equator.
    assert np.allclose(generalise.project(np.array([[-111.0, 0.0]]), 4326, 32612), [[500_000, 0]])
    lat = np.radians(np.linspace(0, 45, 200_001))
    e2 = generalise.FLATTENING * (2 - generalise.FLATTENING)
    arc = np.trapezoid(generalise.MAJOR * (1 - e2) / (1 - e2 * np.sin(lat) ** 2) ** 1.5, lat)
    assert generalise.project(np.array([[-111.0, 45.0]]), 4326, 32612)[0, 1] == pytest.approx(0.9996 * arc, abs=1e-3)
    assert np.allclose(generalise.project(generalise.project(p, 4326, 3857), 3857, 32612), generalise.project(p, 4326, 32612), atol=1e-3)
    for bad in (32600, 32661, 32812):
        with pytest.raises(ValueError):
            generalise.project(p, 4326, bad)
    x, y = generalise.project(np.array([[-111.0, 40.0]]), 4326, 32612)[0]
    row = [("bedrock", 1, "a", shape(f"POLYGON(({x} {y},{x + 9e3} {y},{x + 9e3} {y + 9e3},{x} {y}))"))]
    got = vector_tiles.build_tiles(spark.createDataFrame(row, "layer string, id int, type string, geometry binary"), [0, 8], srid=32612).collect()
    assert {(r["z"], r["x"], r["y"]) for r in got} >= {(0, 0, 0), (8, int((180 - 111) / 360 * 256), 96)}
