"""Tiles that are built feature by feature against encoding whole tiles, refreshing against building everything, and their differences."""

import json
import random

import numpy as np

from planar_spark.functions.tiles import WORLD
from planar_spark.kernel import mvt, wkb
from planar_spark.operators import vector_tiles

FEATURES = "layer string, id long, type string, geometry binary"


def square(x, y, side):
    return f"POLYGON(({x} {y},{x + side} {y},{x + side} {y + side},{x} {y + side},{x} {y}))"


def rows(seed):
    rng = random.Random(seed)
    at = lambda: rng.uniform(-1.5e7, 1.5e7)
    shapes = [square(at(), at(), rng.choice([10.0, 3e5, 6e6])) for _ in range(20)]
    shapes += [f"LINESTRING({at()} {at()},{at()} {at()},{at()} {at()})" for _ in range(6)] + [f"POINT({at()} {at()})" for _ in range(6)]
    out = [("bedrock" if i % 2 else "line", i, "abc"[i % 3] if i % 5 else None, bytearray(wkb.encode(wkb.parse(s)[0]))) for i, s in enumerate(shapes)]
    return [*out, out[0], ("line", 99, "a", None), ("line", 98, "a", bytearray(b"\x01"))]


def plain(data):
    return {(r["z"], r["x"], r["y"]): bytes(r["tile"]) for r in data}


def test_quarters_see_what_whole_tiles_see():
    for _, i, _, data in rows(3)[:32]:
        geometry = wkb.decode(data)[0]
        for zoom in (0, 1, 3):
            got = {(x, y): (kind, drawn) for x, y, kind, drawn in mvt.descend(geometry, zoom, WORLD)}
            want = {}
            for x in range(2**zoom):
                for y in range(2**zoom):
                    kind, parts = mvt.quantised(geometry, mvt.tile_box(zoom, x, y, WORLD))
                    if parts:
                        want[x, y] = kind, sum(len(p) for p in parts)
            assert set(got) == set(want) and all(got[k][0] == want[k][0] for k in want), (i, zoom)


def test_contents_read_back():
    tags = {"id": -5, "type": "ä", "on": True}
    tile = mvt.layer("one", [(wkb.parse("POINT(1 1)")[0], tags), (wkb.parse("POINT(9 9)")[0], {"id": 1})], (0, 0, 4, 4)) + mvt.layer("two", [(wkb.parse(square(0, 0, 2))[0], {"id": 7, "type": None})], (0, 0, 4, 4))
    assert mvt.contents(tile) == [("one", tags), ("two", {"id": 7})] and mvt.contents(b"") == []


def test_refreshing_equals_building_everything(spark):
    before = rows(3)
    after = [r for r in before if r[1] % 7] + [("line", 200, "b", bytearray(wkb.encode(wkb.parse(square(1e6, 1e6, 4e5))[0])))]
    old, new, zooms = spark.createDataFrame(before, FEATURES), spark.createDataFrame(after, FEATURES), [0, 3, 5]
    cache, want = vector_tiles.build_tiles(old, zooms), vector_tiles.build_tiles(new, zooms)
    boxes = []
    for r in before + after:
        if (r[1] % 7 == 0 or r[1] == 200) and r[3] and len(r[3]) > 1:
            a = np.concatenate([np.asarray(p).reshape(-1, 2) for p in wkb.decode(r[3])[0][1]])
            boxes.append((*a.min(0).tolist(), *a.max(0).tolist()))
    got = vector_tiles.refreshed(cache, new, spark.createDataFrame(boxes, "xmin double, ymin double, xmax double, ymax double"), zooms)
    got, want, cached = plain(got.collect()), plain(want.collect()), plain(cache.collect())
    assert got == want and cached != want and len(want) > 20
    changes = vector_tiles.tile_changes(cache, vector_tiles.build_tiles(new, zooms))
    told = {(r["z"], r["x"], r["y"]): r["change"] for r in changes.collect()}
    kind = lambda k: "new" if k not in cached else "gone" if k not in want else "changed"
    assert told == {k: kind(k) for k in cached.keys() | want.keys() if cached.get(k) != want.get(k)} and set(told.values()) >= {"gone", "changed"}
    events = [json.loads(r["payload"]) for r in vector_tiles.tile_events(changes).collect()]
    assert {(e["z"], e["x"], e["y"]): e["change"] for e in events} == told


def test_no_features(spark):
    none = spark.createDataFrame([], FEATURES)
    assert vector_tiles.build_tiles(none, [0, 4]).count() == 0
    boxes = spark.createDataFrame([(0.0, 0.0, 1e7, 1e7)], "xmin double, ymin double, xmax double, ymax double")
    cache = vector_tiles.build_tiles(spark.createDataFrame(rows(4), FEATURES), [2])
    left = vector_tiles.refreshed(cache, none, boxes, [2])
    assert 0 < left.count() < cache.count() and vector_tiles.contents(left).where("layer is null").count() == 0


def test_descent_clips_only_what_crosses_a_border(monkeypatch):
    ring = np.array([[500e3, 500e3], [600e3, 500e3], [600e3, 600e3], [500e3, 600e3], [500e3, 500e3]])
    clips, plain = [], mvt.clip_ring
    want = mvt.quantised(("POLYGON", [ring]), mvt.tile_box(5, 16, 15, WORLD))
    monkeypatch.setattr(mvt, "clip_ring", lambda *a: clips.append(1) or plain(*a))
    got = {(x, y): drawn for x, y, _, drawn in mvt.descend(("POLYGON", [ring]), 5, WORLD)}
    assert got[16, 15] == mvt.commands(want[1], True) and len(clips) <= 2


def test_a_tile_is_put_together_from_a_stream(spark):
    """No list of all features of a tile is made, the bytes are those of the whole layer, and they are read back one after the other."""
    features = [(mvt.POLYGON, bytes([i % 100] * (1 + i % 300)), {"id": i // 2 - 50, "type": "ab"[i % 2] if i % 3 else None}) for i in range(1000)]
    layer = mvt.Layer("one", "id")
    for f in features:
        layer.add(*f)
    whole = b"".join(layer.parts())
    assert whole == mvt.assembled("one", features) and len(layer.values) == 2 and mvt.Layer("none").parts() == []
    each = mvt.each_feature(whole)
    assert next(each) == ("one", {"id": -50}) and sum(1 for _ in each) == 999
    tiles = vector_tiles.build_tiles(spark.createDataFrame(rows(3), FEATURES), [0, 3])
    assert "collect_list" not in tiles._jdf.queryExecution().executedPlan().toString()
