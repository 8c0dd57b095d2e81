"""The kernel for batches against the one for single geometries, and that usual ones do not go one by one."""

import numpy as np
import pyarrow as pa
import pytest

from planar_spark.kernel import bulk, planar, wkb


def ring(rng, whole):
    kind = rng.integers(4)
    x, y = rng.integers(0, 6, 2)
    w, h = rng.integers(1, 5, 2)
    if kind == 0:
        p = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    elif kind == 1:
        p = [(x, y), (x + w, y), (x + w, y + h), (x + w + 1, y + h + 1), (x, y + h + 1)]
    elif kind == 2:
        p = [(x, y), (x + w, y + 1), (x + 1, y + h)]
    else:
        p = [tuple(v) for v in rng.integers(0, 7, (rng.integers(3, 9), 2))]  # crosses itself, or is flat
    p = np.array([*p, p[0]], np.float64)
    return p if whole else p * 0.37 + 0.1


def geometries(rng, n, whole):
    out = []
    for i in range(n):
        if i % 11 == 0:
            out.append(wkb.encode(("MULTIPOLYGON", [[ring(rng, whole)], [ring(rng, whole) + 20]])))
        elif i % 13 == 0:
            out.append(wkb.encode(("MULTIPOLYGON", [[np.array([(0, 0), (9, 0), (9, 9), (0, 9), (0, 0.0)]), np.array([(2, 2), (2, 5), (5, 5), (5, 2), (2, 2.0)])]])))
        elif i % 7 == 0:
            out.append(wkb.encode(("POINT", [rng.integers(0, 7, (1, 2)) * 0.5])))
        else:
            out.append(wkb.encode(("MULTIPOLYGON", [[ring(rng, whole)]])))
    return out


@pytest.mark.parametrize("whole", [True, False])
def test_batches_agree_with_single_geometries(whole):
    rng = np.random.default_rng(5)
    a, b = geometries(rng, 3000, whole), geometries(rng, 3001, whole)[1:]
    one = [wkb.decode(g)[0] for g in a]
    column = pa.array([*a[:10], None, b"junk", *a[10:]], pa.binary()).slice(3)
    boxes, none = bulk.bounds(column)
    want = [None if g in (None, b"junk") else planar.bounds(wkb.decode(g)[0]) for g in column.to_pylist()]
    assert [None if n else tuple(x) for x, n in zip(boxes.tolist(), none, strict=True)] == want
    areas = [g for g, k in zip(a, one, strict=True) if k[0] == "MULTIPOLYGON" and len(k[1]) == 1 and planar.bounds(k)[1] < planar.bounds(k)[3]]
    want = [wkb.encode(("POINT", [np.array([planar.point_on_surface(wkb.decode(g)[0])])])) for g in areas]
    assert bulk.points_on_surface(pa.array(areas, pa.binary())) == want
    for contains, test in ((False, planar.intersects), (True, planar.contains)):
        pairs = [(p, q) for p, q in zip(a, b, strict=True) if not (contains and 21 in (len(p), len(q)))]
        want = [test(wkb.decode(p)[0], wkb.decode(q)[0]) for p, q in pairs]
        got = bulk.tested(pa.array([p for p, _ in pairs], pa.binary()), pa.array([q for _, q in pairs], pa.binary()), contains)
        assert got.tolist() == want
        assert 30 < sum(want) < len(want) - 30


def test_rings_are_walked_together():
    closed = lambda *p: [dict(zip(("x", "y", "tx", "ty"), (*s, *t), strict=True)) for s, t in zip(p, (*p[1:], p[0]), strict=True)]
    square, hole = closed((4, 0), (4, 4), (0, 4), (0, 0)), closed((1, 1), (1, 2), (2, 2), (2, 1))
    knot = closed((0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (1, 2), (1, 1), (0, 1))
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("x", "y", "tx", "ty")]))
    rings, knotted = bulk.walked(pa.array([[], square[::-1], knot, hole + square], kind).slice(1))
    assert [[r.tolist() for r in f] for f in rings] == [
        [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]], [],
        [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]]],
    ]
    assert knotted == [1]
    (made, area), none = bulk.areas_of([rings[0][0], rings[2][1]])
    assert wkb.decode(made)[0][0] == "MULTIPOLYGON" and area == 16 and none is None


def test_usual_geometries_do_not_go_one_by_one(monkeypatch):
    def never(*_):
        raise AssertionError("decoded one by one")

    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], np.float64)
    a = pa.array([wkb.encode(("MULTIPOLYGON", [[square + i]])) for i in range(100)], pa.binary())
    p = pa.array([wkb.encode(("POINT", [np.array([(i, i)], np.float64)])) for i in range(100)], pa.binary())
    monkeypatch.setattr(wkb, "decode", never)
    assert bulk.bounds(a)[0][7].tolist() == [7, 7, 9, 9]
    assert bulk.points_on_surface(a)[3] == bulk.POINT + np.array([4.0, 4.0]).tobytes()
    assert bulk.tested(a, p, False).all() and bulk.tested(a, a, True).all() and bulk.tested(a, a, False).all()


def test_rectangles_are_measured_together(monkeypatch):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        x, y = rng.random(2) * 100
        w, h = rng.random(2) * 5
        p = np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
        p = np.roll(p[:: (-1) ** i], i % 4, axis=0)
        rows.append([wkb.encode(("MULTIPOLYGON", [[np.concatenate([p, p[:1]])]]))])
    odd = [rows[0] + rows[1], [], rows[2] * 2] + [[g] for g in geometries(rng, 300, False) if len(g) != 21]
    kind = pa.list_(pa.binary())
    want = [planar.union_area([wkb.decode(g)[0] for g in r]) for r in rows + odd]
    assert bulk.union_areas(pa.array([rows[5], *rows, *odd], kind).slice(1)) == want
    monkeypatch.setattr(wkb, "decode", None)  # rectangles do not go one by one
    assert bulk.union_areas(pa.array(rows, kind)) == want[:600]
