"""A batch of geometries at once. Points, and areas of one ring with few points, are taken out of their WKB side by side with those of as many points; whatever else
a batch holds goes through ``planar`` one by one. Both ways use the same formulas, so they agree to the bit."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from . import planar, wkb

FEW = 64  # points of a ring that is handled beside others
AT_ONCE = 1 << 20  # numbers of an intermediate array
POINT = struct.pack("<BI", 1, wkb.CODES["POINT"])


def area_head(n: int) -> bytes:
    """What comes before the points of a MultiPolygon of one ring of ``n`` points."""
    return struct.pack("<BIIBIII", 1, wkb.CODES["MULTIPOLYGON"], 1, 1, wkb.CODES["POLYGON"], 1, n)


def groups(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, coordinates (rows, points, 2)) of the column's points and areas of one ring of at most ``FEW`` points; points are those with one."""
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    if data is None or not len(column):
        return []
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held, size = np.frombuffer(data, np.uint8), np.diff(at)
    if column.null_count:
        size = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, size)
    out = []
    for n in np.unique(size):
        points = 1 if n == 21 else (n - 22) // 16
        head = np.frombuffer(POINT if n == 21 else area_head(max(points, 0)), np.uint8)
        if n < 21 or n != len(head) + 16 * points or (n != 21 and not 4 <= points <= FEW):
            continue
        rows = np.flatnonzero(size == n)
        rows = rows[(held[at[rows, None] + np.arange(len(head))] == head).all(axis=1)]
        if len(rows):
            xy = np.ascontiguousarray(held[at[rows, None] + np.arange(len(head), n)]).view("<f8")
            out.append((rows, xy.reshape(len(rows), points, 2).astype(np.float64)))
    return out


def others(n: int, found: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """The rows of ``n`` that are in no group."""
    rest = np.ones(n, bool)
    for rows, _ in found:
        rest[rows] = False
    return np.flatnonzero(rest).tolist()


def bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) boxes, and which rows have none, as they can't be read or are empty."""
    found = groups(column)
    boxes, none = np.zeros((len(column), 4)), np.zeros(len(column), bool)
    for rows, xy in found:
        boxes[rows] = np.concatenate([xy.min(axis=1), xy.max(axis=1)], axis=1)
    for i in others(len(column), found):
        try:
            box = planar.bounds(wkb.decode(column[i].as_py())[0])
        except (ValueError, TypeError):
            box = None
        none[i] = box is None
        boxes[i] = box or 0
    return boxes, none


def surface(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``planar.point_on_surface`` of rings (m, n, 2), and for which of them it holds (the others are flat or not finite)."""
    x1, y1, x2, y2 = xy[:, :-1, 0], xy[:, :-1, 1], xy[:, 1:, 0], xy[:, 1:, 1]
    heights = xy[:, :, 1]
    middle = ((heights.min(axis=1) + heights.max(axis=1)) / 2)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        low = np.where(heights < middle, heights, -np.inf).max(axis=1, keepdims=True)
        high = np.where(heights >= middle, heights, np.inf).min(axis=1, keepdims=True)
        y = (low + high) / 2
        cross = (y1 <= y) != (y2 <= y)
        x = np.sort(np.where(cross, x1 + (x2 - x1) * (y - y1) / (y2 - y1), np.inf), axis=1)
        pairs = x.shape[1] // 2
        left, right = x[:, : 2 * pairs : 2], x[:, 1 : 2 * pairs : 2]
        wide = np.where(np.isfinite(right), right - left, -np.inf)
        best = np.argmax(wide, axis=1)[:, None]
        at = np.take_along_axis(left, best, 1) + np.take_along_axis(wide, best, 1) / 2
    out = np.concatenate([at, y], axis=1)
    return out, np.isfinite(xy).all(axis=(1, 2)) & np.isfinite(out).all(axis=1)


def points_on_surface(column: pa.Array) -> list[bytes | None]:
    """A point inside each geometry, as WKB."""
    found = [(rows, xy) for rows, xy in groups(column) if xy.shape[1] > 1]
    out: list[bytes | None] = [None] * len(column)
    rest = others(len(column), found)
    for rows, xy in found:
        points, good = surface(xy)
        for i, p, ok in zip(rows.tolist(), points, good.tolist(), strict=True):
            if ok:
                out[i] = POINT + p.tobytes()
            else:
                rest.append(i)
    for i in rest:
        p = planar.point_on_surface(wkb.decode(column[i].as_py())[0])
        out[i] = None if p is None else wkb.encode(("POINT", [np.array([p])]))
    return out


def located(points: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """``planar.locate`` of points (m, k, 2), each in its own ring (m, n, 2): (m, k)."""
    x, y = points[:, :, None, 0], points[:, :, None, 1]
    x1, y1, x2, y2 = (c[:, None, :] for c in (xy[:, :-1, 0], xy[:, :-1, 1], xy[:, 1:, 0], xy[:, 1:, 1]))
    cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    within = (np.minimum(x1, x2) <= x) & (x <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= y) & (y <= np.maximum(y1, y2))
    border = ((cross == 0) & within).any(2)
    crosses = ((y1 <= y) != (y2 <= y)) & ((cross > 0) == (y2 > y1))
    return np.where(border, 0, np.where(crosses.sum(2) % 2 == 1, 1, -1))


def cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(m, sides of a, 3 x sides of b): ``planar.cuts`` of rings; NaN where there is none."""
    x1, y1, x2, y2 = (c[:, :, None] for c in (a[:, :-1, 0], a[:, :-1, 1], a[:, 1:, 0], a[:, 1:, 1]))
    u, v, s, t = (c[:, None, :] for c in (b[:, :-1, 0], b[:, :-1, 1], b[:, 1:, 0], b[:, 1:, 1]))
    dx, dy, ex, ey = x2 - x1, y2 - y1, s - u, t - v
    size, den = dx * dx + dy * dy, dx * ey - dy * ex
    with np.errstate(divide="ignore", invalid="ignore"):
        p = ((u - x1) * ey - (v - y1) * ex) / den
        q = ((u - x1) * dy - (v - y1) * dx) / den
        out = [np.where((size > 0) & (den != 0) & (p >= 0) & (p <= 1) & (q >= 0) & (q <= 1), p, np.nan)]
        line = (size > 0) & (den == 0) & ((u - x1) * dy - (v - y1) * dx == 0)
        for cx, cy in ((u, v), (s, t)):
            p = ((cx - x1) * dx + (cy - y1) * dy) / size
            out.append(np.where(line & (p >= 0) & (p <= 1), p, np.nan))
    return np.concatenate(out, axis=2)


def middles(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middles (m, k, 2) of the pieces of the rings ``a`` cut where ``b`` meets them, and which are one's (m, k): the others have no length."""
    at = cuts(a, b)
    m, sides = at.shape[:2]
    ends = np.broadcast_to(np.array([0.0, 1.0]), (m, sides, 2))
    at = np.sort(np.concatenate([ends, np.where(np.isnan(at), 0.0, at)], axis=2), axis=2)[..., None]
    first, last = a[:, :-1, None, :], a[:, 1:, None, :]
    xy = np.where(at == 0, first, np.where(at == 1, last, first + at * (last - first)))
    p, q = xy[:, :, :-1], xy[:, :, 1:]
    return ((p + q) / 2).reshape(m, -1, 2), ((at[:, :, :-1] < at[:, :, 1:]) & (p != q).any(axis=3, keepdims=True)).reshape(m, -1)


def rings_intersect(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    met = ~np.isnan(cuts(a, b)).all(axis=(1, 2))
    return met | (located(b[:, :1], a)[:, 0] >= 0) | (located(a[:, :1], b)[:, 0] >= 0)


def ring_contains(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``planar.contains``; both must be finite."""
    low, high = b.min(axis=1), b.max(axis=1)
    boxed = ((a.min(axis=1) <= low) & (a.max(axis=1) >= high)).all(axis=1)
    at, real = middles(b, a)
    good = boxed & ~((located(at, a) < 0) & real).any(axis=1)
    at, real = middles(a, b)
    # Sides of a whose boxes miss b's are not asked.
    p, q = a[:, :-1], a[:, 1:]
    near = ((np.minimum(p, q) <= high[:, None]) & (np.maximum(p, q) >= low[:, None])).all(axis=2)
    real &= np.repeat(near, real.shape[1] // near.shape[1], axis=1)
    good &= ~((located(at, b) > 0) & real).any(axis=1)
    inside, _ = surface(b)
    c = b - b[:, :1]
    x, y = np.ascontiguousarray(c[:, :, 0]), np.ascontiguousarray(c[:, :, 1])
    flat = (x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y).sum(axis=1) == 0
    return good & (flat | (located(inside[:, None], a)[:, 0] >= 0))


def tested(a: pa.Array, b: pa.Array, contains: bool) -> np.ndarray:
    """For each row whether its geometry in ``a`` contains (or intersects) that in ``b``."""
    keep, rest = np.zeros(len(a), bool), np.ones(len(a), bool)
    in_b = groups(b)
    where = np.full((2, len(a)), -1)
    for k, (rows, _) in enumerate(in_b):
        where[0, rows], where[1, rows] = k, np.arange(len(rows))
    for rows, xy in groups(a):
        for k in np.unique(where[0, rows]):
            mine = np.flatnonzero(where[0, rows] == k)
            if k < 0 or xy.shape[1] == 1:
                continue
            ring, other = xy[mine], in_b[k][1][where[1, rows[mine]]]
            if other.shape[1] == 1:
                test: Callable = (lambda p, q: located(q, p)[:, 0] >= 0) if not contains else None
            else:
                test = ring_contains if contains else rings_intersect
            if test is None:
                continue
            fine = np.isfinite(ring).all(axis=(1, 2)) & np.isfinite(other).all(axis=(1, 2))
            if contains:
                fine &= surface(other)[1]
            mine, ring, other = mine[fine], ring[fine], other[fine]
            n, m = ring.shape[1], other.shape[1]
            step = max(1, AT_ONCE // (n * m * (3 * n + 3 * m if contains else 3)))
            for i in range(0, len(mine), step):
                keep[rows[mine[i : i + step]]] = test(ring[i : i + step], other[i : i + step])
            rest[rows[mine]] = False
    one = planar.contains if contains else planar.intersects
    for i in np.flatnonzero(rest).tolist():
        keep[i] = one(wkb.decode(a[i].as_py())[0], wkb.decode(b[i].as_py())[0])
    return keep


def walked(sides: pa.ListArray) -> tuple[list[list[np.ndarray]], list[int]]:
    """The rings around each face of (x, y, tx, ty), as lists of closed arrays, and the faces that pass a node twice or are not closed, which have none.

    A side is followed by the one that begins where it ends: the sides sorted by their ends beside those sorted by their beginnings tell which. Rings are named
    by their least point and numbered from it by doubling steps.
    """
    n = np.asarray(sides.value_lengths())
    x, y, tx, ty = (np.asarray(c) for c in sides.flatten().flatten())
    face = np.repeat(np.arange(len(n)), n)
    start, end = np.lexsort((y, x, face)), np.lexsort((ty, tx, face))
    knot = np.zeros(len(n), bool)
    x, y, of = x[start], y[start], face[start]
    knot[of[(x != tx[end]) | (y != ty[end])]] = True
    knot[of[1:][(of[1:] == of[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])]] = True
    place = np.empty(len(start), np.int64)
    place[start] = np.arange(len(start))
    jump = np.empty(len(start), np.int64)
    jump[place[end]] = np.arange(len(start))
    least, at, most = np.arange(len(start)), jump, int(n.max(initial=1))
    for _ in range(most.bit_length()):
        least, at = np.minimum(least, least[at]), at[at]
    first = least == np.arange(len(start))
    at, steps = np.where(first, np.arange(len(start)), jump), np.where(first, 0, 1)
    for _ in range(most.bit_length()):
        steps, at = steps + steps[at], at[at]
    order = np.lexsort((-steps, ~first, least))  # the least point, then the others from the furthest from it on
    xy = np.stack([x, y], axis=1)[order].astype(np.float64)
    begins = np.flatnonzero(first[order])
    out: list[list[np.ndarray]] = [[] for _ in n]
    for ring, f in zip(np.split(xy, begins[1:]) if len(begins) else [], of[order][begins].tolist(), strict=True):
        if not knot[f]:
            out[f].append(np.concatenate([ring, ring[:1]]))
    return out, np.flatnonzero(knot).tolist()


def signed_areas(rings: list[np.ndarray]) -> list[float]:
    """``planar.signed_area`` of each closed ring, those of equal length together."""
    size, out = np.array([len(r) for r in rings]), np.zeros(len(rings))
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        xy = np.stack([rings[i] for i in rows])
        c = xy - xy[:, :1]
        x, y = np.ascontiguousarray(c[:, :, 0]), np.ascontiguousarray(c[:, :, 1])
        out[rows] = (x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y).sum(axis=1) / 2
    return out.tolist()


def areas_of(rings: list[np.ndarray]) -> list[tuple[bytes, float] | None]:
    """(MultiPolygon WKB, area) of each closed ring that runs counter-clockwise; None for others."""
    return [(area_head(len(r)) + r.astype("<f8").tobytes(), a) if a > 0 else None for r, a in zip(rings, signed_areas(rings), strict=True)]


def union_areas(shapes: pa.ListArray) -> list[float]:
    """``planar.union_area`` of the geometries of each row. Single upright rectangles, which boxes and tiles are, are measured side by side."""
    n, flat = np.asarray(shapes.value_lengths()), shapes.flatten()
    first, out = np.cumsum(n) - n, np.full(len(n), np.nan)
    row_of = np.full(len(flat), -1)
    row_of[first[n == 1]] = np.flatnonzero(n == 1)
    for rows, xy in groups(flat):
        if xy.shape[1] != 5:
            continue
        same = xy[:, :-1] == xy[:, 1:]  # sides along an axis share the other coordinate
        turns = (same[:, :, 0] == ~same[:, :, 1]).all(axis=1) & (same[:, :-1, 0] != same[:, 1:, 0]).all(axis=1)
        wide = xy.max(axis=1) - xy.min(axis=1)
        fine = turns & (xy[:, 0] == xy[:, 4]).all(axis=1) & np.isfinite(xy).all(axis=(1, 2)) & (row_of[rows] >= 0)
        out[row_of[rows[fine]]] = wide[fine, 1] * wide[fine, 0]
    for i in np.flatnonzero(np.isnan(out)).tolist():
        out[i] = planar.union_area([wkb.decode(g)[0] for g in flat[first[i] : first[i] + n[i]].to_pylist()])
    return out.tolist()
